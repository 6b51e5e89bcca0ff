"""Queries of catalog, changes, typed rows, ingest, exports and end-to-end retrieval, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import registered
from ..functions import text as X
from ..operators import chunk, context, html, lexical, vector
from ..operators.text_index import TextIndex
from ..sources import collections as C
from ..sources import generated
from ..sources import tables as S
from ..sources.shared import scratch
from .lexical_queries import _BM25, docs, hits
from .vector_queries import _E, asked, emb

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def take(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return take


def t(spark, sf, name, *columns):
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return df.select(*[F.col(c).cast("timestamp").alias(c) if k == "timestamp_ntz" else F.col(c) for c, k in df.dtypes])


SMALL = ("region", "nation", "supplier", "customer")


def _files(spark, sf):
    """Documents as files of four kinds: their own text, or JSON with and without a field for it."""
    k, body = F.col("doc_id"), F.coalesce("text", F.lit(""))
    path = F.concat(F.lit("/in/"), k.cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".txt", ".MD", ".json", ".exe")]), (k % 4).cast("int") + 1))
    raw = F.when(k % 4 == 2, F.when(k % 8 == 2, F.to_json(F.struct(body.alias("content")))).otherwise(F.to_json(F.struct(k.alias("key"))))).otherwise(body)
    return docs(spark, sf).select(path.alias("path"), F.encode(raw, "UTF-8").alias("content"))


@query("s2_loaded", "SELECT '/in/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' ELSE '.json' END AS path, CASE doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' ELSE 'json' END AS extension, md5(CASE WHEN doc_id % 8 = 6 THEN '{\"key\":' || doc_id || '}' ELSE coalesce(text, '') END) AS body FROM documents WHERE doc_id % 4 < 3")
def s2(spark, sf):
    return C.loaded(_files(spark, sf)).select("path", "extension", F.md5("text").alias("body"))


@query("s2_pages")
def s2_pages(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet").select(F.concat("url", F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return C.loaded(p)


@query("s3_processed")
def s3_processed(spark, sf):
    return C.processed(_files(spark, sf))


@query("s17_listed", "SELECT doc_id::VARCHAR AS doc_id, coalesce(source, 'unknown') AS filename, ceil(length(text) / 400)::BIGINT AS chunks, length(text) AS characters FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s17_listed(spark, sf):
    """Chunks of 400 characters, listed by document after some documents were deleted."""
    c = docs(spark, sf).where("length(text) > 0").select("doc_id", F.coalesce("source", F.lit("unknown")).alias("filename"), "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 400).cast("int"))).alias("i"))
    c = c.select("doc_id", F.col("doc_id").cast("string").alias("document"), "filename", F.substring("text", F.col("i") * 400 + 1, 400).alias("piece"))
    kept = c.join(t(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    return kept.groupBy(F.col("document").alias("doc_id")).agg(F.max("filename").alias("filename"), F.count("*").alias("chunks"), F.sum(F.length("piece")).cast("long").alias("characters"))


_NUMBER = "('0x' || substr(md5(i || '/{}'), 1, 4))::BIGINT"


@query("s19_generated", f"""WITH r AS (SELECT unnest(range(0, 2000)) AS i), n AS (SELECT i, {_NUMBER.format('a')} AS a, {_NUMBER.format('i')} AS m, {_NUMBER.format('d')} AS d, {_NUMBER.format('w')} AS w, {_NUMBER.format('s')} AS s FROM r)
 SELECT i AS id, 'Notes on ' || ['storage', 'search', 'streams', 'models', 'security'][(i % 5 + 1)::INTEGER] || ' ' || i AS title, ['storage', 'search', 'streams', 'models', 'security'][(i % 5 + 1)::INTEGER] AS category, ['Ada', 'Ben', 'Cho', 'Dee'][(a % 4 + 1)::INTEGER] AS author, m % 10 + 1 AS importance,
 strftime(DATE '2024-01-01' + (d % 366)::INTEGER, '%Y-%m-%d') AS day, array_to_string(list_transform(range(1, 41), lambda j: ['table', 'index', 'query', 'node', 'batch', 'field', 'cache', 'block', 'merge', 'graph', 'score', 'token', 'shard', 'cloud', 'event', 'frame'][((w + j * s) % 16 + 1)::INTEGER]), ' ') AS text FROM n""")
def s19(spark, sf):
    return generated.documents(spark, 2000).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("s4_json_strings", "SELECT conv_id * 1000 + turn AS key, 'body.parts[0]' AS path, md5(text) AS value FROM conversations WHERE length(text) > 10")
def s4(spark, sf):
    body = F.to_json(F.struct(F.col("role"), F.struct(F.array("text", "role").alias("parts"), F.col("turn").alias("n")).alias("body")))
    c = t(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), body.alias("j"))
    return C.json_strings(c, "key", "j").select("key", "path", F.md5("value").alias("value"))


@query("s6_sample_fallback", "SELECT doc_id, md5(CASE WHEN length(coalesce(text, '')) < 2000 THEN 'sample' ELSE text END) AS body FROM documents")
def s6(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(S.sample_where_short(F.col("text"), "sample")).alias("body"))


@query("s10_session_json", "SELECT conv_id, '[' || string_agg('{\"turn\":' || turn || ',\"role\":\"' || role || '\"}', ',' ORDER BY turn) || ']' AS history FROM conversations GROUP BY conv_id")
def s10(spark, sf):
    return S.histories(t(spark, sf, "conversations", "conv_id", "turn", "role"), "conv_id", "turn", ["turn", "role"])


@query("z23_history_export", "SELECT user_id, '[' || string_agg('{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}', ',' ORDER BY event_id) || ']' AS history FROM events GROUP BY user_id")
def z23(spark, sf):
    return S.histories(t(spark, sf, "events", "user_id", "event_id", "event_type"), "user_id", "event_id", ["event_id", "event_type"])


@query("s11_catalog", "SELECT c.i::INTEGER AS place, 'nation' AS \"table\", c.c AS \"column\", c.t AS type FROM (VALUES (1, 'n_nationkey', 'int'), (2, 'n_name', 'string'), (3, 'n_regionkey', 'int')) c(i, c, t) UNION ALL SELECT c.i, 'region', c.c, c.t FROM (VALUES (1, 'r_regionkey', 'int'), (2, 'r_name', 'string')) c(i, c, t)")
def s11(spark, sf):
    return S.catalog({n: t(spark, sf, n) for n in ("nation", "region")})


@query("s11_samples", """SELECT 'nation' AS "table", row_number() OVER (ORDER BY n_nationkey)::INTEGER AS place, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS "row" FROM nation QUALIFY place <= 3
 UNION ALL SELECT 'orders', row_number() OVER (ORDER BY o_orderkey)::INTEGER AS place, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' FROM orders QUALIFY place <= 3""")
def s11_samples(spark, sf):
    """Three rows of each table."""
    return S.samples({"nation": (t(spark, sf, "nation"), "n_nationkey"), "orders": (t(spark, sf, "orders", "o_orderkey", "o_orderstatus"), "o_orderkey")})


@query("s9_files", "SELECT 'csv' AS kind, o_orderkey, o_orderpriority, o_totalprice FROM orders UNION ALL SELECT 'json', o_orderkey, o_orderpriority, o_totalprice FROM orders")
def s9_files(spark, sf):
    """A table written as csv and as json files, read back."""
    o = t(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    both = [S.exported(o, scratch(spark, "export"), kind).withColumn("kind", F.lit(kind)) for kind in ("csv", "json")]
    return both[0].unionByName(both[1]).select("kind", *o.columns)


def _stored(spark, sf) -> C.Collections:
    """Three collections of documents as chunks of 400 characters: by language, changed, cleared and made anew."""
    c = C.Collections(spark, scratch(spark, "collections"))
    d = docs(spark, sf).where("length(text) > 0").select("doc_id", "lang", "source", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 400).cast("int"))).alias("i"))
    m = F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("filename"), F.coalesce("source", F.lit("unknown")))
    rows = d.select("doc_id", "lang", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("id"), F.substring("text", F.col("i") * 400 + 1, 400).alias("text"), F.array(F.lit(1.0)).alias("embedding"), m.alias("metadata"))
    for name, metric in (("en", "cosine"), ("rest", "l2"), ("old", "ip")):
        c.create(name, metric)
    c.add("en", rows.where("lang = 'en'"))
    c.add("rest", rows.where("lang IS NULL OR lang <> 'en'"))
    c.add("old", rows.where("lang = 'de'"))
    c.add("en", rows.where("lang = 'en' AND doc_id % 3 = 0").withColumn("text", F.lit("")))  # known ones are passed over
    c.add("en", rows.where("lang = 'en' AND doc_id % 5 = 0").withColumn("text", F.lit("new")), skip_known=False)
    c.delete("rest", rows.where("doc_id % 4 = 0").select("id"))
    c.create("old", "l2", reset=True)
    c.update_metric("rest", "ip")
    return c


_CHUNKS = "k AS (SELECT doc_id, lang, coalesce(source, 'unknown') AS source, unnest(range(0, (length(text) + 399) // 400)) AS i, text FROM documents WHERE length(text) > 0)"


@query("s12_collections", f"WITH {_CHUNKS} SELECT 'en' AS name, 'cosine' AS metric, count(*) AS rows, 'active' AS state FROM k WHERE lang = 'en' UNION ALL SELECT 'rest', 'ip', count(*), 'active' FROM k WHERE (lang IS NULL OR lang <> 'en') AND doc_id % 4 > 0 UNION ALL SELECT 'old', 'l2', 0, 'empty'")
def s12(spark, sf):
    """Collections made, filled, changed, made anew and listed."""
    return _stored(spark, sf).stats()


@query("s17_collection_documents", f"WITH {_CHUNKS} SELECT doc_id::VARCHAR AS doc_id, any_value(source) AS filename, count(*) AS chunks, sum(CASE WHEN doc_id % 5 = 0 THEN 3 ELSE length(substr(text, i * 400 + 1, 400)) END)::BIGINT AS characters FROM k WHERE lang = 'en' GROUP BY doc_id")
def s17_collection(spark, sf):
    """The documents of a stored collection after some of its rows were replaced, and after it was compacted."""
    c = _stored(spark, sf)
    c.compact("en")
    return c.documents("en")


@query("z22_footprint")
def z22(spark, sf):
    """name, files, bytes of each collection that is stored."""
    c = _stored(spark, sf)
    return spark.createDataFrame([(n, *c.footprint(n)) for n in c.names()], "name string, files long, bytes long")


@query("z24_settings", f"WITH {_CHUNKS} SELECT id, metric FROM (SELECT doc_id || '_' || i AS id, 'ip' AS metric FROM k WHERE lang IS NULL OR lang <> 'en') WHERE split_part(id, '_', 1)::BIGINT % 4 > 0")
def z24_settings(spark, sf):
    """A collection's rows under its new settings."""
    c = _stored(spark, sf)
    return c.get("rest").select("id", F.lit(c.metric("rest")).alias("metric"))


@query("s8_feedback", "SELECT CASE WHEN value > 80 THEN 'good' WHEN value > 20 THEN 'fair' ELSE 'bad' END AS rating, count(*) AS n, max(event_id) AS last_id FROM events WHERE event_type <> 'error' GROUP BY ALL")
def s8(spark, sf):
    """Feedback added in two batches and read back."""
    path, e = scratch(spark, "feedback"), t(spark, sf, "events", "event_id", "event_type", "value").where("event_type <> 'error'")
    rating = F.when(F.col("value") > 80, "good").when(F.col("value") > 20, "fair").otherwise("bad")
    for even in (0, 1):
        C.append_feedback(e.where(F.col("event_id") % 2 == even).select("event_id", rating.alias("rating")), path)
    return spark.read.schema("event_id long, rating string").json(path).groupBy("rating").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("z5_uploaded", "SELECT '/in/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' ELSE '.json' END AS path, md5(CASE WHEN doc_id % 8 = 6 THEN '{' || chr(10) || '  \"key\": ' || doc_id || chr(10) || '}' ELSE coalesce(text, '') END) AS body FROM documents WHERE doc_id % 4 < 3")
def z5(spark, sf):
    """Uploads: JSON without a content of its own is laid out."""
    return C.loaded(_files(spark, sf), pretty=True).select("path", F.md5("text").alias("body"))


@query("m13_page_files", "SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM pages) AS written, (SELECT count(DISTINCT url) FROM pages) AS urls")
def m13(spark, sf):
    """Pages written as JSON, a row for each with its parts and blocks, and counted where they are read again."""
    p = spark.read.parquet(f"{sf}/pages.parquet")
    got = html.structured(p.select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"), "url"), scratch(spark, "pages"))
    return p.agg(F.count("*").alias("pages")).crossJoin(got.agg(F.count("*").alias("written"), F.count_distinct("url").alias("urls")))  # one row each


@query("z3_row_counts", " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n, CASE WHEN count(*) > 0 THEN 'active' ELSE 'empty' END AS state FROM {n}" for n in SMALL))
def z3(spark, sf):
    return S.row_counts({n: t(spark, sf, n) for n in SMALL})


@query("s13_changes", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 2 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT -1 - c_custkey, 0.0::DOUBLE FROM customer WHERE c_custkey % 11 = 0")
def s13(spark, sf):
    c = t(spark, sf, "customer", "c_custkey", "c_acctbal")
    change = lambda rows, balance, gone, at: rows.select("c_custkey", balance.alias("c_acctbal"), F.lit(gone).alias("deleted"), F.lit(at).alias("at"))
    old = change(c.where("c_custkey % 7 = 0"), F.col("c_acctbal") + 1, False, 1)
    new = change(c.where("c_custkey % 7 = 0"), F.col("c_acctbal") + 2, False, 2)
    gone = change(c.where("c_custkey % 5 = 0"), F.col("c_acctbal"), True, 3)
    added = change(c.where("c_custkey % 11 = 0").select((-1 - F.col("c_custkey")).alias("c_custkey"), "c_acctbal"), F.lit(0.0), False, 1)
    return S.changed(c, old.unionByName(new).unionByName(gone).unionByName(added), "c_custkey")


@query("s14_batches", "SELECT doc_id // 100 AS batch, count(*) FILTER (WHERE length(text) >= 200) AS success, count(*) FILTER (WHERE text IS NULL OR length(text) < 200) AS failed, coalesce(sum(CASE WHEN length(text) >= 200 THEN ceil(length(text) / 500) END), 0)::BIGINT AS chunks FROM documents GROUP BY ALL")
def s14(spark, sf):
    n = F.length("text")
    return S.batch_counters(docs(spark, sf), F.floor(F.col("doc_id") / 100), n >= 200, F.ceil(n / 500))


@query("s17_documents", "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, sum(length(text))::BIGINT AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source")
def s17(spark, sf):
    kept = docs(spark, sf).join(t(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_anti")
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("s18_directories", "SELECT '/docs/' || lang AS folder, count(*) AS files, sum(strlen(text))::BIGINT AS size FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def s18(spark, sf):
    d = docs(spark, sf).where("lang IS NOT NULL")
    p = F.concat(F.lit("/docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    other = F.concat(F.lit("/docs2/"), "lang", F.lit("/x"))
    files = d.select(p.alias("path"), F.octet_length("text").alias("size")).unionByName(d.select(other.alias("path"), F.octet_length("text").alias("size")))
    return S.directory(files, "docs")


@query("t4_ratio", "SELECT doc_id, round(CASE WHEN length(text) > 0 THEN (length(text) // 4) / length(text) ELSE 0 END, 6) AS ratio FROM documents WHERE text IS NOT NULL")
def t4b(spark, sf):
    return docs(spark, sf).where("text IS NOT NULL").select("doc_id", F.round(X.token_ratio(F.col("text")), 6).alias("ratio"))


_W = "regexp_extract_all(lower(text), '[가-힣a-zA-Z0-9]+')"


@query("v1_hashed_vectors", f"WITH w AS (SELECT doc_id, unnest({_W}) AS term FROM documents), c AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 2))::INTEGER % 32 AS cell, count(*) AS n FROM w GROUP BY ALL) SELECT doc_id, cell, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c")
def v1(spark, sf):
    return lexical.hashed_vectors(docs(spark, sf), "doc_id", "text", 32).select("doc_id", F.posexplode("embedding").alias("cell", "weight")).where("weight > 0").withColumn("weight", F.round("weight", 6))


@query("k5_semantic", f"WITH {_E}, s AS (SELECT query_id, vec_id, round(list_cosine_similarity(qv, v), 4) AS c FROM q CROSS JOIN e), r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id))::INTEGER AS rank FROM s) SELECT query_id, vec_id, rank, round(greatest(0, 1 - (1 - c)), 4) AS score FROM r WHERE rank <= 5")
def k5(spark, sf):
    found = vector.knn(asked(spark, sf), emb(spark, sf), 5)
    return found.select("query_id", "vec_id", "rank", F.round(F.greatest(F.lit(0.0), 1 - (1 - F.col("score"))), 4).alias("score"))


@query("z1_indexed", "SELECT doc_id, length(text) AS n_chars, length(text) // 4 AS n_tokens, doc_id // 32 AS batch FROM documents")
def z1(spark, sf):
    return docs(spark, sf).select("doc_id", F.length("text").cast("long").alias("n_chars"), X.token_estimate(F.col("text")).alias("n_tokens"), F.floor(F.col("doc_id") / 32).alias("batch"))


@query("z1_built", f"SELECT doc_id, len({_W})::INTEGER AS words, len(list_distinct({_W}))::INTEGER AS terms, (doc_id % 3)::INTEGER AS segment FROM documents")
def z1_built(spark, sf):
    """What an index built in three batches knows of its documents."""
    index = TextIndex(spark, scratch(spark, "built"))
    for i in range(3):
        index.add(docs(spark, sf).where(F.col("doc_id") % 3 == i))
    return index.documents().withColumnRenamed("key", "doc_id")


_LETTERS = "aeinorst"


@query("u2_own_vectors", f"""WITH q AS (SELECT item_id AS query_id, {{}} AS qv FROM benchmark), d AS (SELECT doc_id, {{}} AS v FROM documents),
 s AS (SELECT query_id, doc_id, CASE WHEN list_dot_product(qv, qv) * list_dot_product(v, v) > 0 THEN round(list_cosine_similarity(qv, v), 4) ELSE 0 END AS score FROM q CROSS JOIN d)
 SELECT query_id, doc_id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s) WHERE rank <= 5""".replace("{}", "[" + ", ".join(f"(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{c}', '')))::DOUBLE" for c in _LETTERS) + "]"))
def u2(spark, sf):
    """Search by an embedding of one's own: how often a text has each of some letters."""
    count = lambda t, c: (F.length(t) - F.length(F.replace(t, F.lit(c)))).cast("double")

    def embed(df, key, text):
        t = F.coalesce(text, F.lit(""))
        return df.select(key, F.array(*[count(t, c) for c in _LETTERS]).alias("embedding"))

    q = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return vector.text_search(q, docs(spark, sf), embed, 5)


@query("z2_typed", """SELECT 'knowledge_' || doc_id AS id, md5(substr(text, 1, 500)) AS body, coalesce(lang, 'general') AS category, '["' || source || '"]' AS tags FROM documents WHERE source IS NOT NULL
 UNION ALL SELECT 'conversations_' || (conv_id * 1000 + turn), md5(substr(text, 1, 500)), role, '[]' FROM conversations UNION ALL SELECT 'intents_' || item_id, md5(substr(text, 1, 500)), 'general', '["benchmark"]' FROM benchmark
 UNION ALL SELECT 'apis_' || event_id, md5(substr(props, 1, 500)), event_type, '["' || event_type || '","event"]' FROM events""")
def z2(spark, sf):
    d, c, none = docs(spark, sf).where("source IS NOT NULL"), t(spark, sf, "conversations"), F.lit(None).cast("array<string>")
    b, e = t(spark, sf, "benchmark"), t(spark, sf, "events")
    each = [
        ("category", S.typed(d, "knowledge", F.col("doc_id"), F.col("text"), F.col("lang"), F.array("source"))),
        ("role", S.typed(c, "conversations", F.col("conv_id") * 1000 + F.col("turn"), F.col("text"), F.col("role"), none)),
        ("intent", S.typed(b, "intents", F.col("item_id"), F.col("text"), F.lit(None).cast("string"), F.array(F.lit("benchmark")))),
        ("endpoint", S.typed(e, "apis", F.col("event_id"), F.col("props"), F.col("event_type"), F.array("event_type", F.lit("event")))),
    ]
    out = [x.select("id", F.md5("text").alias("body"), F.col("metadata")[field].alias("category"), F.col("metadata")["tags"].alias("tags")) for field, x in each]
    return reduce(DataFrame.unionByName, out)


@query("z4_json_content", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'kept ' || event_id WHEN 1 THEN '{broken' ELSE props END AS body FROM events")
def z4(spark, sf):
    k = F.col("event_id")
    raw = F.when(k % 3 == 0, F.to_json(F.struct(F.concat(F.lit("kept "), k.cast("string")).alias("content")))).when(k % 3 == 1, "{broken").otherwise(F.col("props"))
    return t(spark, sf, "events").select("event_id", S.content_of(raw).alias("body"))


@query("z7_split_ingest")
def z7(spark, sf):
    """Chunks of the recursive splitter as rows to be added: id, source, place, number of chunks and size."""
    c = chunk.chunked(docs(spark, sf), lambda x: chunk.recursive(x, 1000, 200), "doc_id", "text").join(docs(spark, sf).select("doc_id", "source"), "doc_id")
    total = F.count("*").over(Window.partitionBy("doc_id"))
    return c.select(F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("chunk").cast("string")).alias("chunk_id"), "source", "chunk", total.alias("total_chunks"), F.length("content").alias("chunk_size"))


@query("z8_rag_query", f"""WITH {_BM25}, h AS (SELECT sparse.*, d.text FROM sparse JOIN documents d USING (doc_id)), c AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS e FROM h),
 k AS (SELECT query_id, doc_id, score, CASE WHEN e <= 12000 THEN length(text) WHEN 12000 - (e - length(text)) > 100 THEN 12000 - (e - length(text)) END AS n FROM c)
 SELECT query_id, count(*) AS n_sources, sum(n)::BIGINT AS n_chars, CASE WHEN max(score) / 20 >= 0.7 THEN 'high' WHEN max(score) / 20 >= 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM k WHERE n IS NOT NULL GROUP BY query_id""")
def z8(spark, sf):
    """Search, context within its budget, and what is said about it; the answer itself is a model's."""
    c = context.pack(hits(spark, sf), "text", 3000, 4, 100)
    g = c.groupBy("query_id").agg(F.count("*").alias("n_sources"), F.sum(F.length("content")).cast("long").alias("n_chars"), F.max("score").alias("s"))
    return g.select("query_id", "n_sources", "n_chars", context.confidence_label(F.col("s") / 20).alias("confidence"))


@query("z17_lookup", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN 20 + n_nationkey ELSE 15 END::INTEGER AS temperature, CASE WHEN n_nationkey % 2 = 0 THEN 'clear' ELSE 'unknown' END AS sky FROM nation")
def z17(spark, sf):
    n = t(spark, sf, "nation")
    known = n.where("n_nationkey % 2 = 0").select("n_nationkey", (F.col("n_nationkey") + 20).alias("temperature"), F.lit("clear").alias("sky"))
    return n.join(known, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("temperature", F.lit(15)).alias("temperature"), F.coalesce("sky", F.lit("unknown")).alias("sky"))


@query("z18_preferences", "SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id FROM events GROUP BY user_id, event_type")
def z18(spark, sf):
    return S.preferences(t(spark, sf, "events", "user_id", "event_type", "event_id", "ts"), "user_id", ["event_id"], "event_type", "event_id")


@query("z19_counters", "SELECT event_type, count(*) AS requests, count(*) FILTER (WHERE value > 50) AS good, count(*) FILTER (WHERE NOT value > 50) AS bad, round(avg(value), 4) AS mean, round(max(value), 4) AS longest FROM events GROUP BY event_type")
def z19(spark, sf):
    return S.counters(t(spark, sf, "events"), "event_type", F.col("value") > 50, "value")


@query("z24_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def z24(spark, sf):
    return S.latest(t(spark, sf, "events", "user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("u3_tools", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS clean, length(text) // 4 AS tokens, md5(CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END) AS preview FROM documents")
def u3(spark, sf):
    """The registered SQL functions, through a query in SQL."""
    registered.register(spark)
    return spark.sql("SELECT doc_id, md5(clean_spaces(text)) AS clean, token_estimate(text, 4) AS tokens, md5(text_preview(text, 200)) AS preview FROM {d}", d=docs(spark, sf))


@query("u1_chunk_function", "SELECT doc_id, count(*) AS n, sum(length(c))::BIGINT AS chars FROM (SELECT doc_id, unnest(list_transform(range(0, length(text), 400), lambda i: substr(text, i + 1, 400))) AS c FROM documents) GROUP BY doc_id")
def u1(spark, sf):
    """A chunker of one's own as a table function in SQL."""
    registered.register_chunker(spark, "loom_pieces", lambda x: ((i, min(i + 400, len(x))) for i in range(0, len(x), 400)))
    return spark.sql("SELECT d.doc_id, count(*) AS n, sum(length(c.text)) AS chars FROM {d} d, LATERAL loom_pieces(d.text) c GROUP BY d.doc_id", d=docs(spark, sf))


@query("k2_frequencies", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_W}) AS term FROM documents) GROUP BY term")
def k2_frequencies(spark, sf):
    """Document frequencies from the postings of two batches."""
    d = docs(spark, sf)
    both = [lexical.postings(d.where(F.col("source").isNotNull() & (F.col("source") < "src2")), "doc_id", "text"), lexical.postings(d.where(F.col("source").isNull() | (F.col("source") >= "src2")), "doc_id", "text")]
    return both[0].unionByName(both[1]).groupBy("term").agg(F.count("*").alias("df"))

"""Queries of text scalars, chunkers in expressions, and guardrails, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bpe, stems
from ..functions import text as X
from ..operators import chunk

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def take(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return take


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query("t1_clean", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS cleaned FROM documents")
def t1(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.clean_spaces(F.col("text"))).alias("cleaned"))


@query("t2_collapse", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), E' \n\t\r')) AS cleaned FROM documents")
def t2(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.collapse_runs(F.col("text"))).alias("cleaned"))


@query("t3_one_line", r"SELECT doc_id, md5(replace(text, E'\n', ' ')) AS line FROM documents")
def t3(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.one_line(F.col("text"))).alias("line"))


@query("t4_tokens", r"""SELECT doc_id, (length(text) // 4)::BIGINT AS by_chars, (length(text) // 2)::BIGINT AS by_half, (len(regexp_extract_all(text, '\S+')) * 13 // 10)::BIGINT AS by_words,
 round(CASE WHEN length(text) > 0 THEN (length(text) // 4) / length(text) ELSE 0 END, 6) AS ratio FROM documents""")
def t4(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", X.token_estimate(t).alias("by_chars"), X.token_estimate(t, 2).alias("by_half"), X.word_token_estimate(t).alias("by_words"), F.round(X.token_ratio(t), 6).alias("ratio"))


@query("t5_truncate", "SELECT doc_id, substr(text, 1, 400) AS head FROM documents")
def t5(spark, sf):
    return docs(spark, sf).select("doc_id", X.truncate_tokens(F.col("text"), 100).alias("head"))


@query("t4_bpe_tokens")
def t4_bpe(spark, sf):
    return bpe.with_tokens(docs(spark, sf).select("doc_id", "text"), "text").select("doc_id", "tokens")


@query("t5_bpe_truncate")
def t5_bpe(spark, sf):
    return bpe.truncated(docs(spark, sf).select("doc_id", "text"), "text", 100).select("doc_id", F.md5("cut").alias("cut"), F.length("cut").alias("n_chars"))


@query("t6_terms", f"SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '' AND x NOT IN ({_in(X.ENGLISH_STOPS)})), ' ') AS terms FROM documents")
def t6(spark, sf):
    return docs(spark, sf).select("doc_id", F.concat_ws(" ", X.plain_terms(F.col("text"))).alias("terms"))


@query("t6_stems")
def t6_stems(spark, sf):
    """lang, stem, forms, n: words of each language by their stems. Words are counted first, and each different one is taken to its stem once."""
    words = docs(spark, sf).select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+"), F.lit(0))).alias("w"))
    counted = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    own = counted.select("lang", stems.stems(F.array("w"), F.col("lang"))[0].alias("stem"), "n")
    return own.groupBy("lang", "stem").agg(F.count("*").alias("forms"), F.sum("n").alias("n"))


_KEYWORDS = f"list_filter(regexp_extract_all(text, '[가-힣a-zA-Z0-9]+'), lambda x: length(x) > 1 AND lower(x) NOT IN ({_in(X.ENGLISH_STOPS)}))"


@query("t7_keywords", f"SELECT doc_id, len({_KEYWORDS})::INTEGER AS n, md5(array_to_string({_KEYWORDS}, ' ')) AS keywords FROM documents")
def t7(spark, sf):
    k = X.regex_keywords(F.col("text"))
    return docs(spark, sf).select("doc_id", F.size(k).alias("n"), F.md5(F.concat_ws(" ", k)).alias("keywords"))


@query("t8_split_keywords", rf"SELECT item_id, array_to_string(list_filter(regexp_extract_all(text, '\S+'), lambda x: length(x) > 1 AND x NOT IN ({_in(X.SPLIT_STOPS)})), ' ') AS keywords FROM benchmark")
def t8(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.concat_ws(" ", X.split_keywords(F.col("text"))).alias("keywords"))


_PARTICLES = "|".join(p for p in sorted(X.PARTICLES, key=len, reverse=True) if "?" not in p)
_WITH_KOREAN = "concat(text, CASE item_id % 4 WHEN 0 THEN ' 검색은 무엇인가? 문서에서' WHEN 1 THEN ' 은 는 데이터베이스와 색인을' WHEN 2 THEN ' 임베딩이란, 벡터로 하는' ELSE '' END)"


@query("t9_korean_terms", rf"""SELECT item_id, array_to_string(list_transform(regexp_extract_all(regexp_replace(lower({_WITH_KOREAN}), '[^a-zA-Z0-9_ \t\n\x0B\f\r가-힣]', ' ', 'g'), '[^ \t\n\x0B\f\r]+'), lambda w: regexp_replace(w, '^(.+?)(?:{_PARTICLES})$', '\1')), ' ') AS terms FROM benchmark""")
def t9(spark, sf):
    """Whole texts, some with Korean words and particles after them."""
    return table(spark, sf, "benchmark").select("item_id", F.expr(_WITH_KOREAN).alias("text")).select("item_id", F.concat_ws(" ", X.korean_terms(F.col("text"))).alias("terms"))


@query("t10_query_terms", r"SELECT item_id, regexp_replace(trim(text), '\?$', '') AS q FROM benchmark")
def t10(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.query_terms(F.col("text")).alias("q"))


@query("t11_expand", rf"""SELECT DISTINCT item_id, unnest([text, array_to_string(list_filter(regexp_extract_all(text, '\S+'), lambda x: length(x) > 1 AND x NOT IN ({_in(X.SPLIT_STOPS)})), ' ')]) AS q FROM benchmark""")
def t11(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.explode(X.expanded(F.col("text"))).alias("q"))


SYNONYMS = {"the": ["this", "that"], "on": ["upon", "above"]}


@query("t12_synonyms", """SELECT DISTINCT item_id, q FROM (SELECT item_id, text AS q FROM benchmark
 UNION ALL SELECT item_id, unnest([replace(text, 'the', 'this'), replace(text, 'the', 'that')]) FROM benchmark WHERE contains(lower(text), 'the')
 UNION ALL SELECT item_id, unnest([replace(text, 'on', 'upon'), replace(text, 'on', 'above')]) FROM benchmark WHERE contains(lower(text), 'on'))""")
def t12(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.explode(X.with_synonyms(F.col("text"), SYNONYMS)).alias("q"))


@query("t13_rewrite", f"""SELECT item_id, concat_ws(' ', text, array_to_string({_KEYWORDS}, ' ')) AS longer, array_to_string(list_slice(list_filter({_KEYWORDS}, lambda x: length(x) > 2), 1, 3), ' ') AS shorter FROM benchmark""")
def t13(spark, sf):
    t = F.col("text")
    return table(spark, sf, "benchmark").select("item_id", X.rewritten(t, "expand").alias("longer"), X.rewritten(t, "simplify").alias("shorter"))


@query("t15_sub_queries", "SELECT item_id, unnest(['part ' || item_id, 'rest ' || length(text)]) AS sub FROM benchmark")
def t15(spark, sf):
    t = F.concat(F.lit("so:\n1. part "), F.col("item_id").cast("string"), F.lit("\nno\n- rest "), F.length("text").cast("string"))
    return table(spark, sf, "benchmark").select("item_id", F.explode(X.sub_queries(t)).alias("sub"))


@query("c1_word_chunks", r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents),
 s AS (SELECT doc_id, w, unnest(range(0, len(w), 40)) AS i FROM w WHERE len(w) > 0)
 SELECT doc_id, (i // 40)::INTEGER AS chunk, array_to_string(list_slice(w, i + 1, i + 50), ' ') AS content FROM s WHERE i = 0 OR i + 10 < len(w)""")
def c1(spark, sf):
    return chunk.word_chunks(docs(spark, sf), "doc_id", "text", 50, 10)


@query("c7_sentence_chunks", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', E'\\1\x01', 'g'), E'\x01'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
 i AS (SELECT doc_id, s, unnest(range(0, len(s), 5)) AS i FROM s WHERE len(s) > 0)
 SELECT doc_id, (i // 5)::INTEGER AS chunk, md5(array_to_string(list_slice(s, i + 1, i + 5), ' ')) AS content FROM i""")
def c7(spark, sf):
    return chunk.sentence_chunks(docs(spark, sf), "doc_id", "text", 5).withColumn("content", F.md5("content"))


@query("c10_chunk_rows", r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents),
 s AS (SELECT doc_id, w, unnest(range(0, len(w), 40)) AS i FROM w WHERE len(w) > 0),
 k AS (SELECT doc_id, i // 40 AS chunk, array_to_string(list_slice(w, i + 1, i + 50), ' ') AS content FROM s WHERE i = 0 OR i + 10 < len(w))
 SELECT doc_id || '_chunk_' || chunk AS chunk_id, doc_id AS parent, chunk::INTEGER AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::INTEGER AS total_chunks, length(content)::INTEGER AS chunk_size FROM k""")
def c10(spark, sf):
    return chunk.enriched(chunk.word_chunk_arrays(docs(spark, sf), "text", 50, 10), "doc_id")


def _sliding(size: int, overlap: int, cut: str) -> str:
    """Chunks one after the other: cut is where a chunk that begins at {a} ends, null for its full size."""
    end = lambda a: f"CASE WHEN {a} + {size} >= n THEN n ELSE greatest({a} + 1, least(n, coalesce({cut.replace('{a}', a)}, {a} + {size}))) END"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
 r AS (SELECT doc_id, 0::BIGINT AS chunk, 0::BIGINT AS a, ({end('0')})::BIGINT AS b FROM d
  UNION ALL SELECT doc_id, chunk + 1, a2, ({end('a2')})::BIGINT FROM (SELECT doc_id, chunk, greatest(a + 1, b - {overlap}) AS a2, text, n FROM r JOIN d USING (doc_id) WHERE b < n))
 SELECT doc_id, chunk::INTEGER AS chunk, a::INTEGER AS start, b::INTEGER AS "end", substr(text, a + 1, b - a) AS content FROM r JOIN d USING (doc_id)"""


def _upto(segment: str, pattern: str, before: str, least: str = "0") -> str:
    """Where the last match within a segment ends, from `before` on; null if none ends beyond `least`."""
    n = f"length(regexp_extract({segment}, '(?s)^(.*{pattern})', 1))"
    return f"CASE WHEN {n} > {least} THEN {before} + {n} END"


_HALF = "substr(text, {a} + 251, 250)"
_FAR = "substr(text, {a} + 1, 1050)"
_SLIDING = {
    "c2_sentence_end_chunks": _sliding(500, 50, _upto("substr(text, {a} + 51, 450)", "[.!?]", "{a} + 50")),
    "c3_fixed_chunks": _sliding(500, 50, _upto("substr(text, {a} + 52, 449)", "[ \\n\\t]", "{a} + 51")),
    "c5_boundary_chunks": _sliding(500, 50, "coalesce(" + ", ".join(_upto(_HALF, m, "{a} + 250") for m in ["\\n\\n", "\\.\\n", "\\. ", "\\n", " "]) + ")"),
    "c8_separators_chunks": _sliding(1000, 200, "coalesce(" + ", ".join(_upto(_FAR, m, "{a}", str(499 + n)) for m, n in [("\\n\\n", 2), ("\\n", 1), ("\\. ", 2), ("! ", 2), ("\\? ", 2), ("; ", 2), (", ", 2), (" ", 1)]) + ")"),
}
for _name, _f in (("c2_sentence_end", chunk.sentence_end), ("c3_fixed", chunk.fixed), ("c4_semantic", chunk.semantic), ("c5_boundary", chunk.boundary), ("c6_lists", chunk.list_aware), ("c8_separators", chunk.separators), ("c9_recursive", chunk.recursive)):
    query(f"{_name}_chunks", _SLIDING.get(f"{_name}_chunks"))(lambda spark, sf, f=_f: chunk.chunked(docs(spark, sf).select("doc_id", "text"), f, "doc_id", "text"))


@query("c11_structure", r"""WITH f AS (SELECT doc_id, regexp_matches(text, '(?m)^#{1,6} ') AS has_headings, regexp_matches(text, '(?m)^\s*\|.*\|') AS has_tables, regexp_matches(text, '(?m)^\s*([-*]|[0-9]+\.) ') AS has_lists,
 list_filter(string_split(text, E'\n\n'), lambda x: trim(x, E' \n\t\r') <> '') AS p FROM documents),
 a AS (SELECT *, CASE WHEN len(p) > 0 THEN list_sum(list_transform(p, lambda x: length(x))) / len(p) ELSE 0 END AS mean FROM f),
 z AS (SELECT *, CASE WHEN has_tables THEN 3000 WHEN mean < 300 THEN 2000 WHEN mean < 600 THEN 1500 ELSE 1200 END AS size FROM a)
 SELECT doc_id, has_headings, has_tables, has_lists, size::INTEGER AS chunk_size, least(500, size // 5)::INTEGER AS chunk_overlap FROM z""")
def c11(spark, sf):
    return docs(spark, sf).select("doc_id", chunk.structure(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("c12_rag_strategy", r"""WITH f AS (SELECT doc_id, len(regexp_extract_all(text, '\|[^\n]*\|')) AS tables, list_filter(string_split(text, E'\n'), lambda x: x <> '') AS l FROM documents)
 SELECT doc_id, CASE WHEN tables > 5 THEN 'table' WHEN len(l) > 0 AND list_sum(list_transform(l, lambda x: length(x))) / len(l) > 100 THEN 'semantic' ELSE 'fixed' END AS strategy FROM f""")
def c12(spark, sf):
    return docs(spark, sf).select("doc_id", chunk.strategy(F.col("text")).alias("strategy"))


_EMAIL, _PHONE, _RRN = (p.replace("\\\\", "\\") for p in (X.EMAIL, X.PHONE_KR, X.RRN_KR))


@query("p1_pii", f"""WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '{_EMAIL}'))::INTEGER AS emails, len(regexp_extract_all(text, '{_PHONE}'))::INTEGER AS phones, len(regexp_extract_all(text, '{_RRN}'))::INTEGER AS resident_numbers,
 md5(regexp_replace(regexp_replace(regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g'), '{_RRN}', '[REDACTED]', 'g'), '{_PHONE}', '[PHONE]', 'g')) AS masked FROM documents)
 SELECT doc_id, emails, phones, resident_numbers, emails + phones + resident_numbers > 0 AS has_pii, masked FROM n""")
def p1(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", X.pii(t).alias("p"), F.md5(X.masked(t)).alias("masked")).select("doc_id", "p.*", "masked")


_TERMS = "['the ', 'lorem', 'api key', 'password']"


@query("p2_phrases", f"SELECT doc_id, array_to_string(list_filter({_TERMS}, lambda p: contains(lower(text), p)), ',') AS found FROM documents")
def p2(spark, sf):
    return docs(spark, sf).select("doc_id", F.concat_ws(",", X.phrases_in(F.col("text"), ["the ", "lorem", "api key", "password"])).alias("found"))


_ALL = X.INJECTION + X.BLOCKED


@query("p3_valid_input", f"SELECT doc_id, NOT (regexp_matches(text, '{_EMAIL}') OR regexp_matches(text, '{_PHONE}') OR regexp_matches(text, '{_RRN}') OR {' OR '.join(f'contains(lower(text), {p!r})' for p in _ALL)}) AS valid FROM documents")
def p3(spark, sf):
    return docs(spark, sf).select("doc_id", X.valid_input(F.col("text")).alias("valid"))


_Y = r"list_distinct(regexp_extract_all({}, '\b(?:19|20)[0-9]{{2}}\b'))"
_PAIRS = "SELECT c.conv_id, c.turn, c.text AS answer, p.text AS context FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1"


@query("p4_output_guard", rf"""WITH p AS ({_PAIRS}), n AS (SELECT *, len(list_filter({_Y.format('answer')}, lambda y: NOT list_contains({_Y.format('context')}, y))) AS missing FROM p)
 SELECT conv_id, turn, missing::INTEGER AS new_years, missing = 0 AND NOT contains(lower(answer), 'as an ai') AS passed FROM n""")
def p4(spark, sf):
    p = answers(spark, sf)
    missing = F.size(F.array_except(X.years(F.col("answer")), X.years(F.col("context"))))
    return p.select("conv_id", "turn", missing.alias("new_years"), ((missing == 0) & (F.size(X.phrases_in(F.col("answer"), ["as an ai"])) == 0)).alias("passed"))


def answers(spark, sf):
    c = table(spark, sf, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return c.withColumnRenamed("text", "answer").join(before, ["conv_id", "turn"])


@query("e2_hallucination", rf"""WITH p AS ({_PAIRS}), n AS (SELECT *, contains(lower(answer), 'the ')::INTEGER + contains(lower(answer), 'lorem')::INTEGER + (len(list_filter({_Y.format('answer')}, lambda y: NOT list_contains({_Y.format('context')}, y))) > 0)::INTEGER AS n FROM p)
 SELECT conv_id, turn, CASE WHEN n >= 2 THEN 'high' WHEN n = 1 THEN 'medium' ELSE 'low' END AS risk FROM n""")
def e2(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", X.hallucination_risk(F.col("answer"), F.col("context"), ["the ", "lorem"]).alias("risk"))


@query("e4_citations", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all('[' || (doc_id % 7) || ']' || text || '[10][2][' || (doc_id % 7) || ']', '\[([0-9]+)\]', 1), lambda x: x::BIGINT))), ',') AS cited FROM documents")
def e4(spark, sf):
    m = F.concat(F.lit("["), (F.col("doc_id") % 7).cast("string"), F.lit("]"))
    t = F.concat(m, F.col("text"), F.lit("[10][2]"), m)
    return docs(spark, sf).select("doc_id", F.concat_ws(",", X.citations(t).cast("array<string>")).alias("cited"))


@query("s3_document_key", "SELECT doc_id, substr(md5(source || '_' || length(text)), 1, 12) AS key FROM documents")
def s3(spark, sf):
    return docs(spark, sf).select("doc_id", X.document_key(F.col("source"), F.col("text")).alias("key"))


@query("x14_preview", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def x14(spark, sf):
    return docs(spark, sf).select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("k7_snippet", """WITH p AS (SELECT doc_id, text, instr(lower(text), 'the') AS spot FROM documents), s AS (SELECT *, greatest(spot - 50, 1) AS lo, least(spot + 103, length(text) + 1) AS hi FROM p WHERE spot > 0)
 SELECT doc_id, (CASE WHEN lo > 1 THEN '...' ELSE '' END) || substr(text, lo, hi - lo) || (CASE WHEN hi <= length(text) THEN '...' ELSE '' END) AS snippet FROM s""")
def k7(spark, sf):
    return docs(spark, sf).select("doc_id", X.keyword_in_context(F.col("text"), F.lit("the")).alias("snippet")).where("snippet IS NOT NULL")

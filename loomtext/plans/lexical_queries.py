"""Queries of lexical search, fusion, reranking and context assembly: the benchmark's texts are asked against all documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import context, fusion, lexical, sampling, vector
from ..operators.learnt_vectors import TextVectors
from ..operators.pair_model import PairModel
from ..operators.summary import summarize
from ..operators.text_index import TextIndex
from ..sources.shared import scratch, stored
from .vector_queries import asked as vector_asked
from .vector_queries import emb

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def take(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return take


def docs(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")


def asked(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


_T = "regexp_extract_all(lower(text), '[가-힣a-zA-Z0-9]+')"
_BM25 = f"""w AS (SELECT doc_id, {_T} AS w FROM documents), st AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w),
 tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM w) GROUP BY ALL),
 qt AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_T}) AS term FROM benchmark) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 sc AS (SELECT query_id, doc_id, round(sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * n / mean))), 4) AS score FROM tf JOIN qt USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL),
 sparse AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM sc WHERE score > 0) WHERE rank <= 10)"""
_TFIDF = f"""tx AS MATERIALIZED (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n, {_T} AS w FROM documents), tw AS (SELECT doc_id, n, unnest(w) AS term FROM tx), ttf AS (SELECT doc_id, n, term, count(*) AS tf FROM tw WHERE n > 0 GROUP BY ALL),
 tdf AS (SELECT term, count(*) AS df FROM ttf GROUP BY term), tsc AS (SELECT query_id, doc_id, round(sum(times * tf / n * ln((SELECT docs FROM st) / df)), 6) AS score FROM ttf JOIN qt USING (term) JOIN tdf USING (term) GROUP BY ALL),
 dense AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM tsc WHERE score > 0) WHERE rank <= 10)"""
_BOTH = f"WITH {_BM25}, {_TFIDF}"


_HASHED = f"""dv AS (SELECT doc_id, cell, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM (SELECT doc_id, ('0x' || substr(md5(term), 1, 2))::INTEGER AS cell, count(*) AS n FROM (SELECT doc_id, unnest({_T}) AS term FROM documents) GROUP BY ALL)),
 qv AS (SELECT query_id, cell, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS x FROM (SELECT item_id AS query_id, ('0x' || substr(md5(term), 1, 2))::INTEGER AS cell, count(*) AS n FROM (SELECT item_id, unnest({_T}) AS term FROM benchmark) GROUP BY ALL)),
 cosines AS (SELECT query_id, doc_id, round(sum(qv.x * dv.x), 4) AS score FROM qv JOIN dv USING (cell) GROUP BY ALL)"""


def _semantic(k: int, name: str = "dense", least: float = -1) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM cosines WHERE score >= {least}) WHERE rank <= {k})"


def semantic(spark, sf, k: int = 10, least: float | None = None, text=None):
    """Cosine search over the stand-in vectors of the same texts."""
    q = text if text is not None else asked(spark, sf)
    rows = lexical.hashed_vectors(docs(spark, sf), "doc_id", "text")
    return vector.knn(lexical.hashed_vectors(q, "query_id", "text"), rows, k, key="doc_id", least=least)


def sparse(spark, sf, k: int = 10):
    return lexical.bm25(asked(spark, sf), docs(spark, sf), k)


def other(spark, sf):
    """A second ranking of the same documents to fuse with: TF-IDF."""
    return lexical.tf_idf(asked(spark, sf), docs(spark, sf), 10)


def both(spark, sf):
    """TF-IDF and BM25 from one pass over the documents."""
    return lexical.rank(asked(spark, sf), docs(spark, sf), [lexical.tf_idf_way(10), lexical.bm25_way(10)])


@query("k4_bm25_search", f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM sparse")
def k4(spark, sf):
    return sparse(spark, sf)


def _index(spark, sf) -> TextIndex:
    """A stored index, made in two batches; then every 97th document is replaced."""
    d, index = docs(spark, sf), TextIndex(spark, scratch(spark, "index"))
    index.add(d.where("doc_id % 2 = 0"))
    index.add(d.where("doc_id % 2 = 1"))
    index.update(d.where("doc_id % 97 = 5").withColumn("text", F.concat(F.lit("the river "), F.coalesce("text", F.lit("")))))
    return index


_UPDATED = _BM25.replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN 'the river ' || coalesce(text, '') ELSE text END AS text FROM documents)")


@query("w6_index_update", f"WITH {_UPDATED} SELECT query_id, doc_id, score, rank FROM sparse")
def w6(spark, sf):
    """The stored index is searched, not the documents."""
    return _index(spark, sf).search(asked(spark, sf), 10)


@query("w6_blocks_read")
def w6_blocks(spark, sf):
    """How many blocks of its terms' postings each query's search has read."""
    return _index(spark, sf).blocks_read(asked(spark, sf), 10)


@query("k3_tf_idf_search", f"{_BOTH} SELECT query_id, doc_id, score, rank FROM dense")
def k3(spark, sf):
    return other(spark, sf)


@query("k2_postings", f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_T}) AS term FROM documents) GROUP BY ALL")
def k2(spark, sf):
    return lexical.postings(docs(spark, sf), "doc_id", "text")


@query("k1_keyword_count", "SELECT * FROM (SELECT doc_id, (contains(lower(text), 'the')::INTEGER + contains(lower(text), 'der')::INTEGER + contains(lower(text), 'que')::INTEGER) AS score FROM documents) WHERE score > 0")
def k1(spark, sf):
    return lexical.keyword_count(docs(spark, sf), ["the", "der", "que"]).select("doc_id", "score")


@query("k6_field_search", "SELECT doc_id, source FROM documents WHERE (contains(lower(source), 'src1') OR contains(lower(substr(text, 1, 200)), 'the')) AND lang IN ('en', 'de')")
def k6(spark, sf):
    d = docs(spark, sf)
    hit = F.contains(F.lower("source"), F.lit("src1")) | F.contains(F.lower(F.substring("text", 1, 200)), F.lit("the"))
    return d.where(hit & F.col("lang").isin("en", "de")).select("doc_id", "source")


_N = {"max": "CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0 END", "minmax": "CASE WHEN max(score) OVER (PARTITION BY query_id) > min(score) OVER (PARTITION BY query_id) THEN (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)) ELSE 1 END"}


def _fused(weight: float, how: str, base: str = _BOTH) -> str:
    return f"""{base}, a AS (SELECT query_id, doc_id, {_N[how]} AS s FROM dense), b AS (SELECT query_id, doc_id, {_N[how]} AS s FROM sparse),
 f AS (SELECT query_id, doc_id, round({weight} * coalesce(a.s, 0) + {1 - weight:.1f} * coalesce(b.s, 0), 4) AS score FROM a FULL JOIN b USING (query_id, doc_id)),
 r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM f) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5"""


@query("f1_weighted_max", _fused(0.7, "max"))
def f1(spark, sf):
    return fusion.weighted(*both(spark, sf), 0.7, 5).select("query_id", "doc_id", "score", "rank")


_SEMANTIC = f"WITH {_BM25}, {_HASHED}, {_semantic(10)}"


@query("f1_semantic", _fused(0.7, "max", _SEMANTIC))
def f1_semantic(spark, sf):
    """The semantic side weighs 0.7; twice as many candidates as results from each side."""
    return fusion.weighted(semantic(spark, sf), sparse(spark, sf), 0.7, 5).select("query_id", "doc_id", "score", "rank")


@query("f2_weighted_half", _fused(0.5, "max"))
def f2(spark, sf):
    return fusion.weighted(*both(spark, sf), 0.5, 5).select("query_id", "doc_id", "score", "rank")


@query("f3_weighted_minmax", _fused(0.5, "minmax"))
def f3(spark, sf):
    return fusion.weighted(*both(spark, sf), 0.5, 5, "minmax").select("query_id", "doc_id", "score", "rank")


def _rrf(a: str, b: str) -> str:
    return f"""{_BOTH}, u AS (SELECT query_id, doc_id, {a} / (60 + rank) AS s FROM dense UNION ALL SELECT query_id, doc_id, {b} / (60 + rank) FROM sparse), f AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM u GROUP BY ALL),
 r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM f) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5"""


@query("f4_rrf", _rrf("1.0", "1.0"))
def f4(spark, sf):
    return fusion.rrf(both(spark, sf), 5)


@query("f5_weighted_ranks", _rrf("0.7", "0.3"))
def f5(spark, sf):
    return fusion.rrf(both(spark, sf), 5, weights=[0.7, 0.3])


@query("f6_union", f"""{_BOTH}, u AS (SELECT query_id, doc_id, max(score) AS score FROM (SELECT query_id, doc_id, score FROM dense UNION ALL SELECT query_id, doc_id, score FROM sparse) GROUP BY ALL),
 r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM u) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def f6(spark, sf):
    return fusion.best_of(both(spark, sf), 10)


def _bm25_of(queries: str, name: str, tag: str) -> str:
    """BM25 for other queries (query_id, text), over the tables of _BM25."""
    return f"""{tag}t AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_T}) AS term FROM {queries}) GROUP BY ALL),
 {tag}s AS (SELECT query_id, doc_id, round(sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * n / mean))), 4) AS score FROM tf JOIN {tag}t USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL),
 {name} AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM {tag}s WHERE score > 0) WHERE rank <= 10)"""


@query("f7_two_hops", f"""WITH {_BM25}, more AS (SELECT query_id, string_agg(substr(d.text, 1, 200), ' ' ORDER BY rank) AS t FROM sparse JOIN documents d USING (doc_id) WHERE rank <= 3 GROUP BY query_id),
 asked AS (SELECT query_id, concat_ws(' ', b.text, t) AS text FROM more JOIN benchmark b ON b.item_id = query_id), {_bm25_of('asked', 'second', 'z')},
 u AS (SELECT query_id, doc_id, max(score) AS score FROM (SELECT query_id, doc_id, score FROM sparse UNION ALL SELECT query_id, doc_id, score FROM second) GROUP BY ALL),
 r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM u) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def f7(spark, sf):
    """The second hop asks with the query and the first 200 characters of its first three results."""
    d, q = docs(spark, sf), asked(spark, sf)
    hop = lexical.bm25(q, d, 10)
    more = hop.where("rank <= 3").join(d.select("doc_id", F.substring("text", 1, 200).alias("t")), "doc_id")
    more = more.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), " ").alias("t"))
    second = q.join(more, "query_id").select("query_id", F.concat_ws(" ", "text", "t").alias("text"))
    return fusion.best_of([hop, lexical.bm25(second, d, 10)], 10)


def _keyworded(spark, sf):
    """The queries' keywords as further queries."""
    return asked(spark, sf).select("query_id", F.array_join(X.regex_keywords(F.col("text")), " ").alias("text"))


class Searches:
    """The rankings that several methods start from, each worked out once, to the greatest depth asked for, and kept: a shallower one is its head.
    Vectors are made anew for the documents found alone."""

    def __init__(self, spark, sf, k: int, keyworded: bool = False):
        self.spark, self.sf, self.k, self.keyworded, self.kept = spark, sf, k, keyworded, {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self.kept:
            self.kept[name] = stored(make(), name)
        return self.kept[name]

    def _near(self) -> DataFrame:
        """Both kinds of queries in one scan, each with its kind as part of its key."""
        kinds = [asked(self.spark, self.sf), *([_keyworded(self.spark, self.sf)] if self.keyworded else [])]
        each = [q.select(F.struct("query_id", F.lit(i).alias("kind")).alias("query_id"), "text") for i, q in enumerate(kinds)]
        found = semantic(self.spark, self.sf, 2 * self.k, text=reduce(DataFrame.unionByName, each))
        return found.select("query_id.query_id", "query_id.kind", "doc_id", "score", "rank")

    def semantic(self, k: int, least: float | None = None, kind: int = 0) -> DataFrame:
        own = self._once("near", self._near).where((F.col("kind") == kind) & (F.col("rank") <= k)).drop("kind")
        return own if least is None else own.where(F.col("score") >= least)  # the best come first, so ranks stay

    def sparse(self, k: int) -> DataFrame:
        return self._once("sparse", lambda: sparse(self.spark, self.sf, self.k)).where(F.col("rank") <= k)

    def with_vectors(self, found: DataFrame) -> DataFrame:
        def own():
            d = docs(self.spark, self.sf).join(self._once("near", self._near).where("kind = 0").select("doc_id").distinct(), "doc_id", "left_semi")
            return lexical.hashed_vectors(d, "doc_id", "text")

        return found.join(self._once("vectors", own), "doc_id")


def _compressed(s: Searches, k: int) -> DataFrame:
    """Results that are near enough, without those that repeat a better one; then their ranks."""
    return lexical.top(vector.drop_redundant(s.with_vectors(s.semantic(k, 0.3)), 0.8, key="doc_id"), "query_id", "doc_id", k)


METHODS = {
    "sparse": Searches.sparse,
    "dense": Searches.semantic,
    "hybrid": lambda s, k: fusion.weighted(s.semantic(k), s.sparse(k), 0.5, k),
    "similarity": Searches.semantic,
    "threshold": lambda s, k: s.semantic(k, 0.3),
    "ensemble": lambda s, k: fusion.rrf([s.semantic(k), s.sparse(k)], k, weights=[0.7, 0.3]),
    "multi_query": lambda s, k: fusion.best_of([s.semantic(k), s.semantic(k, kind=1)], k),
    "mmr": lambda s, k: vector.mmr(s.with_vectors(s.semantic(2 * k)), k, 0.7, key="doc_id"),
    "compression": _compressed,
}


def search(spark, sf, method: str, k: int = 5, rerank: bool = False, shared: Searches | None = None) -> DataFrame:
    """One of several methods by name. With rerank, three times as many candidates are searched for, and the pairs' scores choose among them."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    deep = 3 * k if rerank else k
    found = METHODS[method](shared or Searches(spark, sf, deep, method == "multi_query"), deep)
    if rerank:
        q = asked(spark, sf).withColumnRenamed("text", "query_text")
        found = fusion.rerank_by_pairs(found.join(docs(spark, sf).select("doc_id", "text"), "doc_id").join(q, "query_id"), "query_text", "text", k)
    return found.where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def _all(spark, sf, methods: tuple[str, ...]) -> DataFrame:
    shared = Searches(spark, sf, 5, "multi_query" in methods)
    return reduce(DataFrame.unionByName, [search(spark, sf, m, shared=shared).select(F.lit(m).alias("method"), "*") for m in methods])


_EACH = f"""WITH {_BM25}, {_HASHED}, {_semantic(5)}, {_semantic(5, 'near', 0.3)}, s5 AS (SELECT * FROM sparse WHERE rank <= 5),
 ha AS (SELECT query_id, doc_id, {_N['max']} AS s FROM dense), hb AS (SELECT query_id, doc_id, {_N['max']} AS s FROM s5),
 hf AS (SELECT query_id, doc_id, round(0.5 * coalesce(ha.s, 0) + 0.5 * coalesce(hb.s, 0), 4) AS score FROM ha FULL JOIN hb USING (query_id, doc_id)),
 eu AS (SELECT query_id, doc_id, 0.7 / (60 + rank) AS s FROM dense UNION ALL SELECT query_id, doc_id, 0.3 / (60 + rank) FROM s5), ef AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM eu GROUP BY ALL),
 hybrid AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM hf) WHERE rank <= 5),
 ensemble AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM ef) WHERE rank <= 5)"""
_AS = lambda m, table: f"SELECT '{m}' AS method, query_id, doc_id, score, rank FROM {table}"


@query("f8_dispatch", f"{_EACH} {' UNION ALL '.join(_AS(m, t) for m, t in (('sparse', 's5'), ('dense', 'dense'), ('hybrid', 'hybrid')))}")
def f8(spark, sf):
    return _all(spark, sf, ("sparse", "dense", "hybrid"))


@query("z6_methods", f"{_EACH}, u AS ({' UNION ALL '.join(_AS(m, t) for m, t in (('similarity', 'dense'), ('threshold', 'near'), ('ensemble', 'ensemble')))}) SELECT method, query_id, count(*) AS n, max(rank)::INTEGER AS deepest, max(score) AS best FROM u GROUP BY method, query_id")
def z6(spark, sf):
    """What the methods of one search interface find; those without SQL are z6_chosen."""
    return _all(spark, sf, ("similarity", "threshold", "ensemble")).groupBy("method", "query_id").agg(F.count("*").alias("n"), F.max("rank").alias("deepest"), F.max("score").alias("best"))


@query("z6_chosen")
def z6_chosen(spark, sf):
    return _all(spark, sf, ("mmr", "multi_query", "compression"))


@query("f9_metadata_score", f"""WITH {_BM25} SELECT query_id, sparse.doc_id, round(least(1.0, (CASE WHEN len(list_filter({_T.replace('text', 'b.text')}, w -> contains(lower(source), w))) > 0 THEN 0.3 ELSE 0 END)
 + 0.2 * greatest(0, 1 - (DATE '2025-01-01' - (DATE '2024-01-01' + (sparse.doc_id % 366)::INTEGER)) / 365.0) + (CASE WHEN len(regexp_extract_all(d.text, '\\S+')) BETWEEN 50 AND 500 THEN 0.1 ELSE 0 END)), 4) AS meta FROM sparse JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id""".replace("w -> ", "lambda w: "))
def f9(spark, sf):
    r = hits(spark, sf)
    day = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod("doc_id", F.lit(366)).cast("int"))
    s = fusion.metadata_score(F.col("query_text"), F.col("source"), day, F.size(X.words(F.col("text"))), F.to_date(F.lit("2025-01-01")))
    return r.select("query_id", "doc_id", F.round(s, 4).alias("meta"))


def hits(spark, sf) -> DataFrame:
    """Results with their texts and the query's."""
    q = asked(spark, sf).withColumnRenamed("text", "query_text")
    return sparse(spark, sf).join(docs(spark, sf), "doc_id").join(q, "query_id")


_H = f"WITH {_BM25}, h AS (SELECT sparse.*, d.text, d.source, d.lang, b.text AS query_text FROM sparse JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id)"
_J = f"""(CASE WHEN len(list_distinct({_T} || {_T.replace('text', 'query_text')})) > 0 THEN len(list_intersect(list_distinct({_T}), list_distinct({_T.replace('text', 'query_text')}))) / len(list_distinct({_T} || {_T.replace('text', 'query_text')})) ELSE 0 END)"""


@query("rr1_overlap", f"{_H}, s AS (SELECT query_id, doc_id, round(0.7 * score + 0.3 * {_J}, 4) AS score FROM h) SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s")
def rr1(spark, sf):
    return fusion.rerank_by_overlap(hits(spark, sf), "query_text", "text").select("query_id", "doc_id", "score", "rank")


@query("rr2_diversity", f"{_H}, s AS (SELECT *, NOT (row_number() OVER (PARTITION BY query_id, lang ORDER BY rank) = 1 OR rank <= 3) AS late FROM h) SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY late, rank))::INTEGER AS rank FROM s")
def rr2(spark, sf):
    return fusion.rerank_by_diversity(hits(spark, sf), "lang").select("query_id", "doc_id", "rank")


@query("rr3_recency", f"""WITH {_BM25}, h AS (SELECT *, CASE WHEN doc_id % 3 > 0 THEN DATE '2024-01-01' + (doc_id % 366)::INTEGER END AS day FROM sparse),
 g AS (SELECT *, count(day) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY day DESC NULLS LAST, doc_id) - 1 AS i FROM h),
 s AS (SELECT query_id, doc_id, round(score + CASE WHEN day IS NOT NULL THEN (n - i) / n * 0.1 ELSE 0 END, 4) AS score FROM g) SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s""")
def rr3(spark, sf):
    day = F.when(F.col("doc_id") % 3 > 0, F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod("doc_id", F.lit(366)).cast("int")))
    return fusion.rerank_by_recency(sparse(spark, sf).withColumn("day", day), "day").select("query_id", "doc_id", "score", "rank")


@query("rr4_pairs", f"{_H}, s AS (SELECT query_id, doc_id, score AS original, round(1 / (1 + exp(-(10 * {_J} - 5))), 4) AS score FROM h), r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s) SELECT * FROM r WHERE rank <= 5")
def rr4(spark, sf):
    return fusion.rerank_by_pairs(hits(spark, sf), "query_text", "text", 5).select("query_id", "doc_id", "original", "score", "rank")


@query("rr5_before_after", f"""{_H}, s AS (SELECT query_id, doc_id, rank, {_J} AS j, round(1 / (1 + exp(-(10 * {_J} - 5))), 4) AS score FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS after FROM s)
 SELECT query_id, round(max(CASE WHEN rank = 1 THEN j END), 4) AS before, round(max(CASE WHEN after = 1 THEN j END), 4) AS "after" FROM r GROUP BY query_id""")
def rr5(spark, sf):
    h = hits(spark, sf).withColumn("j", fusion.jaccard(F.col("query_text"), F.col("text"))).withColumnRenamed("rank", "was")
    r = fusion.rerank_by_pairs(h, "query_text", "text", 10)
    return r.groupBy("query_id").agg(F.round(F.max(F.when(F.col("was") == 1, F.col("j"))), 4).alias("before"), F.round(F.max(F.when(F.col("rank") == 1, F.col("j"))), 4).alias("after"))


@query("x1_context", f"""{_H}, m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS hi FROM h), k AS (SELECT * FROM m WHERE score >= 8 OR (hi < 8 AND rank = 1)), c AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS e FROM k),
 p AS (SELECT query_id, doc_id, CASE WHEN e <= 12000 THEN length(text) WHEN 12000 - (e - length(text)) > 100 THEN 12000 - (e - length(text)) END AS n FROM c) SELECT query_id, doc_id, n::INTEGER AS n_chars, ceil(n / 4)::BIGINT AS tokens FROM p WHERE n IS NOT NULL""")
def x1(spark, sf):
    c = context.pack(context.above(hits(spark, sf), 8.0), "text", 3000, 4, 100)
    return c.select("query_id", "doc_id", F.length("content").alias("n_chars"), "tokens")


@query("x2_strict_context", f"{_H}, c AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS e FROM h) SELECT query_id, doc_id, ceil(length(text) / 2)::BIGINT AS tokens FROM c WHERE e <= 6000")
def x2(spark, sf):
    return context.pack(hits(spark, sf), "text", 3000, 2).select("query_id", "doc_id", "tokens")


@query("x3_fit", f"""{_H}, c AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS e FROM h), p AS (SELECT query_id, doc_id, CASE WHEN e <= 4000 THEN length(text) WHEN 4000 - (e - length(text)) > 400 THEN 4000 - (e - length(text)) END AS n FROM c) SELECT query_id, doc_id, n::INTEGER AS n_chars FROM p WHERE n IS NOT NULL""")
def x3(spark, sf):
    return context.pack(hits(spark, sf), "text", 2000 - 500 - 100 - 400, 4, 400).select("query_id", "doc_id", F.length("content").alias("n_chars"))


@query("x4_strategy", f"""{_H}, g AS (SELECT query_id, sum(ceil(length(text) / 4))::BIGINT AS tokens, round(avg(score / 20), 4) AS mean_score FROM h GROUP BY query_id) SELECT *, CASE WHEN tokens <= 0.8 * 4000 THEN 'none' WHEN mean_score > 0.6 THEN 'selective' WHEN mean_score > 0.4 THEN 'summarize' ELSE 'truncate' END AS strategy FROM g""")
def x4(spark, sf):
    return context.strategy(hits(spark, sf).withColumn("score", F.col("score") / 20), "text", 4000)


@query("x5_truncated", f"""{_H}, c AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS e FROM h), p AS (SELECT query_id, doc_id, CASE WHEN e <= 8000 THEN length(text) WHEN 8000 - (e - length(text)) > 200 THEN 8000 - (e - length(text)) END AS n FROM c) SELECT query_id, sum(n)::BIGINT AS kept, count(*) AS n_docs FROM p WHERE n IS NOT NULL GROUP BY query_id""")
def x5(spark, sf):
    c = context.pack(hits(spark, sf), "text", 2000, 4, 200)
    return c.groupBy("query_id").agg(F.sum(F.length("content")).alias("kept"), F.count("*").alias("n_docs"))


_CHOSEN = f"""{_H.replace('WITH ', 'WITH RECURSIVE ', 1)}, s AS (SELECT query_id, doc_id, round(score / 20, 4) AS score, text, rank FROM h),
 c AS (SELECT query_id, doc_id, score, score < 0.7 AS summarized, ceil(length(CASE WHEN score >= 0.7 THEN text ELSE substr(text, 1, greatest(1, length(text) // 5)) END) / 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM s WHERE score >= 0.4),
 r AS (SELECT query_id, doc_id, score, tokens, summarized, i, tokens <= 2000 AS taken, CASE WHEN tokens <= 2000 THEN tokens ELSE 0 END AS used FROM c WHERE i = 1
  UNION ALL SELECT c.query_id, c.doc_id, c.score, c.tokens, c.summarized, c.i, r.used + c.tokens <= 2000, CASE WHEN r.used + c.tokens <= 2000 THEN r.used + c.tokens ELSE r.used END FROM r JOIN c ON c.query_id = r.query_id AND c.i = r.i + 1)
 SELECT query_id, doc_id, score, tokens, summarized FROM r WHERE taken"""


@query("x6_selective", _CHOSEN)
def x6(spark, sf):
    return context.select(hits(spark, sf).withColumn("score", F.round(F.col("score") / 20, 4)), "text", 2000)


_SUMMARIES = _H.replace("WITH ", "WITH RECURSIVE ", 1) + r""", d AS (SELECT DISTINCT doc_id, text FROM h),
 l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g')), lambda x: x <> '') AS l FROM d),
 sn AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS s FROM l), nn AS (SELECT doc_id, count(*) AS n FROM sn GROUP BY doc_id),
 sw AS (SELECT DISTINCT doc_id, pos, unnest(regexp_extract_all(lower(s), '[가-힣a-zA-Z0-9]+')) AS w FROM sn), sz AS (SELECT doc_id, pos, count(*) AS k FROM sw GROUP BY ALL), wc AS (SELECT doc_id, w, count(*) AS c FROM sw GROUP BY ALL),
 walk AS (SELECT doc_id, pos, 0 AS round, 1.0::DOUBLE / n AS r FROM sz JOIN nn USING (doc_id)
  UNION ALL SELECT doc_id, pos, round + 1, 0.15 / n + 0.85 * sum(mass / c) FROM (SELECT doc_id, w, round, sum(r / k) AS mass FROM walk JOIN sw USING (doc_id, pos) JOIN sz USING (doc_id, pos) WHERE round < 20 GROUP BY doc_id, w, round) m JOIN sw USING (doc_id, w) JOIN wc USING (doc_id, w) JOIN nn USING (doc_id) GROUP BY doc_id, pos, round, n),
 sr AS (SELECT doc_id, pos, s, greatest(1, length(text) // 5) AS room, row_number() OVER (PARTITION BY doc_id ORDER BY round(coalesce(r, 0.15 / n), 9) DESC, pos) AS place, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY round(coalesce(r, 0.15 / n), 9) DESC, pos) AS used
  FROM sn JOIN nn USING (doc_id) JOIN d USING (doc_id) LEFT JOIN (SELECT * FROM walk WHERE round = 20) w USING (doc_id, pos)),
 su AS (SELECT doc_id, string_agg(substr(s, 1, room), ' ' ORDER BY pos) AS summary FROM sr WHERE used <= room OR place = 1 GROUP BY doc_id)"""


@query("x7_summaries", f"{_SUMMARIES} SELECT query_id, doc_id, coalesce(summary, '') AS summary FROM h LEFT JOIN su USING (doc_id)")
def x7(spark, sf):
    """A fifth of each text: the sentences that a walk over shared words comes to most."""
    return summarize(hits(spark, sf), "text", 0.2).select("query_id", "doc_id", "summary")


@query("x8_formatted", f"{_H} SELECT query_id, md5(string_agg('[' || rank || '] (' || lang || ', ' || source || ') ' || substr(text, 1, 100), E'\\n' ORDER BY rank)) AS body FROM h GROUP BY query_id")
def x8(spark, sf):
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), "lang", F.lit(", "), "source", F.lit(") "), F.substring("text", 1, 100))
    g = hits(spark, sf).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("x"))
    return g.select("query_id", F.md5(F.array_join(F.transform("x", lambda x: x["l"]), "\n")).alias("body"))


@query("x9_context_stats", f"{_H} SELECT query_id, lang, count(*) AS n, min(length(text))::INTEGER AS least, max(length(text))::INTEGER AS most, round(avg(length(text)), 4) AS mean FROM h GROUP BY query_id, lang")
def x9(spark, sf):
    n = F.length("text")
    return hits(spark, sf).groupBy("query_id", "lang").agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 4).alias("mean"))


@query("x10_confidence", f"WITH {_BM25}, m AS (SELECT query_id, max(score) / 20 AS s FROM sparse GROUP BY query_id) SELECT query_id, CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.4 THEN 'medium' ELSE 'low' END AS plain, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.5 THEN 'medium' ELSE 'low' END AS reranked FROM m")
def x10(spark, sf):
    m = sparse(spark, sf).groupBy("query_id").agg((F.max("score") / 20).alias("s"))
    return m.select("query_id", context.confidence_label(F.col("s")).alias("plain"), context.confidence_label(F.col("s"), True).alias("reranked"))


@query("x11_final_confidence", "SELECT doc_id, round(CASE WHEN toxic = 0 THEN 0.3 * (doc_id % 10) / 10 + 0.4 * (doc_id % 7) / 7 + 0.3 * quality ELSE 0.4 * (doc_id % 10) / 10 + 0.6 * (doc_id % 7) / 7 END, 4) AS confidence FROM labels")
def x11(spark, sf):
    d, answer = F.col("doc_id"), F.when(F.col("toxic") == 0, F.col("quality").cast("double"))
    c = context.final_confidence((d % 10) / 10, (d % 7) / 7, answer)
    return spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.round(c, 4).alias("confidence"))


@query("x12_votes", "WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT source, lang, round(n / sum(n) OVER (PARTITION BY source), 4) AS share, (row_number() OVER (PARTITION BY source ORDER BY n DESC, lang))::INTEGER AS place FROM n) SELECT * FROM r WHERE place <= 2")
def x12(spark, sf):
    return context.votes(docs(spark, sf), "source", "lang")


@query("x13_router", "SELECT vec_id, CASE WHEN label > 7 AND (vec_id % 10) / 10.0 < 0.3 THEN 'reject' WHEN (vec_id % 10) / 10.0 < 0.3 THEN 'generic' ELSE 'full' END AS route FROM embeddings")
def x13(spark, sf):
    return emb(spark, sf).select("vec_id", context.route((F.col("vec_id") % 10) / 10, F.col("label") <= 7).alias("route"))


@query("e1_recall", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS query_id, label AS ql, v AS qv FROM e WHERE vec_id % 50 = 0),
 s AS (SELECT query_id, vec_id, ql = label AS rel, round(list_cosine_similarity(qv, v), 4) AS score FROM q CROSS JOIN e), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
 SELECT query_id, k::INTEGER AS k, round(count(*) FILTER (WHERE rel AND rank <= k) / count(*) FILTER (WHERE rel), 4) AS recall FROM r CROSS JOIN (SELECT unnest([1, 5, 10]) AS k) GROUP BY query_id, k""")
def e1(spark, sf):
    e = emb(spark, sf)
    found = vector.knn(vector_asked(spark, sf), e, 10)
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return context.recall_at(found, q.join(e.select("vec_id", "label"), "label"), [1, 5, 10], "vec_id")


@query("v1_learnt_vectors")
def v1_learnt(spark, sf):
    """Vectors of all documents from the texts themselves."""
    v = TextVectors.fit(docs(spark, sf), "doc_id", "text", 64).fitted("doc_id")
    return v.select("doc_id", F.transform("embedding", lambda x: F.round(x, 4)).alias("embedding"))


@query("k5_learnt_search")
def k5_learnt(spark, sf):
    """The documents nearest to each benchmark text by learnt vectors."""
    learnt = TextVectors.fit(docs(spark, sf), "doc_id", "text", 128)
    return vector.knn(learnt.vectors(asked(spark, sf), "query_id", "text"), learnt.fitted("doc_id"), 10, key="doc_id")


@query("e1_learnt_recall")
def e1_learnt(spark, sf):
    """method, queries, recall: of the documents that hold a benchmark text, the share among the ten nearest, by learnt and by hashed vectors of as
    many dimensions."""
    d, q = docs(spark, sf), asked(spark, sf)
    learnt = TextVectors.fit(d, "doc_id", "text", 256)
    # a text that holds another one has all its cells: the pairs that can be are found by the stored cells, and only these texts are read again
    flat = lambda c: F.concat(F.lit(" "), F.array_join(lexical.terms(c), " "), F.lit(" "))
    can = stored(learnt.holding(q, "query_id", "text").withColumnRenamed("key", "doc_id"), "can")
    held = can.join(d.select("doc_id", "text"), "doc_id").join(q.select("query_id", F.col("text").alias("q")), "query_id").where(F.contains(flat(F.col("text")), flat(F.col("q"))))
    held = stored(held.select("query_id", "doc_id"), "held")
    sides = {"learnt": (learnt.vectors(q, "query_id", "text"), learnt.fitted("doc_id")), "hashed": (lexical.hashed_vectors(q, "query_id", "text"), lexical.hashed_vectors(d, "doc_id", "text"))}
    out = None
    for name, (a, b) in sides.items():
        found = vector.knn(a, b, 10, key="doc_id").select("query_id", "doc_id", F.lit(1).alias("hit"))
        each = held.join(found, ["query_id", "doc_id"], "left").groupBy("query_id").agg((F.count("hit") / F.least(F.count("*"), F.lit(10))).alias("r"))
        part = each.agg(F.lit(name).alias("method"), F.count("*").alias("queries"), F.round(F.avg("r"), 4).alias("recall"))
        out = part if out is None else out.unionByName(part)
    return out


_PAIR_SIMILARITY = f"""WITH d AS (SELECT doc_id, lang, cell, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM (SELECT doc_id, lang, ('0x' || substr(md5(term), 1, 2))::INTEGER AS cell, count(*) AS n FROM (SELECT doc_id, lang, unnest({_T}) AS term FROM documents) GROUP BY ALL)),
 c AS (SELECT lang, count(*) AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY lang), s AS (SELECT lang, cell, sum(x) AS x FROM d WHERE lang IS NOT NULL GROUP BY ALL),
 p AS (SELECT a.lang AS lang_a, b.lang AS lang_b, sum(a.x * b.x) AS dot FROM s a JOIN s b ON a.cell = b.cell AND a.lang < b.lang GROUP BY ALL),
 m AS (SELECT x.lang AS lang_a, y.lang AS lang_b, round(coalesce(dot, 0) / x.n / y.n, 4) AS mean FROM c x JOIN c y ON x.lang < y.lang LEFT JOIN p ON p.lang_a = x.lang AND p.lang_b = y.lang)
 SELECT lang_a, lang_b, mean, CASE WHEN mean > 0.8 THEN 'high' WHEN mean > 0.6 THEN 'medium' ELSE 'low' END AS bucket FROM m"""


@query("e5_cross_lingual", _PAIR_SIMILARITY)
def e5(spark, sf):
    """Over all pairs of texts in two languages."""
    d = docs(spark, sf).where("text IS NOT NULL")
    v = lexical.hashed_vectors(d.select(F.struct("doc_id", "lang").alias("k"), "text"), "k", "text")
    return lexical.mean_similarity(v.select("k.lang", "embedding"), "lang")


@query("e6_training_pairs", """WITH k AS (SELECT DISTINCT toxic, doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY h, doc_id) AS place, count(*) OVER (PARTITION BY toxic) AS n FROM k)
 SELECT doc_id, CASE WHEN place <= floor(n * 0.1 + 0.5) THEN 'test' ELSE 'train' END AS split, labels.toxic AS label FROM labels JOIN r USING (doc_id, toxic)""")
def e6(spark, sf):
    """A tenth of each label, exactly."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    return sampling.stratified_split(labels, "doc_id", "label", 0.1).select("doc_id", "split", "label")


_ASK = "CASE j WHEN 0 THEN substr(text, 1, 60) ELSE substr(text, -60) END"


@query("e6_pairs", """WITH p AS (SELECT item_id, text, md5(item_id::VARCHAR) AS h FROM benchmark), b AS (SELECT greatest(1, count(*) // 48) AS n FROM p), q AS (SELECT item_id, j, md5(item_id || '/' || j) AS h FROM p CROSS JOIN (VALUES (0), (1)) t(j)),
 o AS (SELECT q.item_id, q.j, p.item_id AS passage_id, row_number() OVER (PARTITION BY q.item_id, q.j ORDER BY md5(q.item_id || '/' || q.j || '/' || p.item_id), p.item_id) AS place
  FROM q CROSS JOIN b JOIN p ON ('0x' || substr(q.h, 1, 8))::BIGINT % b.n = ('0x' || substr(p.h, 1, 8))::BIGINT % b.n AND p.item_id <> q.item_id)
 SELECT item_id, j::INTEGER AS j, item_id AS passage_id, 1::INTEGER AS label FROM q UNION ALL SELECT item_id, j, passage_id, 0 FROM o WHERE place <= 3""")
def e6_pairs(spark, sf):
    """The first and last 60 characters of each passage are the questions that it answers."""
    p = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    q = p.select("item_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    return fusion.training_pairs(q, p.select(F.col("item_id").alias("passage_id")), ["item_id", "j"], "item_id", "passage_id", 3)


def _labelled(spark, sf) -> DataFrame:
    """The pairs of e6_pairs with their texts; a tenth of the questions' passages, exactly, is held out."""
    p = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    ask = F.when(F.col("j") == 0, F.substring("text", 1, 60)).otherwise(F.substring("text", -60, 60))
    q = p.select("item_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"), "text").select("item_id", "j", ask.alias("question"))
    rows = e6_pairs(spark, sf).join(q, ["item_id", "j"]).join(p.select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage")), "passage_id")
    return sampling.stratified_split(rows.withColumn("one", F.lit(1)), "item_id", "one", 0.2)


@query("rr4_trained")
def rr4_trained(spark, sf):
    """Hits in the order of a scorer fitted to labelled pairs."""
    model = PairModel.train(_labelled(spark, sf), "question", "passage")
    scored = model.score(hits(spark, sf).withColumnRenamed("score", "original"), "query_text", "text", ["query_id", "doc_id", "original"])
    return lexical.top(scored, "query_id", "doc_id", 5)


@query("rr4_held_out")
def rr4_held_out(spark, sf):
    """scorer, pairs, chosen, right, precision, recall: pairs of held-out passages that the trained scorer and the overlap of words score 0.5 or
    more, each question's best pair alone (precision_at_1) beside it."""
    rows = stored(_labelled(spark, sf), "labelled")
    model = PairModel.train(rows.where("split = 'train'"), "question", "passage")
    held = rows.where("split = 'test'")
    by_model = model.score(held, "question", "passage", ["item_id", "j", "passage_id", "label"]).withColumn("scorer", F.lit("trained"))
    overlap = fusion.sigmoid(10 * fusion.jaccard(F.col("question"), F.col("passage")) - 5)
    by_words = held.select("item_id", "j", "passage_id", "label", overlap.alias("score"), F.lit("overlap").alias("scorer"))
    first = F.row_number().over(Window.partitionBy("scorer", "item_id", "j").orderBy(F.desc("score"), "passage_id")) == 1
    both = by_model.unionByName(by_words).withColumn("first", first)
    chosen, right = F.col("score") >= 0.5, F.col("label") == 1
    n = lambda c: F.count_if(c)
    share = lambda a, b: F.round(F.coalesce(F.try_divide(n(a), n(b)), F.lit(0.0)), 4)
    return both.groupBy("scorer").agg(F.count("*").alias("pairs"), n(chosen).alias("chosen"), n(chosen & right).alias("right"), share(chosen & right, chosen).alias("precision"), share(chosen & right, right).alias("recall"), share(F.col("first") & right, F.col("first")).alias("precision_at_1"))


@query("z21_nearest_patterns", f"""WITH rv AS (SELECT conv_id, turn, cell, n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)) AS x FROM (SELECT conv_id, turn, ('0x' || substr(md5(term), 1, 2))::INTEGER AS cell, count(*) AS n FROM (SELECT conv_id, turn, unnest({_T}) AS term FROM conversations WHERE role = 'user' AND conv_id % 50 = 0) GROUP BY ALL)),
 pv AS (SELECT item_id, cell, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS x FROM (SELECT item_id, ('0x' || substr(md5(term), 1, 2))::INTEGER AS cell, count(*) AS n FROM (SELECT item_id, unnest({_T}) AS term FROM benchmark) GROUP BY ALL)),
 r AS (SELECT conv_id, turn FROM conversations WHERE role = 'user' AND conv_id % 50 = 0 AND text IS NOT NULL), a AS (SELECT r.conv_id, r.turn, b.item_id, round(coalesce(sum(rv.x * pv.x), 0), 4) AS similarity FROM r CROSS JOIN (SELECT item_id FROM benchmark WHERE text IS NOT NULL) b LEFT JOIN (rv JOIN pv USING (cell)) ON rv.conv_id = r.conv_id AND rv.turn = r.turn AND pv.item_id = b.item_id GROUP BY ALL),
 k AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY similarity DESC, item_id))::INTEGER AS rank FROM a)
 SELECT conv_id, turn, item_id AS pattern_id, similarity, rank, round(0.4 * max(similarity) OVER (PARTITION BY conv_id, turn) + 0.6 * 0.7, 4) AS confidence FROM k WHERE rank <= 5""")
def z21(spark, sf):
    """The patterns nearest to a request, and what they and the keywords' fixed confidence say together."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user' AND conv_id % 50 = 0 AND text IS NOT NULL")
    p = spark.read.parquet(f"{sf}/benchmark.parquet").where("text IS NOT NULL").select(F.col("item_id").alias("pattern_id"), "text")
    near = lexical.nearest_patterns(c.select(F.struct("conv_id", "turn").alias("request"), "text"), p, 5, "request", "pattern_id")
    best = F.max("similarity").over(Window.partitionBy("request"))
    return near.withColumn("confidence", F.round(0.4 * best + 0.6 * F.lit(0.7), 4)).select("request.*", "pattern_id", "similarity", "rank", "confidence")


@query("z9_precision", f"{_H}, p AS (SELECT query_id, round(avg((len(list_intersect(list_distinct({_T}), list_distinct({_T.replace('text', 'query_text')}))) >= 3)::INTEGER), 4) AS precision FROM h WHERE rank <= 5 GROUP BY query_id) SELECT query_id, precision FROM p")
def z9(spark, sf):
    h = hits(spark, sf).where("rank <= 5")
    both = F.size(F.array_intersect(lexical.terms(F.col("text")), lexical.terms(F.col("query_text"))))
    return h.groupBy("query_id").agg(F.round(F.avg((both >= 3).cast("int")), 4).alias("precision"))

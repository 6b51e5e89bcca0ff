"""Queries over the table embeddings, with their SQL. The queries of a search are the rows whose vec_id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import filters, tsne, vector
from ..operators.vector_index import VectorIndex
from ..sources.shared import scratch

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def take(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return take


def emb(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label")


def asked(spark, sf) -> DataFrame:
    return emb(spark, sf).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS query_id, label AS query_label, v AS qv FROM e WHERE vec_id % 50 = 0)"
_S = "CASE WHEN list_dot_product(qv, qv) * list_dot_product(v, v) > 0 THEN round(list_cosine_similarity(qv, v), 4) ELSE 0 END"


def _ranked(score: str = _S, where: str = "TRUE", partition: str = "query_id", k: int = 5, columns: str = "query_id, vec_id, score, rank") -> str:
    return f"""WITH {_E}, s AS (SELECT query_id, query_label, vec_id, label, {score} AS score FROM q CROSS JOIN e WHERE {where}),
 r AS (SELECT *, (row_number() OVER (PARTITION BY {partition} ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) SELECT {columns} FROM r WHERE rank <= {k}"""


_NEXT = "n AS (SELECT a.vec_id, b.vec_id AS next_id, a.v AS x, b.v AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"


def neighbours(spark, sf):
    e = emb(spark, sf)
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("y"))
    return e.withColumnRenamed("embedding", "x").join(after, "vec_id")


@query("v2_cosine", f"WITH {_E}, {_NEXT} SELECT vec_id, next_id, round(list_cosine_similarity(x, y), 6) AS cosine FROM n")
def v2(spark, sf):
    return neighbours(spark, sf).select("vec_id", "next_id", F.round(V.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query("v3_norms", f"WITH {_E} SELECT vec_id, round(sqrt(list_dot_product(v, v)), 5) AS norm, abs(sqrt(list_dot_product(v, v)) - 1) < 1e-6 AS normalized FROM e")
def v3(spark, sf):
    v = F.col("embedding")
    return emb(spark, sf).select("vec_id", F.round(V.norm(v), 5).alias("norm"), V.is_normalized(v).alias("normalized"))


@query("v4_distances", f"WITH {_E} SELECT query_id, vec_id, round(list_distance(qv, v), 4) AS l2, round(list_sum(list_transform(list_zip(qv, v), lambda p: abs(p[1] - p[2]))), 4) AS l1, round(1 - list_cosine_similarity(qv, v), 4) AS cosine FROM q CROSS JOIN e")
def v4(spark, sf):
    return vector.pairs(asked(spark, sf), emb(spark, sf), ("l2", "l1", "distance")).withColumnRenamed("distance", "cosine")


@query("v5_extremes", f"WITH {_E}, s AS (SELECT query_id, vec_id, {_S} AS score FROM q CROSS JOIN e WHERE query_id <> vec_id) SELECT query_id, arg_max(vec_id, score * 1000000 - vec_id / 1000000.0) AS most_similar, max(score) AS most, arg_min(vec_id, score * 1000000 + vec_id / 1000000.0) AS least_similar, min(score) AS least FROM s GROUP BY query_id")
def v5(spark, sf):
    return vector.extremes(asked(spark, sf), emb(spark, sf))


@query("v6_many_to_many", f"WITH {_E} SELECT query_id, vec_id, {_S} AS score FROM q CROSS JOIN e")
def v6(spark, sf):
    return vector.pairs(asked(spark, sf), emb(spark, sf)).withColumnRenamed("cosine", "score")


@query("v7_top_k", _ranked())
def v7(spark, sf):
    return vector.knn(asked(spark, sf), emb(spark, sf), 5)


@query("v8_dot_top_k", _ranked("round(list_dot_product(qv, v), 4)"))
def v8(spark, sf):
    return vector.knn(asked(spark, sf), emb(spark, sf), 5, "ip")


@query("v9_knn_l2", _ranked("-round(list_distance(qv, v), 4)", k=10, columns="query_id, vec_id, -score AS distance, rank"))
def v9(spark, sf):
    return vector.knn(asked(spark, sf), emb(spark, sf), 10, "l2").select("query_id", "vec_id", (-F.col("score")).alias("distance"), "rank")


@query("v10_conversions", f"WITH {_E} SELECT query_id, vec_id, round(1 / (1 + round(list_distance(qv, v), 4)), 4) AS inverse, greatest(0, round(1 - round(list_distance(qv, v), 4), 4)) AS complement, round(({_S} + 1) / 2, 5) AS shifted FROM q CROSS JOIN e")
def v10(spark, sf):
    d, c, s = F.col("l2"), F.col("cosine"), V.similarity_of_distance
    both = vector.pairs(asked(spark, sf), emb(spark, sf), ("l2", "cosine"))
    return both.select("query_id", "vec_id", F.round(s(d), 4).alias("inverse"), F.round(s(d, "complement"), 4).alias("complement"), F.round(s(c, "shifted"), 5).alias("shifted"))


@query("v11_interpretation", f"WITH {_E} SELECT query_id, CASE WHEN s >= 0.8 THEN 'very similar' WHEN s >= 0.6 THEN 'similar' WHEN s >= 0.4 THEN 'somewhat similar' ELSE 'different' END AS likeness, count(*) AS n FROM (SELECT query_id, {_S} AS s FROM q CROSS JOIN e) GROUP BY ALL")
def v11(spark, sf):
    n = vector.score_counts(asked(spark, sf), emb(spark, sf), [least for least, _ in V.COSINE_STEPS])
    names = F.array(*[F.lit(name) for _, name in V.COSINE_STEPS], F.lit("different"))
    return n.select("query_id", names[F.col("step")].alias("likeness"), "n")


@query("v12_threshold", _ranked(where=f"{_S} >= 0.3"))
def v12(spark, sf):
    return vector.knn(asked(spark, sf), emb(spark, sf), 5, least=0.3)


def candidates(spark, sf, k):
    e = emb(spark, sf)
    return vector.knn(asked(spark, sf), e, k).join(e, "vec_id")


#: Candidates of each query in their order, with their cosines to each other.
_CANDIDATES = f"""WITH RECURSIVE {_E}, s AS (SELECT query_id, vec_id, {_S} AS score, v FROM q CROSS JOIN e), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s),
 c AS (SELECT * FROM k WHERE {{}}), m AS (SELECT a.query_id, a.vec_id, any_value(a.score) AS score, any_value(a.place) AS place, map_from_entries(list((b.vec_id, CASE WHEN list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v) > 0 THEN list_cosine_similarity(a.v, b.v) ELSE 0 END))) AS near FROM c a JOIN c b USING (query_id) GROUP BY a.query_id, a.vec_id)"""
_MMR = _CANDIDATES.format("place <= 10") + """, g AS (SELECT query_id, 0 AS step, []::BIGINT[] AS taken FROM m GROUP BY query_id
  UNION ALL SELECT query_id, step + 1, list_append(taken, vec_id) FROM (SELECT g.query_id, step, taken, vec_id, row_number() OVER (PARTITION BY g.query_id ORDER BY round(0.7 * score - 0.3 * coalesce(list_max(list_transform(taken, lambda t: near[t])), 0), 9) DESC, place) AS n FROM g JOIN m USING (query_id) WHERE step < 5 AND NOT list_contains(taken, vec_id)) WHERE n = 1),
 x AS (SELECT query_id, unnest(taken) AS vec_id, unnest(range(1, 6)) AS rank FROM g WHERE step = 5)
 SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM x JOIN m USING (query_id, vec_id)"""
_APART = _CANDIDATES.format("place <= 20 AND score >= 0.3") + """, g AS (SELECT query_id, 0::BIGINT AS step, []::BIGINT[] AS kept FROM m GROUP BY query_id
  UNION ALL SELECT g.query_id, step + 1, CASE WHEN coalesce(list_max(list_transform(kept, lambda t: near[t])), 0) <= 0.8 THEN list_append(kept, vec_id) ELSE kept END FROM g JOIN m ON m.query_id = g.query_id AND m.place = step + 1)
 SELECT query_id, vec_id, score FROM (SELECT query_id, unnest(kept) AS vec_id FROM (SELECT query_id, arg_max(kept, step) AS kept FROM g GROUP BY query_id)) JOIN m USING (query_id, vec_id)"""


@query("v13_mmr", _MMR)
def v13(spark, sf):
    return vector.mmr(candidates(spark, sf, 10), 5, 0.7)


@query("v14_redundancy", _APART)
def v14(spark, sf):
    return vector.drop_redundant(candidates(spark, sf, 20).where("score >= 0.3"), 0.8)


WHERE = {"$or": [{"label": {"$in": [1, 2]}}, {"$and": [{"label": {"$gte": 5}}, {"label": {"$ne": 7}}]}]}


@query("v15_filtered_knn", _ranked(where="(label IN (1, 2) OR (label >= 5 AND label <> 7))"))
def v15(spark, sf):
    return vector.knn(asked(spark, sf), emb(spark, sf), 5, where=filters.compile_where(WHERE))


@query("v16_date_range", _ranked(where="(DATE '2024-01-01' + (vec_id % 366)::INTEGER) BETWEEN DATE '2024-03-01' AND DATE '2024-08-31'"))
def v16(spark, sf):
    day = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod("vec_id", F.lit(366)).cast("int"))
    return vector.knn(asked(spark, sf), emb(spark, sf), 5, where=day.between("2024-03-01", "2024-08-31"))


@query("v17_faceted", _ranked(partition="query_id, label", k=2, columns="query_id, vec_id, label, score, rank"))
def v17(spark, sf):
    return vector.knn(asked(spark, sf), emb(spark, sf), 2, per="label")


@query("v18_two_categories", f"""WITH {_E}, s AS (SELECT query_id, vec_id, label, {_S} AS score FROM q CROSS JOIN e WHERE label IN (query_label, (query_label + 1) % 10)), w AS (SELECT *, label = (SELECT any_value(query_label) FROM q WHERE q.query_id = s.query_id) AS own FROM s),
 c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS n FROM w), f AS (SELECT query_id, vec_id, label, round(score * (0.7 + 0.3 * CASE WHEN own THEN 1.0 ELSE 0.6 END), 4) AS weighted FROM c WHERE n <= 5),
 r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY weighted DESC, vec_id))::INTEGER AS rank FROM f) SELECT query_id, vec_id, label, weighted, rank FROM r WHERE rank <= 5""")
def v18(spark, sf):
    label = F.col("label")
    q = emb(spark, sf).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", label.alias("own"), F.array(label, (label + 1) % 10).alias("asks"))
    near = vector.knn(q, emb(spark, sf), 5, per="label", asks="asks").drop("rank").join(q.select("query_id", "own"), "query_id")
    near = near.withColumn("w", F.when(label == F.col("own"), 1.0).otherwise(0.6))
    both = near.withColumn("weighted", F.round(F.col("score") * (0.7 + 0.3 * F.col("w")), 4))
    w = Window.partitionBy("query_id").orderBy(F.desc("weighted"), "vec_id")
    return both.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query_id", "vec_id", "label", "weighted", "rank")


@query("v19_category_search", _ranked(where="label = 3"))
def v19(spark, sf):
    return vector.knn(asked(spark, sf), emb(spark, sf), 5, where=filters.compile_where({"label": 3}))


@query("v20_two_filters", _ranked(where="label <= 4 AND label <> 2 AND vec_id >= 100", k=3))
def v20(spark, sf):
    return vector.knn(asked(spark, sf), emb(spark, sf), 3, where=filters.compile_where({"label": {"$lte": 4, "$ne": 2}, "vec_id": {"$gte": 100}}))


@query("v21_pca")
def v21(spark, sf):
    return vector.pca(emb(spark, sf), 2).select("vec_id", F.round("pc1", 4).alias("pc1"), F.round("pc2", 4).alias("pc2"))


@query("v21_tsne")
def v21_tsne(spark, sf):
    """A map of all vectors by the layout of some."""
    return tsne.tsne(emb(spark, sf)).select("vec_id", "label", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("v22_clusters")
def v22(spark, sf):
    return vector.kmeans(emb(spark, sf), 10).groupBy("cluster", "label").agg(F.count("*").alias("n"))


@query("v23_border", f"WITH {_E}, d AS (SELECT query_id, min(round(list_distance(qv, v), 4)) AS nearest FROM q CROSS JOIN e WHERE query_label <> label GROUP BY query_id) SELECT query_id, nearest, nearest < 1.2 AS border FROM d")
def v23(spark, sf):
    q = emb(spark, sf).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    near = vector.knn(asked(spark, sf), emb(spark, sf), 1, "l2", per="label").join(q, "query_id").where("label <> query_label")
    return near.groupBy("query_id").agg((-F.max("score")).alias("nearest")).withColumn("border", F.col("nearest") < 1.2)


@query("v24_lsh")
def v24(spark, sf):
    return vector.lsh_search(asked(spark, sf), emb(spark, sf), 5)


@query("v24_recall")
def v24_recall(spark, sf):
    """The share of the true neighbours that v24_lsh finds."""
    true, found = v7(spark, sf).select("query_id", "vec_id"), v24(spark, sf).select("query_id", "vec_id", F.lit(1).alias("hit"))
    both = true.join(found, ["query_id", "vec_id"], "left")
    return both.agg(F.count("*").alias("neighbours"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


def _index(spark, sf) -> VectorIndex:
    index = VectorIndex(spark, scratch(spark, "vectors"))
    index.build(emb(spark, sf))
    return index


@query("v24_ivf")
def v24_ivf(spark, sf):
    """Search of a stored inverted file: as many cells as reach a recall of 0.93 on sampled rows."""
    index = _index(spark, sf)
    return index.search(asked(spark, sf), 5, index.calibrate(0.93))


@query("v24_ivf_recall")
def v24_ivf_recall(spark, sf):
    """The share of the true neighbours that v24_ivf finds, and of the rows that its cells hold, over all queries."""
    index = _index(spark, sf)
    probes = index.calibrate(0.93)
    found = index.search(asked(spark, sf), 5, probes).select("query_id", "vec_id", F.lit(1).alias("hit"))
    both = v7(spark, sf).select("query_id", "vec_id").join(found, ["query_id", "vec_id"], "left").agg(F.count("*").alias("neighbours"), F.count("hit").alias("found"))
    read = index.probed(asked(spark, sf), probes).agg(F.sum("rows_read").alias("rows_read"), F.sum("rows").alias("rows"))
    return both.crossJoin(read).select("neighbours", "found", F.round(F.col("found") / F.col("neighbours"), 4).alias("recall"), "rows_read", "rows")  # one row each


@query("v24_pq_recall")
def v24_pq_recall(spark, sf):
    """Bytes of a vector and of its code; the share of the true neighbours found by codes alone, and when the best 50 are scored again."""
    index = _index(spark, sf)
    cells = len(index.books().cells)
    true = v7(spark, sf).select("query_id", "vec_id")
    for name, rerank in (("by_codes", 0), ("reranked", 10)):
        found = index.search(asked(spark, sf), 5, cells, codes=True, rerank=rerank).select("query_id", "vec_id", F.lit(1).alias(name))
        true = true.join(found, ["query_id", "vec_id"], "left")
    share = lambda c: F.round(F.count(c) / F.count("*"), 4).alias(c)
    size = index.rows().agg(F.max(F.size("v") * 4).alias("vector_bytes"), F.max(F.length("code")).alias("code_bytes"))
    return true.agg(F.count("*").alias("neighbours"), share("by_codes"), share("reranked")).crossJoin(size)  # one row each


@query("v25_dimensions", "WITH x AS (SELECT unnest(range(0, 64))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT dim, round(min(x), 5) AS least, round(max(x), 5) AS most, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std FROM x GROUP BY dim")
def v25(spark, sf):
    d = vector.dimension_stats(emb(spark, sf))
    return d.select("dim", *[F.round(c, 5).alias(c) for c in ("least", "most", "mean", "std")])


@query("v26_pair_report", f"WITH {_E}, {_NEXT} SELECT vec_id, next_id, round(list_cosine_similarity(x, y), 4) AS cosine, round(list_distance(x, y), 4) AS l2, CASE WHEN list_distance(x, y) < 1.0 THEN 'near' WHEN list_distance(x, y) < 1.8 THEN 'middle' ELSE 'far' END AS reach FROM n")
def v26(spark, sf):
    x, y = F.col("x"), F.col("y")
    d = V.l2(x, y)
    reach = F.when(d < 1.0, "near").when(d < 1.8, "middle").otherwise("far")
    return neighbours(spark, sf).select("vec_id", "next_id", F.round(V.cosine(x, y), 4).alias("cosine"), F.round(d, 4).alias("l2"), reach.alias("reach"))

"""Fusion of two rankings and reranking. Results are tables of query_id, doc_id, score, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .lexical import terms, top

Q, D = "query_id", "doc_id"


def normalized(df: DataFrame, how: str) -> DataFrame:
    """Scores of each query by its greatest one (max), or moved to 0 to 1 (minmax; 1 where all are equal)."""
    w = Window.partitionBy(Q)
    hi, lo = F.max("score").over(w), F.min("score").over(w)
    if how == "max":
        s = F.when(hi > 0, F.col("score") / hi).otherwise(F.lit(0.0))
    elif how == "minmax":
        s = F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(F.lit(1.0))
    else:
        raise ValueError(f"unknown normalisation {how}")
    return df.select(Q, D, s.alias("score"))


def weighted(dense: DataFrame, sparse: DataFrame, weight: float, k: int, how: str = "max") -> DataFrame:
    """weight * dense + (1 - weight) * sparse; what only one side has counts as 0 on the other."""
    a, b = normalized(dense, how).withColumnRenamed("score", "dense"), normalized(sparse, how).withColumnRenamed("score", "sparse")
    both = a.join(b, [Q, D], "full_outer").fillna(0.0, ["dense", "sparse"])
    return top(both.withColumn("score", F.round(weight * F.col("dense") + (1 - weight) * F.col("sparse"), 4)), Q, D, k)


def rrf(results: list[DataFrame], k: int, constant: int = 60, weights: list[float] | None = None) -> DataFrame:
    """Sum of weight / (constant + rank) over the rankings."""
    out = None
    for df, w in zip(results, weights or [1.0] * len(results)):
        part = df.select(Q, D, (F.lit(w) / (F.lit(constant) + F.col("rank"))).alias("score"))
        out = part if out is None else out.unionByName(part)
    return top(out.groupBy(Q, D).agg(F.round(F.sum("score"), 6).alias("score")), Q, D, k)


def best_of(results: list[DataFrame], k: int) -> DataFrame:
    """The union of several rankings; of a repeated document the best score."""
    out = results[0].select(Q, D, "score")
    for df in results[1:]:
        out = out.unionByName(df.select(Q, D, "score"))
    return top(out.groupBy(Q, D).agg(F.max("score").alias("score")), Q, D, k)


def jaccard(a: Column, b: Column) -> Column:
    """Of the words of two texts; 0 without words."""
    x, y = F.array_distinct(terms(a)), F.array_distinct(terms(b))
    n = F.size(F.array_union(x, y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(F.lit(0.0))


def rerank_by_overlap(results: DataFrame, query_text: str, text: str, weight: float = 0.3) -> DataFrame:
    score = F.round((1 - weight) * F.col("score") + weight * jaccard(F.col(query_text), F.col(text)), 4)
    w = Window.partitionBy(Q).orderBy(F.desc("score"), D)
    return results.withColumn("score", score).withColumn("rank", F.row_number().over(w))


def rerank_by_diversity(results: DataFrame, category: str, free: int = 3) -> DataFrame:
    """First those that are the first of their category, or among the first few taken; then the rest, in order."""
    first = F.row_number().over(Window.partitionBy(Q, category).orderBy("rank")) == 1
    kept = results.withColumn("_late", ~(first | (F.col("rank") <= free)))
    w = Window.partitionBy(Q).orderBy("_late", "rank")
    return kept.withColumn("rank", F.row_number().over(w)).drop("_late")


def rerank_by_recency(results: DataFrame, day: str, bonus: float = 0.1) -> DataFrame:
    """Dated rows gain up to the bonus, the latest most: (n - i) / n of it for the i-th of n."""
    w = Window.partitionBy(Q)
    n = F.count(day).over(w)
    i = F.row_number().over(w.orderBy(F.desc_nulls_last(day), D)) - 1
    gain = F.when(F.col(day).isNotNull(), (n - i) / n * bonus).otherwise(0.0)
    out = results.withColumn("score", F.round(F.col("score") + gain, 4))
    return out.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), D)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rerank_by_pairs(results: DataFrame, query_text: str, text: str, k: int) -> DataFrame:
    """As a cross-encoder's scores would: a score of the pair (here the overlap of words, moved to -5 to 5) through a sigmoid."""
    out = results.withColumn("original", F.col("score")).withColumn("score", F.round(sigmoid(10 * jaccard(F.col(query_text), F.col(text)) - 5), 4))
    return top(out, Q, D, k)


def metadata_score(query: Column, title: Column, day: Column, words: Column, as_of: Column) -> Column:
    """0.3 for a word of the query in the title, up to 0.2 for the last year, 0.1 for 50 to 500 words; 1 at most."""
    hit = F.exists(terms(query), lambda w: F.contains(F.lower(title), w))
    recent = F.greatest(F.lit(0.0), 1 - F.datediff(as_of, day) / F.lit(365.0))
    return F.least(F.lit(1.0), F.when(hit, 0.3).otherwise(0.0) + 0.2 * F.coalesce(recent, F.lit(0.0)) + F.when(words.between(50, 500), 0.1).otherwise(0.0))


def training_pairs(questions: DataFrame, passages: DataFrame, question_key: list[str], own: str, key: str, negatives: int = 3) -> DataFrame:
    """question_key, key, label: each question with the passage that it belongs to (1), and with some others (0).

    Passages are dealt to buckets by hash, about sixteen for each negative asked for; a question takes from one bucket those whose hash with it
    is least, and what is lacking from the next ones, as long as there are any. So a question meets a bounded number of passages, whatever the
    table, and reruns agree.
    """
    buckets = max(1, passages.count() // (16 * negatives))
    text = F.concat_ws("/", *question_key)
    bucket = lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % buckets
    q = questions.withColumn("bucket", bucket(text)).withColumn("lacking", F.lit(negatives))
    p = passages.select(key, bucket(F.col(key).cast("string")).alias("bucket"))
    w = Window.partitionBy(*question_key).orderBy("h", key)
    others = None
    for further in range(buckets):
        met = q.join(p, "bucket").where(F.col(own) != F.col(key)).withColumn("h", F.md5(F.concat_ws("/", text, F.col(key))))
        part = stored(met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.col("lacking")).select(*question_key, key), "negatives")
        others = part if others is None else others.unionByName(part)
        had = part.groupBy(*question_key).agg(F.count("*").alias("had"))
        q = q.join(had, question_key, "left").withColumn("lacking", F.col("lacking") - F.coalesce("had", F.lit(0))).where("lacking > 0").drop("had")
        q = stored(q.withColumn("bucket", (F.col("bucket") + 1) % buckets), "lacking")
        if not q.limit(1).count():
            break
    positive = questions.select(*question_key, F.col(own).alias(key), F.lit(1).alias("label"))
    return positive.unionByName(others.select(*question_key, key, F.lit(0).alias("label")))

"""Context assembly: token budgets over ranked results, confidence, votes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Q = "query_id"


def above(results: DataFrame, least: float) -> DataFrame:
    """Rows of at least that score; of a query without any, its best one."""
    hi = F.max("score").over(Window.partitionBy(Q))
    return results.withColumn("_hi", hi).where((F.col("score") >= least) | ((F.col("_hi") < least) & (F.col("rank") == 1))).drop("_hi")


def pack(results: DataFrame, text: str, budget: int, chars: int = 4, partial: int | None = None) -> DataFrame:
    """Texts in rank order while their tokens fit the budget; packing stops at the first that doesn't. With partial, that one is cut to the
    room that is left if this is more than so many characters. Adds tokens and content."""
    n = F.length(text)
    end = F.sum(n).over(Window.partitionBy(Q).orderBy("rank"))
    room = F.lit(budget * chars) - (F.col("_end") - n)
    out = results.withColumn("_end", end)
    content = F.when(F.col("_end") <= budget * chars, F.col(text))
    if partial is not None:
        content = F.coalesce(content, F.when(room > partial, F.col(text).substr(F.lit(1), room.cast("int"))))
    out = out.withColumn("content", content).where("content IS NOT NULL")
    return out.withColumn("tokens", F.ceil(F.length("content") / F.lit(chars)).cast("long")).drop("_end")


def select(results: DataFrame, text: str, budget: int, whole: float = 0.7, summary: float = 0.4, chars: int = 4) -> DataFrame:
    """Texts in rank order that fit what is left of the budget; those that don't are passed over, not the end. From the score `whole` on a
    text is taken as it is, from `summary` on its first fifth. Each query's candidates are a bounded list."""

    def pick(f: pd.DataFrame) -> pd.DataFrame:
        used, rows = 0, []
        for q, d, s, t in f.sort_values("rank")[[Q, "doc_id", "score", text]].itertuples(index=False):
            if s < summary:
                continue
            body = t if s >= whole else t[: max(1, len(t) // 5)]
            tokens = -(-len(body) // chars)
            if used + tokens <= budget:
                used += tokens
                rows.append((q, d, s, tokens, s < whole))
        return pd.DataFrame(rows, columns=[Q, "doc_id", "score", "tokens", "summarized"])

    return results.groupBy(Q).applyInPandas(pick, f"{Q} long, doc_id long, score double, tokens long, summarized boolean")


def strategy(results: DataFrame, text: str, most: int, chars: int = 4) -> DataFrame:
    """For each query: whether its texts exceed 0.8 of the budget, and by the mean score how to compress them."""
    g = results.groupBy(Q).agg(F.sum(F.ceil(F.length(text) / F.lit(chars))).cast("long").alias("tokens"), F.round(F.avg("score"), 4).alias("mean_score"))
    how = F.when(F.col("tokens") <= 0.8 * most, "none").when(F.col("mean_score") > 0.6, "selective").when(F.col("mean_score") > 0.4, "summarize").otherwise("truncate")
    return g.withColumn("strategy", how)


def confidence_label(score: Column, reranked: bool = False) -> Column:
    hi, mid = (0.8, 0.5) if reranked else (0.7, 0.4)
    return F.when(score >= hi, "high").when(score >= mid, "medium").otherwise("low")


def final_confidence(classification: Column, retrieval: Column, answer: Column) -> Column:
    """0.3, 0.4, 0.3; without an answer's own confidence 0.4, 0.6."""
    return F.when(answer.isNotNull(), 0.3 * classification + 0.4 * retrieval + 0.3 * answer).otherwise(0.4 * classification + 0.6 * retrieval)


def votes(df: DataFrame, key: str, label: str) -> DataFrame:
    """The two most frequent labels for each key with their shares; ties by label."""
    n = df.groupBy(key, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    out = n.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 4)).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), label)))
    return out.where("place <= 2").select(key, label, "share", "place")


def route(confidence: Column, known: Column) -> Column:
    return F.when(~known & (confidence < 0.3), "reject").when(confidence < 0.3, "generic").otherwise("full")


def recall_at(results: DataFrame, relevant: DataFrame, ks: list[int], key: str = "doc_id") -> DataFrame:
    """query_id, k, recall: the share of relevant rows among the first k; 0 where nothing is relevant."""
    total = relevant.groupBy(Q).agg(F.count("*").alias("n"))
    hits = results.join(relevant.select(Q, key), [Q, key], "left_semi")
    found = hits.groupBy(Q).agg(*[F.sum((F.col("rank") <= k).cast("int")).alias(f"h{k}") for k in ks])
    all_q = results.select(Q).distinct().join(total, Q, "left").join(found, Q, "left")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h")) for k in ks])).alias("x")
    return all_q.select(Q, "n", each).select(Q, F.col("x.k").alias("k"), F.when(F.coalesce("n", F.lit(0)) > 0, F.round(F.coalesce("x.h", F.lit(0)) / F.col("n"), 4)).otherwise(F.lit(0.0)).alias("recall"))

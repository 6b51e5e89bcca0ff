"""Connected components of a table of links, by least labels and pointer jumping; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node that has a link: label is the least node that it reaches. links: two long columns; nulls and links of a
    node with itself are left out. An empty table gives an empty one."""
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = materialize(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        at = labels.select(F.col("node").alias("v"), F.col("label").alias("of_v"))
        near = edges.join(at, "v").groupBy("u").agg(F.min("of_v").alias("m"))
        hooked = labels.join(near, labels["node"] == near["u"]).select("node", F.least("label", "m").alias("to"), F.col("label").alias("was"))
        hooked = materialize(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        new = materialize(hooked.join(jump, "to", "left").select("node", F.coalesce("beyond", "to").alias("label"), (F.col("was") != F.coalesce("beyond", "to")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        release(labels, hooked)
        labels = new
        if not moved:
            release(edges)
            return labels.select("node", "label")

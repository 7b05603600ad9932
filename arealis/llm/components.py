"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.spread import drop, keep


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each linked node with the smallest node that it can reach: ``node``, ``component``.

    Every round takes the smallest label among the neighbours and then the
    label of that label, so the rounds grow with the logarithm of a chain's
    length.  A node with many links is only ever aggregated, with partial
    minima before the shuffle.  Links with a null end are ignored; no links
    give no rows.
    """
    one_way = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    both = keep(one_way.union(one_way.select("dst", "src")).distinct(), "links")
    labels = keep(
        both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low"))
        .select("node", F.least("node", "low").alias("component")),
        "labels",
    )
    while True:
        offered = (
            both.join(labels, both.dst == labels.node)
            .groupBy("src").agg(F.min("component").alias("offer"))
        )
        near = labels.join(offered, labels.node == offered.src, "left").select(
            "node", F.col("component").alias("old"), F.least("component", "offer").alias("new")
        )
        of_label = labels.select(F.col("node").alias("at"), F.col("component").alias("jump"))
        new = keep(
            near.join(of_label, near.new == of_label["at"], "left").select(
                "node", F.least("new", "jump").alias("component"), (F.least("new", "jump") < F.col("old")).alias("moved")
            ),
            "labels",
        )
        drop(labels)
        labels = new
        if not labels.where("moved").limit(1).count():
            drop(both)
            return labels.select("node", "component")

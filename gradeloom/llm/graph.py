"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import dropped, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The smallest node reachable from every node that has a link.

    ``edges`` has two LONG columns ``a`` and ``b``; direction and repeats do not
    matter, a link to itself is harmless. Returns ``node``, ``component``; an
    empty table gives an empty one.

    Each round takes the smallest label among the neighbours and then the label
    of that label, so the length of a chain halves. A node with very many links
    is combined on the map side; labels are written after each round, and the
    driver sees only the number of changes.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = stored(both.union(both.select("dst", "src")).distinct(), "links")
    labels = stored(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"))
                    .select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = (both.join(labels.select(F.col("node").alias("dst"), "component"), "dst")
                .groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near")))
        step = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        nxt = stored(step.join(jump, "mid", "left").select(
            "node", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")), "labels")
        changed = nxt.where("old <> component").limit(1).count()
        dropped(labels)
        labels = nxt
        if not changed:
            dropped(both)
            return labels.select("node", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

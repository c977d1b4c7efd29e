"""Connected components of a stored edge list, by joins.

Every round hooks each component to its smallest neighbour, follows the hooks
to their ends by doubling, and keeps the edges that still cross components.
Tables are written each round, nothing is collected but counts, and a hub's
edges meet in aggregates that combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import sized_broadcast, stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (u, v) -> (node, comp): comp is the smallest node that can be
    reached. Nodes without edges have no row. Null ends are ignored."""
    live = stored(edges.select("u", "v").filter("u <> v").distinct(), f"{name}-edges")
    labels = stored(live.select(F.col("u").alias("node")).union(live.select("v")).distinct()
                    .select("node", F.col("node").alias("comp")), f"{name}-labels")
    while not live.isEmpty():
        both = live.select("u", "v").union(live.select("v", "u")).toDF("node", "other")
        hooks = stored(both.groupBy("node").agg(F.min("other").alias("other"))
                       .select("node", F.least("node", "other").alias("up")), f"{name}-hooks")
        while True:  # hooks lead to smaller nodes, so they end
            ends = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = stored(hooks.join(ends, "up", "left")
                            .select("node", F.coalesce("top", "up").alias("up"),
                                    (F.coalesce("top", "up") != F.col("up")).alias("moved")), f"{name}-hooks")
            hooks = jumped.select("node", "up")
            if jumped.filter("moved").isEmpty():
                break
        hooks = sized_broadcast(hooks)  # few components are left after some rounds, a hub's being one key
        at = hooks.select(F.col("node").alias("comp"), "up")
        labels = stored(labels.join(at, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")),
                        f"{name}-labels")
        for end in ("u", "v"):
            h = hooks.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up"))
            live = live.join(h, end, "left").withColumn(end, F.coalesce(f"{end}_up", end)).drop(f"{end}_up")
        live = stored(live.select("u", "v").filter("u <> v").distinct(), f"{name}-edges")
    return labels

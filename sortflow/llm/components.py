"""Connected components: of a table of edges by smallest-label hooking and pointer jumping, of numbers inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortflow.plans.workspace import materialise


class Union:
    """Components of numbers; each is named by its smallest."""

    def __init__(self, size: int) -> None:
        self.parent = np.arange(size)

    def roots(self, of: np.ndarray) -> np.ndarray:
        root = self.parent[of]
        while (above := self.parent[root]).tobytes() != root.tobytes():
            root = above
        return root

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.roots(a), self.roots(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round takes the smallest label among a node's neighbours and then the
    label of that label, so labels travel in doubling steps. Rounds are written,
    and every step is an aggregate or a join: no component is gathered.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "component-edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node", "left")
        hooked = hooked.select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("hook"))
        jump = labels.select(F.col("node").alias("hook"), F.col("label").alias("jump"))
        moved = hooked.join(jump, "hook", "left").select("node", "old", F.least("hook", F.coalesce("jump", "hook")).alias("label"))
        moved = materialise(moved, "labels")
        labels = moved.select("node", "label")
        if moved.where("label != old").isEmpty():
            return labels.withColumnRenamed("label", "component")

"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolane.llm.common import Scratch


class Forest:
    """Union-find over any longs; the root of a tree is its least node."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, i: int) -> int:
        up = self.up
        while (j := up.setdefault(i, i)) != i:
            up[i] = i = up.setdefault(j, j)
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition -> an edge from each of its nodes to the least node that it reaches there; a least node has one to itself."""
    trees = Forest()
    for b in batches:
        for i, j in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            trees.join(i, j)
    nodes = list(trees.up)
    for low in range(0, len(nodes), 100_000):
        own = nodes[low : low + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([trees.find(i) for i in own], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, scratch: Scratch, name: str, fits: int = 500_000) -> DataFrame:
    """node, label (the smallest node reachable) for each node of edges (a, b: long).

    Edges are dealt to tasks of `fits` edges, and each task gives back a forest of
    its own; that is done again as long as it leaves much fewer edges.  Edges that
    fit one task are done then, and others go through rounds: each node takes the
    least label around it, then the label of its label.  What a round makes is
    written to the shared folder, so that neither the plan nor the lineage grows.
    """
    held, before, k = scratch.write(edges.select("a", "b"), f"{name}-edges"), None, 0
    n = held.count()
    while before is None or n > fits and n < 0.7 * before or n <= fits < before:
        tasks, k = max(1, -(-n // fits)), k + 1
        dealt = held.coalesce(1) if tasks == 1 else held.repartition(tasks)
        held, before = scratch.write(dealt.mapInArrow(_forest, "a long, b long"), f"{name}-forest{k}"), n
        if tasks == 1:
            return held.select(F.col("a").alias("node"), F.col("b").alias("label"))
        n = held.count()
    both = scratch.write(held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both")
    labels = scratch.write(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), f"{name}-0")
    for k in range(1, 64):
        around = both.join(labels, both["a"] == labels["node"]).groupBy("b").agg(F.min("label").alias("near"))
        lower = labels.join(around, labels["node"] == around["b"], "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("old"))
        lower = scratch.write(lower, f"{name}-{k}-near")
        up = lower.select(F.col("node").alias("root"), F.col("label").alias("top"))
        jumped = lower.join(up, lower["label"] == up["root"], "left").select("node", F.least("label", F.coalesce("top", "label")).alias("label"), "old")
        made = scratch.write(jumped, f"{name}-{k}")
        changed = made.filter("label <> old").limit(1).count()
        labels = made.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("components: no end after 64 rounds")

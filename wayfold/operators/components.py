"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import dealt, saved


#: Edges that one task may join by itself (some tens of MB).
FEW = 200_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Union-find over edges (u, v)."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        parent: dict = {}

        def root(x):
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            field = batch.schema.field(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
                if a != b:
                    parent[max(a, b)] = min(a, b)  # so a root is the least of its tree
        if parent:
            nodes = list(parent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, field), pa.array([root(x) for x in nodes], field)], ["node", "comp"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"node {kind}, comp {kind}")


def _forest(edges: DataFrame, most: int = FEW) -> DataFrame:
    """Edges (u, v) that connect the same nodes: of each task's edges a forest, made anew after every ``most`` nodes."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        parent: dict = {}

        def root(x):
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def trees(field):
            pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], field), pa.array([r for _, r in pairs], field)], ["u", "v"])

        field = None
        for batch in batches:
            field = batch.schema.field(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
                if a != b:
                    parent[max(a, b)] = min(a, b)  # so u > v in every edge
            if len(parent) >= most:
                yield trees(field)
        if parent:
            yield trees(field)

    return edges.select("u", "v").mapInArrow(run, f"u {kind}, v {kind}")


def connected(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, comp) of every node of ``edges`` (a, b): the least node it is connected with.

    Up to ``FEW`` edges are joined by one task. Beyond, rounds of large-star and small-star (Kiveris et al., 2014), each written as a table; long chains take a logarithmic number."""
    edges = saved(_forest(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).distinct())
    if edges.count() <= few:
        return saved(_in_one_task(edges))
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(dealt(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(dealt(small), "u")
        edges = saved(linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state or not now["n"]:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())

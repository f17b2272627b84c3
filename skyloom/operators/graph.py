"""Connected components on edge tables (G1), without collecting the graph anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.session import staged, unstage

#: Edges of a graph that one task labels, and edges that a task holds at a time when it reduces its own.
SMALL_EDGES, HELD_EDGES = 100_000, 1_000_000


def _oriented(edges: DataFrame) -> DataFrame:
    return (
        edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    hooked = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(low.select("u", F.col("m").alias("v")))


class _Forest:
    """Union-find by smallest node."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def add(self, us: list, vs: list) -> None:
        for a, b in zip(us, vs, strict=True):
            x, y = self.find(self.parent.setdefault(a, a)), self.find(self.parent.setdefault(b, b))
            if x != y:
                self.parent[max(x, y)] = min(x, y)


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = _Forest()
    for batch in batches:
        forest.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
    nodes = sorted(forest.parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], ["node", "component"])


def _spanning(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kinds = _Forest(), None

        def edges() -> pa.RecordBatch:
            pairs = [(x, r) for x in forest.parent if (r := forest.find(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kinds[k]) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            kinds = batch.schema.types
            forest.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if len(forest.parent) >= held:
                yield edges()
                forest = _Forest()
        if forest.parent:
            yield edges()

    return run


def spanning_edges(edges: DataFrame) -> DataFrame:
    """Edges u, v (v the smaller) that connect what the edges of each partition connect, one less than nodes at most.

    Each task reduces its own edges before any shuffle, HELD_EDGES nodes at a
    time, so a component of very many edges sends what its nodes make.
    """
    known = edges.where("u is not null and v is not null and u <> v")
    kinds = dict(edges.dtypes)
    return known.mapInArrow(_spanning(HELD_EDGES), f"u {kinds['u']}, v {kinds['v']}")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", small: int = SMALL_EDGES, max_rounds: int = 60) -> DataFrame:
    """Label every node that has an edge with the smallest node of its component.

    Each task first reduces its edges to a forest, so what is shuffled and
    written grows with nodes, not with edges. A forest of ``small`` edges at most
    is labelled by union-find in one task. A larger one alternates large-star and small-star steps, so chains need a number of
    rounds that is logarithmic in their length. Each round is written to the
    shared folder; hubs are never gathered in one task, since the minimum is a
    map-side combined aggregate that is joined back.

    Nulls in either end and self loops are ignored, repeated edges count once,
    and an empty table gives an empty result. Returns ``node``, ``component``.
    """
    current = staged(_oriented(spanning_edges(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")))), "cc")
    if not current.select("u").limit(small + 1).count() > small:
        return current.select(F.col("u").cast("long"), F.col("v").cast("long")).repartition(1).mapInArrow(_union_find, "node long, component long")
    print_sum = None
    for _ in range(max_rounds):
        step = staged(_oriented(_small_star(_oriented(_large_star(current)))), "cc")
        unstage(current)
        current = step
        seen = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if print_sum == tuple(seen):
            break
        print_sum = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

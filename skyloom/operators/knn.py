"""Nearest neighbours across tasks: cells of space, a first pass inside a cell, then only the cells that may hold nearer points (J6 to J8)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import staged

#: Points of a cell, about; groups of fewer have one cell.
CELL_POINTS = 4096
#: Cells of all large groups together, at most about: beyond, cells hold more points. Points that the trees are made from, about.
MAX_CELLS, SAMPLE_POINTS = 65_536, 400_000
#: Queries that one task takes in one cell, points of a leaf inside a cell, pairs that are compared at a time.
CELL_QUERIES, LEAF, PAIRS = 16_384, 64, 1 << 22
#: Distances are float32: what is nearer than this share more may still tie.
CLOSE = 1 + 1e-5


def squares(queries: np.ndarray, points: np.ndarray, scale: list[float] | None = None) -> np.ndarray:
    """Squared float32 distances, dimension by dimension."""
    d = np.zeros((len(queries), len(points)), np.float32)
    for k in range(points.shape[1]):
        gap = queries[:, None, k] - points[None, :, k]
        if scale:
            gap *= np.float32(scale[k])
        d += gap * gap
    return d


def leaves(points: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """Places of points in the leaves of a k-d tree, which halves at the median of the widest dimension."""
    found, open_ = [], [np.arange(len(points))]
    while open_:
        own = open_.pop()
        wide = np.ptp(points[own], axis=0)
        if len(own) <= most or not wide.any():
            found += [own[at : at + most] for at in range(0, len(own), most)]
            continue
        order = np.argpartition(points[own, wide.argmax()], len(own) // 2)
        open_ += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return found


@dataclass
class Cells:
    """A k-d tree over all of space: node ``i`` splits at ``cut[i]`` of dimension ``dim[i]``; below 0, ``dim`` is a leaf's -1 - number."""

    dim: np.ndarray
    cut: np.ndarray
    down: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, most: int) -> Cells:
        """Leaves of ``most`` points of the sample at most, but for points that are alike."""
        dim, cut, down, open_, n = [0], [0.0], [0], [(0, sample)], 0
        while open_:
            at, own = open_.pop()
            wide = np.ptp(own, axis=0) if len(own) else np.zeros(1)
            k = int(wide.argmax())
            middle = float(np.partition(own[:, k], len(own) // 2)[len(own) // 2]) if len(own) > most else 0.0
            left = own[:, k] < middle if len(own) > most else None
            if left is not None and not left.any():  # the median is the least value
                middle = float(np.min(own[own[:, k] > middle, k], initial=np.inf))
                left = own[:, k] < middle
            if left is None or not wide.any() or left.all():
                dim[at], n = -1 - n, n + 1
                continue
            dim[at], cut[at], down[at] = k, middle, len(dim)
            dim += [0, 0]
            cut += [0.0, 0.0]
            down += [0, 0]
            open_ += [(down[at], own[left]), (down[at] + 1, own[~left])]
        return cls(np.array(dim), np.array(cut), np.array(down))

    def __len__(self) -> int:
        return (len(self.dim) + 1) // 2

    def of_points(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each point falls in."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.dim[at] >= 0)
            if not len(inner):
                return -1 - self.dim[at]
            node = at[inner]
            at[inner] = self.down[node] + ~(x[inner, self.dim[node]] < self.cut[node])


def _best(parts: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, ids, d = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((ids, d, q))
    q, ids, d = q[order], ids[order], d[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], ids[first], d[first]


def k_nearest(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, scales: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query places, point ids and squared distances of the k nearest points, ties by id, and the points that each query was compared with.

    Both sides are dealt to leaves of k-d trees. A leaf of queries looks at the
    leaves of points around it, nearest first, until no further one can hold a
    nearer point than those that it has.
    """
    k = min(k, len(points))
    compared = np.zeros(len(queries), np.int64)
    scale = np.array(scales)
    held = leaves(points * scale)
    low, high = (np.array([f(points[own], axis=0) for own in held], np.float64) * scale for f in (np.min, np.max))
    low, high = np.minimum(low, high), np.maximum(low, high)
    size = np.array([len(own) for own in held])
    parts = []
    for own in leaves(queries * scale):
        box = queries[own].astype(np.float64) * scale
        apart = np.maximum(np.maximum(low - box.max(axis=0), box.min(axis=0) - high), 0)
        away = (apart * apart).sum(axis=1)
        order = np.argsort(away, kind="stable")
        enough = int(np.searchsorted(np.cumsum(size[order]), k)) + 1
        found, begin = None, 0
        while True:
            near = np.concatenate([held[i] for i in order[begin:enough]])
            more = []
            for at in range(0, len(near), max(k, PAIRS // LEAF)):
                part = near[at : at + max(k, PAIRS // LEAF)]
                d = squares(queries[own], points[part], scales)
                most = min(k, len(part)) - 1
                q, p = np.nonzero(d <= np.partition(d, most, axis=1)[:, most : most + 1])
                more.append((q, ids[part[p]], d[q, p]))
            compared[own] += len(near)
            found = _best([*([found] if found else []), *more], k)
            kth = found[2][np.searchsorted(found[0], np.arange(len(own)), side="right") - 1]
            reach = int(np.searchsorted(away[order], float(kth.max()) * CLOSE, side="right"))
            begin = enough
            if reach <= enough:
                break
            enough = reach
        parts.append((own[found[0]], found[1], found[2]))
    q, found_ids, d = (np.concatenate(c) for c in zip(*parts, strict=True))
    return q, found_ids, d, compared


def _group(keys: list[str]):
    """One text for each group; a null key is a value."""
    return F.to_json(F.struct(*keys)) if keys else F.lit("")


def _trees(points: DataFrame, dims: list[str]) -> dict[str, Cells]:
    """A tree for each group of more than CELL_POINTS points, from a sample that is drawn by hash."""
    sizes = points.groupBy("_g").agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(CELL_POINTS, total // MAX_CELLS)
    large = {r["_g"]: r["n"] for r in sizes.where(F.col("n") > most).collect()}  # MAX_CELLS at most
    if not large:
        return {}
    names = F.broadcast(points.sparkSession.createDataFrame([(g,) for g in large], "_g string"))
    share = min(1.0, SAMPLE_POINTS / sum(large.values()))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = points.where(drawn).join(names, "_g", "left_semi").select("_g", *dims).toPandas()
    found = {g: Cells.of(own[dims].to_numpy(np.float32), max(8, int(most * share))) for g, own in sample.groupby("_g")}
    return {g: c for g, c in found.items() if len(c) > 1}


def _placed(rows: DataFrame, trees: dict[str, Cells], dims: list[str]) -> DataFrame:
    """Rows with the cell that they lie in: 0 in groups without a tree."""
    if not trees:
        return rows.withColumn("_cell", F.lit(0))
    held = rows.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("int")
    def cell(group: pd.Series, *values: pd.Series) -> pd.Series:
        out, x = np.zeros(len(group), np.int32), np.column_stack([v.to_numpy(np.float32) for v in values])
        for g, own in group.groupby(group).indices.items():
            if g in held.value:
                out[own] = held.value[g].of_points(x[own])
        return pd.Series(out)

    return rows.withColumn("_cell", cell("_g", *dims))


def _dealt(queries: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """Queries and points of one table; a cell's queries are dealt to parts of CELL_QUERIES, and its points repeated for each."""
    parts = queries.groupBy(*by).agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")
    asked = queries.join(parts, by).withColumn("_part", part).drop("_parts")
    repeated = points.join(parts, by).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return asked.unionByName(repeated)


def knn(points: DataFrame, queries: DataFrame, k: int, dims: list[str], keys: list[str] | None = None, scale: list[float] | None = None) -> DataFrame:
    """The k nearest points of each query within a group, by scaled float32 distance; ties go to the smaller point id.

    ``points`` has keys, point_id and dims; ``queries`` keys, query_id and
    dims. A scale of 0 counts as 1. Groups with fewer than k points give all.
    Rows with a null or NaN coordinate are no neighbours and have none; a null
    key is a group of its own.

    Space is cut into cells by a k-d tree for each large group; leaves cover all
    of space, so the sample that the tree comes from decides the balance only.
    A query looks for its neighbours in its own cell, and then in those cells
    whose points' box is no farther than the k-th that it has. Of points at the
    same place only the k smallest ids can be found, so no place fills a cell;
    queries of a cell are dealt to several tasks.
    """
    return knn_compared(points, queries, k, dims, keys, scale).drop("compared")


def knn_compared(points: DataFrame, queries: DataFrame, k: int, dims: list[str], keys: list[str] | None = None, scale: list[float] | None = None) -> DataFrame:
    """As knn(), with the number of points that each query was compared with."""
    keys = keys or []
    scales = [s or 1.0 for s in (scale or [1.0] * len(dims))]
    size = np.abs(np.array(scales))
    kinds = dict(points.dtypes)
    axes = [f"_d{i}" for i in range(len(dims))]  # names that no key has
    whole = lambda df, name, asks: df.select(*keys, _group(keys).alias("_g"), F.col(name).alias("id"), F.lit(asks).alias("asks"), *[F.col(c).cast("float").alias(a) for c, a in zip(dims, axes, strict=True)])
    usable = " and ".join(f"{a} is not null and not isnan({a})" for a in axes)
    here = Window.partitionBy("_g", *axes).orderBy("id")
    p = whole(points, "point_id", False).where(usable).withColumn("_r", F.row_number().over(here)).where(F.col("_r") <= k).drop("_r")
    p, q = staged(p, "points"), whole(queries, "query_id", True).where(usable)
    trees = _trees(p, axes)
    p, q = _placed(p, trees, axes), _placed(q, trees, axes)
    cells = ["_g", "_cell"]
    boxes: dict[str, tuple[np.ndarray, ...]] = {}
    if trees:
        p = staged(p, "points")
        edges = p.groupBy(*cells).agg(*[f(a).alias(f"{n}{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))])
        names = F.broadcast(p.sparkSession.createDataFrame([(g,) for g in trees], "_g string"))
        for g, own in edges.join(names, "_g", "left_semi").toPandas().groupby("_g"):  # a row for each cell of a tree
            low, high = (own[[f"{n}{a}" for a in axes]].to_numpy(np.float64) * scales for n in ("lo", "hi"))
            boxes[g] = own["_cell"].to_numpy(), np.minimum(low, high), np.maximum(low, high)
    held = p.sparkSession.sparkContext.broadcast(boxes)
    columns = [*keys, "query_id", "point_id", "dist_sq", "compared", "_cell", *axes]
    schema = "".join(f"{c} {kinds[c]}, " for c in keys) + "query_id long, point_id long, dist_sq double, compared long, _cell int, " + ", ".join(f"{a} float" for a in axes)

    def found(g: pd.DataFrame, certify: bool) -> pd.DataFrame:
        asked, there = g[g.asks], g[~g.asks]
        if not len(asked):
            return pd.DataFrame({c: [] for c in columns})
        x, n = asked[axes].to_numpy(np.float32), len(asked)
        if len(there):
            q, ids, d, compared = k_nearest(there[axes].to_numpy(np.float32), there.id.to_numpy(), x, k, scales)
        else:
            q, ids, d, compared = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(n, np.int64)
        out = pd.DataFrame({"query_id": asked.id.to_numpy()[q], "point_id": ids, "dist_sq": d.astype(np.float64), "_cell": -1})
        out["compared"] = np.where(np.append(True, q[1:] != q[:-1])[: len(q)], compared[q], 0)
        for c in axes:
            out[c] = np.float32(0)
        own = held.value.get(g["_g"].iloc[0])
        if certify and own is not None:
            number, low, high = own
            counts = np.bincount(q, minlength=n)
            kth = np.full(n, np.inf)
            last = np.cumsum(counts) - 1
            order = np.argsort(q, kind="stable")
            full = counts >= k
            kth[full] = d[order][last[full]]
            visits = []
            for part in leaves(x * size):
                at = x[part].astype(np.float64) * scales
                apart = np.maximum(np.maximum(low - at.max(axis=0), at.min(axis=0) - high), 0)
                near = np.flatnonzero(((apart * apart).sum(axis=1) <= kth[part].max() * CLOSE) & (number != g["_cell"].iloc[0]))
                apart = np.maximum(np.maximum(low[None, near] - at[:, None], at[:, None] - high[None, near]), 0)
                a, b = np.nonzero((apart * apart).sum(axis=2) <= kth[part][:, None] * CLOSE)
                visits.append((part[a], number[near[b]]))
            a, b = (np.concatenate(c) for c in zip(*visits, strict=True))
            more = pd.DataFrame({"query_id": asked.id.to_numpy()[a], "point_id": 0, "dist_sq": kth[a], "_cell": b, "compared": 0, **{c: x[a, i] for i, c in enumerate(axes)}})
            out = pd.concat([out, more])
        for c in keys:
            out[c] = asked[c].iloc[0]
        return out[columns]

    by = [*keys, "_g", "_cell", "_part"]
    first = _dealt(q, p, cells).groupBy(*by).applyInPandas(lambda g: found(g, True), schema)
    finds = first
    if trees:
        first = staged(first, "finds")
        visits = first.where("_cell >= 0").select(*keys, _group(keys).alias("_g"), F.col("query_id").alias("id"), F.lit(True).alias("asks"), *axes, "_cell")
        second = _dealt(visits, p, cells).groupBy(*by).applyInPandas(lambda g: found(g, False), schema)
        finds = first.where("_cell < 0").unionByName(second)
    one = Window.partitionBy(*keys, "query_id")
    ranked = finds.withColumn("rank", F.row_number().over(one.orderBy("dist_sq", "point_id"))).withColumn("compared", F.sum("compared").over(one))
    return ranked.where(F.col("rank") <= k).select(*keys, "query_id", "rank", "point_id", "dist_sq", "compared")


def nearest(points: DataFrame, queries: DataFrame, dims: list[str], keys: list[str] | None = None, scale: list[float] | None = None) -> DataFrame:
    """The nearest point of each query."""
    return knn(points, queries, 1, dims, keys, scale).drop("rank")

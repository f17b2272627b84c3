"""Line tools: members of a line, combination of lines, RANSAC fits (A12, FL18, A24)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.angles import line_distance


def on_line(points: DataFrame, max_distance: float, x: str = "phi", y: str = "lam", theta: str = "theta", rho: str = "rho") -> DataFrame:
    """Points within ``max_distance`` of their row's line."""
    return points.where(line_distance(x, y, theta, rho) <= max_distance)


def combine_lines(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Weighted mean line of each group: weights are positive significances; without any, the first line.

    sigma is the root of the sum of squares of positive significances.
    """
    w = F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(0.0)
    total = F.sum(w)
    mean = lambda c: F.when(total > 0, F.sum(w * F.col(c)) / total).otherwise(F.min_by(c, order))
    return lines.groupBy(*keys).agg(mean("theta").alias("theta"), mean("rho").alias("rho"), F.sqrt(F.sum(w * w)).alias("sigma"))


def _best_line(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[int, float, float]:
    """Inliers, angle and offset of the best of the lines through pairs of points, all tried together."""
    dx, dy = x[b] - x[a], y[b] - y[a]
    some = np.hypot(dx, dy) >= 1e-10
    if not some.any():
        return 0, 0.0, 0.0
    theta = np.arctan2(dx[some], -dy[some])
    rho = x[a[some]] * np.cos(theta) + y[a[some]] * np.sin(theta)
    inliers = (np.abs(np.cos(theta)[:, None] * x + np.sin(theta)[:, None] * y - rho[:, None]) <= threshold).sum(axis=1)
    best = int(inliers.argmax())
    return int(inliers[best]), float(theta[best]), float(rho[best])


def drawn_pairs(name: str, n: int, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of two different points of ``n`` for each trial, from the MD5 sum of the group's name and the trial's number."""
    digits = [hashlib.md5(f"{name}-{t}".encode()).hexdigest() for t in range(iterations)]
    first = np.array([int(d[:8], 16) for d in digits]) % n
    return first, (first + 1 + np.array([int(d[8:16], 16) for d in digits]) % (n - 1)) % n


def ransac_lines(points: DataFrame, keys: list[str], threshold: float, iterations: int, seed: int = 1, x: str = "phi", y: str = "lam") -> DataFrame:
    """For each group, of ``iterations`` random pairs the line of most inliers; the earliest wins a tie.

    Pairs are drawn by a hash of the seed, the group's keys and the trial, from
    the points in the order of x and y, so reruns and other engines agree.
    Groups of fewer than two points, or whose pairs all coincide, give no row.
    A group travels as two lists, so it should be bounded; groups here are
    cells, of max_roi_stars points at most.
    """
    pairs = F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))
    name = F.concat_ws("-", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    lists = points.groupBy(*keys).agg(pairs.alias("_p")).where(F.size("_p") > 1).select(*keys, name.alias("_name"), F.col("_p.x").alias("_x"), F.col("_p.y").alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = [], len(keys)
            for i in range(batch.num_rows):
                xs, ys = (np.asarray(batch.column(n + k)[i].values) for k in (1, 2))
                own.append(_best_line(xs, ys, *drawn_pairs(batch.column(n)[i].as_py(), len(xs), iterations), threshold))
            found = pa.array([r[0] > 0 for r in own])
            columns = [pa.array([r[k] for r in own], t) for k, t in enumerate((pa.int32(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(n)), *columns], [*keys, "inliers", "theta", "rho"]).filter(found)

    kinds = dict(points.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", inliers int, theta double, rho double"
    return lists.mapInArrow(run, schema)

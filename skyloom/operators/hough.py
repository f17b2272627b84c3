"""Line detection by Hough voting (A13 to A16)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.config import DetectConfig
from skyloom.operators.windows import cap_rois, gate_srs, sr_counts

CELL = ["patch_id", "p", "q"]
#: Cells whose votes are counted together.
CELLS_AT_ONCE = 64


def hough_votes(points: DataFrame, cfg: DetectConfig, keys: list[str] = CELL, x: str = "phi", y: str = "lam") -> DataFrame:
    """Votes of points for lines: counts by keys, angle bin t and offset bin r.

    Columns of ``points`` other than keys, x and y go into no bin; a column n
    (the group's size) is carried along. Input that is partitioned by the keys
    is counted without another shuffle.
    """
    carry = [c for c in ("n", "n_selected") if c in points.columns]
    narrow = points.select(*keys, *carry, x, y).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(cfg.n_theta - 1))))
    theta = F.lit(-math.pi) + (F.col("t") + 0.5) * F.lit(2 * math.pi / cfg.n_theta)
    rho = F.col(x) * F.cos(theta) + F.col(y) * F.sin(theta)
    bins = narrow.withColumn("r", F.floor((rho + cfg.rho_max) / (2 * cfg.rho_max / cfg.n_rho)).cast("int"))
    return bins.where(F.col("r").between(0, cfg.n_rho - 1)).groupBy(*keys, *carry, "t", "r").agg(F.count("*").alias("votes"))


def line_significance(votes, n, n_rho: int = 100) -> Column:
    """Excess of a peak over an even spread, with floors for lines that hold much of the group."""
    votes, n = F.col(votes).cast("double"), F.col(n).cast("double")
    even = F.greatest(F.lit(1.0), n / n_rho)
    s = (votes - even) / F.greatest(F.lit(1.0), F.sqrt(even))
    s = F.when(votes / n > 0.3, F.greatest(s, F.lit(5.0))).otherwise(s)
    s = F.when(votes / n > 0.5, F.greatest(s, F.lit(8.0))).otherwise(s)
    return F.when((votes > 0) & (n > 0), s).otherwise(0.0)


def hough_peaks(votes: DataFrame, cfg: DetectConfig, keys: list[str] = CELL) -> DataFrame:
    """The line of most votes of each group; the lowest angle bin, then offset bin, wins a tie."""
    carry = [c for c in ("n", "n_selected") if c in votes.columns]
    best = votes.groupBy(*keys, *carry).agg(F.max(F.struct("votes", (-F.col("t")).alias("t"), (-F.col("r")).alias("r"))).alias("b"))
    theta = F.lit(-math.pi) + (0.5 - F.col("b.t")) * F.lit(2 * math.pi / cfg.n_theta)
    rho = F.lit(-cfg.rho_max) + (0.5 - F.col("b.r")) * F.lit(2 * cfg.rho_max / cfg.n_rho)
    return best.select(*keys, *carry, F.col("b.votes").alias("votes"), theta.alias("theta"), rho.alias("rho"))


def _peak_finder(cfg: DetectConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta = -math.pi + (np.arange(cfg.n_theta) + 0.5) * (2 * math.pi / cfg.n_theta)
        cos, sin, width = np.cos(theta), np.sin(theta), 2 * cfg.rho_max / cfg.n_rho
        size = cfg.n_theta * cfg.n_rho
        for batch in batches:
            for at in range(0, batch.num_rows, CELLS_AT_ONCE):
                part = batch.slice(at, CELLS_AT_ONCE)
                xs, ys = part.column(4), part.column(5)
                n = np.diff(np.asarray(xs.offsets))
                x, y = np.asarray(xs.flatten()), np.asarray(ys.flatten())
                r = np.floor((x[:, None] * cos + y[:, None] * sin + cfg.rho_max) / width).astype(np.int64)
                place = (np.repeat(np.arange(len(n)), n)[:, None] * cfg.n_theta + np.arange(cfg.n_theta)) * cfg.n_rho + r
                votes = np.bincount(place[(r >= 0) & (r < cfg.n_rho)], minlength=len(n) * size).reshape(-1, size)
                best = votes.argmax(axis=1)  # the first of equal ones: lowest angle, then offset
                t, k = best // cfg.n_rho, best % cfg.n_rho
                most = votes[np.arange(len(n)), best]
                some = pa.array(most > 0)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in range(4)), pa.array(n, pa.int32()), pa.array(most, pa.int64()), pa.array(theta[t]), pa.array(-cfg.rho_max + (k + 0.5) * width)],
                    ["patch_id", "p", "q", "n", "n_selected", "votes", "theta", "rho"],
                ).filter(some)

    return run


def cell_lines(cell_stars: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Peak line and significance of each cell, over its selected stars.

    The same peaks as hough_peaks(hough_votes(...)): a cell has max_roi_stars
    stars at most, so its positions go as two short lists to numpy, which counts
    the votes of many cells at once instead of making n_theta rows of each star.
    """
    lists = cell_stars.groupBy(*CELL, "n").agg(F.collect_list("phi").alias("x"), F.collect_list("lam").alias("y"))
    peaks = lists.mapInArrow(_peak_finder(cfg), "patch_id int, p int, q int, n long, n_selected int, votes long, theta double, rho double")
    return peaks.withColumn("sigma", line_significance("votes", "n_selected", cfg.n_rho))


def roi_table(star_patch: DataFrame, lines: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Significant regions of interest: each cell once for each of its axes whose signal region passes.

    axis 0 takes the cell's pmra window as signal region i and its pmdec window
    as cross window j, axis 1 the other way round. roi orders a patch's regions.
    """
    good = gate_srs(sr_counts(star_patch, cfg), cfg).select("patch_id", "axis", "i")
    strong = lines.where(F.col("sigma") >= cfg.roi_sigma_cut)
    sides = F.explode(F.array(
        F.struct(F.lit(0).alias("axis"), F.col("p").alias("i"), F.col("q").alias("j")),
        F.struct(F.lit(1).alias("axis"), F.col("q").alias("i"), F.col("p").alias("j")),
    ))
    both = strong.withColumn("_s", sides).select(*strong.columns, "_s.axis", "_s.i", "_s.j")
    kept = cap_rois(both.join(good, ["patch_id", "axis", "i"]), cfg)
    w = cfg.n_windows
    roi = ((F.col("patch_id").cast("long") * w + F.col("i")) * 2 + F.col("axis")) * w + F.col("j")
    return kept.withColumn("roi", roi)

"""Overlapping windows in proper motion: signal regions and cells (J3 to J5, W3, W4, FL9, FL10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.config import DetectConfig
from skyloom.session import staged

#: Rows of cells that one task sorts, about, and stars of a cell from which it is sorted in slices of so many.
TASK_ROWS, SLICE_ROWS = 500_000, 500_000


def window_ids(pm: str, cfg: DetectConfig) -> Column:
    """The windows [start, start + width) that hold a proper motion; window k starts at pm_min + k step.

    A range that is one too wide on both sides is checked by the exact
    half-open predicate, so rounding in the division cannot matter.
    """
    x = F.col(pm)
    low = F.floor((x - cfg.pm_min - cfg.sr_width) / cfg.sr_step) - 1
    high = F.floor((x - cfg.pm_min) / cfg.sr_step) + 1
    inside = lambda k: (x >= cfg.pm_min + k * cfg.sr_step) & (x < cfg.pm_min + k * cfg.sr_step + cfg.sr_width)
    held = F.filter(F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(cfg.n_windows - 1))), inside)
    lowest, highest = cfg.pm_min, cfg.pm_min + (cfg.n_windows - 1) * cfg.sr_step + cfg.sr_width
    return F.when((x >= lowest) & (x < highest), held)


def sr_members(star_patch: DataFrame, cfg: DetectConfig) -> DataFrame:
    """A row for each star, axis (0: pmra, 1: pmdec) and window i."""
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), window_ids(pm, cfg).alias("ks")) for a, pm in ((0, "pmra"), (1, "pmdec"))]))
    wide = star_patch.withColumn("_w", axes)
    return wide.withColumn("axis", F.col("_w.axis")).withColumn("i", F.explode("_w.ks")).withColumn("i", F.col("i").cast("int")).drop("_w")


def sr_counts(star_patch: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Stars in each signal region and, as the rest of the patch, in its sideband."""
    narrow = star_patch.select("patch_id", "pmra", "pmdec")
    counted = sr_members(narrow, cfg).groupBy("patch_id", "axis", "i").agg(F.count("*").alias("n_sr"))
    total = narrow.groupBy("patch_id").agg(F.count("*").alias("n_patch"))
    return counted.join(total, "patch_id").select("patch_id", "axis", "i", "n_sr", (F.col("n_patch") - F.col("n_sr")).alias("n_sb"))


def gate_srs(counts: DataFrame, cfg: DetectConfig) -> DataFrame:
    return counts.where(F.col("n_sr").between(cfg.min_stars_sr, cfg.max_stars_sr))


def sideband_members(star_patch: DataFrame, regions: DataFrame, cfg: DetectConfig) -> DataFrame:
    """A row for each star of a patch outside each of the given regions (patch_id, axis, i) of the patch.

    These are stars times regions, so ask for the regions that are looked at;
    scores do without these rows.
    """
    start = F.lit(cfg.pm_min) + F.col("i") * cfg.sr_step
    pm = F.when(F.col("axis") == 0, F.col("pmra")).otherwise(F.col("pmdec"))
    return star_patch.join(regions.select("patch_id", "axis", "i"), "patch_id").where(~((pm >= start) & (pm < start + cfg.sr_width)))


def cells(star_patch: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Stars of each (pmra window p, pmdec window q) of a patch, with the cell's size n.

    Cells with fewer than min_stars_roi drop out; of more than max_roi_stars,
    every (n div max_roi_stars)-th in the order of star_id stays, max_roi_stars
    at most. Rows are dealt by cell, and not by patch, to as many tasks as make
    TASK_ROWS each, so more stars are more tasks and not larger ones; a cell of
    more than SLICE_ROWS is ordered in slices of its range of star_id.
    """
    cell, spark = ["patch_id", "p", "q"], star_patch.sparkSession
    ks = star_patch.withColumn("p", F.explode(window_ids("pmra", cfg))).withColumn("q", F.explode(window_ids("pmdec", cfg)))
    ks = ks.withColumns({"p": F.col("p").cast("int"), "q": F.col("q").cast("int")})
    sizes = staged(ks.groupBy(*cell).agg(F.count("*").alias("_size"), F.min("star_id").cast("double").alias("_lo"), F.max("star_id").cast("double").alias("_hi")), "sizes")
    rows = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    large = sizes.where(F.col("_size") > SLICE_ROWS)  # rows / SLICE_ROWS at most
    slices = F.ceil(F.col("_size") / SLICE_ROWS)
    place = F.floor((F.col("star_id").cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * slices)
    sliced = lambda how: ks.join(F.broadcast(large), cell, how).withColumn("_slice", F.least(F.coalesce(place, F.lit(0)), slices - 1))
    if large.isEmpty():
        own, dealt = cell, ks.withColumns({"_before": F.lit(0), "_size": F.lit(None).cast("long")})
    else:
        own = [*cell, "_slice"]
        upto = F.sum("_own").over(Window.partitionBy(*cell).orderBy("_slice"))
        before = sliced("inner").groupBy(*own).agg(F.count("*").alias("_own")).withColumn("_before", upto - F.col("_own")).drop("_own")
        dealt = sliced("left").drop("_lo", "_hi").join(F.broadcast(before), own, "left").withColumn("_before", F.coalesce("_before", F.lit(0)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    part = Window.partitionBy(*own)
    placed = dealt.repartition(tasks, *own).withColumn("rn", F.row_number().over(part.orderBy("star_id")) - 1 + F.col("_before"))
    placed = placed.withColumn("n", F.coalesce("_size", F.count("*").over(part)))
    step = F.greatest(F.floor(F.col("n") / cfg.max_roi_stars), F.lit(1))
    chosen = (F.col("rn") % step == 0) & (F.floor(F.col("rn") / step) < cfg.max_roi_stars)
    kept = placed.where((F.col("n") >= cfg.min_stars_roi) & chosen)
    return kept.withColumn("ordinal", F.floor(F.col("rn") / step).cast("int")).select(*ks.columns, "n", "ordinal")


def cap_rois(rois: DataFrame, cfg: DetectConfig) -> DataFrame:
    """The first max_rois_per_patch regions of each patch in the order of window, axis and cross window."""
    order = Window.partitionBy("patch_id").orderBy("i", "axis", "j")
    return rois.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= cfg.max_rois_per_patch).drop("_rn")

"""Take a survey's new files: stars in their patches, and the signal regions that are full enough to search.

A survey delivers files for years, and a detection run needs to know which
patches and windows of proper motion hold enough stars. This job takes only
files that it has not seen:

* ``star_patch`` grows by the stars of new files that pass the sky cuts, once for
  each patch that they lie in, with their patch coordinates; partitions are
  zones of declination of the patches' centres.
* ``regions`` holds, for every patch and window, the stars inside (n_sr) and in
  the rest of the patch (n_sb), where both limits are met; same partitions.

Both are streams over files that end when nothing new is there. What has been
taken, and the running counts, are in the checkpoint folder: a run without new
files changes nothing, and a run that was broken off is finished by the next. A
file is taken once, by its path; each of its rows counts. Counts are one for
each patch and window, 5,000 times 476 at most, however many stars there are.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobs.common import command_line, log
from skyloom.config import DetectConfig
from skyloom.operators import cuts, patches, windows
from skyloom.sources.catalog import normalise
from skyloom.sources.demo import stars_of_events

DEFAULTS = {
    "stars": "events", "ra_min": 0.0, "ra_max": 360.0, "dec_min": -90.0, "dec_max": 90.0, "patch_radius": 1.78,
    "min_stars_patch": 50, "min_stars_sr": 10, "max_stars_sr": 100_000, "files_per_batch": 200,
}
STAR = ["star_id", "patch_id", "ra", "dec", "pmra", "pmdec", "rv", "distance", "phi", "lam", "mu_phi", "mu_lam", "dist_from_center"]
#: The window that stands for the whole patch.
ALL = -1


def stars_of(rows: DataFrame, kind: str) -> DataFrame:
    """Stars of a catalogue with headers as surveys have them, named by target_id, or of an events table."""
    if kind == "events":
        return stars_of_events(rows)
    if kind == "catalogue":
        named = normalise(rows, F.lit(0), texts=False)
        return named.withColumn("star_id", F.col("target_id"))
    raise ValueError(f"stars must be events or catalogue, not {kind}")


def finished(query: StreamingQuery, what: str) -> int:
    """Wait for a stream to end; rows that it took."""
    query.awaitTermination()
    taken = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("%s: took %d new rows in %d batches", what, taken, sum(p["numInputRows"] > 0 for p in query.recentProgress))
    return taken


def take_stars(spark: SparkSession, source: str, output: str, checkpoint: str, chosen: dict, cfg: DetectConfig) -> int:
    schema = spark.read.parquet(source).schema
    path = source.rstrip("/")
    # a pattern that only this path meets: streams read folders, and by a pattern a single file as well
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", chosen["files_per_batch"]).parquet(f"{path[:-1]}[{path[-1]}]")
    held = cuts.sky_cuts(stars_of(rows, chosen["stars"]), cfg)
    grid = patches.patches_frame(spark, patches.patch_grid(cfg))
    near = patches.assign_patches(held, grid, cfg.patch_radius)
    zones = grid.select("patch_id", F.floor(F.col("center_dec")).cast("int").alias("zone"))
    placed = near.join(F.broadcast(zones), "patch_id").select(*STAR, "zone")  # a row for each patch: MAX_PATCHES at most
    writer = placed.writeStream.format("parquet").partitionBy("zone").option("checkpointLocation", f"{checkpoint}/stars")
    return finished(writer.trigger(availableNow=True).start(f"{output}/star_patch"), f"stars of {source}")


def count_regions(spark: SparkSession, output: str, checkpoint: str, chosen: dict, cfg: DetectConfig) -> int:
    schema = spark.read.parquet(f"{output}/star_patch").schema
    stars = spark.readStream.schema(schema).option("maxFilesPerTrigger", chosen["files_per_batch"]).parquet(f"{output}/star_patch")
    narrow = stars.select("zone", "patch_id", "pmra", "pmdec")
    inside = windows.sr_members(narrow, cfg).select("zone", "patch_id", "axis", "i")
    whole = narrow.select("zone", "patch_id", F.lit(ALL).alias("axis"), F.lit(ALL).alias("i"))
    counts = inside.unionByName(whole).groupBy("zone", "patch_id", "axis", "i").count()

    def write(counted: DataFrame, batch: int) -> None:
        # the counts are used once in the plan, since they move the stream's state on
        patch = F.max(F.when(F.col("axis") == ALL, F.col("count"))).over(Window.partitionBy("patch_id"))
        found = counted.withColumn("n_patch", patch).where((F.col("axis") != ALL) & (F.col("n_patch") >= cfg.min_stars_patch)).withColumnRenamed("count", "n_sr")
        found = windows.gate_srs(found.withColumn("n_sb", F.col("n_patch") - F.col("n_sr")), cfg)
        found.select("patch_id", "axis", "i", "n_sr", "n_sb", "zone").write.mode("overwrite").partitionBy("zone").parquet(f"{output}/regions")
        log.info("regions: written anew to %s/regions by batch %d", output, batch)

    writer = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{checkpoint}/regions")
    return finished(writer.trigger(availableNow=True).start(), f"regions of {output}/star_patch")


def run(spark: SparkSession, source: str, output: str, checkpoint: str, settings: dict | None = None) -> dict[str, int]:
    """Take the new files below ``source``; rows that each step took."""
    chosen = {**DEFAULTS, **(settings or {})}
    cfg = replace(DetectConfig(), **{c: v for c, v in chosen.items() if c not in ("stars", "files_per_batch")})
    output, checkpoint = output.rstrip("/"), checkpoint.rstrip("/")
    log.info("reading new files of %s, writing to %s, marks in %s", source, output, checkpoint)
    taken = {"stars": take_stars(spark, source, output, checkpoint, chosen, cfg), "regions": count_regions(spark, output, checkpoint, chosen, cfg)}
    stars, regions = read_output(spark, output)
    log.info("%s/star_patch now holds %d rows, %s/regions %d", output, stars.count(), output, regions.count())
    return taken


def read_output(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """Stars in patches and regions, as the last run left them."""
    return spark.read.parquet(f"{output}/star_patch"), spark.read.parquet(f"{output}/regions")


if __name__ == "__main__":
    command_line("survey_ingest", {"source": "folder (or file) of Parquet files that grows", "output": "folder of the tables", "checkpoint": "folder of the marks"}, DEFAULTS, run)

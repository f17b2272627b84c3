"""Catalogues in the order of the sky, so that cuts and patches read the row groups that they meet (FL1, FL2, J1)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.config import DetectConfig

#: Height of a zone of declination in degrees, and parts of right ascension in each.
ZONE, PARTS = 0.5, 4096
#: Ranges that a filter has at most; beyond, the closest become one.
MAX_RANGES = 128
#: Bytes of a row group: the unit that a cut skips.
GROUP_BYTES = 8 << 20
#: Degrees by which ranges are wider than what they must hold.
MARGIN = 1e-6


def sky_cell(ra: str = "ra", dec: str = "dec") -> Column:
    """The zone of declination and the part of right ascension as one number; -1 where a position is null or NaN."""
    zone = F.floor((F.greatest(F.least(F.col(dec), F.lit(90.0)), F.lit(-90.0)) + 90) / ZONE)
    part = F.least(F.greatest(F.floor(F.col(ra) / 360 * PARTS), F.lit(0)), F.lit(PARTS - 1))
    known = F.col(ra).isNotNull() & F.col(dec).isNotNull() & ~F.isnan(ra) & ~F.isnan(dec)
    return F.when(known, zone * PARTS + part).otherwise(-1).cast("long")


def write_sky_catalogue(stars: DataFrame, path: str, files: int | None = None, group_bytes: int = GROUP_BYTES) -> None:
    """Write stars as Parquet in the order of their cells, ``sky_cell`` first.

    Files are ranges of cells, and a cell of many stars may lie in several: ties
    are broken by right ascension and a hash. One shuffle.
    """
    order = ["sky_cell", "ra", F.xxhash64(*[F.col(f"`{c}`") for c in stars.columns])]
    placed = stars.select(sky_cell().alias("sky_cell"), *[F.col(f"`{c}`") for c in stars.columns if c != "sky_cell"])
    dealt = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.option("parquet.block.size", group_bytes).mode("overwrite").parquet(path)


def _cells(zone: int, low: float, high: float) -> list[tuple[int, int]]:
    """Cells of a zone between two right ascensions, the second of which may be beyond 360 or the first below 0."""
    if high - low >= 360:
        return [(zone * PARTS, zone * PARTS + PARTS - 1)]
    low, high = low % 360, high % 360
    spans = [(low, high)] if low <= high else [(0.0, high), (low, 360.0)]
    return [(zone * PARTS + min(int(a / 360 * PARTS), PARTS - 1), zone * PARTS + min(int(b / 360 * PARTS), PARTS - 1)) for a, b in spans]


def _zones(low: float, high: float) -> range:
    return range(int((max(low - MARGIN, -90.0) + 90) / ZONE), int((min(high + MARGIN, 90.0) + 90) / ZONE) + 1)


def box_ranges(cfg: DetectConfig) -> list[tuple[int, int]]:
    """Ranges of cells that hold all of a run's box on the sky; a box whose first right ascension is the larger wraps."""
    low, high = cfg.ra_min, cfg.ra_max + (360 if cfg.ra_min > cfg.ra_max else 0)
    return merged([r for z in _zones(cfg.dec_min, cfg.dec_max) for r in _cells(z, low - MARGIN, high + MARGIN)])


def patch_ranges(centres: list[tuple[float, float]], radius: float) -> list[tuple[int, int]]:
    """Ranges of cells that hold all of the discs of ``radius`` around the centres (ra, dec)."""
    found = []
    for ra, dec in centres:
        pole = abs(dec) + radius >= 90 - MARGIN
        half = 180.0 if pole else math.degrees(math.asin(min(1.0, math.sin(math.radians(radius)) / math.cos(math.radians(dec))))) + MARGIN
        found += [r for z in _zones(dec - radius, dec + radius) for r in _cells(z, ra - half, ra + half)]
    return merged(found)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch as one, and the closest as one until there are MAX_RANGES."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    if len(out) > MAX_RANGES:
        gaps = sorted(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1], reverse=True)
        cuts = sorted(gaps[: MAX_RANGES - 1])
        out = [(out[a][0], out[b - 1][1]) for a, b in zip([0, *cuts], [*cuts, len(out)], strict=True)]
    return out


def read_sky_catalogue(spark: SparkSession, path: str, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """Stars of a catalogue that write_sky_catalogue() wrote, all or those of some ranges of cells.

    The ranges become comparisons of one integer column, so files and row
    groups beyond them are not read. What comes is more than a box or a disc
    holds: cut exactly afterwards. No range gives no star.
    """
    stars = spark.read.parquet(path)
    if ranges is None:
        return stars.drop("sky_cell")
    inside = F.lit(False)
    for low, high in ranges:
        inside = inside | F.col("sky_cell").between(low, high)
    return stars.where(inside).drop("sky_cell")

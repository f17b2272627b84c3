"""Passes of a survey over each star (A25, J14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.angles import separation

#: Cells of the sky that a radius is long.
CELLS = 48
#: Degrees by which a cell counts as larger than it is, so that rounding cannot matter.
MARGIN = 1e-5


def _upright(ra: str, dec: str) -> tuple[Column, Column]:
    """Right ascension from 0 to 360 and declination from -90 to 90 of the same place, for any angles."""
    a, d = F.radians(ra), F.radians(dec)
    return F.pmod(F.degrees(F.atan2(F.cos(d) * F.sin(a), F.cos(d) * F.cos(a))), F.lit(360.0)), F.degrees(F.asin(F.sin(d)))


def _place(df: DataFrame, ra: str, dec: str, step: float) -> DataFrame:
    """Adds the cell _x, _y of a position: zones of declination, cut to about as wide parts; null where a position is not finite."""
    a, d = _upright(ra, dec)
    known = (F.abs(ra) < float("inf")) & (F.abs(dec) < float("inf"))
    zone = F.when(known, F.floor(d / step)).cast("int")
    return df.withColumn("_y", zone).withColumn("_x", F.when(known, F.floor(a / (360.0 / _parts("_y", step)))).cast("int"))


def _inmost(zone: str, step: float) -> Column:
    """The greatest cosine of declination in a zone."""
    low = F.col(zone) * step
    return F.when((low <= 0) & (low + step >= 0), 1.0).otherwise(F.cos(F.radians(F.least(F.abs(low), F.abs(low + step)))))


def _parts(zone: str, step: float) -> Column:
    return F.greatest(F.floor(360.0 * _inmost(zone, step) / step), F.lit(1))


def tile_coverage(stars: DataFrame, tiles: DataFrame, radius: float) -> DataFrame:
    """Passes over each star: the sum over tiles whose centre is within ``radius``.

    Tiles at one place count as one. The sky is cut into cells of a CELLS-th of
    the radius. A tile that holds a whole cell goes into one sum for all of its
    stars, and only tiles whose border may cut the cell are compared with each
    star, by the exact distance; so pairs grow with cells and tiles, or with
    stars and borders, but not with stars and tiles. Cells meet tiles by
    declination bands of one radius. A star without a finite position has 0.
    """
    step = radius / CELLS
    once = tiles.groupBy("tile_ra", "tile_dec").agg(F.sum("passes").alias("passes"))
    _, tile_dec = _upright("tile_ra", "tile_dec")
    # no place of a cell is two steps from its centre, also where a zone at a pole is one cell
    around = F.sequence(F.floor((tile_dec - radius - 2 * step) / radius), F.floor((tile_dec + radius + 2 * step) / radius))
    sides = once.where((F.abs("tile_ra") < float("inf")) & (F.abs("tile_dec") < float("inf"))).withColumn("_band", F.explode(around))

    placed = _place(stars, "ra", "dec", step)
    wide = 360.0 / _parts("_y", step)
    cells = placed.select("_y", "_x").where("_y is not null").distinct()
    cells = cells.select("_y", "_x", ((F.col("_x") + 0.5) * wide).alias("_ra"), ((F.col("_y") + 0.5) * step).alias("_dec"), (step / 2 + wide / 2 * _inmost("_y", step) + MARGIN).alias("_reach"))
    met = cells.withColumn("_band", F.floor(F.col("_dec") / radius)).join(sides, "_band").withColumn("_away", separation("_ra", "_dec", "tile_ra", "tile_dec"))
    whole, cut = F.col("_away") + F.col("_reach") <= radius, F.col("_away") - F.col("_reach") <= radius
    tile = F.struct(F.col("tile_ra").alias("ra"), F.col("tile_dec").alias("dec"), "passes")
    sums = met.where(cut).groupBy("_y", "_x").agg(F.coalesce(F.sum(F.when(whole, F.col("passes"))), F.lit(0)).alias("_whole"), F.collect_list(F.when(~whole, tile)).alias("_cut"))

    passes = lambda t: F.when(separation("ra", "dec", t["ra"], t["dec"]) <= radius, F.coalesce(t["passes"], F.lit(0))).otherwise(0)
    border = F.aggregate("_cut", F.lit(0).cast(dict(once.dtypes)["passes"]), lambda total, t: total + passes(t))
    full = placed.join(sums, ["_y", "_x"], "left")
    return full.select(*stars.columns, F.coalesce(F.col("_whole") + border, F.lit(0)).alias("coverage"))

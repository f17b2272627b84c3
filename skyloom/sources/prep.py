"""Catalogue preparation: stacked tables, magnitudes, quality and export (SRC7 to SRC11, SRC13, J13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.angles import flux_magnitude, flux_magnitude_error, is_finite
from skyloom.operators.ordinal import global_ordinal
from skyloom.sources.catalog import ALIASES
from skyloom.sources.fits import read_fits, row_number


def hstack(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows side by side by their places in the given orders; of clashing names, the left column stays."""
    a = global_ordinal(left, [F.col(c) for c in left_order], "_row")
    b = global_ordinal(right, [F.col(c) for c in right_order], "_row")
    names = {c.lower() for c in left.columns}
    return a.join(b.select("_row", *[c for c in right.columns if c.lower() not in names]), "_row").drop("_row")


def stacked_hdus(spark: SparkSession, path: str, hdus: tuple[int, ...], distances: str | None = None, distance_hdu: int = 2) -> DataFrame:
    """The tables of several HDUs of a FITS file side by side, row by row, and those of a second file behind them.

    Of clashing names the first column stays. Rows meet by their number, which
    each task knows from its range, so no table is sorted.
    """
    parts = [read_fits(spark, path, h) for h in hdus] + ([read_fits(spark, distances, distance_hdu)] if distances else [])
    out, names = None, set()
    for part in parts:
        own = [c for c in part.columns if c.lower() not in names]
        names |= {c.lower() for c in own}
        part = part.select(*[F.col(f"`{c}`") for c in own], row_number().alias("_row"))
        out = part if out is None else out.join(part, "_row")
    return out.drop("_row")


def prepared_catalogue(spark: SparkSession, path: str, hdus: tuple[int, ...], distances: str | None = None, names: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """From FITS tables to rows for export: stack, keep good stars, add magnitudes and colours, project by aliases."""
    rows = stacked_hdus(spark, path, hdus, distances)
    there = {c.lower() for c in rows.columns}
    if {"rvs_warn", "rr_spectype"} <= there:
        rows = good_stars(rows)
    bands = tuple(b for b in ("g", "r", "z") if {f"flux_{b}", f"flux_ivar_{b}"} <= there)
    rows = with_magnitudes(rows, bands) if bands else rows
    aliases = {k: (*v, k) for k, v in ALIASES.items()} | {"g_mag": ("g_mag", *ALIASES["g_mag"]), "g_r": ("g_r",), "r_z": ("r_z",)}
    return export_rows(rows, names or aliases)


def convert_catalogue(spark: SparkSession, source: str, target: str, hdu: int = 2, limit: int | None = None) -> DataFrame:
    """A FITS table's rows with finite motions as CSV files with a header; returns what was written."""
    rows = finite_motion(read_fits(spark, source, hdu), limit)
    flat = rows.select(*[c for c, kind in rows.dtypes if not kind.startswith("array")])
    flat.write.mode("overwrite").csv(target, header=True)
    return spark.read.csv(target, header=True)


def with_magnitudes(df: DataFrame, bands: tuple[str, ...] = ("g", "r", "z")) -> DataFrame:
    """Magnitudes and errors of flux_<band> and flux_ivar_<band>, and the colours g-r and r-z."""
    for b in bands:
        df = df.withColumn(f"{b}_mag", flux_magnitude(f"flux_{b}")).withColumn(f"{b}_mag_err", flux_magnitude_error(f"flux_{b}", f"flux_ivar_{b}"))
    pairs = [(x, y) for x, y in (("g", "r"), ("r", "z")) if x in bands and y in bands]
    return df.withColumns({f"{x}_{y}": F.col(f"{x}_mag") - F.col(f"{y}_mag") for x, y in pairs}) if pairs else df


def good_stars(df: DataFrame, warn: str = "rvs_warn", kind: str = "rr_spectype") -> DataFrame:
    return df.where((F.col(warn) == 0) & (F.trim(kind) == "STAR"))


def export_rows(df: DataFrame, names: dict[str, tuple[str, ...]], max_motion: float = 200.0) -> DataFrame:
    """Project columns by aliases and keep rows with a finite position on the sphere and finite, moderate motion."""
    there = {c.lower(): c for c in df.columns}
    chosen = {k: [there[a.lower()] for a in v if a.lower() in there] for k, v in names.items()}
    out = df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in v]).alias(k) for k, v in chosen.items() if v])
    for c in ("ra", "dec", "pmra", "pmdec"):
        if c in out.columns:
            out = out.where(F.col(c).isNotNull() & is_finite(c))
    if {"ra", "dec"} <= set(out.columns):
        out = out.where(F.col("ra").between(0, 360) & F.col("dec").between(-90, 90))
    if {"pmra", "pmdec"} <= set(out.columns):
        out = out.where((F.abs("pmra") < max_motion) & (F.abs("pmdec") < max_motion))
    return out


def finite_motion(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows with finite proper motions, the first ``limit`` only where asked."""
    kept = df.where(is_finite("pmra") & is_finite("pmdec"))
    return kept if limit is None else kept.limit(limit)


def survey_stars(spark: SparkSession, view: str) -> DataFrame:
    """Stars with proper motions of a registered survey view."""
    return spark.sql(
        f"SELECT ra, dec, pmra, pmdec, phot_g_mean_mag AS g_mag, phot_bp_mean_mag - phot_rp_mean_mag AS bp_rp FROM {view} "
        "WHERE spectype = 'STAR' AND pmra IS NOT NULL AND pmdec IS NOT NULL"
    )

"""Star catalogues from CSV, Parquet or FITS files (SRC1 to SRC3, SRC5, SRC6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: header names in order of preference
ALIASES: dict[str, tuple[str, ...]] = {
    "ra": ("ra", "target_ra"),
    "dec": ("dec", "target_dec"),
    "pmra": ("pmra", "pm_ra", "gaia_pmra"),
    "pmdec": ("pmdec", "pm_dec", "gaia_pmdec"),
    "g_mag": ("g_mag", "gaia_phot_g_mean_mag", "phot_g_mean_mag"),
    "bp_rp": ("bp_rp", "gaia_bp_rp"),
    "rv": ("rv", "vrad", "radial_velocity"),
    "parallax": ("parallax", "gaia_parallax", "plx"),
    "teff": ("teff", "teff_gspphot"),
    "teff_err": ("teff_err",),
    "logg": ("logg", "logg_gspphot"),
    "logg_err": ("logg_err",),
    "feh": ("feh", "mh_gspphot", "fe_h"),
    "feh_err": ("feh_err", "fe_h_err"),
    "vsini": ("vsini",),
    "distance": ("distance", "dist50"),
    "target_id": ("target_id", "targetid"),
}
DEFAULTS = {"g_mag": 20.0, "bp_rp": 0.75}
NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def bind(columns: list[str]) -> dict[str, str]:
    """The column that each field takes: the first alias that occurs, whatever its case."""
    there = {}
    for c in columns:
        there.setdefault(c.strip().lower(), c)
    return {field: next(there[a] for a in names if a in there) for field, names in ALIASES.items() if any(a in there for a in names)}


def leading_number(text: Column) -> Column:
    """The number that a text begins with, NaN for nan, 0 for anything else."""
    digits = F.regexp_extract(text, NUMBER, 1)
    nan = F.lower(F.trim(text)).rlike(r"^[+-]?nan")
    return F.when(nan, F.lit(float("nan"))).when(digits != "", digits.try_cast("double")).otherwise(0.0)


def normalise(raw: DataFrame, ordinal: Column | None = None, texts: bool = True, as_given: bool = False) -> DataFrame:
    """Bind columns by alias, fill defaults, derive distances and drop impossible positions.

    A missing column or a null value takes its default: 0, 20 for g_mag, 0.75
    for bp_rp. Distance is the explicit one, else 1/parallax above 0.01 mas,
    else 100 where a parallax is given, else 0. NaN positions stay, as any
    comparison with them is false. ``as_given`` neither drops positions nor
    derives distances: what is not there is 0, as FITS catalogues are taken.
    """
    bound = bind(raw.columns)
    missing = [c for c in ("ra", "dec") if c not in bound]
    if missing:
        raise ValueError(f"no column for {' and '.join(missing)}")
    at = lambda c: F.col(f"`{bound[c]}`")
    number = (lambda c: leading_number(at(c))) if texts else (lambda c: at(c).cast("double"))

    def value(c: str) -> Column:
        default = F.lit(DEFAULTS.get(c, 0.0))
        return F.when(at(c).isNotNull(), number(c)).otherwise(default) if c in bound else default

    fields = [c for c in ALIASES if c not in ("target_id", "distance")]
    out = [value(c).alias(c) for c in fields]
    plx = number("parallax") if "parallax" in bound and not as_given else None
    far = F.when(plx > 0.01, 1.0 / plx).otherwise(100.0) if plx is not None else F.lit(0.0)
    if plx is not None:
        far = F.when(at("parallax").isNotNull(), far).otherwise(0.0)
    if "distance" in bound:
        far = F.when(at("distance").isNotNull(), number("distance")).otherwise(far)
    ids = F.coalesce(F.regexp_extract(at("target_id").cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0)) if "target_id" in bound else F.lit(0)
    star = ordinal if ordinal is not None else F.monotonically_increasing_id()
    stars = raw.select(star.cast("long").alias("star_id"), *out, far.alias("distance"), ids.cast("long").alias("target_id"))
    if as_given:
        return stars
    outside = lambda c, lo, hi: ~F.isnan(c) & ~F.col(c).between(lo, hi)
    return stars.where(~outside("ra", 0, 360) & ~outside("dec", -90, 90))


def in_file_order(raw: DataFrame) -> tuple[DataFrame, Column]:
    """Rows of a file source with what numbers them from 0: by file name, block and place.

    A partition holds whole blocks of files, in an order of Spark's own. Rows of
    a block stand together, so a row's place is its number less the block's
    first. Only a row for each block reaches the driver, whose shifts go back
    as a broadcast table; the file is read once more for them.
    """
    own = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq"))
    counts = own.groupBy("_file", "_block").agg(F.min("_seq").alias("first"), F.count("*").alias("n")).collect()
    total, shifts = 0, []
    for r in sorted(counts, key=lambda r: (r["_file"], r["_block"])):
        shifts.append((r["_file"], r["_block"], total - r["first"]))
        total += r["n"]
    table = raw.sparkSession.createDataFrame(shifts, "_file string, _block long, _shift long")
    return own.join(F.broadcast(table), ["_file", "_block"], "left"), F.col("_seq") + F.col("_shift")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV catalogue with a header. star_id is the row's place in the file, or in the files of a folder by name."""
    raw = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, mode="PERMISSIVE")
    rows, place = in_file_order(raw)
    return normalise(rows, place)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalise(spark.read.parquet(path), texts=False)


def read_catalog(spark: SparkSession, path: str, fits: bool = True) -> DataFrame:
    """Dispatch on the extension: .fits and .fit, .parquet, else CSV. FITS rows are taken as given: all positions, no derived distance."""
    lower = path.lower().rstrip("/")
    if lower.endswith((".fits", ".fit")):
        if not fits:
            raise RuntimeError("FITS input is switched off; convert the file or allow fits")
        from skyloom.sources.fits import read_fits

        return normalise(read_fits(spark, path), texts=False, as_given=True)
    return read_parquet(spark, path) if lower.endswith(".parquet") else read_csv(spark, path)

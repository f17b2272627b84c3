"""Exact order statistics of groups of any size by histograms that are refined where the place lies (A4 to A6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import staged

#: Buckets of a range after the first histogram, and rows below which a group or range is always sorted.
BUCKETS, SORTED_ROWS = 4096, 10_000
_RANGE = ["_g", "lo", "hi"]


def _binade(v: str) -> Column:
    """Sign and binary exponent as one number that rises with the value; NaN is greater than all."""
    x = F.col(v)
    power = F.floor(F.log2(F.abs(x))) + 1100  # 25 to 2123
    finite = F.when(x > 0, power).when(x < 0, -power).otherwise(0)
    return F.when(F.isnan(x), 9999).when(x == float("inf"), 5000).when(x == float("-inf"), -5000).otherwise(finite).cast("long")


def _part(v: str) -> Column:
    """The part of a range that a value lies in; a range is within one binade, so each step resolves 12 of 52 bits."""
    share = (F.col(v) - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("long")


def order_statistics(df: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """keys, n and one column for each of ``places``: the value at that place (from 0) of the group in ascending order.

    Places are expressions over ``n``, the group's number of values; they are
    held to 0 and n - 1. Null values do not count, and a group without values
    has no row; NaN comes last. A null key is a group. An empty table gives none.

    Groups of no more than a quarter of an even partition's rows are sorted.
    There are at most four larger ones for each partition. These are counted
    by binades, and then only the rows of the bucket that holds a place by finer
    buckets of it, all groups and places at once, until what is left can be
    sorted or is one value. Counts combine before the shuffle, so one group may
    be the whole table, and no group's values meet in a list.
    """
    spark = df.sparkSession
    group = F.to_json(F.struct(*keys)) if keys else F.lit("")
    rows = staged(df.select(*keys, group.alias("_g"), F.col(value).cast("double").alias("_v")).where("_v is not null"), "values")
    sizes = rows.groupBy("_g", *keys).agg(F.count("*").alias("n"))
    even = max(SORTED_ROWS, rows.count() // (4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    at = {name: F.greatest(F.least(place.cast("long"), F.col("n") - 1), F.lit(0)) for name, place in places.items()}
    large = staged(sizes.where(F.col("n") > even).select("_g", "n"), "large")

    own = Window.partitionBy("_g")
    small = rows.join(F.broadcast(large.select("_g")), "_g", "left_anti")
    numbered = small.withColumn("_k", F.row_number().over(own.orderBy("_v")) - 1).withColumn("n", F.count("*").over(own))
    found = numbered.groupBy(*keys, "_g", "n").agg(*[F.max(F.when(F.col("_k") == p, F.col("_v"))).alias(c) for c, p in at.items()])
    if large.isEmpty():
        return found.select(*keys, "n", *places)

    goals = large.select("_g", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), p.alias("rest")) for c, p in at.items()])).alias("_p"))
    open_ = staged(goals.select("_g", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), "_p.name", "_p.rest"), "open")
    values = None
    level = 0
    while not open_.isEmpty():
        ranges = F.broadcast(open_.select(*_RANGE).distinct())
        inside = rows.select("_g", "_v").join(ranges, "_g")
        inside = inside.where(F.col("_v").between(F.col("lo"), F.col("hi"))) if level else inside
        counted = inside.groupBy(*_RANGE, (_part("_v") if level else _binade("_v")).alias("b")).agg(F.count("*").alias("c"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        upto = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*_RANGE).orderBy("b")))
        held = open_.join(upto, _RANGE).where("rest < upto and rest >= upto - c")
        held = staged(held.select("_g", F.col("least").alias("lo"), F.col("most").alias("hi"), "name", (F.col("rest") - F.col("upto") + F.col("c")).alias("rest"), "c"), "held")
        one = held.where("lo = hi").select("_g", "name", F.col("lo").alias("_v"))
        few = held.where(f"lo != hi and c <= {even}")
        sides = F.broadcast(few.select(*_RANGE).distinct())
        ordered = rows.select("_g", "_v").join(sides, "_g").where(F.col("_v").between(F.col("lo"), F.col("hi")))
        ordered = ordered.withColumn("rest", F.row_number().over(Window.partitionBy(*_RANGE).orderBy("_v")) - 1)
        ended = one.unionByName(ordered.join(few, [*_RANGE, "rest"]).select("_g", "name", "_v"))
        values = ended if values is None else values.unionByName(ended)
        open_ = held.where(f"lo != hi and c > {even}").select("_g", "lo", "hi", "name", "rest")
        level += 1
    names = large.join(sizes.drop("n"), "_g")
    wide = values.groupBy("_g").agg(*[F.max(F.when(F.col("name") == c, F.col("_v"))).alias(c) for c in places])
    return found.select(*keys, "n", *places).unionByName(names.join(wide, "_g").select(*keys, "n", *places))


def quantiles(df: DataFrame, keys: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """keys, n and percentiles by linear interpolation between the two values around each; at and beyond the ends, least and greatest."""
    spot = {c: (F.col("n") - 1) * (min(max(p, 0.0), 100.0) / 100.0) for c, p in percents.items()}
    ends = {f"_{side}_{c}": f(x) for c, x in spot.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    found = order_statistics(df, keys, value, ends)
    between = lambda c: F.col(f"_lo_{c}") + (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) * (spot[c] - F.floor(spot[c]))
    level = lambda c: F.when(F.col(f"_lo_{c}") == F.col(f"_hi_{c}"), F.col(f"_lo_{c}")).otherwise(between(c))  # noqa: E731  infinite values stay
    return found.select(*keys, "n", *[level(c).alias(c) for c in percents])


def group_statistics(df: DataFrame, keys: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """keys, n, mean, variance, std (of the sample; 0 for fewer than two values) and percentiles of each group."""
    x = F.col(value).cast("double")
    moments = df.where(x.isNotNull()).groupBy(*keys).agg(F.avg(x).alias("mean"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("variance"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"))
    return _joined(moments, quantiles(df, keys, value, percents), keys)


def silverman_bandwidths(df: DataFrame, keys: list[str], value: str, name: str = "h") -> DataFrame:
    """keys and 0.9 min(std, IQR / 1.34) n^-0.2, quartiles by place; std where the IQR vanishes; 0.5 for fewer than two values."""
    df = staged(df.select(*keys, value), "rows")  # moments and places read it
    x = F.col(value).cast("double")
    moments = df.where(x.isNotNull()).groupBy(*keys).agg(F.stddev_samp(x).alias("_std"))
    n = F.col("n")
    both = _joined(moments, order_statistics(df, keys, value, {"_q1": F.floor(n / 4), "_q3": F.floor(n * 3 / 4)}), keys)
    scale = F.least("_std", (F.col("_q3") - F.col("_q1")) / 1.34)
    scale = F.when(scale < 1e-10, F.col("_std")).otherwise(scale)
    return both.select(*keys, F.when(n < 2, 0.5).otherwise(0.9 * scale * F.pow(n.cast("double"), F.lit(-0.2))).alias(name))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables of a row for each group, side by side; null keys meet."""
    if not keys:
        return left.join(right)  # a row each
    other = right.withColumnsRenamed({c: f"_other_{c}" for c in keys})
    same = [F.col(c).eqNullSafe(F.col(f"_other_{c}")) for c in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return left.join(other, on).drop(*[f"_other_{c}" for c in keys])

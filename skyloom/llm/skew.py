"""Joins on keys of which one may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows below which no key is hot.
HOT_ROWS = 256


def salted_join(rows: DataFrame, table: DataFrame, key: list[str], spread: str, how: str = "inner") -> DataFrame:
    """``rows`` with the one row that ``table`` has for each key, where a key may hold most of ``rows``.

    Keys of more rows than a quarter of an even partition are dealt to several
    places by a hash of ``spread``, and their row of ``table`` is repeated for
    these. There are four such keys for each partition at most, so the list of
    them is collected and sent to all tasks, and the repeats are eight rows for
    each partition at most. ``rows`` is counted first: pass a written table.
    """
    spark = rows.sparkSession
    even = max(HOT_ROWS, rows.count() // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hot = rows.groupBy(*key).agg(F.count("*").alias("_places")).where(F.col("_places") > even).select(*key, F.ceil(F.col("_places") / even).cast("int").alias("_places"))
    found = hot.collect()
    if not found:
        return rows.join(table, key, how)
    hot = F.broadcast(spark.createDataFrame(found, hot.schema))
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_places")).cast("int"), F.lit(0))).drop("_places")
    repeated = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_places", F.lit(1)) - 1))).drop("_places")
    return dealt.join(repeated, [*key, "_salt"], how).drop("_salt")

"""Global ordinals of a sorted table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import staged


def global_ordinal(df: DataFrame, order: list[Column], name: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """Add ``name``, each row's place (from 0) in the order of ``order``.

    Rows are dealt by ranges of the order, numbered within each range, and
    shifted by the counts of the ranges before; only those counts reach the
    driver. Rows that tie get places next to each other.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ordinal")
    before, shift = 0, {}
    for r in dealt.groupBy("_range").count().orderBy("_range").collect():
        shift[r["_range"]] = before
        before += r["count"]
    if not shift:
        return dealt.drop("_range").withColumn(name, F.lit(0).cast("long"))
    shifts = F.create_map(*[F.lit(x) for k, v in shift.items() for x in (k, v)])
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + shifts[F.col("_range")]
    return dealt.withColumn(name, place.cast("long")).drop("_range")

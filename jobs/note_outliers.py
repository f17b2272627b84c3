"""Screen the free texts of a catalogue: which records lie where few others of their language do.

Observers' notes and remarks come with a survey's tables, with cut-off lines,
pasted logs and filler among them. Each record becomes a point - words,
characters a word and lines in a thousand words, each less the median of its
language and divided by its quartile distance - and gets the score that stars
get in a signal region: how far the distance of its k-th neighbour lies below
the mean of its language. Low scores are lonely points.

Output: ``records`` with the features' distances and scores, one partition for
each language; ``summary`` with a row for each language and source. A run
writes only the partitions that its input has, whole, and so may be repeated
or run for one language's delivery after the other.

Null texts, languages and sources are ''. Rows that share a doc_id are one
record: the greatest of them by language, source and features. Records without
a doc_id are counted in the log and left out. Languages of fewer than
``least_group`` records get the score 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log
from skyloom.operators.knn import knn
from skyloom.operators.selection import order_statistics
from skyloom.session import scratch, staged

DEFAULTS = {"neighbours": 5, "flag_below": -3.0, "least_group": 20}
FEATURES = ["words", "length", "lines"]
#: What parts words: the blanks of ASCII.
BLANKS = r"[\x20\x09-\x0D]+"


def features(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the three features of each record; doubles of whole numbers, and ratios of such."""
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "lang", "source"))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    # counting matches copies the whole text for each; a text that begins or ends with a blank has an empty part there
    split = documents.select("doc_id", lang.alias("lang"), source.alias("source"), F.split(text, BLANKS).alias("parts"), F.length(text).alias("chars"), breaks.alias("breaks"))
    empty = lambda at: (F.element_at("parts", at) == "").cast("int")
    words = F.size("parts") - empty(1) - F.when(F.size("parts") > 1, empty(-1)).otherwise(0)
    counted = split.select("doc_id", "lang", "source", words.cast("double").alias("words"), "chars", "breaks")
    whole = F.greatest("words", F.lit(1.0))
    made = counted.select("doc_id", "lang", "source", "words", (F.col("chars") / whole).alias("length"), (F.col("breaks") * 1000 / whole).alias("lines"))
    names = made.columns[1:]
    return made.groupBy("doc_id").agg(F.max(F.struct(*names)).alias("r")).select("doc_id", *[f"r.{c}" for c in names])


def centred(records: DataFrame) -> DataFrame:
    """Features less their language's median, in units of its quartile distance (1 where that is 0), as float32."""
    n = F.col("n")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in FEATURES]))
    tall = records.select("lang", each.alias("_f")).select("lang", "_f.feature", "_f.value")
    found = order_statistics(tall, ["lang", "feature"], "value", {"q1": F.floor(n / 4), "middle": F.floor(n / 2), "q3": F.floor(n * 3 / 4)})
    wide = F.when(F.col("q3") > F.col("q1"), F.col("q3") - F.col("q1")).otherwise(1.0)
    of = lambda column, c: F.max(F.when(F.col("feature") == c, column))
    units = found.groupBy("lang").agg(*[x for c in FEATURES for x in (of(F.col("middle"), c).alias(f"m_{c}"), of(wide, c).alias(f"w_{c}"))])
    z = {f"z_{c}": ((F.col(c) - F.col(f"m_{c}")) / F.col(f"w_{c}")).cast("float") for c in FEATURES}
    return records.join(units, "lang").withColumns(z).select(*records.columns, *z)


def scored(points: DataFrame, neighbours: int, least_group: int) -> DataFrame:
    """Adds kth_distance and score; the place of the k-th neighbour counts the record itself as 0."""
    dims = [f"z_{c}" for c in FEATURES]
    found = knn(points.withColumnRenamed("doc_id", "point_id"), points.withColumnRenamed("doc_id", "query_id"), neighbours + 1, dims, ["lang"])
    far = staged(found.groupBy("lang", "query_id").agg(F.sqrt(F.max("dist_sq")).alias("kth_distance")), "far")  # scores and their means read it
    stats = far.groupBy("lang").agg(F.avg("kth_distance").alias("mean"), F.stddev_pop("kth_distance").alias("std"), F.count("*").alias("n"))
    score = F.when((F.col("std") > 1e-9) & (F.col("n") >= least_group), (F.col("mean") - F.col("kth_distance")) / F.col("std")).otherwise(0.0)
    both = far.join(stats, "lang").select(F.col("query_id").alias("doc_id"), "kth_distance", score.alias("score"))
    return points.join(both, "doc_id")


def run(spark: SparkSession, source: str, output: str, settings: dict | None = None) -> dict[str, int]:
    """Screen the documents at ``source``; rows read and written."""
    chosen = {**DEFAULTS, **(settings or {})}
    output = output.rstrip("/")
    documents = spark.read.parquet(source)
    counts = documents.agg(F.count("*").alias("rows"), F.count("doc_id").alias("named")).first()
    log.info("read %d rows of %s, %d without doc_id", counts["rows"], source, counts["rows"] - counts["named"])

    def written(df: DataFrame, name: str) -> DataFrame:
        # an option of the writer: the session's own mode stays as it is
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{output}/{name}")
        return spark.read.parquet(f"{output}/{name}")

    with scratch():
        records = staged(features(documents.where("doc_id is not null")), "features")  # texts are read once
        made = scored(staged(centred(records), "points"), chosen["neighbours"], chosen["least_group"])
        rows = made.withColumn("flagged", F.col("score") < chosen["flag_below"]).withColumn("part", F.concat(F.lit("lang-"), "lang"))
        kept = written(rows.select("doc_id", "lang", "source", *FEATURES, "kth_distance", "score", "flagged", "part"), "records")
    given = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")).distinct()
    here = kept.join(given, "lang", "left_semi")  # earlier runs may have left other languages
    total = here.groupBy("part", "lang", "source").agg(F.count("*").alias("records"), F.count(F.when(F.col("flagged"), True)).alias("flagged"), F.min("score").alias("lowest"))
    written(total, "summary")
    n = here.count()
    log.info("wrote %d records of this run to %s/records, their summary to %s/summary", n, output, output)
    return {"read": counts["rows"], "written": n}


def read_output(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{output}/records").drop("part"), spark.read.parquet(f"{output}/summary").drop("part")


if __name__ == "__main__":
    command_line("note_outliers", {"source": "documents as Parquet", "output": "folder of the tables"}, DEFAULTS, run)

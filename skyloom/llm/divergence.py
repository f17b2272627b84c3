"""Divergence of the vocabularies of sources, by relational operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.arrays import exactly
from skyloom.session import staged

#: What parts terms: all of ASCII but letters. A match of its complement is a longest run between two of these.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts of one; documents of a language that a kept term occurs in; ranks of a group's own terms.
SCALE, MIN_DOCS, TOP_TERMS = 1_000_000_000, 10, 10


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term with ``n`` occurrences and ``docs`` documents that have the term.

    Each document gives its terms twice: all of them, and each distinct one.
    Both are summed in one row for each term by one aggregate that combines
    before the shuffle. Texts are split at what is no term: extracting matches
    copies the whole text for each match, which long texts do not stand.
    """
    terms = F.split(F.translate("text", CAPITALS, SMALL), GAP)
    sides = F.explode_outer(F.array(F.struct(F.lit(0).alias("once"), F.col("t")), F.struct(F.lit(1).alias("once"), F.array_distinct("t").alias("t"))))
    both = docs.select("lang", "source", terms.alias("t")).select("lang", "source", sides.alias("s")).select("lang", "source", "s.once", F.explode_outer("s.t").alias("term"))
    return both.where("term != ''").groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("docs"))


def share(count: str, total: str, kept: str):
    """1 + floor(SCALE (count + 2) / (total + 2 kept)); the product is a decimal, so no count is too large."""
    return F.expr(f"1 + (cast({SCALE} AS decimal(10,0)) * cast({count} + 2 AS decimal(20,0))) div cast({total} + 2 * {kept} AS decimal(20,0))")


#: floor((p - q)^2 / (p + q)); shares are SCALE + 1 at most, so the square is below 2^63.
DISTANCE = "((p - q) * (p - q)) div (p + q)"


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """How far the vocabulary of each source of a language is from that of the others, and by which terms.

    Needs text, lang, source; returns lang, source, part, item, value, rank.
    Every (lang, source) group that occurs gives every term that ``min_docs``
    documents of the language have, with its occurrences there, zeros included,
    and a smoothed share p in parts of SCALE. Part ``pair`` has, for each other
    source of the language, the sum over kept terms of the integer
    (p - q)^2 / (p + q), all ranks; part ``term`` the terms that a group has and
    has more of than the whole language, by the same measure, to ``top_terms``.
    Ranks go by value, then item in the order of UTF-8.

    Null text, lang and source are ''. Each row is a document, repeated rows and
    doc_ids too. A text without terms still makes its group occur; a language
    without kept terms has pairs of value 0 and no term rows. An empty table
    gives an empty result. Other columns are not read, whatever their names.

    Terms are counted before the shuffle, so a source with a third of all rows
    sends each task's distinct terms. The dense table has sources times kept
    terms of a language as rows; it is dealt by term, with the groups repeated
    for each place, so no language is one task. The measure is symmetric: the
    self-join on language and term makes each pair of sources once.
    """
    own = exactly(docs, "text", "lang", "source")
    own = own.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    spark = own.sparkSession
    places = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = staged(term_counts(own).withColumn("d", F.sum("docs").over(Window.partitionBy("term", "lang"))).where(F.col("d") >= min_docs).select("lang", "source", "term", "n"), "terms")

    # keys begin with the term, by whose first bytes Spark sorts: languages are alike
    # a row for each group and one for each language: few, so their sums are taken again and again
    by_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"))
    by_lang = by_term.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("all_total"))
    occurs = own.select("lang", "source").distinct()
    groups = staged(
        occurs.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept", "all_total")]), "groups"
    )

    repeated = groups.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    dealt = by_term.withColumn("place", F.pmod(F.xxhash64("term"), F.lit(places)).cast("int"))
    crossed = dealt.join(repeated.hint("shuffle_hash"), ["lang", "place"]).drop("place")
    dense = crossed.join(counts, ["term", "lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    dense = staged(dense.select("lang", "source", "term", "n", share("n", "total", "kept").alias("p"), share("all_n", "all_total", "kept").alias("q")), "dense")

    left = dense.select("lang", "term", "source", "p")
    right = dense.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"))
    summed = left.join(right, ["term", "lang"]).where("source < other").groupBy("lang", "source", "other").agg(F.sum(F.expr(DISTANCE)).alias("value"))
    names = groups.select("lang", "source")
    zeros = names.join(names.withColumnRenamed("source", "other"), "lang").where("source < other").select("lang", "source", "other", F.lit(0).cast("long").alias("value"))
    once = summed.unionByName(zeros).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    pairs = once.select("lang", "value", ways.alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    terms = dense.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(DISTANCE).alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", place).unionByName(terms.withColumn("rank", place).where(F.col("rank") <= top_terms))
    return ranked.select("lang", "source", "part", "item", "value", "rank")

"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators.ordinal import global_ordinal
from skyloom.session import staged

#: Bits of the hash that one histogram resolves, and bits of the hash.
LEVEL_BITS = 12
HASH_BITS = 60
#: What a word is.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, cap: int) -> DataFrame:
    """Add ``target`` to a table of source and source_size.

    Sources in code point order, null last, weigh ``weights`` in turn. They
    share ``budget`` times all sizes by weight; a target stops at ``cap`` times
    its source's size and the excess is shared again by weight, until none is
    above. The level at which uncapped targets stand rises with each aggregate.
    """
    ranked = global_ordinal(sizes, [F.col("source").asc_nulls_last()], "_rank")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = staged(ranked.withColumn("_w", F.get(cycle, (F.col("_rank") % len(weights)).cast("int")).cast("long")), "sources")
    total, heavy = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    goal = min(budget, cap) * total
    level = goal / heavy if heavy else 0.0
    full = F.col("source_size") * cap
    while True:
        above = full <= F.lit(level) * F.col("_w")
        capped, rest = ranked.agg(F.coalesce(F.sum(F.when(above, full)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("_w"))), F.lit(0))).first()
        raised = (goal - capped) / rest if rest else level
        if not raised > level * (1 + 1e-12):
            break
        level = raised
    target = F.when(above, full.cast("double")).otherwise(F.lit(level) * F.col("_w"))
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source of ``goals``, the hash below which sizes add up to its ``rest``.

    ``rows`` has source, size and hash (0 to 2^60 - 1); ``goals`` has source and
    rest, below the source's size. A histogram by source and the leading bits
    of the hash shows the bucket in which the sum passes the goal; only rows of
    that bucket are counted again by their next bits, until a boundary bucket
    holds one hash. The nearer side of it is taken. Smaller goals give smaller
    thresholds, so their rows are a subset of those of larger goals.
    """
    spark = rows.sparkSession
    open_ = goals.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    done = None
    for depth in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        bucket = F.shiftright("hash", HASH_BITS - depth)
        counted = rows.select("source", "size", bucket.alias("bucket"), "hash")
        if depth > LEVEL_BITS:
            edge = open_.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
            counted = counted.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("bucket", LEVEL_BITS) == F.col("p"))).drop("s", "p")
        sums = counted.groupBy("source", "bucket").agg(F.sum("size").alias("held"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        goal = open_.select(F.col("source").alias("s"), "rest", "below")
        upto = F.sum("held").over(Window.partitionBy("source").orderBy("bucket"))
        passed = (
            sums.withColumn("upto", upto).join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
            .where("below + upto > rest").groupBy("source")
            .agg(F.min_by(F.struct("bucket", "held", "upto", "lo", "hi", "rest", "below"), "bucket").alias("b"))
            .select("source", "b.rest", F.col("b.bucket").alias("prefix"), (F.col("b.below") + F.col("b.upto") - F.col("b.held")).alias("below"), "b.held", "b.lo", "b.hi")
        )
        passed = staged(passed, "edge")
        last = F.lit(depth == HASH_BITS) | (F.col("lo") == F.col("hi"))
        ended = passed.where(last).select("source", F.when(F.col("rest") - F.col("below") > F.col("held") / 2, F.col("hi") + 1).otherwise(F.col("lo")).alias("threshold"))
        done = ended if done is None else done.unionByName(ended)
        open_ = passed.where(~last).select("source", "rest", "prefix", "below")
        if open_.isEmpty():
            break
    return done if done is not None else spark.createDataFrame([], "source string, threshold long")


#: The columns that mix_sources adds.
MIXED = ("source_size", "target", "copies")


def mix_sources(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.0, cap: int = 3) -> DataFrame:
    """How often a mix takes each row of a table of source, size and hash.

    Adds source_size, target and copies. A source whose target is r times its
    size and a rest takes every row r times, and once more the rows whose hash
    is below the source's threshold, whose sizes come nearest to the rest.

    ``sized`` is read once for each histogram level: pass a narrow, written
    table. A null source is a source; null sizes count as 0. Rows with the same
    hash share one fate. Sources without any size take nothing. An empty table
    gives an empty result. Other columns of ``sized`` come through; columns
    that are named like the three new ones are replaced.
    """
    sizes = sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    goals = source_targets(sizes, weights, budget, cap)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    goals = staged(goals.withColumn("rounds", rounds).withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size")), "goals")
    edges = thresholds(sized, goals.where("rest > 0 and source_size > 0").select("source", "rest"))
    plan = goals.join(edges.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    own = [c for c in sized.columns if c not in MIXED]
    edge = F.coalesce("threshold", F.lit(0))
    plan = staged(plan.select(F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_size"), F.col("target").alias("_mix_target"), F.col("rounds").alias("_mix_rounds"), edge.alias("_mix_edge")), "plan")
    joined = sized.select(*[F.col(f"`{c}`") for c in own]).join(plan, F.col("source").eqNullSafe(F.col("_mix_source")))
    copies = F.col("_mix_rounds") + (F.col("hash") < F.col("_mix_edge")).cast("int")
    return joined.select(*[F.col(f"`{c}`") for c in own], *[c.alias(n) for c, n in zip((F.col("_mix_size"), F.col("_mix_target"), copies), MIXED, strict=True)])


def sized_documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size in words and hash of each document, with ``more`` columns."""
    spread = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - HASH_BITS)
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), spread.alias("hash"), *more)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.0, cap: int = 3) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken.

    The decision is made again for each row from its source's threshold, so
    texts are read once more but never shuffled. Needs doc_id, text, source;
    all columns come through as they are, whatever their names. Null texts have
    no words and stay out unless their hash is below a threshold or whole rounds
    are taken; rows that repeat another have its fate; an empty table gives an
    empty result.
    """
    names = docs.columns
    decided = staged(sized_documents(docs).select("source", "size", "hash"), "sized")
    plan = mix_sources(decided, weights, budget, cap)
    # the copies of a row depend on its source and hash alone
    taken = plan.groupBy("source", "copies").agg(F.max("hash").alias("top"))
    steps = staged(taken.groupBy("source").agg(F.min("copies").alias("few"), F.max("copies").alias("many"), F.max_by("top", "copies").alias("edge")), "steps")
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("source").cast("string").alias("_s"), F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - HASH_BITS).alias("_h"))
    joined = keyed.join(steps, F.col("_s").eqNullSafe(F.col("source")))
    copies = F.when(F.col("_h") <= F.col("edge"), F.col("many")).otherwise(F.col("few"))
    repeated = joined.withColumn("_n", copies).where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return repeated.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])

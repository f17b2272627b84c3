"""Sharding by histogram sort: splitters from exact byte counts, then one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the key that one round of probes resolves.
PROBE_BITS = 8
KEY_BITS = 128
#: Rows that one task of the exchange should get at most.
ROWS_A_TASK = 4_000_000
_LOW = -(2**63)


def _place(key: Column) -> Column:
    """Signed order as unsigned order."""
    return key.bitwiseXOR(F.lit(_LOW))


def _prefix(depth: int) -> Column:
    """The leading ``depth`` (of 64) bits of _h, or for more, the leading bits of _t."""
    return F.shiftrightunsigned(_place(F.col("_h" if depth <= 64 else "_t")), 64 - (depth if depth <= 64 else depth - 64))


def find_splitters(keys: DataFrame, parts: int, tolerance: float) -> tuple[list[tuple[int, int]], int]:
    """Keys (h, t) that cut the bytes of ``keys`` (_h, _t, _size) into equal parts, and all bytes.

    Each round counts the bytes below the candidate boundaries that the next
    bits allow, within the interval that holds each splitter, and keeps the
    child interval in which it lies. A splitter is settled by a boundary within
    ``tolerance`` of a part's bytes, or by the nearer side of a single key.
    Boundaries between values of h come first, so rows with one h stay
    together where the tolerance allows. The driver sees counts of intervals:
    2^PROBE_BITS for each open splitter at most.
    """
    total = keys.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    if not total:
        return [], 0
    near = tolerance * total / parts
    goals = [total * i / parts for i in range(1, parts)]
    #: open splitters: index -> (h prefix, t prefix, bytes below)
    open_ = {i: (0, 0, 0) for i in range(len(goals))}
    found: dict[int, tuple[int, int]] = {}

    def bound(h: int, t: int, depth: int) -> tuple[int, int]:
        if depth <= 64:
            return ((h << (64 - depth)) + _LOW, _LOW) if h < 1 << depth else (2**63 - 1, 2**63 - 1)
        if t >= 1 << (depth - 64):
            return (h + 1 + _LOW, _LOW)
        return h + _LOW, (t << (128 - depth)) + _LOW

    for depth in range(PROBE_BITS, KEY_BITS + 1, PROBE_BITS):
        child = _prefix(depth).alias("child")
        if depth == PROBE_BITS:
            counted = keys.select(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("t"), child, "_size")
        else:
            edges = sorted({v[:2] for v in open_.values()})
            signed = [(h - 2**64 if h >= 2**63 else h, t - 2**64 if t >= 2**63 else t) for h, t in edges]
            if depth <= 64:
                counted = keys.select(_prefix(depth - PROBE_BITS).alias("h"), F.lit(0).cast("long").alias("t"), child, "_size")
            elif depth == 64 + PROBE_BITS:
                counted = keys.select(_place(F.col("_h")).alias("h"), F.lit(0).cast("long").alias("t"), child, "_size")
            else:
                counted = keys.select(_place(F.col("_h")).alias("h"), _prefix(depth - PROBE_BITS).alias("t"), child, "_size")
            inside = keys.sparkSession.createDataFrame(signed, "h long, t long")  # an edge for each open splitter at most
            counted = counted.join(F.broadcast(inside), ["h", "t"])
        held: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in counted.groupBy("h", "t", "child").agg(F.sum("_size").alias("b")).collect():
            held.setdefault((r["h"] % 2**64, r["t"] % 2**64), []).append((r["child"] % 2**64, r["b"]))
        for i, (h, t, below) in list(open_.items()):
            upto = below
            for c, b in sorted(held[h, t]):
                if upto + b > goals[i] or abs(upto + b - goals[i]) <= near:
                    break
                upto += b
            step = (lambda c: (c, 0)) if depth <= 64 else (lambda c, h=h: (h, c))
            low, high = bound(*step(c), depth), bound(*step(c + 1), depth)
            if abs(upto - goals[i]) <= near or abs(upto + b - goals[i]) <= near or depth == KEY_BITS:
                found[i] = low if abs(upto - goals[i]) <= abs(upto + b - goals[i]) else high
                del open_[i]
            else:
                open_[i] = (*step(c), upto)
        if not open_:
            break
    cuts = [found[i] for i in sorted(found)]
    return [max(cuts[: i + 1]) for i in range(len(cuts))], total


def _part(cuts: list[tuple[int, int]], first: int = 0) -> Column:
    """The number of cuts at or below the key, as a balanced tree of comparisons."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    h, t = cuts[mid]
    below = (F.col("_h") < F.lit(h)) | ((F.col("_h") == F.lit(h)) & (F.col("_t") < F.lit(t)))
    return F.when(below, _part(cuts[:mid], first)).otherwise(_part(cuts[mid + 1 :], first + mid + 1))


def histogram_sort(df: DataFrame, key: Column, tie: Column, size: Column, shards: int, tolerance: float = 0.005) -> DataFrame:
    """Sort ``df`` by (key, tie) into ``shards`` shards of nearly equal bytes; adds shard and slot, or replaces columns of these names.

    key and tie are longs (null sorts first), size is a long (null counts as
    0). Rows go to the place of their range in one exchange; slots count from 0
    in each shard. A shard of very many rows is dealt to several tasks, whose
    counts before give the shift of their slots. Rows with equal key and tie
    stay in one shard. ``df`` is read several times: pass a written table. All
    other columns come through, whatever their names. An empty table gives an
    empty result.
    """
    names = [c for c in df.columns if c not in ("shard", "slot")]
    # columns travel under numbers, so that no name can clash
    keys = df.select(
        F.coalesce(key, F.lit(_LOW)).alias("_h"), F.coalesce(tie, F.lit(_LOW)).alias("_t"), F.coalesce(size, F.lit(0)).alias("_size"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)]
    )
    fine = max(1, -(-df.count() // (shards * ROWS_A_TASK)))
    cuts, _ = find_splitters(keys, shards * fine, tolerance / fine)
    # one exchange puts each part in a partition of its own, which the window takes as it is
    dealt = keys.withColumn("_part", _part(cuts)).repartitionById(shards * fine, F.col("_part"))
    order = Window.partitionBy("_part").orderBy("_h", "_t")
    slot = F.row_number().over(order).cast("long") - 1
    if fine > 1:
        before, shift = 0, []
        for p, n in sorted((r["_part"], r["count"]) for r in keys.withColumn("_part", _part(cuts)).groupBy("_part").count().collect()):
            before = 0 if not shift or p // fine != shift[-2] // fine else before
            shift += [p, before]
            before += n
        slot = slot + F.create_map(*[F.lit(x) for x in shift])[F.col("_part")]
    own = [F.col(f"_{i}").alias(c) for i, c in enumerate(names)]
    return dealt.select(*own, slot.alias("slot"), F.floor(F.col("_part") / fine).cast("int").alias("shard"))

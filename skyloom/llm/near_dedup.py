"""Near duplicates by SuperMinHash signatures, banding, exact checks and union-find grouping."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.arrays import GOLDEN, lists, mix64, runs, shingles, small_batches, utf8
from skyloom.llm.skew import salted_join
from skyloom.operators.graph import connected_components
from skyloom.session import staged, unstage

#: Rows of a band.
ROWS = 5
#: A linked pair that shares no band is as rare as this.
MISS = 1e-6
#: Rows and shingles of each side of a block of comparisons, about.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: Shingles of a slab: the columns of a matrix product.
SLAB = 4096


def bands_for(percent: int) -> int:
    """Bands that make a pair just at the threshold share one, but for a chance of MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def superminhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, m: int) -> np.ndarray:
    """SuperMinHash signatures of many sets at once, as (n_sets, m) unsigned 64-bit words.

    Every element draws a random permutation of the m places by Fisher-Yates;
    at step j it offers ``j + r`` to place p(j). Steps run over all elements
    together; a set stops as soon as all its places hold less than j + 1, since
    later steps offer more. A word holds j in its upper and r in its lower half.
    """
    held = np.full(n_sets * m, np.iinfo(np.uint64).max, np.uint64)
    perm = None
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    base, steps = owner * m, np.arange(1, m + 1, dtype=np.uint64) * GOLDEN
    for j in range(m):
        if not len(elements):
            break
        x = mix64(elements + steps[j])
        k = j + (((x & low) * np.uint64(m - j)) >> half).astype(np.int64)
        place = k if perm is None else perm[np.arange(len(k)), k].astype(np.int64)
        np.minimum.at(held, base + place, (np.uint64(j) << half) | (x >> half))
        unfinished = held.reshape(n_sets, m).max(axis=1) >= (np.uint64(j + 1) << half)
        go = unfinished[owner]
        rows = np.flatnonzero(go)
        if perm is None:
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(rows), 1))
        else:
            perm[np.arange(len(k)), k] = perm[:, j]
            perm = perm[rows]
        k = k[rows]
        if j == 0:
            perm[np.arange(len(k)), k] = 0
        elements, owner, base = elements[rows], owner[rows], base[rows]
    return held.reshape(n_sets, m)


def _signer(k: int, n_bands: int):
    m = n_bands * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), utf8(batch.column(1))
            for i, j in runs(texts, 400_000):
                elements, n = shingles(texts[i:j], k)
                owner = np.repeat(np.arange(j - i), n)
                held = superminhash(elements, owner, j - i, m).reshape(j - i, n_bands, ROWS)
                band = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64) * GOLDEN, (j - i, n_bands))
                for r in range(ROWS):
                    band = mix64(band + held[:, :, r])
                digest = np.zeros((2, j - i), np.uint64)
                np.add.at(digest[0], owner, mix64(elements))
                np.add.at(digest[1], owner, mix64(elements ^ GOLDEN))
                some = n > 0
                flat = np.ascontiguousarray(band[some]).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n), *(pa.array(d.view(np.int64)) for d in digest), lists(flat, some * n_bands, pa.int64())],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return run


def _set_reader(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), utf8(batch.column(1))
            for i, j in runs(texts, 1_000_000):
                elements, n = shingles(texts[i:j], k)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), lists(elements.view(np.int64), n, pa.int64())], ["doc_id", "members"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, rep) whose whole shingle sets are as similar as asked, as (a, b). A hub may be in very many pairs."""
    one = sets.select(F.col("doc_id").alias("hub"), F.col("members").alias("x"))
    two = sets.select(F.col("doc_id").alias("rep"), F.col("members").alias("y"))
    hubs = one.join(pairs.select("hub").distinct(), "hub", "left_semi")
    full = salted_join(pairs, hubs, ["hub"], "rep").join(two, "rep")
    both = F.size(F.array_intersect("x", "y"))
    alike = 100 * both >= percent * (F.size("x") + F.size("y") - both)
    return staged(full.where(alike).select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct(), "links")


def _near(n1: str, n2: str, percent: int):
    """No pair can be linked whose set sizes differ more."""
    return (100 * F.least(n1, n2)) >= (percent * F.greatest(n1, n2))


def _star(open_: DataFrame, hub_by, percent: int) -> DataFrame:
    """Pairs of each bucket's hub with its members of other components."""
    hubs = staged(open_.groupBy("bucket").agg(F.min_by(F.struct("rep", "n", "part"), hub_by).alias("hub")), "hubs")
    joined = salted_join(open_, hubs, ["bucket"], "rep").where((F.col("part") != F.col("hub.part")) & _near("n", "hub.n", percent))
    pairs = joined.select(F.col("hub.rep").alias("hub"), "rep")
    return staged(pairs.where("hub <> rep").distinct(), "pairs")


def _unclear(members: DataFrame, labels: DataFrame, settled: int) -> DataFrame:
    """Members, with their component as part, of the buckets that have more than ``settled`` and not one component only.

    ``settled`` is 2 if a star has compared each bucket as it stands, since it
    leaves no pair of two members open, and 1 if members have left since then.
    """
    labelled = members.drop("part").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = staged(labelled.withColumn("part", F.coalesce("component", "rep")).drop("component"), "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("c")).where(f"lo < hi and c > {settled}")
    out = staged(salted_join(labelled, mixed.select("bucket"), ["bucket"], "rep"), "open")
    unstage(labelled)
    return out


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    whole = column.combine_chunks()
    ends = np.asarray(whole.offsets)
    values = np.asarray(whole.values)
    return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _block_links(percent: int):
    def run(block: pa.Table) -> pa.Table:
        """For each row marked few, one other row in each other component that it is linked with."""
        few, many = block.filter(block["few"]), block.filter(pc.invert(block["few"]))
        sets = [x for t in (few, many) if t.num_rows for x in _sets(t["members"])]
        size = np.array([len(x) for x in sets])
        n = few.num_rows
        values, code, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        shared = counts > 1
        row, code = row[shared[code]], (np.cumsum(shared) - 1)[code[shared[code]]]
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        both = np.zeros((n, len(sets) - n), np.float32)
        for at in range(0, int(shared.sum()), SLAB):
            low, high = np.searchsorted(code, [at, at + SLAB])
            dense = np.zeros((len(sets), SLAB), np.float32)
            dense[row[low:high], code[low:high] - at] = 1
            both += dense[:n] @ dense[n:].T
        joint = size[:n, None] + size[None, n:] - both
        part_1, part_2 = few.column("part").to_numpy(), many.column("part").to_numpy()
        rep_1, rep_2 = few.column("rep").to_numpy(), many.column("rep").to_numpy()
        linked = (100 * both >= percent * joint) & (part_1[:, None] != part_2[None, :])
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for i, j in np.argwhere(linked).tolist():
            out.setdefault((i, int(part_2[j])), (int(rep_1[i]), int(rep_2[j])))
        found = [(min(p), max(p)) for p in out.values()]
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return run


def _rest_links(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that may still be hidden among ``open_``, found block by block.

    Groups are what buckets connect. In each, rows outside its largest
    component meet the rows that may be linked with them by size: those of their
    own class of sizes and of the two beside it, in blocks of about BLOCK by BLOCK
    rows and of BLOCK_SHINGLES on each side, whose intersections are matrix
    products; only links leave a block, one for each row and component.
    """
    hubs = staged(open_.groupBy("bucket").agg(F.min("rep").alias("hub")), "hubs")
    groups = connected_components(salted_join(open_, hubs, ["bucket"], "rep").select("rep", "hub").distinct(), "rep", "hub")
    # linked sets differ in size by less than a class is wide
    sizes = F.floor(F.log("n") / (math.log(100 / percent) * 1.0001 if percent < 100 else 1.0)).cast("int")
    rows = open_.select("rep", "part", "n").distinct().join(groups.select(F.col("node").alias("rep"), F.col("component").alias("grp")), "rep")
    rows = staged(rows.withColumn("cls", sizes), "rest")
    main = rows.groupBy("grp", "part").agg(F.count("*").alias("c")).groupBy("grp").agg(F.max_by("part", F.struct("c", "part")).alias("main"))
    few = staged(salted_join(rows, main, ["grp"], "rep").where("part != main").drop("main"), "few")
    many = staged(rows.withColumn("cls", F.explode(F.sequence(F.col("cls") - 1, F.col("cls") + 1))), "many")
    sides = lambda c: F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.lit(1)).cast("int").alias(c)
    blocks = staged(few.groupBy("grp", "cls").agg(sides("o")).join(many.groupBy("grp", "cls").agg(sides("m")), ["grp", "cls"]), "blocks")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = sets.select(F.col("doc_id").alias("rep"), "members")
    placed = lambda side: salted_join(side, blocks, ["grp", "cls"], "rep").join(members, "rep")
    left = placed(few).select(F.lit(True).alias("few"), "grp", "cls", "rep", "part", "members", own("o").alias("i"), each("m").alias("j"))
    right = placed(many).select(F.lit(False).alias("few"), "grp", "cls", "rep", "part", "members", each("o").alias("i"), own("m").alias("j"))
    found = left.unionByName(right).groupBy("grp", "cls", "i", "j").applyInArrow(_block_links(percent), "a long, b long")
    return staged(found.distinct(), "links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose k-word shingle sets have a Jaccard similarity of ``percent`` or more.

    ``docs`` needs doc_id and text; other columns are ignored. Shingles are
    compared by 64-bit hashes. Returns one row
    per input row: doc_id, n_shingles, component_id (the smallest doc_id
    reachable through links, its own included) and kept (doc_id is component_id).

    Equal sets collapse into one representative by an aggregate, so copies
    never meet in pairs. Representatives that share a band are candidates. Each
    bucket first checks its members against its smallest one. Of the buckets
    that then hold several components, members drop out that have too many
    shingles of their own to be linked with anything there; the others are
    checked against their bucket's most central member, then against another,
    and what is still open is compared in blocks. Every check is on full sets.

    Null or empty text has no shingles, links with nothing and is kept. A null
    doc_id has a null component_id and is kept. Rows with one doc_id count as
    one node of the graph. An empty table gives an empty result.
    """
    docs = small_batches(docs.select("doc_id", "text"))
    n_bands = bands_for(percent)
    signed = staged(
        docs.mapInArrow(_signer(k, n_bands), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"), "signed"
    )
    key = ["set_a", "set_b", "n_shingles"]
    classes = (
        signed.where("n_shingles > 0 and doc_id is not null").groupBy(*key)
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"))
    )
    classes = staged(classes, "classes")
    banded = staged(classes.select("rep", F.col("n_shingles").alias("n"), F.explode(F.array_distinct("bands")).alias("bucket")), "banded")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    members = staged(salted_join(banded, shared, ["bucket"], "rep"), "members")
    unstage(banded)

    labels = None
    pairs = _star(members.withColumn("part", F.col("rep")), F.struct("rep"), percent)
    if not members.isEmpty():  # without pairs of the smallest members too, others may be linked
        wanted = members.select(F.col("rep").alias("doc_id")).distinct()
        sets = staged(docs.join(wanted, "doc_id", "left_semi").mapInArrow(_set_reader(k), "doc_id long, members array<long>"), "sets")
        links = _links(pairs, sets, percent)
        labels = connected_components(links, "a", "b")
        open_ = _unclear(members, labels, 2)
        if not open_.isEmpty():
            some = sets.join(open_.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
            lone = (
                some.select("doc_id", F.explode("members").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("doc_id").alias("rep"))
                .where("c = 1").groupBy("rep").agg(F.count("*").alias("own"))
            )
            open_ = open_.join(lone, "rep", "left").withColumn("own", F.coalesce("own", F.lit(0)))
            members = staged(open_.where(F.col("own") * 100 <= F.col("n") * (100 - percent)), "members")
            for settled, hub_by in ((1, F.struct(F.col("own") / F.col("n"), "rep")), (2, F.struct(F.xxhash64("rep", "bucket"), "rep"))):
                open_ = _unclear(members, labels, settled)
                pairs = _star(open_, hub_by, percent)
                if pairs.isEmpty():
                    continue
                links = links.unionByName(_links(pairs, sets, percent))
                labels = connected_components(links, "a", "b")
            open_ = _unclear(members, labels, 2)
            if not open_.isEmpty():
                links = links.unionByName(_rest_links(open_, sets, percent))
                labels = connected_components(links, "a", "b")

    moved = classes.where("copies > 1").select(*key, "rep")
    if labels is not None:
        moved = (
            classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
            .where((F.col("copies") > 1) | F.col("component").isNotNull())
            .select(*key, F.coalesce("component", "rep").alias("rep"))
        )
    result = salted_join(signed.select("doc_id", *key), staged(moved, "moved"), key, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with all columns as they are; rows without words all stay.

    The row of the smallest doc_id stays. Rows are documents of their own also
    where they repeat a doc_id or have none (these come last): of such rows, a
    group keeps that of the smallest hash of doc_id and text, so no different
    text is lost and reruns agree. Of rows that have one doc_id and text, the
    one of the smallest hash of all columns stays.
    """
    names = docs.columns
    own = [F.col(f"`{c}`") for c in names]
    again = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null")
    if again.isEmpty():
        gone = staged(near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id").alias("_gone")), "gone")
        return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti").select(*own)
    again = staged(again.select(F.col("doc_id").alias("_again")), "again")
    numbered = docs.select(*[c.alias(f"_{i}") for i, c in enumerate(own)], F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbered = numbered.join(again, F.col("doc_id").eqNullSafe(F.col("_again")), "left").withColumn(
        "_node", F.when(F.col("doc_id").isNull() | F.col("_again").isNotNull(), F.xxhash64("doc_id", "text", F.lit(23))).otherwise(F.col("doc_id"))
    )
    numbered = staged(numbered.drop("_again").withColumn("_row", F.xxhash64(*[f"_{i}" for i in range(len(names)) if not dict(docs.dtypes)[names[i]].startswith("map")])), "numbered")
    nodes = numbered.groupBy("_node").agg(F.min("doc_id").alias("id"), F.min("_row").alias("_first"))
    # a node that rows share has one n_shingles and component
    found = near_duplicates(numbered.select(F.col("_node").alias("doc_id"), "text"), k, percent).distinct()
    order = F.struct(F.col("id").isNull().alias("none"), "id", "_node")
    found = staged(found.select(F.col("doc_id").alias("_node"), "n_shingles", "component_id").join(nodes, "_node"), "nodes")
    best = found.groupBy("component_id").agg(F.min(order).alias("b")).select(F.col("b._node").alias("_node"))
    kept = found.join(best, "_node", "left_semi").select("_node", "n_shingles", "_first")
    left = numbered.join(kept, "_node").where((F.col("n_shingles") == 0) | (F.col("_row") == F.col("_first")))
    single = left.where("n_shingles = 0").unionByName(left.where("n_shingles > 0").dropDuplicates(["_node"]))
    return single.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)])

"""Approximate nearest neighbours by largest inner product: inverted lists and adaptive dimension scans."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.arrays import lists
from skyloom.session import staged, unstage

#: Rows that the centroids are fitted on at most, vectors of a list, about, and lists at most.
FIT_ROWS = 20_000
LIST_ROWS = 1024
MOST_LISTS = 4096
#: Vectors and queries of one block at most, about, and pairs of them that are scanned at a time. A block holds several lists.
BLOCK_ROWS = 32_768
BLOCK_QUERIES = 4096
PAIRS = 1 << 20
#: Dimensions of a column block, and how sure the test of a pair and of a list is (larger drops fewer).
STEP = 8
EPSILON = 2.1
LIST_SURE = 1.0
#: Rows of the sample whose k-th best score is a first lower limit for a query.
FLOOR_ROWS = 4096
#: A query first visits this share of the lists, nearest first; what it finds there limits the rest.
FIRST_SHARE = 0.1


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vec of the rows that take part: not null or zero, all components finite, one length.

    The length is that of most such vectors (the longer one of a tie).
    Components of less than double precision stay as they are.
    """
    kind = "float" if dict(df.select(F.col(f"`{vector}`").alias("v")).dtypes)["v"] == "array<float>" else "double"
    vec = F.transform(F.col(f"`{vector}`"), lambda x: x.cast(kind))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    rows = staged(rows.where(fine), "vectors")
    dims = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("vec") == (dims["d"] if dims else 0))


def fit_centroids(sample: np.ndarray, n_lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids of a sample, begun at distinct rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:n_lists]].copy()
    for _ in range(rounds):
        near = nearest(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row."""
    out = []
    for at in range(0, len(x), 2048):
        d = (centres**2).sum(1)[None, :] - 2 * x[at : at + 2048] @ centres.T
        top = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
        out.append(np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def rotation(d: int, seed: int = 11) -> np.ndarray:
    """A random rotation: each leading block of rotated dimensions is a fair sample of a distance."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def lifted(x: np.ndarray, radius: float, query: bool) -> np.ndarray:
    """One more dimension, in which the nearest by distance are those of largest inner product."""
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(radius**2 - (x**2).sum(1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def adaptive_scan(queries: np.ndarray, rows: np.ndarray, limits: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a rotated query and a rotated row whose distance may be below the query's limit (squared).

    Dimensions come in column blocks of STEP. After each, a pair's distance is
    estimated from the dimensions seen; the pair is abandoned once its estimate
    is above the limit by more than chance explains: with ``epsilon`` infinite,
    once the dimensions seen are above it themselves. All pairs are scanned
    together, by matrix products while many are left and pair by pair then.
    """
    d = rows.shape[1]
    at, bound = 0, lambda: limits * min(1.0, (at / d) * (1 + epsilon / math.sqrt(at)) ** 2 if at < d else 1.0)
    part = np.zeros((len(queries), len(rows)))
    left = np.ones(part.shape, bool)
    while at < d:
        a, b = queries[:, at : at + STEP], rows[:, at : at + STEP]
        part += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
        at += a.shape[1]
        left &= part <= bound()[:, None]
        if 8 * np.count_nonzero(left) < left.size:
            break
    q, r = np.nonzero(left)
    part = part[q, r]
    while at < d and len(q):
        gap = queries[q, at : at + STEP] - rows[r, at : at + STEP]
        part += np.einsum("ij,ij->i", gap, gap)
        at += gap.shape[1]
        keep = part <= bound()[q]
        q, r, part = q[keep], r[keep], part[keep]
    return q, r


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pc.list_flatten(column)
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed in the same order, so equal vectors tie; 16,384 pairs at a time."""
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[at : at + 16384], y[at : at + 16384], optimize=False) for at in range(0, len(x), 16384))])


def _first_k(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: largest score, then smallest id."""
    order = np.lexsort((ids, -scores, query))
    heads = np.flatnonzero(np.diff(query[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    return order[rank < k]


def _sample_scores(ids: np.ndarray, x: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray) -> np.ndarray:
    scores = x @ sample.T
    scores[ids[:, None] == sample_ids[None, :]] = -np.inf
    return scores


def _floors(sample_ids: np.ndarray, sample: np.ndarray, k: int):
    """Each query with a score that its k-th best has at least: the k-th best among a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            floor = np.full(len(ids), -np.inf)
            for at in range(0, len(ids) if len(sample) > k else 0, 1024):
                scores = _sample_scores(ids[at : at + 1024], x[at : at + 1024], sample_ids, sample)
                least = np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k]
                floor[at : at + 1024] = least - 1e-9 * np.abs(least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(floor)], ["id", "vec", "floor"])

    return run


def _filler(sample_ids: np.ndarray, sample: np.ndarray, k: int):
    """The k best of a sample for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for at in range(0, len(ids), 1024):
                scores = _sample_scores(ids[at : at + 1024], x[at : at + 1024], sample_ids, sample)
                q, r = np.nonzero(scores >= np.partition(scores, max(len(sample) - k, 0), axis=1)[:, max(len(sample) - k, 0)][:, None])
                some = (scores[q, r] > -np.inf).nonzero()[0]
                q, r = q[some], r[some]
                exact = products(sample[r], x[at + q])
                own = _first_k(q, sample_ids[r], exact, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + q[own]]), pa.array(sample_ids[r[own]]), pa.array(exact[own])], ["query_id", "vec_id", "score"])

    return run


def _assigner(centres: np.ndarray, radius: float):
    """Each vector's list, and how far it is from the list's centre without the further dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            near = nearest(lifted(x, radius, False), centres, 1)[:, 0] if len(x) else np.zeros(0, np.int64)
            gap = np.sqrt(((x - centres[near, : x.shape[1]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(gap)], ["id", "vec", "list", "gap"])

    return run


@dataclass
class Lists:
    """What is known of each list: centre, vectors, and the largest and the mean square distance of these from it."""

    centres: np.ndarray
    count: np.ndarray
    reach: np.ndarray
    spread: np.ndarray
    #: The block that each list belongs to, and whether lists are left out only where no vector can be better.
    block: np.ndarray
    exact: bool

    def blocks(self, rows: int) -> None:
        """Deal lists to blocks of about ``rows`` vectors; lists whose centres lie alike are together."""
        apart = self.centres - self.centres.mean(axis=0)
        along = apart @ np.linalg.svd(apart, full_matrices=False)[2][0]
        order = np.argsort(along, kind="stable")
        upto = np.cumsum(self.count[order])
        self.block[order] = np.unique(((upto - self.count[order]) // rows).astype(np.int64), return_inverse=True)[1]

    def choose(self, x: np.ndarray, floor: np.ndarray, first: int, later: bool) -> list[np.ndarray]:
        """The lists that each query visits: at first those of best centres, later the others that may hold better than its floor.

        No vector of a list has a score above that of its centre by more than
        the query's length times the list's reach; by the spread of the list's
        vectors over all dimensions, hardly one goes beyond a few deviations.
        """
        score = x @ self.centres.T
        score[:, self.count == 0] = -np.inf
        if first < score.shape[1]:
            place = np.argpartition(-score, first - 1, axis=1)
        else:
            place = np.tile(np.arange(score.shape[1]), (len(x), 1))
        if not later:
            return [np.sort(p[self.count[p] > 0]) for p in place[:, :first]]
        long = np.sqrt((x * x).sum(axis=1))[:, None]
        deviations = np.sqrt(2 * np.log(np.maximum(self.count, 2))) + LIST_SURE
        far = self.reach if self.exact else np.minimum(self.reach, np.sqrt(self.spread / x.shape[1]) * deviations)
        most = score + long * far[None, :] * (1 + 1e-9)
        may = most >= floor[:, None]
        np.put_along_axis(may, place[:, :first], False, axis=1)
        return [np.flatnonzero(m) for m in may & (self.count > 0)]


def _router(known: Lists, first: int, later: bool):
    """Each query once for each block that has lists for it, with these lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, floor = _matrix(batch.column(1)), batch.column(2).to_numpy()
            for at in range(0, len(x), 1024):
                found = known.choose(x[at : at + 1024], floor[at : at + 1024], first, later)
                owner, flat = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate([np.zeros(0, np.int64), *found])
                order = np.lexsort((flat, known.block[flat], owner))
                owner, flat = owner[order], flat[order]
                heads = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(known.block[flat], prepend=-1) != 0))
                sizes = np.diff(np.append(heads, len(flat)))
                took = pa.array(at + owner[heads])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(took) for c in range(3)), pa.array(known.block[flat[heads]].astype(np.int32)), lists(flat.astype(np.int32), sizes, pa.int32())], ["id", "vec", "floor", "block", "lists"]
                )

    return run


def _searcher(k: int, epsilon: float):
    def run(block: pa.Table) -> pa.Table:
        """The k best of the block's vectors for each of its queries, list by list."""
        asked, held = block.filter(block["asks"]), block.filter(pc.invert(block["asks"]))
        out: list[list[np.ndarray]] = [[], [], []]
        if asked.num_rows and held.num_rows:
            ids, raw = held["id"].to_numpy(), _matrix(held["vec"])
            q_ids, q_raw, floors = asked["id"].to_numpy(), _matrix(asked["vec"]), asked["floor"].to_numpy()
            radius, turn = math.sqrt((raw * raw).sum(axis=1).max()), rotation(raw.shape[1] + 1)
            rows, queries = lifted(raw, radius, False) @ turn, lifted(q_raw, radius, True) @ turn
            limits = np.maximum(radius**2 + (q_raw * q_raw).sum(axis=1) - 2 * floors, 0) * (1 + 1e-9) + 1e-12
            of = pc.list_flatten(held["lists"]).to_numpy()  # a vector has one list, a query those that it visits
            visits, visitor = pc.list_flatten(asked["lists"]).to_numpy(), pc.list_parent_indices(asked["lists"]).to_numpy()
            for one in np.unique(of):
                mine, guests = np.flatnonzero(of == one), visitor[visits == one]
                many = max(1, PAIRS // len(mine))
                for at in range(0, len(guests), many):
                    some = guests[at : at + many]
                    q, r = adaptive_scan(queries[some], rows[mine], limits[some], epsilon)
                    q, r = some[q], mine[r]
                    keep = ids[r] != q_ids[q]
                    q, r = q[keep], r[keep]
                    scores = np.concatenate([np.zeros(0), *(products(raw[r[i : i + 16384]], q_raw[q[i : i + 16384]]) for i in range(0, len(q), 16384))])
                    own = _first_k(q, ids[r], scores, k)
                    for column, found in zip(out, (q_ids[q[own]], ids[r[own]], scores[own]), strict=True):
                        column.append(found)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        q, v, scores = join(out[0], np.int64), join(out[1], np.int64), join(out[2], np.float64)
        best = _first_k(q, v, scores, k)
        return pa.table({"query_id": pa.array(q[best], pa.int64()), "vec_id": pa.array(v[best], pa.int64()), "score": pa.array(scores[best], pa.float64())})

    return run


FOUND = "query_id long, vec_id long, score double"


def _k_best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, each vector once, with their ranks."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _visit(held: DataFrame, routed: DataFrame, known: Lists, k: int) -> DataFrame:
    """What queries (id, vec, floor, block, lists) find in the lists that they name.

    A query's vector goes once to each block that it visits, not to each list.
    """
    n = int(known.block.max(initial=0)) + 1
    there = np.bincount(known.block, known.count, minlength=n)
    wants = {r["block"]: r["count"] for r in routed.groupBy("block").count().collect()}
    per = lambda counts, most: F.array(*[F.lit(max(1, -(-int(c) // most))) for c in counts])[F.col("block")]
    v_parts, q_parts = per(there, BLOCK_ROWS), per([wants.get(i, 0) for i in range(n)], BLOCK_QUERIES)
    own = lambda parts: F.pmod(F.xxhash64("id"), parts).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    placed = held.withColumn("block", F.array(*[F.lit(int(b)) for b in known.block])[F.col("list")])
    left = placed.select(F.lit(False).alias("asks"), "id", "vec", F.lit(0.0).alias("floor"), "block", F.array("list").alias("lists"), own(v_parts).alias("v"), each(q_parts).alias("q"))
    right = routed.select(F.lit(True).alias("asks"), "id", "vec", "floor", "block", "lists", each(v_parts).alias("v"), own(q_parts).alias("q"))
    return left.unionByName(right).groupBy("block", "v", "q").applyInArrow(_searcher(k, math.inf if known.exact else EPSILON), FOUND)


def nearest_neighbours(df: DataFrame, key: str, vector: str, queries, k: int = 20, n_lists: int | None = None, exact: bool = False) -> DataFrame:
    """The k vectors of largest inner product, in double precision, for each row that ``queries`` (a condition on id) selects.

    Vectors get a further dimension that turns inner products into distances
    and are dealt to the lists of their nearest centroids, which are fitted on
    FIT_ROWS rows at most, drawn by hash; every vector is in one list. A query
    first visits the FIRST_SHARE of lists with the best centres. The k-th best
    found there, or among a sample of FLOOR_ROWS vectors, limits the rest: it
    visits every other list that may hold better by the list's spread, be it
    one or all; with ``exact``, by the list's farthest vector, and no candidate
    is abandoned by chance, so the result is that of comparing all. Lists lie
    in blocks, and a query is sent once to each block that it visits; blocks of
    many vectors or queries are split, so a very common vector never fills a
    task. Within a block, rotated vectors lie
    in column blocks and an adaptive scan abandons candidates early; what it
    leaves is scored on the original vectors. The sample's own finds go only to
    queries that have fewer than k.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id. Rows with one id count as one vector, with their best score; those
    with the query's own id are no candidates. Null ids and vectors that are
    null, zero, of another length than most, or hold null or non-finite
    components take no part. Other columns are ignored. An empty table gives an
    empty result.
    """
    spark = df.sparkSession
    rows = valid_vectors(df, key, vector)
    kind = dict(rows.dtypes)["vec"]
    n, longest = rows.agg(F.count("*"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    radius = math.sqrt(longest)
    by_hash = F.xxhash64("id", "vec")
    drawn = rows.where(F.shiftrightunsigned(by_hash, 2) <= int(min(1.0, 1.2 * FIT_ROWS / n + 200 / n) * 2**62)).orderBy(by_hash, "id").limit(FIT_ROWS)
    kept = drawn.select("id", "vec").collect()
    sample, sample_ids = np.array([r["vec"] for r in kept], np.float64), np.array([r["id"] for r in kept])
    wanted = min(n_lists or -(-n // LIST_ROWS), MOST_LISTS, max(1, len(sample) // 8))
    centres = fit_centroids(lifted(sample, radius, False), wanted)
    sample, sample_ids = sample[:FLOOR_ROWS], sample_ids[:FLOOR_ROWS]

    held = staged(rows.mapInArrow(_assigner(centres, radius), f"id long, vec {kind}, list int, gap double"), "held")
    known = Lists(centres[:, :-1], *np.zeros((3, len(centres))), np.zeros(len(centres), np.int64), exact)
    for r in held.groupBy("list").agg(F.count("*").alias("n"), F.max("gap").alias("reach"), F.avg(F.col("gap") * F.col("gap")).alias("spread")).collect():
        known.count[r["list"]], known.reach[r["list"]], known.spread[r["list"]] = r["n"], r["reach"], r["spread"]
    known.blocks(min(max(n // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))), LIST_ROWS), BLOCK_ROWS))
    first = max(1, math.ceil(FIRST_SHARE * len(centres)))
    asked = staged(rows.where(queries).mapInArrow(_floors(sample_ids, sample, k), f"id long, vec {kind}, floor double"), "asked")
    routed = f"id long, vec {kind}, floor double, block int, lists array<int>"
    at_first = staged(asked.mapInArrow(_router(known, first, False), routed), "first")
    found = staged(_k_best(_visit(held, at_first, known, k), k), "found")
    unstage(at_first)
    floors = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    asked_again = asked.join(floors, "id", "left").select("id", "vec", F.greatest("floor", F.coalesce("least", F.lit(float("-inf")))).alias("floor"))
    later = staged(asked_again.mapInArrow(_router(known, first, True), routed), "later")
    found = staged(_k_best(found.drop("rank").unionByName(_visit(held, later, known, k)), k), "found")
    unstage(held)
    unstage(later)
    full = found.groupBy("query_id").count().where(F.col("count") >= k)
    short = staged(asked.join(full, asked["id"] == full["query_id"], "left_anti").select("id", "vec"), "short")
    if not short.isEmpty():
        found = staged(_k_best(found.drop("rank").unionByName(short.mapInArrow(_filler(sample_ids, sample, k), FOUND)), k), "found")
    return found.select("query_id", "rank", "vec_id", "score")

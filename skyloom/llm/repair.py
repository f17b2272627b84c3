"""Token ids in binary shards, compressed by Re-Pair grammars and decodable at any document."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.arrays import lists, runs, small_batches, utf8
from skyloom.llm.files import opened
from skyloom.llm.subwords import WordCachedTokenizer
from skyloom.session import shared_path, staged

MAGIC = b"RPR2"
HEAD = struct.Struct("<4sBIIIQQI")
#: Ids of a shard, about: a shard ends with the document that reaches this.
SHARD_IDS = 1 << 20
#: Words whose ids a worker keeps at most.
WORDS_KEPT = 1_000_000
#: Bytes of text that are encoded together: the more, the fewer words are looked up again.
RUN_BYTES = 4_000_000
#: How often a pair must occur: each replacement saves a symbol, a rule takes two and its length, together nearly four.
LEAST = 4
#: Two symbols in one word: the place of the left one and the mask of the right one.
HALF, LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
#: What a symbol may do in the next pass: begin or end a pair that was left out, or be in any pair as a new one.
LEFT, RIGHT, NEW = np.uint8(1), np.uint8(2), np.uint8(4)


def _pairs(seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of ``at``, less those of overlapping pairs, and the symbols there and behind.

    Pairs of a run of one symbol overlap; every second one counts. ``at`` must
    hold all places of such a run or none.
    """
    first, second = seq[at], seq[at + 1]
    twins = np.flatnonzero(first == second)
    if len(twins):
        place = at[twins]
        begins = np.flatnonzero(np.diff(place, prepend=-2) != 1)
        odd = (np.arange(len(twins)) - np.repeat(begins, np.diff(np.append(begins, len(twins))))) % 2 == 1
        keep = np.ones(len(at), bool)
        keep[twins[odd]] = False
        at, first, second = at[keep], first[keep], second[keep]
    return at, first, second


def _grouped(at: np.ndarray, first: np.ndarray, second: np.ndarray, symbols: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs in ascending order, where each one's places begin, and all places in that order.

    Both symbols and the place are sorted as one number where they fit into 64 bits.
    """
    wide, deep = np.uint64(max(symbols - 1, 1).bit_length()), np.uint64(max(size - 1, 1).bit_length())
    if 2 * int(wide) + int(deep) <= 64:
        keys = first.astype(np.uint64)
        keys <<= wide
        keys |= second
        keys <<= deep
        keys |= at.astype(np.uint64)
        keys.sort()
        places = (keys & np.uint64((1 << int(deep)) - 1)).astype(np.int64)
        keys >>= deep
        heads = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        pairs = keys[heads]
        return ((pairs >> wide) << HALF) | (pairs & np.uint64((1 << int(wide)) - 1)), heads, places
    keys = (first.astype(np.uint64) << HALF) | second
    order = np.argsort(keys, kind="stable")
    heads = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
    return keys[order[heads]], heads, at[order]


def repair(ids: np.ndarray, ends: np.ndarray, first: int, least: int = LEAST):
    """Replace frequent pairs by nonterminals ``first``, ``first + 1``, ... until none occurs ``least`` times.

    ``ends`` are the places after each document's last id; no pair crosses
    them. A pass counts pairs and replaces those that occur ``least`` times or
    more together, the more frequent ones first: a symbol that stands left in
    one chosen pair never stands right in another, so occurrences cannot overlap
    and the result is that of replacing them one after the other. What this
    leaves out comes in a later pass. Counts of a pair never grow but where it
    has a new symbol, so a pass looks at pairs of the last pass's symbols and at
    those that it left out. Ids are below ``first``. Returns symbols, ends in
    them, and rules as (n, 2).
    """
    seq = ids.astype(np.uint32)
    last = ends - 1  # a document has one id at least, so each ends at a place of its own
    rules: list[np.ndarray] = []
    n = first
    role = np.full(first, NEW, np.uint8)
    while len(seq) > 1:
        held = role[seq]
        may = (held[:-1] | held[1:]) & NEW
        may |= (held[:-1] & LEFT) & (held[1:] >> 1)
        may[last[:-1]] = 0
        at, a, b = _pairs(seq, np.flatnonzero(may != 0))
        if not len(at):
            break
        pairs, heads, places = _grouped(at, a, b, n, len(seq))
        counts = np.diff(np.append(heads, len(places)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        often = often[np.argsort(-counts[often], kind="stable")]
        stands, chosen, rest = bytearray(n), [], []  # 1: left in a chosen pair, 2: right in one, 3: both in a pair of its own
        lefts, rights = (pairs[often] >> HALF).tolist(), (pairs[often] & LOW).tolist()
        for k, x, y in zip(often.tolist(), lefts, rights, strict=True):
            if x != y:
                if stands[x] < 2 and stands[y] & 1 == 0:
                    stands[x], stands[y] = 1, 2
                    chosen.append(k)
                    continue
            elif not stands[x]:
                stands[x] = 3
                chosen.append(k)
                continue
            rest.append(k)
        chosen = np.sort(np.array(chosen))
        sizes = counts[chosen]
        begin = np.cumsum(sizes) - sizes
        hit = places[np.repeat(heads[chosen] - begin, sizes) + np.arange(int(sizes.sum()))]
        seq[hit] = np.repeat(np.arange(n, n + len(chosen), dtype=np.uint32), sizes)
        found, rest = pairs[chosen], pairs[rest] if rest else pairs[:0]
        rules.append(np.stack([found >> HALF, found & LOW], axis=1).astype(np.uint32))
        role = np.zeros(n + len(chosen), np.uint8)
        role[(rest >> HALF).astype(np.int64)] = LEFT
        role[(rest & LOW).astype(np.int64)] |= RIGHT
        role[n:] = NEW
        n += len(chosen)
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        last = np.cumsum(keep)[last] - 1
        seq = seq[keep]
    return seq, last + 1, np.concatenate([np.zeros((0, 2), np.uint32), *rules])


def _depths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many rules a symbol is deep, for all symbols; a rule uses ids and earlier rules only."""
    depth, new = np.zeros(first + len(rules), np.int64), np.zeros(len(rules), np.int64)
    while True:
        new = 1 + np.maximum(depth[rules[:, 0]], depth[rules[:, 1]])
        if (new == depth[first:]).all():
            return depth
        depth[first:] = new


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each nonterminal stands for."""
    depth, size = _depths(rules, first)[first:], np.ones(first + len(rules), np.int64)
    for d in range(1, int(depth.max(initial=0)) + 1):
        own = np.flatnonzero(depth == d)
        size[first + own] = size[rules[own, 0]] + size[rules[own, 1]]
    return size[first:].astype(np.uint32)


def _packed(values: np.ndarray, bits: int) -> bytes:
    """Numbers as their low 16 bits, then a plane of bits for each higher one."""
    planes = [np.packbits((values >> np.uint32(k)) & np.uint32(1) == 1, bitorder="little").tobytes() for k in range(16, bits)]
    return b"".join([(values & np.uint32(0xFFFF)).astype("<u2").tobytes(), *planes])


def _unpacked(data: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    """``n`` numbers that begin at byte ``at``, and where they end."""
    values = np.frombuffer(data, "<u2", n, at).astype(np.uint32)
    at += 2 * n
    for k in range(16, bits):
        size = -(-n // 8)
        values |= np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
        at += size
    return values, at


def pack_shard(doc_ids: list[int | None], arrays: list[np.ndarray], before: int, first: int) -> bytes:
    """The bytes of a shard: head, document table, expansion lengths, rules, symbols.

    The document table has ids, null marks, and the ends of each document in
    symbols and in ids; every array must hold one id at least. Rules and
    symbols take as many bits as the shard's largest symbol.
    """
    ends = np.cumsum([len(a) for a in arrays]).astype(np.int64)
    symbols, stops, rules = repair(np.concatenate(arrays), ends, first)
    bits = max(16, int(first + len(rules) - 1).bit_length())
    head = HEAD.pack(MAGIC, bits, len(arrays), len(rules), len(symbols), int(ends[-1]), before, first)
    table = (
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.array([i is None for i in doc_ids], "u1").tobytes(),
        stops.astype("<u4").tobytes(), ends.astype("<u8").tobytes(),
    )
    return b"".join((head, *table, expansion_lengths(rules, first).astype("<u4").tobytes(), _packed(rules.ravel(), bits), _packed(symbols, bits)))


class Shard:
    """A packed shard: decodes all of its ids, or those of one document."""

    def __init__(self, data: bytes):
        magic, bits, self.n_docs, n_rules, n_symbols, self.n_ids, self.before, self.first = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a Re-Pair shard")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        self.doc_ids, self.null_ids = take("<i8", self.n_docs), take("u1", self.n_docs).astype(bool)
        self.stops, self.ends = take("<u4", self.n_docs), take("<u8", self.n_docs).astype(np.int64)
        self.lengths = take("<u4", n_rules)
        rules, at = _unpacked(data, at, 2 * n_rules, bits)
        self.rules = rules.reshape(-1, 2)
        self.symbols, at = _unpacked(data, at, n_symbols, bits)
        self._spelled: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _spell(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All expansions in a row, those of the plain ids first, and where each symbol's begins and how long it is."""
        if self._spelled is None:
            sizes = np.concatenate([np.ones(self.first, np.int64), self.lengths])
            start = np.cumsum(sizes) - sizes
            whole = np.arange(int(sizes.sum()), dtype=np.uint32)
            depth = _depths(self.rules, self.first)[self.first :]
            self._spelled = whole, start, sizes
            for d in range(1, int(depth.max(initial=0)) + 1):
                own = np.flatnonzero(depth == d)
                a, b = self.rules[own].T
                to = start[self.first + own]
                for symbols, begin in ((a, to), (b, to + sizes[a])):
                    whole[self._places(begin, sizes[symbols])] = self._expand(symbols)
        return self._spelled

    @staticmethod
    def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """begin, begin + 1, ... of each, ``size`` numbers long, in a row."""
        at = np.cumsum(size)
        place = np.repeat(begin - (at - size), size)
        place += np.arange(len(place))
        return place

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        whole, start, size = self._spell()
        return whole.take(self._places(start[symbols], size[symbols]))

    def all_ids(self) -> np.ndarray:
        return self._expand(self.symbols)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, without decoding others."""
        return self._expand(self.symbols[self.stops[i - 1] if i else 0 : self.stops[i]])


def _writer(path: str, tokenizer: str, end_id: int, first: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordCachedTokenizer.at(tokenizer, limit=WORDS_KEPT), TaskContext.get().partitionId()
        store, folder = opened(path)
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.rpr"
        out, at, before, ids, arrays, held, manifest = None, 0, 0, [], [], 0, []

        def flush():
            nonlocal out, at, before, ids, arrays, held
            if not arrays:
                return
            if out is None:
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(name, compression=None)
            data = pack_shard(ids, arrays, before, first)
            out.write(data)
            known = [i for i in ids if i is not None]
            manifest.append((part, name.rsplit("/", 1)[1], at, len(data), len(arrays), held, min(known, default=None), max(known, default=None)))
            at, before, ids, arrays, held = at + len(data), before + held, [], [], 0

        for batch in batches:
            texts, numbers = utf8(batch.column(1)), batch.column(0).to_pylist()
            for i, j in runs(texts, RUN_BYTES):
                for k, got in zip(range(i, j), encoder.ids(texts[i:j]), strict=True):
                    ids.append(numbers[k])
                    arrays.append(np.append(got, np.uint32(end_id)))
                    held += len(got) + 1
                    if held >= shard_ids:
                        flush()
        flush()
        if out is not None:
            out.close()
        columns = list(zip(*manifest, strict=True)) or [[]] * 8
        kinds = (pa.int32(), pa.string(), *[pa.int64()] * 6)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "file", "at", "bytes", "n_docs", "n_ids", "low", "high"])

    return run


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, first: int, shard_ids: int = SHARD_IDS, partitions: int | None = None) -> DataFrame:
    """Encode doc_id and text of ``docs`` into Re-Pair shards below ``path``, in the order of doc_id.

    Every document's ids are followed by ``end_id``; ids are below ``first``.
    A task writes the shards of its range of doc_id to one file, in one pass
    and with one shard in memory. A task that runs again writes a new file, and
    only files of the returned manifest count. Null doc_ids come first, rows
    with one doc_id in the order of a hash of their texts; null text is empty,
    a text of any length is one document of one shard, and other columns are
    ignored. An empty table writes nothing. The manifest has a row for each
    shard: file and place, documents, ids, and the least and greatest doc_id.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = small_batches(docs).select("doc_id", "text").repartitionByRange(n, *order).sortWithinPartitions(*order)
    manifest = dealt.mapInArrow(_writer(path, tokenizer, end_id, first, shard_ids), "part int, file string, at long, bytes long, n_docs long, n_ids long, low long, high long")
    return staged(manifest.withColumn("folder", F.lit(path)), "manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, folder = opened(row["folder"])
            with store.open_input_file(f"{folder}/{row['file']}") as f:
                f.seek(row["at"])
                shard = Shard(f.read(row["bytes"]))
            ids, begins = shard.all_ids().astype("<u4"), np.concatenate([[0], shard.ends[:-1]])
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(begins, shard.ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard.doc_ids, mask=shard.null_ids), pa.array([row["part"]] * shard.n_docs, pa.int32()),
                    pa.array(begins + shard.before), pa.array(shard.ends - begins), pa.array(sums, pa.int64()),
                ],
                ["doc_id", "part", "start", "n_tokens", "ids_crc32"],
            )


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """Decode the shards of a manifest: doc_id, start, n_tokens and ids_crc32 of each document.

    start counts the ids of all documents before; the driver sees one sum for
    each file.
    """
    spark = manifest.sparkSession
    total, shifts = 0, []
    for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        shifts.append((r["part"], total))
        total += r["n"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    decoded = manifest.repartition(n, "file", "at").mapInArrow(_reader, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    moved = decoded.join(F.broadcast(spark.createDataFrame(shifts, "part int, shift long")), "part")  # a row for each file
    return moved.select("doc_id", (F.col("start") + F.col("shift")).alias("start"), "n_tokens", "ids_crc32")


def _picker(wanted: list[int]):
    asked = np.unique(np.array(wanted, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not ((asked >= row["low"]) & (asked <= row["high"])).any():
                    continue
                store, folder = opened(row["folder"])
                with store.open_input_file(f"{folder}/{row['file']}") as f:
                    f.seek(row["at"])
                    shard = Shard(f.read(row["bytes"]))
                own = np.flatnonzero(np.isin(shard.doc_ids, asked) & ~shard.null_ids)
                found = [shard.document(i) for i in own]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[own]), lists(np.concatenate(found).astype(np.int32), np.array([len(x) for x in found]), pa.int32())], ["doc_id", "ids"])

    return run


def read_documents(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of some documents: only shards whose range holds one of them are read, and only these documents decoded."""
    near = manifest.where(F.col("low").isNotNull() & (F.col("high") >= min(doc_ids, default=0)) & (F.col("low") <= max(doc_ids, default=-1)))
    return near.mapInArrow(_picker(doc_ids), "doc_id long, ids array<int>")


def token_shards(docs: DataFrame, tokenizer: str, end_id: int, first: int) -> DataFrame:
    """Write shards to the shared folder and read them back."""
    return read_token_shards(write_token_shards(docs, shared_path(docs.sparkSession, "shards"), tokenizer, end_id, first))

"""Arrow and numpy helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3 * 0x9E3779B97F4A7C15 % 2**64 | 1
_powers = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 64), _BASE, np.uint64)]))
    return _powers


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def exactly(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, even where others differ from them by case alone."""
    df = df.toDF(*[c if c in names else f"_other{i}" for i, c in enumerate(df.columns)])
    return df.select(*names)


def small_batches(df: DataFrame) -> DataFrame:
    """Hold the session's Arrow batches to BATCH_BYTES, so that workers stay small whatever the rows are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def runs(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Slices of whole texts that hold ``limit`` bytes at most, or one text."""
    i, held = 0, 0
    for j, t in enumerate(texts):
        if j > i and held + len(t) > limit:
            yield i, j
            i, held = j, 0
        held += len(t)
    if i < len(texts):
        yield i, len(texts)


#: Bytes that separate words, x20 and x09 to x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes hashed at a time; a text is cut only between words.
CHUNK = 1 << 20


def _hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = ~SPACE[data]
    starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    kept = data[solid]
    first = np.cumsum(solid)[starts] - 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = np.diff(np.append(first, len(kept)))
    place = np.arange(len(kept)) - np.repeat(first, lengths)
    terms = (kept.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
    return mix64(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * GOLDEN), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and each text's number of words."""
    if len(texts) == 1 and len(texts[0]) > CHUNK:
        data, parts, at = np.frombuffer(texts[0], np.uint8), [], 0
        while at < len(data):
            end = min(at + CHUNK, len(data))
            while end < len(data) and not SPACE[data[end]]:
                gap = np.flatnonzero(SPACE[data[end : end + CHUNK]])
                end = end + int(gap[0]) if len(gap) else min(end + CHUNK, len(data))
            parts.append(_hash_piece(data[at:end])[0])
            at = end
        found = np.concatenate(parts)
        return found, np.array([len(found)])
    joined = np.frombuffer(b" ".join(texts), np.uint8)
    found, starts = _hash_piece(joined)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return found, np.diff(np.searchsorted(starts, begins))


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of each text, ascending, and their number.

    Words are compared with A-Z in lower case. A text of fewer than k words has
    its whole sequence as the only shingle; one without words has none.
    """
    words, n = word_hashes([t.lower() for t in texts])
    begin = np.concatenate([[0], np.cumsum(n)])
    out = []
    if len(words) >= k:
        full = np.full(len(words) - k + 1, k, np.uint64) * GOLDEN
        for i in range(k):
            full = mix64(full + words[i : len(words) - k + 1 + i])
    for d in range(len(n)):
        if n[d] >= k:
            out.append(np.unique(full[begin[d] : begin[d + 1] - k + 1]))
        elif n[d]:
            whole = np.full(1, n[d], np.uint64) * GOLDEN
            for w in words[begin[d] : begin[d + 1]]:
                whole = mix64(whole + w)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array([len(x) for x in out], np.int64)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array from flat values and list sizes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))

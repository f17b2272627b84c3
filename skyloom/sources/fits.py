"""FITS binary tables as a PySpark data source, read with pushed filters and written by tasks (SRC4, SRC11)."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from skyloom.sources.stores import store_of

BLOCK = 2880
ROWS_A_PART = 500_000
#: Code of a column's form: numpy kind, Arrow type, Spark type.
FORMS = {
    "L": ("S1", pa.bool_(), "boolean"), "B": ("u1", pa.int32(), "int"), "I": (">i2", pa.int32(), "int"), "J": (">i4", pa.int32(), "int"),
    "K": (">i8", pa.int64(), "long"), "E": (">f4", pa.float64(), "double"), "D": (">f8", pa.float64(), "double"),
}


#: Bytes of variable-length cells that are read at a time.
HEAP_BYTES = 64 << 20


def _open(path: str):
    store, inner = store_of(path)
    return store.open_input_file(inner)


def _files(path: str) -> list[str]:
    """The file itself, or the files of a folder that end like FITS files, by name."""
    store, inner = store_of(path)
    if store.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    found = store.get_file_info(fs.FileSelector(inner))
    names = sorted(f.base_name for f in found if f.is_file and f.base_name.lower().endswith((".fits", ".fit")) and not f.base_name.startswith(("_", ".")))
    if not names:
        raise FileNotFoundError(f"no FITS file in {path}")
    return [f"{path.rstrip('/')}/{n}" for n in names]


def _header(f, at: int) -> tuple[dict[str, str], int]:
    cards, done = {}, False
    while not done:
        f.seek(at)
        block = f.read(BLOCK)
        if len(block) < BLOCK:
            raise ValueError("a FITS header ends early")
        at += BLOCK
        for i in range(0, BLOCK, 80):
            card = block[i : i + 80].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                done = True
                break
            if card[8:10] == "= ":
                text = card[10:].strip()
                if text.startswith("'"):
                    cards[key] = text[1 : text.index("'", 1)].rstrip()
                else:
                    cards[key] = text.split("/")[0].strip()
    return cards, at


def _size(c: dict[str, str]) -> int:
    if int(c.get("NAXIS", 0)) == 0:
        return 0
    n = abs(int(c["BITPIX"])) // 8 * int(c.get("GCOUNT", 1))
    body = 1
    for k in range(1, int(c["NAXIS"]) + 1):
        body *= int(c[f"NAXIS{k}"])
    return -(-n * (body + int(c.get("PCOUNT", 0))) // BLOCK) * BLOCK


@dataclass(frozen=True)
class Field:
    """A column: its code, the bytes of its cell, and how numbers are scaled. ``heap`` is the element's code of a variable-length one."""

    name: str
    code: str
    at: int
    repeat: int
    scale: float
    zero: float
    none: int | None
    heap: str = ""

    @property
    def scaled(self) -> bool:
        return (self.scale, self.zero) != (1, 0)

    def kind(self) -> str:
        code = self.heap or self.code
        one = "string" if code == "A" else "boolean" if code == "X" else "double" if self.scaled else FORMS[code][2]
        many = self.code == "X" or self.code != "A" and self.repeat > 1 or self.heap and self.heap != "A"
        return f"array<{one}>" if many else one

    def size(self) -> int:
        if self.heap:
            return 8 if self.code == "P" else 16
        return -(-self.repeat // 8) if self.code == "X" else self.repeat if self.code == "A" else self.repeat * np.dtype(FORMS[self.code][0]).itemsize

    def flat(self, raw: np.ndarray, code: str) -> pa.Array:
        """Cells of one element each, as they stand in the file."""
        gone = None if self.none is None or code not in "BIJK" else raw == self.none
        if code == "L":
            return pa.array(raw == b"T", mask=raw == b"\0")
        if self.scaled:
            return pa.array(raw.astype(np.float64) * self.scale + self.zero, mask=gone)
        return pa.array(raw.astype(raw.dtype.newbyteorder("=")), FORMS[code][1], mask=gone)


class Layout:
    """Columns, row size and place of the table of HDU ``hdu`` (2: the first extension)."""

    def __init__(self, path: str, hdu: int):
        with _open(path) as f:
            at = 0
            for k in range(1, hdu + 1):
                cards, data = _header(f, at)
                if k < hdu:
                    at = data + _size(cards)
        if cards.get("XTENSION") != "BINTABLE":
            raise ValueError(f"HDU {hdu} is no binary table")
        self.at, self.width, self.rows = data, int(cards["NAXIS1"]), int(cards["NAXIS2"])
        self.heap = data + int(cards.get("THEAP", self.width * self.rows))
        self.columns: list[Field] = []
        offset = 0
        for i in range(1, int(cards["TFIELDS"]) + 1):
            form = cards[f"TFORM{i}"]
            digits = form[: len(form) - len(form.lstrip("0123456789"))]
            repeat, code = int(digits or 1), form[len(digits)]
            none = cards.get(f"TNULL{i}")
            heap = form[len(digits) + 1] if code in "PQ" and repeat else ""
            field = Field(cards.get(f"TTYPE{i}", f"col{i}"), code, offset, repeat, float(cards.get(f"TSCAL{i}", 1)), float(cards.get(f"TZERO{i}", 0)), None if none is None else int(none), heap)
            if repeat and (code in ("A", "X") or code in FORMS or heap in FORMS or heap == "A"):
                self.columns.append(field)
                offset += field.size()
            else:  # complex numbers, and cells without any element
                offset += repeat * {"C": 8, "M": 16, "P": 8, "Q": 16}.get(code, 0)

    def schema(self) -> str:
        return ", ".join(f"`{c.name}` {c.kind()}" for c in self.columns)

    def column(self, field: Field, rows: np.ndarray, f) -> pa.Array:
        """A column of some rows (bytes, a row each); variable-length cells come from the file."""
        cell, n = np.ascontiguousarray(rows[:, field.at : field.at + field.size()]), len(rows)
        if field.heap:
            return self._far(field, cell, f)
        if field.code == "A":
            return pa.array([x.decode("ascii", "replace").rstrip() for x in cell.view(f"S{field.repeat}").ravel().tolist()], pa.string())
        if field.code == "X":
            flat = pa.array(np.unpackbits(cell, axis=1)[:, : field.repeat].ravel().astype(bool))
        else:
            flat = field.flat(cell.view(FORMS[field.code][0]).ravel(), field.code)
            if field.repeat == 1:
                return flat
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * field.repeat), flat)

    def _far(self, field: Field, cell: np.ndarray, f) -> pa.Array:
        size, begin = cell.view(">i4" if field.code == "P" else ">i8").reshape(-1, 2).astype(np.int64).T
        each = 1 if field.heap == "A" else np.dtype(FORMS[field.heap][0]).itemsize
        parts: list[bytes] = [b""] * len(size)
        order = np.argsort(begin, kind="stable")
        i = 0
        while i < len(order):  # neighbouring cells together
            j, first, end = i, int(begin[order[i]]), 0
            while j < len(order) and (j == i or begin[order[j]] + size[order[j]] * each - first <= HEAP_BYTES):
                end = max(end, int(begin[order[j]] + size[order[j]] * each))
                j += 1
            f.seek(self.heap + first)
            data = f.read(max(0, end - first))
            for k in order[i:j]:
                parts[k] = data[int(begin[k]) - first : int(begin[k] + size[k] * each) - first]
            i = j
        if field.heap == "A":
            return pa.array([x.split(b"\0")[0].decode("ascii", "replace").rstrip() for x in parts], pa.string())
        flat = field.flat(np.frombuffer(b"".join(parts), FORMS[field.heap][0]), field.heap)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), flat)


class Rows(InputPartition):
    def __init__(self, path: str, first: int, n: int):
        self.path, self.first, self.n = path, first, n


class FitsReader(DataSourceReader):
    """A task for each range of rows of each file; rows have one width, so ranges need no index."""

    def __init__(self, options: dict[str, str]):
        self.path, self.hdu = options["path"], int(options.get("hdu", "2"))
        self.filters: list[tuple] = []
        #: bytes of cells that were decoded by this reader, for tests
        self.decoded = 0

    def partitions(self):
        files = _files(self.path)
        return [Rows(p, i, min(ROWS_A_PART, n - i)) for p in files for n in [Layout(p, self.hdu).rows] for i in range(0, n, ROWS_A_PART)] or [Rows(files[0], 0, 0)]

    def _passing(self, layout: Layout, rows: np.ndarray) -> np.ndarray:
        """Places of the rows that pass all pushed filters; the cells of other columns are not looked at."""
        keep = np.ones(len(rows), bool)
        for test, name, value in self.filters:
            field = next(c for c in layout.columns if c.name == name)
            cell = np.ascontiguousarray(rows[:, field.at : field.at + field.size()]).view(FORMS[field.code][0]).ravel()
            self.decoded += cell.nbytes
            found = field.flat(cell, field.code)
            known = np.ones(len(rows), bool) if not found.null_count else np.asarray(found.is_valid())
            keep &= known & _TESTS[test](np.asarray(found.fill_null(0)), value)
        return np.flatnonzero(keep)

    def read(self, partition: Rows):
        layout = Layout(partition.path, self.hdu)
        with _open(partition.path) as f:
            for i in range(partition.first, partition.first + partition.n, 10_000):
                n = min(10_000, partition.first + partition.n - i)
                f.seek(layout.at + i * layout.width)
                rows = np.frombuffer(f.read(n * layout.width), np.uint8).reshape(-1, layout.width)
                if self.filters:
                    rows = rows[self._passing(layout, rows)]
                if len(rows):
                    self.decoded += len(rows) * sum(c.size() for c in layout.columns)
                    yield pa.RecordBatch.from_arrays([layout.column(c, rows, f) for c in layout.columns], [c.name for c in layout.columns])


#: Comparisons as Spark makes them: NaN equals itself and is greater than all numbers.
_TESTS = {
    "EqualTo": lambda x, v: x == v, "GreaterThan": lambda x, v: (x > v) | (x != x), "GreaterThanOrEqual": lambda x, v: (x >= v) | (x != x),
    "LessThan": lambda x, v: x < v, "LessThanOrEqual": lambda x, v: x <= v, "In": lambda x, v: np.isin(x, v), "IsNotNull": lambda x, v: np.ones(len(x), bool),
}


class FilteringReader(FitsReader):
    """Takes comparisons of single numbers with constants; Spark tests the rest."""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        numbers = {c.name.lower(): c.name for c in Layout(_files(self.path)[0], self.hdu).columns if c.code in "BIJKED" and c.repeat == 1}
        for f in filters:
            kind, path = type(f).__name__, getattr(f, "attribute", ())
            values = getattr(f, "value", 0)
            plain = all(isinstance(v, int | float) and not isinstance(v, bool) and not math.isnan(v) for v in (values if isinstance(values, tuple | list) else (values,)))
            if kind in _TESTS and len(path) == 1 and path[0].lower() in numbers and plain:
                self.filters.append((kind, numbers[path[0].lower()], list(values) if isinstance(values, tuple) else values))
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class FitsWriter(DataSourceArrowWriter):
    """Each task writes whole FITS files of ROWS_A_PART rows at most; committed ones get their names, others go."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = options["path"].rstrip("/"), schema, overwrite
        kinds = {"long": "K", "integer": "J", "short": "I", "double": "D", "float": "E", "boolean": "L", "string": "A"}
        wrong = [f"{f.name} {f.dataType.simpleString()}" for f in schema if f.dataType.typeName() not in kinds]
        if wrong:
            raise ValueError(f"FITS tables here hold numbers, logicals and texts, not {', '.join(wrong)}")
        self.codes = [kinds[f.dataType.typeName()] for f in schema]
        self.before: list[str] = []
        store, inner = store_of(self.path)
        if store.get_file_info(inner).type == fs.FileType.Directory:
            self.before = [f.path for f in store.get_file_info(fs.FileSelector(inner)) if f.is_file and f.base_name.endswith(".fits")]

    def _file(self, table: pa.Table) -> str:
        store, inner = store_of(self.path)
        store.create_dir(inner, recursive=True)
        name = f"_{uuid.uuid4().hex}.fits"
        with store.open_output_stream(f"{inner}/{name}", compression=None) as out:
            out.write(fits_table({f.name: _cells(table.column(i), self.codes[i]) for i, f in enumerate(self.schema)}))
        return name

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        held, n, files = [], 0, []
        for batch in iterator:
            while batch.num_rows:
                part = batch.slice(0, ROWS_A_PART - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == ROWS_A_PART:
                    files.append(self._file(pa.Table.from_batches(held)))
                    held, n = [], 0
        if n:
            files.append(self._file(pa.Table.from_batches(held)))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, inner = store_of(self.path)
        names = [n for m in messages if m for n in m.files]
        if not names and (self.overwrite or not self.before):
            kinds = {"K": pa.int64(), "J": pa.int32(), "I": pa.int16(), "D": pa.float64(), "E": pa.float32(), "L": pa.bool_(), "A": pa.string()}
            names = [self._file(pa.table({f.name: pa.array([], kinds[c]) for f, c in zip(self.schema, self.codes, strict=True)}))]
        if self.overwrite:
            for old in self.before:
                store.delete_file(old)
        run = uuid.uuid4().hex[:8]
        for i, name in enumerate(names):
            store.move(f"{inner}/{name}", f"{inner}/part-{i:05d}-{run}.fits")
        for f in store.get_file_info(fs.FileSelector(inner)):
            if f.base_name.startswith("_") and f.base_name.endswith(".fits"):  # of tasks that ran twice
                store.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, inner = store_of(self.path)
        for m in messages:
            for name in m.files if m else ():
                store.delete_file(f"{inner}/{name}")


def _cells(column: pa.ChunkedArray, code: str) -> tuple[np.ndarray, int | None, bool]:
    """A column as fits_table() takes it."""
    if code == "A":
        texts = [(x or "").encode("ascii", "replace") for x in column.to_pylist()]
        return np.array(texts, f"S{max([1, *map(len, texts)])}"), None, False
    if code == "L":
        return np.array([b"\0" if x is None else b"T" if x else b"F" for x in column.to_pylist()], "S1"), None, True
    if code in "DE":
        return column.to_numpy().astype({"D": "f8", "E": "f4"}[code]), None, False  # null is NaN
    kind = np.dtype({"K": "i8", "J": "i4", "I": "i2"}[code])
    none = int(np.iinfo(kind).min) if column.null_count else None
    return np.asarray(column.fill_null(np.iinfo(kind).min) if none is not None else column).astype(kind), none, False


class FitsDataSource(DataSource):
    """``spark.read.format("fits").option("hdu", 2).load(path)``: columns of a binary table, or of those of a folder.

    Numbers, logicals, bits and texts; several of them in a cell, or a cell of
    variable length, are an array, and a column's null number (TNULL) and
    undefined logicals are null. Complex columns are left out. With the option
    ``pushdown`` (which Spark must allow, see read_fits), comparisons of numbers
    are tested first, and the other cells of rows that fail are not decoded.

    ``df.write.format("fits").mode(...).save(path)`` writes a folder of FITS
    files. Null logicals and integers stay null (unless an integer column holds
    its least number beside nulls, which becomes null as well), null doubles become
    NaN, null texts are empty, and texts are ASCII without blanks at their end.
    """

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return Layout(_files(self.options["path"])[0], int(self.options.get("hdu", "2"))).schema()

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else FitsReader)(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> FitsWriter:
        return FitsWriter(self.options, schema, overwrite)


def row_number() -> Column:
    """A row's place in the table, from 0, right behind read_fits: tasks hold ranges of ROWS_A_PART rows in order."""
    seen = F.monotonically_increasing_id()
    return F.shiftright(seen, 33) * ROWS_A_PART + seen.bitwiseAND(F.lit((1 << 33) - 1))


def read_fits(spark: SparkSession, path: str, hdu: int = 2) -> DataFrame:
    """A table of a FITS file or of a folder of them; filters are pushed where spark.sql.python.filterPushdown.enabled is set."""
    spark.dataSource.register(FitsDataSource)
    pushed = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()
    return spark.read.format("fits").option("hdu", str(hdu)).option("pushdown", pushed).load(path)


def write_fits(df: DataFrame, path: str) -> None:
    """Write a folder of FITS files, one or more for each task."""
    df.sparkSession.dataSource.register(FitsDataSource)
    df.write.format("fits").mode("overwrite").save(path)


def fits_table(columns: dict[str, np.ndarray]) -> bytes:
    """The bytes of a FITS file with one binary table; text arrays are of bytes.

    A column is an array, or an array, the number that is null in it (or None),
    and whether its single bytes T, F and zero are logicals.
    """
    code = {"f8": "D", "f4": "E", "i8": "K", "i4": "J", "i2": "I", "u1": "B", "b1": "L"}

    def header(cards: list[tuple[str, object]]) -> bytes:
        lines = [f"{k:<8}= {repr(v) if isinstance(v, str) else 'T' if v is True else v:>20}" for k, v in cards] + ["END"]
        text = "".join(f"{x:<80}" for x in lines)
        return (text + " " * (-len(text) % BLOCK)).encode()

    forms, parts, nulls = [], [], []
    for name, v in columns.items():
        v, none, logical = v if isinstance(v, tuple) else (v, None, False)
        v = np.asarray(v)
        nulls.append(none)
        if logical:
            forms.append((name, "L"))
            parts.append(v.view(np.uint8)[:, None])
        elif v.dtype.kind == "S":
            forms.append((name, f"{v.dtype.itemsize}A"))
            parts.append(v.view(np.uint8).reshape(len(v), v.dtype.itemsize))
        elif v.dtype.kind == "b":
            forms.append((name, "L"))
            parts.append(np.where(v, ord("T"), ord("F")).astype(np.uint8)[:, None])
        else:
            forms.append((name, code[v.dtype.str[1:]]))
            parts.append(np.ascontiguousarray(v.astype(v.dtype.newbyteorder(">"))).view(np.uint8).reshape(len(v), v.dtype.itemsize))
    body = np.concatenate(parts, axis=1)
    cards: list[tuple[str, object]] = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", body.shape[1]), ("NAXIS2", body.shape[0]), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(forms))]
    for i, (name, form) in enumerate(forms, 1):
        cards += [(f"TTYPE{i}", name), (f"TFORM{i}", form)] + ([(f"TNULL{i}", nulls[i - 1])] if nulls[i - 1] is not None else [])
    data = body.tobytes()
    return header([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0)]) + header(cards) + data + b"\0" * (-len(data) % BLOCK)

"""CSV files with names of their own, written by tasks (SNK1, SNK2, SNK5)."""

from __future__ import annotations

import csv
import fnmatch
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from skyloom.sources.stores import store_of

#: The column that names a row's file.
FILE = "_file"


@dataclass
class Files(WriterCommitMessage):
    names: list[str]
    folder: str


class NamedCsvWriter(DataSourceArrowWriter):
    """Rows come sorted by file. A task writes into a folder of its own, whose files get their places once all tasks are done."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.columns = options["path"].rstrip("/"), [f.name for f in schema if f.name != FILE]
        self.always = [x for x in options.get("always", "").split(",") if x]
        self.replaces = [x for x in options.get("replaces", "").split(",") if x]
        self.run = f"_writing-{uuid.uuid4().hex}"

    def _begin(self, folder: str, name: str):
        store, inner = store_of(self.path)
        store.create_dir(f"{inner}/{self.run}/{folder}", recursive=True)
        out = store.open_output_stream(f"{inner}/{self.run}/{folder}/{name}", compression=None)
        out.write(_lines([self.columns]))
        return out

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        folder, names, out = uuid.uuid4().hex, [], None
        for batch in iterator:
            files, values = batch[FILE].to_pylist(), [batch[c].to_pylist() for c in self.columns]
            rows, at = list(zip(*values, strict=True)), 0
            while at < len(files):
                end = at
                while end < len(files) and files[end] == files[at]:
                    end += 1
                if not names or names[-1] != files[at]:
                    if out is not None:
                        out.close()
                    names.append(files[at])
                    out = self._begin(folder, files[at])
                out.write(_lines(rows[at:end]))
                at = end
        if out is not None:
            out.close()
        return Files(names, folder)

    def commit(self, messages: list[Files | None]) -> None:
        store, inner = store_of(self.path)
        done = [m for m in messages if m]
        missing = [n for n in self.always if not any(n in m.names for m in done)]
        for name in missing:
            self._begin("none", name).close()
        for f in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if f.is_file and any(fnmatch.fnmatch(f.base_name, p) for p in self.replaces):
                store.delete_file(f.path)
        for folder, names in [*((m.folder, m.names) for m in done), ("none", missing)]:
            for name in names:
                store.move(f"{inner}/{self.run}/{folder}/{name}", f"{inner}/{name}")
        self._clean()

    def abort(self, messages: list[Files | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        store, inner = store_of(self.path)
        if store.get_file_info(f"{inner}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{inner}/{self.run}")


def _lines(rows: list) -> bytes:
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    return text.getvalue().encode()


class NamedCsv(DataSource):
    """``df.write.format("named_csv")``: see write_named_csv."""

    @classmethod
    def name(cls) -> str:
        return "named_csv"

    def writer(self, schema: StructType, overwrite: bool) -> NamedCsvWriter:
        return NamedCsvWriter(self.options, schema)


def write_named_csv(df: DataFrame, path: str, file: Column, order: list[Column], columns: list[str] | None = None, always: list[str] | None = None, replaces: list[str] | None = None) -> None:
    """Write ``columns`` of ``df`` as CSV files with a header, each row into the file that ``file`` names, by rising values of ``order``.

    A file is written by one task, row after row, and nothing passes the
    driver. Files appear only when all tasks are done: a job that fails leaves
    none and changes none. Files of ``always`` have their header where no row
    goes there; files that match patterns of ``replaces`` and are of an earlier
    run go. Null values are empty; file names must not be null.
    """
    df.sparkSession.dataSource.register(NamedCsv)
    by = [f"_by{i}" for i in range(len(order))]
    rows = df.select(file.alias(FILE), *[c.alias(n) for c, n in zip(order, by, strict=True)], *[F.col(f"`{c}`") for c in columns or df.columns])
    rows = rows.repartition(FILE).sortWithinPartitions(FILE, *by).drop(*by)
    rows.write.format("named_csv").mode("append").option("always", ",".join(always or [])).option("replaces", ",".join(replaces or [])).save(path)

"""WARC archives as a PySpark data source, with revisit records for equal payloads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from skyloom.llm.files import listed, opened
from skyloom.llm.skew import salted_join
from skyloom.session import staged

READ_SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, "
    "content_type string, content_length long, payload_length long, headers map<string,string>, payload binary, file string, offset long"
)
#: Columns that a pushed filter may decide, and the headers that hold them.
BY_HEADER = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A writing task begins a new file after so many bytes; files with an index are read in ranges of this size.
FILE_BYTES = 32 << 20
#: Bytes of a record that are decoded to read its fields, at first.
HEAD_BYTES = 4096
DATE = "2020-01-01T00:00:00Z"
FILE_INFO = b"format: WARC File Format 1.1\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """One record: version line, named fields, block and two empty lines. Line breaks in values become blanks."""
    named = {"WARC-Type": kind, **headers, "Content-Length": str(len(block))}
    head = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in named.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    last = ""
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            found[last] = value.strip()
    return found


def parse_records(stream: io.BufferedIOBase, wanted=lambda fields: True, payloads: bool = True, size: int | None = None) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """Offset, fields and block of each record whose fields are wanted.

    Headers come first; the block of an unwanted record, or every block if
    ``payloads`` is false, is passed over without being kept. ``stream`` gives
    uncompressed bytes; offsets count these. With ``size``, the number of its
    bytes, the stream can seek, and what is passed over is not read.
    """
    at = 0
    while True:
        line = stream.readline()
        if not line:
            return
        begin = at
        at += len(line)
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {begin}")
        head = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line)
            at += len(line)
        at += len(line)
        fields = _fields(b"".join(head))
        length = int(fields.get("content-length", 0))
        keep = wanted(fields)
        block, left = ([] if keep and payloads else None), length
        if block is None and size is not None:
            if at + length > size:
                raise ValueError(f"record at byte {begin} ends early")
            stream.seek(at + length)
            left = 0
        while left:
            piece = stream.read(min(left, 1 << 20))
            if not piece:
                raise ValueError(f"record at byte {begin} ends early")
            left -= len(piece)
            if block is not None:
                block.append(piece)
        at += length
        if keep:
            yield begin, fields, None if block is None else b"".join(block)


def split_http(fields: dict[str, str], block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP fields and body of an application/http block; other blocks are all body."""
    if not fields.get("content-type", "").startswith("application/http"):
        return {}, block
    head, _, body = block.partition(b"\r\n\r\n")
    return _fields(head.partition(b"\r\n")[2]), body


def index_path(path: str) -> str:
    """Where the index of an archive is: beside it, under a hidden name."""
    folder, _, name = path.rpartition("/")
    return f"{folder}/.{name}.idx"


def parse_members(file, members: np.ndarray, wanted=lambda fields: True, payloads: bool = True) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """As parse_records, from a file whose gzip members (offsets and sizes) hold a record each; offsets are those of members.

    Of each member, only the fields are decoded; the block follows where it is
    wanted, and the other members' rest is left as it is.
    """
    for at, size in members.tolist():
        file.seek(at)
        first = file.read(min(size, HEAD_BYTES))
        unpack = zlib.decompressobj(31)
        head = unpack.decompress(first, HEAD_BYTES)
        while b"\r\n\r\n" not in head:
            more = unpack.unconsumed_tail or file.read(min(HEAD_BYTES, size - (file.tell() - at)))
            if not more:
                raise ValueError(f"member at byte {at} holds no record")
            head += unpack.decompress(more, HEAD_BYTES)
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        lines, _, begun = head.partition(b"\r\n\r\n")
        fields = _fields(lines.partition(b"\r\n")[2])
        if not wanted(fields):
            continue
        block = None
        if payloads:
            block = begun + unpack.decompress(unpack.unconsumed_tail + file.read(size - (file.tell() - at)))
            length = int(fields.get("content-length", 0))
            if len(block) < length:
                raise ValueError(f"record at byte {at} ends early")
            block = block[:length]
        yield at, fields, block


@dataclass
class FilePart(InputPartition):
    """Records of a file that begin from byte ``low`` on and before ``high``; only files with an index are cut."""

    store: str
    path: str
    size: int
    low: int
    high: int
    indexed: bool


class WarcReader(DataSourceReader):
    """A task for each file, or for each range of FILE_BYTES of one that has an index. Filters on record type and header columns are decided on parsed headers."""

    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        self.payloads = options.get("payloads", "true").lower() != "false"
        self.allowed: dict[str, set] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and name in BY_HEADER and f.value is not None:
                values = {f.value}
            elif isinstance(f, In) and name in BY_HEADER:
                values = {v for v in f.value if v is not None}
            elif isinstance(f, IsNotNull) and name in BY_HEADER:
                self.present.add(BY_HEADER[name])
                continue
            else:
                yield f
                continue
            key = BY_HEADER[name]
            self.allowed[key] = self.allowed[key] & values if key in self.allowed else values

    def partitions(self):
        every = listed(self.uri, hidden=True)
        there, parts = {path for path, _ in every}, []
        for path, size in every:
            if path.endswith((".warc", ".warc.gz")) and not path.rpartition("/")[2].startswith((".", "_")):
                indexed = path.endswith(".gz") and index_path(path) in there
                cuts = [*range(0, size, FILE_BYTES)] if indexed else [0]
                parts += [FilePart(self.uri, path, size, a, b, indexed) for a, b in zip(cuts, [*cuts[1:], size], strict=True)]
        return parts or [FilePart(self.uri, "", 0, 0, 0, False)]

    def wanted(self, fields: dict[str, str]) -> bool:
        return all(h in fields for h in self.present) and all(fields.get(h) in v for h, v in self.allowed.items())

    def read(self, partition: FilePart):
        if not partition.path:
            return
        store, _ = opened(partition.store)
        with store.open_input_file(partition.path) as raw:
            if partition.indexed:
                with store.open_input_stream(index_path(partition.path), compression=None) as f:
                    members = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
                members = members[(members[:, 0] >= partition.low) & (members[:, 0] < partition.high)]
                records = parse_members(raw, members, self.wanted, self.payloads)
            elif partition.path.endswith(".gz"):
                records = parse_records(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20), self.wanted, self.payloads)
            else:
                records = parse_records(io.BufferedReader(raw, 1 << 16), self.wanted, self.payloads, partition.size)
            for offset, f, block in records:
                body, length = None, None
                if block is not None:
                    http, body = split_http(f, block)
                    if f.get("warc-type") == "revisit":
                        body, length = None, int(http["content-length"]) if http.get("content-length", "").isdigit() else None
                    else:
                        length = len(body)
                digest = f.get("warc-payload-digest")
                yield (
                    f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-date"), f.get("warc-refers-to"),
                    digest, f.get("content-type"), int(f.get("content-length", 0)), length, f, body, partition.path, offset,
                )


@dataclass
class Written(WriterCommitMessage):
    moves: list


class WarcWriter(DataSourceWriter):
    """Rows to .warc.gz files, a gzip member for each record behind one that describes the file, with an index of the members beside it.

    Files get their names when the job commits, and what they replace goes
    after that.
    """

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.uri, self.names, self.overwrite = options["path"].rstrip("/"), schema.fieldNames(), overwrite
        self.level = int(options.get("level", "4"))

    def write(self, rows):
        store, folder = opened(self.uri)
        store.create_dir(folder, recursive=True)
        moves, out, held, members = [], None, 0, []

        def add(record: bytes) -> None:
            nonlocal held
            packed = gzip.compress(record, self.level, mtime=0)
            out.write(packed)
            members.append((held, len(packed)))
            held += len(packed)

        def close() -> None:
            nonlocal out, members
            out.close()
            out = None
            whole = moves[-1][1]
            moves.append((f"{index_path(whole)}.tmp", index_path(whole)))
            with store.open_output_stream(moves[-1][0], compression=None) as index:
                index.write(np.array(members, "<i8").tobytes())
            members = []

        try:
            for row in rows:
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    moves.append((f"{folder}/.{name}.tmp", f"{folder}/{name}"))
                    out, held = store.open_output_stream(moves[-1][0], compression=None), 0
                    add(record_bytes("warcinfo", {"WARC-Record-ID": f"<urn:file:{name}>", "WARC-Date": DATE, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, FILE_INFO))
                add(row_record(row.asDict()))
                if held >= FILE_BYTES:
                    close()
            if out is not None:
                close()
        except BaseException:
            if out is not None:
                out.close()
            self._drop(store, moves)
            raise
        return Written(moves)

    @staticmethod
    def _drop(store, moves: list) -> None:
        for half, _ in moves:
            if store.get_file_info(half).type.name == "File":
                store.delete_file(half)

    def commit(self, messages):
        store, _ = opened(self.uri)
        old = [p for p, _ in listed(self.uri, hidden=True) if p.endswith((".warc", ".warc.gz", ".idx"))] if self.overwrite else []
        for m in messages:
            for half, whole in m.moves if m else ():
                store.move(half, whole)
        for path in old:
            store.delete_file(path)

    def abort(self, messages):
        store, _ = opened(self.uri)
        for m in messages:
            self._drop(store, m.moves if m else [])


def row_record(r: dict) -> bytes:
    """The record of a row of record_id, target_uri, payload, record_type, refers_to and optional payload_digest, date, content_type."""
    payload = bytes(r["payload"] or b"")
    kind = r["record_type"]
    digest = r.get("payload_digest") or base32_sha1(payload)
    headers = {
        "WARC-Record-ID": r["record_id"], "WARC-Date": r.get("date") or DATE, "WARC-Target-URI": r.get("target_uri") or "",
        "WARC-Payload-Digest": digest if ":" in digest else f"sha1:{digest}", "Content-Type": "application/http; msgtype=response",
    }
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {r.get('content_type') or 'text/html; charset=utf-8'}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "revisit":
        headers |= {"WARC-Refers-To": r["refers_to"], "WARC-Profile": PROFILE}
        return record_bytes(kind, headers, http)
    return record_bytes(kind, headers, http + payload)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").save(folder)``.

    Option payloads=false leaves every payload undecoded. Filters on record_id,
    record_type, target_uri, date, refers_to, payload_digest and content_type
    are pushed down and decided on a record's fields, before its payload is
    decoded; of archives with an index beside them (those written here) and of
    plain files, other payloads are not even read. The last column, offset, is
    that of the gzip member where there is an index, else that of the record in
    the uncompressed bytes. Overwriting replaces archives and indexes only.
    Spark keeps pushed filters with a loaded frame, so load a folder anew for
    each query that filters otherwise.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def base32_of_hex(digest):
    """Base32 of a SHA-1 in hex, as a column: four times 40 bits are eight digits each."""
    digits = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows for the writer from page_id, url and html: equal payloads of at least ``least_bytes`` are stored once.

    The page with the largest page_id of equal payloads is the response, the
    others revisit it. Payloads are compared by SHA-1. Null html is an empty
    payload; a null page_id never is the target of a revisit unless all are
    null, and then all are responses; rows that repeat the largest page_id are
    all responses. Payloads of any length are whole, and other columns are
    ignored. Only digests are grouped, and a digest of very many pages is dealt
    to several tasks. The pages that revisit others are joined to the table by
    page and digest, so html moves once and evenly, or not at all where that
    list is small.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    base = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("hex"))
    keys = staged(base.where(F.octet_length("payload") >= least_bytes).select("page_id", "hex"), "digests")
    keepers = keys.groupBy("hex").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1 and keeper is not null").drop("copies")
    follow = salted_join(keys, staged(keepers, "keepers"), ["hex"], "page_id").where(~F.col("page_id").eqNullSafe(F.col("keeper")))
    follow = staged(follow.select(F.col("page_id").alias("_page"), F.col("hex").alias("_hex"), "keeper").distinct(), "revisits")
    joined = base.join(follow, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("hex") == F.col("_hex")), "left")
    again = F.col("keeper").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return joined.select(
        urn(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"), "payload",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, urn(F.col("keeper"))).alias("refers_to"),
    )


def archived_pages(archive: DataFrame) -> DataFrame:
    """Per record of archives written from with_revisits: page_id, payload size and digest, type and the page referred to.

    Responses are measured on the payload that was read; revisits carry length
    and digest of the full payload in their headers.
    """
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    payload = F.col("payload")
    return archive.where(F.col("record_type").isin("response", "revisit")).select(
        number("record_id").alias("page_id"),
        F.coalesce(F.octet_length(payload).cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(base32_of_hex(F.sha1(payload)), F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )

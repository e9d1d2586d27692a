"""WARC archives as a Spark data source, ``spark.read.format("warc")``.

Each record is two gzip members, the header and the payload; each states the length of its own compressed bytes in the
header field that gzip sets aside for such uses (subfield ``sl``), so a reader may seek over a payload that nobody asked
for. To any other reader the file is one gzip stream of plain records. Files are the partitions, large ones cut at
records that the index beside them lists. Filters on the record type and on the page id, the target and the payload
digest are pushed to the reader and tested on headers alone; the payload is read and unpacked only for records that pass,
and only if the column ``payload`` is asked for.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from hazewell.llm.token_files import _put, open_path

#: Smaller payloads are never revisits.
MIN_REVISIT = 100
SPLIT_BYTES = 64 << 20
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20
SCHEMA = "record_type string, page_id long, target string, refers_to long, payload_bytes long, payload_digest string, payload binary"
HEADER_FIELDS = ("record_type", "page_id", "target", "refers_to", "payload_bytes", "payload_digest")


def _member(data: bytes) -> bytes:
    """One gzip member whose extra field tells how many compressed bytes it has in all."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    size = 10 + 2 + 8 + len(body) + 8
    extra = struct.pack("<2sHI", b"sl", 4, size)
    return struct.pack("<4sIBBH", b"\x1f\x8b\x08\x04", 0, 0, 255, len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _member_size(head: bytes, at: int) -> int:
    if len(head) < 20 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"sl":
        raise ValueError(f"no record starts at {at}")
    return struct.unpack_from("<I", head, 16)[0]


def _plain(member: bytes) -> bytes:
    return zlib.decompress(member, 31)


def _clean(value: str) -> str:
    """A header value on one line: other control characters and white space at its ends would not come back."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in value)


def header(kind: str, page_id: int | None, target: str | None, digest: str, size: int, refers_to: int | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {_clean(target)}"] if target is not None else []
    lines += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: text/html;charset=utf-8", f"Content-Length: {0 if kind == 'revisit' else size}", "", ""]
    return "\r\n".join(lines).encode()


def parse_header(data: bytes) -> dict:
    lines = data.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC header")
    found = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:] if line)
    number = lambda k: int(found[k]) if k in found else None
    target = found.get("WARC-Target-URI")
    if target is not None and "%" in target:
        target = "".join([(p if not n else chr(int(p[:2], 16)) + p[2:]) for n, p in enumerate(target.split("%"))])
    return {
        "record_type": found["WARC-Type"], "page_id": number("X-Page-Id"), "target": target, "refers_to": number("X-Refers-To-Page-Id"),
        "payload_bytes": number("X-Payload-Length"), "payload_digest": found["WARC-Payload-Digest"].removeprefix("sha256:"),
    }


class Part(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _test(f):
    """A header test for a pushed filter, or None if it is not one that headers can answer."""
    name = f.attribute[0] if len(f.attribute) == 1 else None
    if name not in HEADER_FIELDS:
        return None
    value = getattr(f, "value", None)
    return {
        EqualTo: lambda h: h[name] is not None and h[name] == value, EqualNullSafe: lambda h: h[name] == value, In: lambda h: h[name] is not None and h[name] in value,
        IsNull: lambda h: h[name] is None, IsNotNull: lambda h: h[name] is not None, GreaterThan: lambda h: h[name] is not None and h[name] > value,
        GreaterThanOrEqual: lambda h: h[name] is not None and h[name] >= value, LessThan: lambda h: h[name] is not None and h[name] < value,
        LessThanOrEqual: lambda h: h[name] is not None and h[name] <= value,
    }.get(type(f))


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.path = options.get("path")
        self.names = [f.name for f in schema.fields]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self):
        store, root = open_path(self.path)
        found = store.get_file_info(filesystems.FileSelector(root, recursive=True)) if store.get_file_info(root).type == filesystems.FileType.Directory else [store.get_file_info(root)]
        out = []
        for info in sorted(found, key=lambda i: i.path):
            if not info.path.endswith(".warc.gz"):
                continue
            starts, index = [], f"{info.path}.starts"
            if info.size > self.split and store.get_file_info(index).type == filesystems.FileType.File:
                with store.open_input_stream(index) as f:
                    data = f.read()
                starts = [s for (s,) in struct.iter_unpack("<Q", data)]
            cuts = [0]
            for s in starts:
                if s - cuts[-1] >= self.split:
                    cuts.append(s)
            out += [Part(info.path, a, b) for a, b in zip(cuts, [*cuts[1:], info.size])]
        return out or [Part("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        store, _ = open_path(self.path)
        tests = [_test(f) for f in self.filters]
        wanted = "payload" in self.names
        rows: list[dict] = []
        held = 0
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in ("page_id", "refers_to", "payload_bytes") else pa.string()) for n in self.names])
        with store.open_input_file(partition.path) as f:
            at = partition.start
            while at < partition.end:
                size = _member_size(f.read_at(20, at), at)
                row = parse_header(_plain(f.read_at(size, at)))
                at += size
                size = _member_size(f.read_at(20, at), at)
                if all(t(row) for t in tests):
                    if wanted:
                        body = _plain(f.read_at(size, at))
                        row["payload"] = None if row["record_type"] == "revisit" else body[: row["payload_bytes"]]
                        held += len(body)
                        if row["payload"] is not None and hashlib.sha256(row["payload"]).hexdigest() != row["payload_digest"]:
                            raise ValueError(f"{partition.path}: damaged payload at {at}")
                    rows.append({n: row[n] for n in self.names})
                at += size
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcSource(DataSource):
    """Options: ``path`` (a file or folder), ``columns`` (those to read; all by default), ``splitBytes``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return ", ".join(c for c in SCHEMA.split(", ") if not wanted or c.split()[0] in wanted)

    def reader(self, schema):
        return WarcReader(schema, self.options)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records under a path. Without ``payload`` among the columns no payload is read; a revisit's payload is null."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    source = spark.read.format("warc")
    return (source.option("columns", ",".join(columns)) if columns else source).load(path)


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, target, payload, payload_digest, payload_bytes, record_type, refers_to of each page.

    Of equal payloads of at least ``min_revisit`` bytes the one with the smallest page_id is the response, the others are
    revisits; rows that repeat that page_id are responses too. A null page_id never is the smallest unless all are null.
    Only digests with more than one page meet the pages in a join; its hot digests may be split by adaptive execution.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("target"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.length("payload").cast("long")})
    first = rows.filter(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    rows = rows.join(first, "payload_digest", "left").withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    return rows.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("first"))).drop("first")


def write(pages: DataFrame, folder: str, **columns) -> DataFrame:
    """Write each page as a record; one row (file, n_records) per archive. Null html is an empty payload, a null url has no target.

    Each task writes its own file under a name that a second run of the task takes over whole.
    """
    rows = plan_records(pages, **columns).select("page_id", "target", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts: list[bytes] = []

        def members() -> Iterator[bytes]:
            at = 0
            for batch in batches:
                for page, target, payload, digest, size, kind, first in zip(*(c.to_pylist() for c in batch.columns)):
                    starts.append(struct.pack("<Q", at))
                    data = _member(header(kind, page, target, digest, size, first)) + _member((b"" if kind == "revisit" else payload) + b"\r\n\r\n")
                    at += len(data)
                    yield data

        stream = members()
        head = next(stream, None)
        if head is None:
            return
        store, at = open_path(folder)
        store.create_dir(at, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"

        def every() -> Iterator[bytes]:
            yield head
            yield from stream

        _put(store, posixpath.join(at, name), every())
        _put(store, posixpath.join(at, f"{name}.starts"), iter([b"".join(starts)]))
        yield pa.RecordBatch.from_pydict({"file": [f"{folder.rstrip('/')}/{name}"], "n_records": [len(starts)]}, schema=pa.schema([("file", pa.string()), ("n_records", pa.int64())]))

    return rows.mapInArrow(save, "file string, n_records long")

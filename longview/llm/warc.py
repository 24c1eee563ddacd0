"""A WARC data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans a partition for each archive file. Filters on ``record_type``, ``record_id`` and
``target_uri`` are pushed down: a record's header block is parsed first, and the payload of a record
that no filter keeps, or of any record with option ``payload=false``, is neither copied nor decoded.
Gzipped archives hold a member for each record; members written here carry their length in the gzip
extra field ``sl`` (WARC 1.0, annex D), so that unwanted ones are skipped without inflating them.
Plain files are passed over by Content-Length, gzipped ones of other writers are inflated in a stream.

Writing makes files named by task attempt; the driver lists those of the attempts that succeeded in
``_manifest.json``, and readers of a folder with a manifest take no other files. A lost executor or a
repeated task so leaves no doubled records.

Paths may be of any file system that pyarrow opens (file, hdfs, s3, gs ...).

Defined cases: null payloads are written as empty; null headers are left out; records of unknown type
are returned as they are; an empty table gives an archive folder without records.
"""

from __future__ import annotations

import datetime
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .common import lookup, scratch, settle

SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, refers_to string, payload_digest string, payload_length long, payload binary"
_NAMES = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length"}
_ARROW = pa.schema([(c, pa.binary() if c == "payload" else pa.int64() if c == "payload_length" else pa.string()) for c in (x.split()[0] for x in SCHEMA.split(", "))])
ROLL_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
_PUSHED = ("record_type", "record_id", "target_uri")


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return pyarrow.fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:", path) else f"file://{path}")


def _clean(v: str) -> str:
    return re.sub(r"[\r\n]+", " ", v)


def record_bytes(row: dict) -> bytes:
    """A WARC/1.0 record."""
    payload = row.get("payload") or b""
    head = ["WARC/1.0"]
    head += [f"{h}: {_clean(str(row[c]))}" for c, h in _NAMES.items() if row.get(c) is not None]
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` has its own length and that of its content."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    total = 12 + 12 + len(body) + 8
    if total >= 1 << 32 or len(data) >= 1 << 32:  # too long for the field: a plain member
        return b"\x1f\x8b\x08\x00" + bytes(4) + b"\x00\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra = b"sl" + struct.pack("<HII", 8, total, len(data))
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data))


def parse_head(head: bytes) -> dict:
    """Header fields by lower-case name; ``""`` has the version line. Folded lines are joined."""
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).splitlines()
    out = {"": lines[0] if lines else ""}
    for x in lines[1:]:
        k, sep, v = x.partition(":")
        if sep:
            out[k.strip().lower()] = v.strip()
    return out


class _Plain:
    """Records of an uncompressed stream."""

    def __init__(self, f):
        self.f, self.buf = f, b""

    def _more(self) -> bool:
        x = self.f.read(1 << 16)
        self.buf += x
        return bool(x)

    def _skip(self, n: int) -> None:
        have = min(n, len(self.buf))
        self.buf, n = self.buf[have:], n - have
        while n:
            x = self.f.read(min(n, 1 << 20))
            if not x:
                raise EOFError("the archive ends inside a record")
            n -= len(x)

    def _take(self, n: int) -> bytes:
        parts, have = [self.buf[:n]], min(n, len(self.buf))
        self.buf = self.buf[have:]
        while have < n:
            x = self.f.read(min(n - have, 1 << 20))
            if not x:
                raise EOFError("the archive ends inside a record")
            parts.append(x)
            have += len(x)
        return b"".join(parts)

    def records(self, want) -> Iterator[tuple[dict, bytes | None]]:
        while True:
            self.buf = self.buf.lstrip(b"\r\n")
            while (end := self.buf.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.buf.strip():
                        raise EOFError("the archive ends inside a header")
                    return
                self.buf = self.buf.lstrip(b"\r\n") if not self.buf.startswith(b"WARC") else self.buf
            head = parse_head(self._take(end + 4)[:end])
            n = int(head.get("content-length", 0))
            keep, load = want(head)
            data = self._take(n) if keep and load else self._skip(n)
            if keep:
                yield head, data


class _Inflated:
    """A file of gzip members as one stream."""

    def __init__(self, f, first: bytes):
        self.f, self.raw, self.z = f, first, zlib.decompressobj(31)

    def read(self, n: int) -> bytes:
        while True:
            if self.z.eof:
                self.raw, self.z = self.z.unused_data or self.raw, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.f.read(1 << 16)
                if not self.raw:
                    return b""
            out = self.z.decompress(self.raw, n)
            self.raw = self.z.unconsumed_tail if not self.z.eof else b""
            if self.z.eof and self.z.unused_data:
                self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
            if out:
                return out


def read_records(f, want) -> Iterator[tuple[dict, bytes | None]]:
    """(header, payload or None) of the records that ``want(header) -> (keep, load)`` keeps."""
    start = f.read(24)
    if not start.startswith(b"\x1f\x8b"):
        p = _Plain(f)
        p.buf = start
        yield from p.records(want)
        return
    while len(start) == 24 and start[3] == 4 and start[12:14] == b"sl":
        total, size = struct.unpack("<II", start[16:24])
        body = f.read(total - 24)
        z = zlib.decompressobj(-15)
        data = z.decompress(body, 4096)
        while (end := data.find(b"\r\n\r\n")) < 0 and z.unconsumed_tail:
            data += z.decompress(z.unconsumed_tail, 4096)
        head = parse_head(data[:end])
        keep, load = want(head)
        if keep:
            payload = None
            if load:
                data += z.decompress(z.unconsumed_tail) + z.flush()
                if len(data) != size or zlib.crc32(data) != struct.unpack("<I", body[-8:-4])[0]:
                    raise ValueError("a record's checksum is wrong")
                payload = data[end + 4 : end + 4 + int(head.get("content-length", 0))]
            yield head, payload
        start = f.read(24)
    if start:
        yield from _Plain(_Inflated(f, start)).records(want)


class WarcPartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.load, self.tests = options["path"], options.get("payload", "true").lower() != "false", []

    def pushFilters(self, filters):
        for x in filters:
            if isinstance(x, EqualTo) and x.attribute[0] in _PUSHED:
                self.tests.append((x.attribute[0], {x.value}))
            elif isinstance(x, In) and x.attribute[0] in _PUSHED:
                self.tests.append((x.attribute[0], set(x.value)))
            else:
                yield x

    def partitions(self):
        fs, root = _open(self.path)
        if fs.get_file_info(root).type == pyarrow.fs.FileType.File:
            return [WarcPartition(self.path)]
        if fs.get_file_info(f"{root}/_manifest.json").type == pyarrow.fs.FileType.File:
            with fs.open_input_stream(f"{root}/_manifest.json") as f:
                names = json.loads(f.read())
        else:
            names = [i.base_name for i in fs.get_file_info(pyarrow.fs.FileSelector(root)) if re.search(r"\.warc(\.gz)?$", i.base_name)]
        return [WarcPartition(f"{self.path}/{n}") for n in sorted(names)] or [WarcPartition("")]

    def read(self, partition):
        if not partition.value:
            return
        tests = [(_NAMES[c].lower(), v) for c, v in self.tests]
        fs, path = _open(partition.value)
        rows, size = [], 0
        with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as f:
            for head, payload in read_records(f, lambda h: (all(h.get(c) in v for c, v in tests), self.load)):
                n = head.get("x-payload-length")
                rows.append({c: head.get(h.lower()) for c, h in _NAMES.items()} | {"payload_length": int(n) if n else None, "payload": payload})
                size += len(payload or b"") + 500
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    size += out.write(m := gzip_member(record_bytes(row))) or len(m)
                    if size >= ROLL_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return _Written(names)

    def commit(self, messages):
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        names, at = [n for m in messages if m for n in m.names], f"{root}/_manifest.json"
        if fs.get_file_info(at).type == pyarrow.fs.FileType.File:
            with fs.open_input_stream(at) as f:
                names = json.loads(f.read()) + names
        with fs.open_output_stream(at) as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages):
        fs, root = _open(self.path)
        for n in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{root}/{n}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive(pages: DataFrame, path: str, min_bytes: int = 100) -> None:
    """Write a record for each row of (page_id, url, html): of equal payloads of at least ``min_bytes``
    bytes that with the smallest page_id as response, the others as revisit of it.

    Rows that repeat the smallest page_id of their payload are all responses; a null page_id is no smallest one, and where
    all are null all are responses. Only payloads that occur
    twice or more go into the table of first pages, which is joined by :func:`common.lookup`.
    """
    register(pages.sparkSession)
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    first = p.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    p = lookup(p, settle(first, "first-pages"), ["digest"], "page_id")
    again = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    p.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(datetime.datetime(2024, 1, 1).isoformat() + "Z").alias("date"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.when(again, urn(F.col("first_id"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.col("n_bytes").alias("payload_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """What the archives at ``path`` hold of each page; payloads are read for responses only."""
    register(spark)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    id_of = lambda c: F.when(page(c) != "", page(c)).cast("long")
    full = spark.read.format("warc").load(path).where("record_type = 'response'")
    full = full.select(id_of("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    heads = spark.read.format("warc").option("payload", "false").load(path).where("record_type = 'revisit'")
    heads = heads.select(id_of("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", id_of("refers_to").alias("refers_to"))
    return full.unionAll(heads)


def op8(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return digests(spark, path)

"""WARC archives as a Python data source (format name `warc`), with identical payloads written once.

Writing: each task writes one archive under a name of its own; the driver's commit lists the archives in a manifest,
so what a lost or repeated attempt left is never read, and with each the places where members begin, every MARK_BYTES
or so. Reading: partitions are runs of byte ranges of about `splitbytes` between these places, so a large archive is
many tasks; predicates on record_type and on header columns are taken over from Spark and tested on the parsed header,
and payloads of records that fail them (or of all, with option payload=false) are skipped, not decoded.

Archives are written as .warc.gz, a gzip member a record. Each member's extra field `sl` holds its compressed and
plain lengths, so that a reader can inflate a header and go on to the next member. Other .warc and .warc.gz files are
read too, each as a whole. A record without Content-Length, or one that ends early, is an error.
"""

from __future__ import annotations

import gzip
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from cohera.plans.shared import placed, salted_lookup, scratch_path, written

FIELDS = "record_id string, record_type string, target_uri string, payload_digest string, payload_length bigint, refers_to string, payload binary"
#: Column of a record and the header field that holds it.
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length", "refers_to": "WARC-Refers-To",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed date of the records: archives of the same rows are the same bytes.
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "manifest.json"
BATCH_BYTES = 16_000_000
#: Bytes between two places in an archive from which it can be read.
MARK_BYTES = 8_000_000


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and a path in it. A path without scheme could be on any machine's own disk and is refused."""
    if "://" not in path and not path.startswith("file:"):
        raise ValueError(f"give the path of an archive with its scheme: {path}")
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark resolves it by."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def header(fields: dict[str, object]) -> bytes:
    lines = [f"{k}: {str(v).translate({10: '%0A', 13: '%0D'})}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode()


def record(row: dict) -> bytes:
    """The bytes of a record: header lines, block, two line ends. A revisit has no block."""
    block = b"" if row["record_type"] == "revisit" else row["payload"] or b""
    fields = {"WARC-Type": row["record_type"], "WARC-Date": DATE} | {h: row[c] for c, h in HEADERS.items() if c != "record_type"}
    if row["payload_digest"] is not None:
        fields["WARC-Payload-Digest"] = f"sha256:{row['payload_digest']}"
    if row["record_type"] == "revisit":
        fields["WARC-Profile"] = REVISIT_PROFILE
    return header(fields | {"Content-Type": "text/html", "Content-Length": len(block)}) + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member with its lengths in the extra field."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 32 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHQQ", 20, b"sl", 16, size, len(raw))
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _manifest(fs: pafs.FileSystem, at: str) -> list[list] | None:
    """[name, size, records, places where members begin] of each archive; None where there is no manifest."""
    listed = posixpath.join(at, MANIFEST)
    if fs.get_file_info(listed).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(listed) as f:
        return json.loads(f.read())


@dataclass
class _Wrote(WriterCommitMessage):
    name: str
    size: int
    records: int
    marks: list[int]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Wrote:
        fs, at = _store(self.path)
        name, records, marks, at_byte = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0], 0
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(posixpath.join(at, name), compression=None, buffer_size=1 << 20) as out:
            for batch in iterator:
                for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                    for row in part.to_pylist():
                        if at_byte - marks[-1] >= MARK_BYTES:
                            marks.append(at_byte)
                        at_byte += out.write(member(record(row)))
                        records += 1
        return _Wrote(name, at_byte, records, marks)

    def commit(self, messages: list[_Wrote | None]) -> None:
        fs, at = _store(self.path)
        fs.create_dir(at, recursive=True)
        old = [] if self.overwrite else _manifest(fs, at) or []
        listed = old + [[m.name, m.size, m.records, m.marks] for m in messages if m]
        with fs.open_output_stream(posixpath.join(at, MANIFEST)) as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list[_Wrote | None]) -> None:
        fs, at = _store(self.path)
        for m in messages:
            if m:
                fs.delete_file(posixpath.join(at, m.name))


@dataclass
class _Ranges(InputPartition):
    parts: list[tuple[str, int, int | None]]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, payload: bool):
        self.path, self.split_bytes, self.payload = path, split_bytes, payload
        self.tests: dict[str, set] = {}

    def pushFilters(self, filters):  # noqa: N802
        """Take over = and IN on header columns; all others stay with Spark."""
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if name in HEADERS and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tests[name] = self.tests.get(name, wanted) & wanted
            else:
                yield f

    def partitions(self) -> list[_Ranges]:
        """Byte ranges of archives in runs of about split_bytes; an archive that says no places is one range (end None)."""
        fs, at = _store(self.path)
        listed = _manifest(fs, at)
        if listed is not None:
            ranges = [(n, a, b) for n, size, _, marks in listed for a, b in zip(marks, [*marks[1:], size], strict=True) if b > a]
            sized = [(r, r[2] - r[1]) for r in ranges]
        else:
            found = fs.get_file_info(pafs.FileSelector(at)) if fs.get_file_info(at).type == pafs.FileType.Directory else [fs.get_file_info(at)]
            files = [(i.base_name, i.size) for i in found if i.type == pafs.FileType.File and i.base_name.endswith((".warc", ".warc.gz"))]
            sized = [((n, 0, None), size) for n, size in sorted(files, key=lambda x: (-x[1], x[0]))]
            if fs.get_file_info(at).type == pafs.FileType.File:
                self.path = posixpath.dirname(self.path)
        out, held = [[]], 0
        for part, length in sized:
            if out[-1] and held + length > self.split_bytes:
                out.append([])
                held = 0
            out[-1].append(part)
            held += length
        return [_Ranges(parts) for parts in out]

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        fs, at = _store(self.path)
        rows, size = [], 0
        for name, start, end in partition.parts:
            with fs.open_input_file(posixpath.join(at, name)) as f:
                whole = end is None
                for row in records_of(f, name.endswith(".gz"), self.tests, self.payload) if whole else read_members(f, self.tests, self.payload, start, end):
                    rows.append(row)
                    size += len(row[-1] or b"") + 500
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(cols, [*HEADERS, "payload"])


def records_of(f, gz: bool, tests: dict[str, set], payload: bool) -> Iterator[tuple]:
    """Records of an open archive of any of the three layouts."""
    if not gz:
        return read_records(f, tests, payload, seekable=True)
    if _member_size(f.read(32)):
        return read_members(f, tests, payload, 0, f.size())
    f.seek(0)
    return read_records(gzip.GzipFile(fileobj=f), tests, payload, seekable=False)


def _member_size(head: bytes) -> int:
    """The length of a gzip member that begins so; 0 if it doesn't say."""
    if len(head) < 32 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"sl\x10\0":
        return 0
    return struct.unpack("<Q", head[16:24])[0]


def read_members(f, tests: dict[str, set], payload: bool, at: int, end: int, peek: int = 4096) -> Iterator[tuple]:
    """Records from byte `at` up to `end` of an archive whose members say their lengths: only wanted blocks are read
    and inflated in full."""
    while at < end:
        f.seek(at)
        data = f.read(min(peek, end - at))
        size = _member_size(data[:32])
        if not size or at + size > end:
            raise ValueError("a WARC member ends early")
        inflate = zlib.decompressobj(-15)
        raw, fed = inflate.decompress(data[32 : size - 8], peek), min(len(data), size)
        while raw.find(b"\r\n\r\n") < 0:
            more = inflate.unconsumed_tail
            if not more:
                more = f.read(min(peek, size - fed))
                fed += len(more)
                if not more:
                    raise ValueError("a WARC record ends within its header")
            raw += inflate.decompress(more, peek)
        cut = raw.find(b"\r\n\r\n") + 4
        row, length = parse_header(raw[: cut - 4])
        if all(row[c] in v for c, v in tests.items()):
            block = None
            if payload:
                rest = inflate.unconsumed_tail + (f.read(size - fed) if size > fed else b"")
                block = (raw[cut:] + inflate.decompress(rest))[:length]
                if len(block) < length:
                    raise ValueError("a WARC record ends within its block")
            yield (*row.values(), block)
        at += size


def parse_header(raw: bytes) -> tuple[dict, int]:
    """The header columns of a record, and the length of its block."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if "content-length" not in fields:
        raise ValueError("a WARC record has no Content-Length")
    length = int(fields["content-length"])
    row = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
    if row["payload_digest"] and row["payload_digest"].startswith("sha256:"):
        row["payload_digest"] = row["payload_digest"][7:]
    row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else length
    return row, length


def read_records(f, tests: dict[str, set], payload: bool, seekable: bool, chunk: int = 1 << 20) -> Iterator[tuple]:
    """Records of an archive as rows of FIELDS: headers first; a block is sliced out only if its record is wanted."""
    data, at, done = b"", 0, False

    def more(least: int) -> None:
        nonlocal data, at, done
        while len(data) - at < least and not done:
            got = f.read(max(chunk, least - (len(data) - at)))
            done = not got
            data, at = data[at:] + got, 0

    while True:
        end = -1
        while end < 0:
            end = data.find(b"\r\n\r\n", at)
            if end < 0:
                if done:
                    if data[at:].strip():
                        raise ValueError("a WARC record ends within its header")
                    return
                more(len(data) - at + 1)
        row, length = parse_header(data[at:end])
        at = end + 4
        wanted = all(row[c] in v for c, v in tests.items())
        if wanted and payload:
            more(length + 4)
            if len(data) - at < length:
                raise ValueError("a WARC record ends within its block")
            yield (*row.values(), data[at : at + length])
            at += length + 4
        else:
            if wanted:
                yield (*row.values(), None)
            held = len(data) - at
            if length + 4 <= held:
                at += length + 4
            elif seekable:
                f.seek(f.tell() + length + 4 - held)
                data, at = b"", 0
            else:
                more(length + 4)
                at += length + 4


class WarcDataSource(DataSource):
    """spark.read.format("warc"), options path, splitbytes (32 MB), payload (true); df.write.format("warc")."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> WarcReader:
        o = self.options
        return WarcReader(o["path"], int(o.get("splitbytes", 32_000_000)), str(o.get("payload", "true")).lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_warc(rows: DataFrame, path: str) -> None:
    """Write rows with the columns of FIELDS as archives under `path`."""
    register(rows.sparkSession)
    kinds = [f.split(" ") for f in FIELDS.split(", ")]
    rows.select(*[F.col(c).cast(t).alias(c) for c, t in kinds]).write.format("warc").mode("append").save(qualified(rows.sparkSession, path))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(qualified(spark, path))


def deduplicated_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """Records (FIELDS) of pages: of equal payloads of at least `least_bytes` bytes one is response, others revisit it.

    The response is the one with the smallest id (null ids last; of rows with one id, the first by place). A null page
    has an empty payload. Every row is a record, repeated rows too. Other columns are ignored. Verdicts are reached on
    narrow rows (place, id, digest), and only the places of revisits come back to the payloads. Groups of copies meet
    as partial minima; the lookup is salted, so that no group is one task's work.
    """
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    rows = placed(pages).select("_at", F.col(f"`{id_col}`").alias("id"), F.col(f"`{uri_col}`").cast("string").alias("target_uri"), payload.alias("payload"))
    narrow = rows.filter(F.length("payload") >= least_bytes).select(F.struct(F.col("id").isNull().alias("none"), "id", "_at").alias("who"), F.sha2("payload", 256).alias("digest"), F.xxhash64("_at").alias("spread"))
    narrow = written(narrow, "digests")
    firsts = written(narrow.groupBy("digest").agg(F.min("who").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first"), "firsts")
    copies = salted_lookup(narrow, firsts, "digest", "spread", how="inner").filter("who._at <> first._at")
    copies = written(copies.select(F.col("who._at").alias("_at"), F.lit(True).alias("again"), F.col("first.id").alias("first_id")), "copies")
    out = rows.join(copies, "_at", "left").withColumn("payload_digest", F.sha2("payload", 256))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    again = F.coalesce("again", F.lit(False))
    return out.select(
        urn("id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", "payload_digest",
        F.length("payload").cast("long").alias("payload_length"), F.when(again, urn("first_id")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Responses are read with their payloads, revisits by their headers alone; either predicate is tested by the reader."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch_path(spark, "warc")
    write_warc(deduplicated_records(pages), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    stored = read_warc(spark, path).filter("record_type = 'response'").withColumns({"payload_length": F.length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    revisits = read_warc(spark, path, payload=False).filter("record_type = 'revisit'")
    return stored.unionByName(revisits).select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"),
    )


#: DuckDB SQL for the rows of op3_warc.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

"""Operator 11, WARC archives: one gzip member a record, written by Spark tasks and read back in byte ranges.

The reader cuts every archive into ranges of bytes. A task scans its range for gzip's magic bytes, takes a candidate for a
member only if it decodes to a WARC header, and owns the records that start inside its range; the last one may end beyond
it. So no index of offsets is needed, and archives of any size are read by many tasks.

Rows of equal payload are stored once: the row of smallest key is a response, the others are revisits that refer to it.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import HOT_KEYS, cut, hot_from

MAGIC = b"\x1f\x8b\x08"
#: Payloads from which on a repeated one becomes a revisit, in bytes.
LEAST_BYTES = 100
#: Bytes of a range that one task reads, of an archive until the writer begins the next, and of one read.
RANGE_BYTES, FILE_BYTES, READ_BYTES = 64 << 20, 1 << 30, 1 << 20
#: Decoded bytes of a header that must have ended by then.
HEADER_BYTES = 1 << 16
#: Payload bytes and rows of a batch that a reading task hands over.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000
#: The profile of a revisit whose payload is that of the record it refers to, as WARC 1.1 names it.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archives carry no time of their own making, so that a task that runs again writes the same bytes.
DATE = "1970-01-01T00:00:00Z"

WRITTEN = "key string, url string, payload binary, payload_digest string, payload_bytes bigint, record_type string, refers_to string"
READ = (
    "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes bigint, payload binary, file string, offset bigint"
)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that all executors share, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub("^s3a:", "s3:", uri))


def urn(key: str | None) -> str:
    return f"<urn:x-row:{quote(key, safe='')}>" if key is not None else "<urn:x-row>"


def key_of(record_id: Column) -> Column:
    """The key that a record's identity was made from; null for records of other makers and rows without a key."""
    return F.url_decode(F.nullif(F.regexp_extract(record_id, r"^<urn:x-row:(.*)>$", 1), F.lit("")))


def header_value(text: str) -> str:
    """Control characters would end a header's line: they are written as %XX."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(row: dict) -> bytes:
    """One WARC record; a revisit has the headers of the response, with its length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + row["payload"]
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {urn(row['key'])}", f"WARC-Date: {DATE}"]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {header_value(row['url'])}")
    head.append(f"WARC-Payload-Digest: sha256:{row['payload_digest']}")
    if revisit:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {urn(row['refers_to'])}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """data as one gzip member. Where data itself holds gzip's magic, the stream is flushed inside it: bytes that deflate
    stores as they are can then not pass for a member, even if the payload is an archive."""
    squeeze, out, at = zlib.compressobj(level, zlib.DEFLATED, 31), [], 0
    while (found := data.find(MAGIC, at)) >= 0:
        out += [squeeze.compress(data[at : found + 1]), squeeze.flush(zlib.Z_SYNC_FLUSH)]
        at = found + 1
    return b"".join([*out, squeeze.compress(data[at:]), squeeze.flush()])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    """A task writes files of its own name; the commit lists those of the attempts that count, and readers trust the list."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.level = options["path"], int(options.get("level", 6))
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = opened(self.folder)
        fs.create_dir(folder, recursive=True)
        files, sink, size = [], None, 0
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if sink is None:
                        files.append([f"{uuid.uuid4().hex}.warc.gz", 0])
                        sink, size = fs.open_output_stream(f"{folder}/{files[-1][0]}", compression=None), 0
                    size += sink.write(packed := member(record(row), self.level)) or len(packed)
                    files[-1][1] = size
                    if size >= self.file_bytes:
                        sink.close()
                        sink = None
        finally:
            if sink is not None:
                sink.close()
        return Written([tuple(x) for x in files])

    def commit(self, messages: list) -> None:
        fs, folder = opened(self.folder)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/_{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{name}.part", compression=None) as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())
        fs.move(f"{name}.part", name)

    def abort(self, messages: list) -> None:
        fs, folder = opened(self.folder)
        for m in messages:
            for name, _ in m.files if m else []:
                fs.delete_file(f"{folder}/{name}")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class Window:
    """Bytes of a file from a moving position on."""

    def __init__(self, source: pa.NativeFile, at: int):
        self.source, self.base, self.held = source, at, b""
        source.seek(at)

    def upto(self, end: int) -> int:
        """Reads until the file's end or position end are held; returns the position up to which bytes are."""
        while self.base + len(self.held) < end and (more := self.source.read(READ_BYTES)):
            self.held += more
        return self.base + len(self.held)

    def find(self, at: int, end: int) -> int:
        """The first magic that starts at at or later and before end, or -1."""
        while at < end:
            top = self.upto(min(at + READ_BYTES, end) + len(MAGIC) - 1)
            found = self.held.find(MAGIC, at - self.base, min(top, end + len(MAGIC) - 1) - self.base)
            if found >= 0:
                return self.base + found
            if top < min(at + READ_BYTES, end) + len(MAGIC) - 1:
                return -1
            at = min(at + READ_BYTES, end)
            self.drop(at)
        return -1

    def drop(self, at: int) -> None:
        if at - self.base >= READ_BYTES:
            self.held, self.base = self.held[at - self.base :], at

    def decode(self, at: int) -> tuple[bytes, int] | None:
        """The decoded member at position at and the position behind it; None if that is no member that begins with a
        WARC header. Reading goes on only once the header is there. A member that breaks off behind its header is an error."""
        inflate, out, size, header = zlib.decompressobj(31), [], 0, False
        place = at
        while not inflate.eof:
            step = min(1 << 16, self.upto(place + 1) - place)
            if step <= 0:
                if header:
                    raise ValueError(f"the record at byte {at} is cut off")
                return None
            try:
                got = inflate.decompress(self.held[place - self.base : place - self.base + step])
            except zlib.error as e:
                if header:
                    raise ValueError(f"the record at byte {at} is damaged: {e}") from e
                return None
            place += step
            out.append(got)
            size += len(got)
            if not header:
                start = b"".join(out)
                if not b"WARC/".startswith(start[:5]) or size > HEADER_BYTES and b"\r\n\r\n" not in start[:HEADER_BYTES]:
                    return None
                header = start[:5] == b"WARC/" and (cut_at := start.find(b"\r\n\r\n")) > 0 and re.search(rb"(?im)^content-length:[ \t]*\d+", start[:cut_at]) is not None
                if not header and inflate.eof:
                    return None
                out = [start]
        return b"".join(out), place - len(inflate.unused_data)


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}


def parsed(data: bytes) -> Iterator[dict]:
    """The records of one member, which is one record in archives that can be split."""
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        head = headers(data[at:end])
        block = data[end + 4 : end + 4 + (size := int(head.get("content-length", 0)))]
        kind, payload, length = head.get("warc-type"), block, len(block)
        if head.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            length = int(headers(http).get("content-length", len(payload))) if kind == "revisit" else len(payload)
        yield {
            "record_id": head.get("warc-record-id"), "record_type": kind, "target_uri": head.get("warc-target-uri"),
            "payload_digest": head["warc-payload-digest"].partition(":")[2].lower() if "warc-payload-digest" in head else None,
            "refers_to": head.get("warc-refers-to"), "payload_bytes": length, "payload": None if kind == "revisit" else payload,
        }
        at = end + 4 + size + 4


class WarcReader(DataSourceReader):
    def __init__(self, schema: pa.Schema, options: dict[str, str]):
        self.arrow, self.folder = schema, options["path"]
        self.range_bytes, self.corrupt = int(options.get("rangebytes", RANGE_BYTES)), options.get("corrupt", "fail")
        if self.corrupt not in ("fail", "skip"):
            raise ValueError("corrupt is fail or skip")

    def partitions(self) -> list[Range]:
        """Names and sizes only: those that commits have listed, or all archives of a folder without a commit."""
        fs, folder = opened(self.folder)
        info = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        lists = [f.path for f in info if re.search(r"/_[0-9a-f]{32}\.json$", f.path)]
        if lists:
            files = [x for path in lists for x in json.loads(fs.open_input_file(path).read())]
        else:
            files = [(f.base_name, f.size) for f in info if f.base_name.endswith(".warc.gz")]
        return [Range(name, at, min(at + self.range_bytes, size)) for name, size in sorted(map(tuple, files)) for at in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.end <= part.start:
            return
        fs, folder = opened(self.folder)
        with fs.open_input_file(f"{folder}/{part.path}") as source:
            rows, held, window, at = [], 0, Window(source, part.start), part.start
            while (at := window.find(at, part.end)) >= 0:
                try:
                    found = window.decode(at)
                except ValueError as e:
                    if self.corrupt == "fail":
                        raise ValueError(f"{part.path}: {e}") from e
                    found = None
                if found is None:
                    at += 1
                    continue
                for row in parsed(found[0]):
                    rows.append(row | {"file": part.path, "offset": at})
                    held += len(row["payload"] or b"")
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=self.arrow)
                    rows, held = [], 0
                at = found[1]
                window.drop(at)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=self.arrow)


class Warc(DataSource):
    """Format framewright-warc. Options: rangebytes and corrupt (fail, or skip damaged records) to read, level and
    filebytes to write."""

    @classmethod
    def name(cls) -> str:
        return "framewright-warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> WarcReader:
        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        return WarcReader(pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in READ.split(", ")]), dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def with_revisits(df: DataFrame, key: str, payload: str, least: int = LEAST_BYTES) -> DataFrame:
    """Adds payload_digest, payload_bytes, record_type and refers_to; payload becomes binary, null counts as empty.

    Of equal payloads of at least `least` bytes, the row of smallest key is the response, all others revisits; rows that
    repeat this key are all responses. A row without a key is never referred to. The table of repeated payloads has a
    row for each; up to HOT_KEYS of them are broadcast, beyond that only the hottest are, and the others meet their rows
    in a shuffle, so that no task gets all rows of one payload.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    marked = df.withColumns({payload: body, "payload_bytes": F.octet_length(body).cast("bigint"), "payload_digest": F.sha2(body, 256)})
    digest = F.when(F.col("payload_bytes") >= least, F.unhex("payload_digest"))
    firsts = marked.select(digest.alias("__digest"), F.col(key).alias("__key")).where("__digest IS NOT NULL").groupBy("__digest").agg(F.min("__key").alias("__first"), F.count("*").alias("__n"))
    firsts = cut(firsts.where("__n > 1 AND __first IS NOT NULL"))
    marked = marked.withColumn("__digest", digest)
    if firsts.count() <= HOT_KEYS:
        found = marked.join(F.broadcast(firsts.drop("__n")), "__digest", "left")
    else:
        hot = firsts.where(F.col("__n") >= hot_from(df.count()))
        near = F.broadcast(hot.select(F.col("__digest"), F.col("__first").alias("__hot")))
        own = F.when(F.col("__hot").isNull() & F.col("__digest").isNotNull(), F.col("__digest")).otherwise(F.unhex(F.hex(F.xxhash64("payload_digest", key))))
        rest = firsts.select(F.col("__digest").alias("__own"), "__first")
        found = marked.join(near, "__digest", "left").withColumn("__own", own).join(rest, "__own", "left").withColumn("__first", F.coalesce("__hot", "__first")).drop("__own", "__hot")
    revisit = F.col("__first").isNotNull() & ~F.col(key).eqNullSafe(F.col("__first"))
    out = found.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("__first"))})
    return out.drop("__digest", "__first")


def write(df: DataFrame, folder: str, key: str, url: str, payload: str, least: int = LEAST_BYTES, level: int = 6) -> None:
    """Appends a record for every row to the archives in folder, which all executors share: an absolute path or an address
    that Arrow's file systems open. An empty table writes a commit without archives; other columns are left out."""
    df.sparkSession.dataSource.register(Warc)
    rows = with_revisits(df.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload")), "key", "payload", least)
    text = {c: F.col(c).cast("string") for c in ("key", "url", "refers_to")}
    rows.withColumns(text).select(*[x.split()[0] for x in WRITTEN.split(", ")]).write.format("framewright-warc").option("level", level).mode("append").save(folder)


def read(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, corrupt: str = "fail") -> DataFrame:
    """The records of all archives in folder, one row each: READ's columns. A revisit has no payload; its payload_bytes
    are those that the headers state. Records that begin inside another record's stored bytes are told apart only in
    archives of this writer, which breaks them up."""
    spark.dataSource.register(Warc)
    return spark.read.format("framewright-warc").option("rangebytes", range_bytes).option("corrupt", corrupt).load(folder)


def checked(records: DataFrame) -> DataFrame:
    """payload_digest as computed from what was read; a payload that differs from its header's digest fails the job."""
    own = F.sha2("payload", 256)
    wrong = F.raise_error(F.concat(F.lit("payload and digest differ: "), F.coalesce("record_id", F.lit("")))).cast("string")
    return records.withColumn("payload_digest", F.when(F.col("payload").isNull() | F.col("payload_digest").isNull(), F.coalesce("payload_digest", own)).when(own == F.col("payload_digest"), own).otherwise(wrong))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""

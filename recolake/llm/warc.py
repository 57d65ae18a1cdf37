"""WARC archives: monolithic gzip files, their normaliser and a reader by offset.

``write_archives`` writes records through Spark's text writer: a row is a record, the two line ends that close a record are the row separator, and
the gzip codec makes each file one stream. Such a monolithic file can only be read from its start.

``normalise`` inflates each whole-file stream once, in one task and in pieces, rewrites every record as a gzip member of its own, and writes a
sidecar offset index (a table: archive, offset, length and the record's identity). It takes any archive of records that state their Content-Length, wherever Spark's
readers reach; only the record at hand is held in memory. ``read_records`` opens the archives at the offsets of the index.

``page_records`` turns pages into records: of equal payloads the smallest page id's is a response, the others are revisits that refer to it.

Defined results: a null payload counts as empty; a null url leaves the target out; line ends in an url are percent-encoded; a null page id comes after all
others and is left out of the record; equal rows get a record each, one of them the response; an empty table gives no archives and no
records; other columns are not read; very long payloads are records as long (up to 2 GB, a string's bound in Spark).

Recovery: a task that runs again writes archives of another name; the index, which Spark commits, names those that count. Archives go to the shared
folder by pyarrow's file systems (local, hdfs, s3, gs); the monolithic files are read and written by Spark.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their own
COPIES = 10_000  # equal rows that one task writes the records of
FILE_RECORDS = 20_000  # of a monolithic file, which one task inflates
CHUNK_BYTES = 8 << 20  # of an archive that one task reads by offset
END = b"\r\n\r\n"
# fixed value: the profile of a revisit whose payload is identical
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(hex_digest: Column) -> Column:
    """Base 32 (RFC 4648) of a SHA-1 in hex: 15 hex digits are 12 letters."""
    def part(a: int, n: int) -> Column:
        return F.lpad(F.conv(F.substring(hex_digest, a, n), 16, 32), n * 4 // 5, "0")
    return F.translate(F.concat(part(1, 15), part(16, 15), part(31, 10)),
                       "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _identity(page: Column, url: Column, copy: Column) -> Column:
    """A record id that says which page, payload and copy it is."""
    h = F.md5(F.concat_ws("\x00", F.coalesce(page.cast("string"), F.lit("\x01")), F.coalesce(url, F.lit("\x01")), F.hex("key"),
                          copy.cast("string")).cast("binary"))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _record(kind: str, payload: Column, date: str) -> Column:
    """The text of a record without the line ends that close it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"),
                    F.lit("\r\n\r\n"))
    more = []
    if kind == "revisit":
        more = [_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", F.concat(F.lit("<"), "origin", F.lit(">")))]
    target = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {date}\r\n"), _line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        _line("WARC-Target-URI", target), _line("X-Page-ID", F.col("page_id").cast("string")), *more,
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", (F.octet_length(http) + F.octet_length(payload)).cast("string")), F.lit("\r\n"), http, payload)


def page_records(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                 date: str = DATE) -> DataFrame:
    """record: the text of a WARC record per page. Payloads under ``least_bytes`` are all responses."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    raw = F.col("payload").cast("binary")
    keyed = rows.withColumns({"key": F.unhex(F.sha2(raw, 256)), "digest": _base32(F.sha1(raw)), "size": F.octet_length("payload").cast("long")})
    order = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", F.col("url").isNull().alias("bare"), "url")
    long_enough = F.col("size") >= least_bytes

    # a row per distinct payload: its response; equal payloads meet where they lie first, so a hot one is shuffled once a task
    bodies = keyed.filter(long_enough).groupBy("key", "digest", "size").agg(F.min(order).alias("at"), F.first("payload").alias("payload"))
    answers = (bodies.select("key", "digest", "size", "payload", "at.page_id", "at.url")
               .withColumn("record_id", _identity(F.col("page_id"), F.col("url"), F.lit(0))))

    # the other pages, without their payloads: equal rows are counted, and dealt out again in blocks
    short = F.when(~long_enough, F.col("payload")).alias("short")
    counted = stored(keyed.groupBy("key", "digest", "size", "page_id", "url", short).agg(F.count(F.lit(1)).alias("copies")), "warc-pages")
    firsts = counted.filter(long_enough).groupBy("key").agg(F.min(order).alias("at"))
    placed = counted.join(firsts, "key", "left").withColumn("from", F.when(
        F.col("page_id").eqNullSafe(F.col("at.page_id")) & F.col("url").eqNullSafe(F.col("at.url")) & long_enough, 1).otherwise(0).cast("long"))
    few = placed.filter(F.col("copies") <= COPIES).withColumn("block", F.lit(0).cast("long"))
    many = (placed.filter(F.col("copies") > COPIES)
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
            .repartition("key", "page_id", "url", "block"))
    low, high = F.greatest("from", F.col("block") * COPIES), F.least(F.col("copies"), (F.col("block") + 1) * COPIES) - 1
    rest = few.unionByName(many).filter(low <= high).withColumn("copy", F.explode(F.sequence(low, high))).withColumns({
        "record_id": _identity(F.col("page_id"), F.col("url"), F.col("copy")),
        "origin": _identity(F.col("at.page_id"), F.col("at.url"), F.lit(0))})
    return (answers.select(_record("response", F.col("payload"), date).alias("record"))
            .unionByName(rest.filter(long_enough).select(_record("revisit", F.lit(""), date).alias("record")))
            .unionByName(rest.filter(~long_enough).select(_record("response", F.col("short"), date).alias("record"))))


def write_archives(records: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Monolithic archives: every file is one gzip stream of records."""
    (records.select("record").write.option("compression", "gzip").option("lineSep", END.decode())
     .option("maxRecordsPerFile", file_records).text(path))


class Records:
    """Cuts a stream of bytes, fed in any pieces, into records (without the line ends that close them)."""

    def __init__(self):
        self.buffer, self.need = bytearray(), 0

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.buffer += data
        while len(self.buffer) > self.need:
            if not self.need:
                begin = len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))
                del self.buffer[:begin]
                end = self.buffer.find(END)
                if end < 0:
                    return
                self.need = end + len(END) + int(headers(bytes(self.buffer[:end]))["content-length"])
            if len(self.buffer) < self.need:
                return
            yield bytes(self.buffer[:self.need])
            del self.buffer[:self.need]
            self.need = 0

    def close(self) -> None:
        if self.buffer.strip(b"\r\n"):
            raise ValueError("the archive ends inside a record")


def headers(block: bytes) -> dict[str, str]:
    """Header lines by lower-case name; the first line (version or status) has none."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", block).split(b"\r\n")[1:]
    return {k.decode().strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in (x.partition(b":") for x in lines) if k}


class _Archive:
    """An archive of one member a record, being written."""

    def __init__(self, folder: str):
        self.name, self.size, self.records = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, Records()
        fs, path = pafs.FileSystem.from_uri(self.name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path, compression=None)

    def add(self, record: bytes) -> tuple:
        member = gzip.compress(record + END, mtime=0)
        self.out.write(member)
        h = headers(record[:record.index(END)])
        row = (self.name, self.size, len(member), h.get("warc-record-id", "").strip("<>"), h.get("warc-type"))
        self.size += len(member)
        return row

    def close(self) -> None:
        self.records.close()
        self.out.close()


_INDEX = [("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())]
_READ = [("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()),
         ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
_SQL_TYPES = {pa.string(): "string", pa.int64(): "long"}


def _ddl(columns: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{name} {_SQL_TYPES[kind]}" for name, kind in columns)


def _batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    values = list(zip(*rows, strict=True)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, (_, kind) in zip(values, columns, strict=True)], names=[name for name, _ in columns])


def normalise(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Archives of one member a record below ``path``/archives, and their index at ``path``/index, from the gzip archives at ``source``."""
    # Spark inflates a file from start to end in one task; lines with the end that the reader took are the stream again, byte by byte
    lines = (spark.read.option("lineSep", "\n").text(source)
             .select(F.concat("value", F.lit("\n")).cast("binary").alias("data"), F.col("_metadata.file_path").alias("file")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, archive = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, a = [], 0
            runs = pa.compute.run_end_encode(batch["file"])
            for name, b in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if name != file:
                    if archive:
                        archive.close()
                    file, archive = name, _Archive(f"{path}/archives")
                rows += [archive.add(record) for record in archive.records.feed(_joined(batch["data"], a, b))]
                a = b
            yield _batch(rows, _INDEX)
        if archive:
            archive.close()

    lines.mapInArrow(run, _ddl(_INDEX)).write.parquet(f"{path}/index")
    return index(spark, path)


def _joined(data: pa.BinaryArray, a: int, b: int) -> bytes:
    """The bytes of rows a to b, which lie one after the other in the array's buffer."""
    part = data.slice(a, b - a)
    offsets = memoryview(part.buffers()[1]).cast("i")
    return bytes(memoryview(part.buffers()[2])[offsets[part.offset]:offsets[part.offset + len(part)]])


def index(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar offset index: archive, offset, length, record_id, record_type of every record."""
    return spark.read.schema(_ddl(_INDEX)).parquet(f"{path}/index")


def _parsed(member: bytes) -> tuple:
    record = gzip.decompress(member)[:-len(END)]
    cut = record.index(END)
    h, block = headers(record[:cut]), record[cut + len(END):]
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
    inner, _, payload = block.partition(END)
    size = len(payload)
    if h["warc-type"] == "revisit":
        size = int(headers(inner)["content-length"])
    elif digest != (own := base64.b32encode(hashlib.sha1(payload).digest()).decode()):
        raise ValueError(f"record {h.get('warc-record-id')}: payload digest {own}, stated {digest}")
    page, refers = h.get("x-page-id"), h.get("warc-refers-to")
    return (page and int(page), h["warc-record-id"].strip("<>"), h["warc-type"], refers and refers.strip("<>"), size, digest)


def read_records(records: DataFrame) -> DataFrame:
    """page_id, record_id, record_type, refers_to_id, payload_bytes, payload_digest of the records that an index names, each read at its offset;
    a payload that is not what its record states is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch[c].to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != name:
                    if file:
                        file.close()
                    fs, path = pafs.FileSystem.from_uri(archive)
                    name, file = archive, fs.open_input_file(path)
                rows.append(_parsed(file.read_at(length, offset)))
            yield _batch(rows, _READ)
        if file:
            file.close()

    chunk = F.floor(F.col("offset") / CHUNK_BYTES)
    return (records.select("archive", "offset", "length").repartition("archive", chunk).sortWithinPartitions("archive", "offset")
            .mapInArrow(run, _ddl(_READ)))


def page_table(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (the page that a revisit's response is of) of records as read."""
    rows = stored(records, "warc-records")
    answers = rows.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return rows.join(answers, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

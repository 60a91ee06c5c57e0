"""WARC archives: written as whole-file gzip streams, normalised to one gzip member a record, with an offset index.

All files are read and written by Spark's text source, so they may lie in any
store that Spark reaches, several tasks share the work and a lost task is run
again. A record ends with an empty line after its block, so a row with the line
separator CR LF CR LF is a record; the normalised archive separates its members
by an empty gzip member (20 bytes that inflate to nothing), so it is valid gzip
and Spark can split it at records, which a whole-file stream does not allow.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconloom.sources.durable import durable, release

#: Fixed values of the formats: an empty line, the gzip header without a time, a whole member that holds nothing.
EMPTY_LINE = b"\r\n\r\n"
GZIP_HEADER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 0xFF])
EMPTY_MEMBER = GZIP_HEADER + bytes([3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads from this size on are written once.
LEAST_BYTES = 1000
#: Bytes that a task gives back at a time.
_SEND = 1 << 22

INDEX = "file string, offset long, length long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long"


def revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``page_id, url, html, refers_to``: of equal payloads of ``least`` bytes and more all but that of the largest id refer to it.

    Payloads are equal by SHA-256. Repeats are found on ids and hashes, and written as a table, so that Spark
    broadcasts them only while its own size check allows it. A null html is an empty payload; rows with a null id
    refer to none and are referred to by none; rows that share the largest id both keep their payload."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_key", F.when((F.octet_length("html") >= least) & F.col("page_id").isNotNull(), F.sha2("html", 256)))
    again = base.where("_key is not null").groupBy("_key").agg(F.count("*").alias("_n"), F.max("page_id").alias("_first")).where("_n > 1").select(F.col("_key").alias("_again"), "_first")
    both = base.join(durable(again, "warc-repeats"), F.col("_key") == F.col("_again"), "left")
    return both.select("page_id", "url", "html", F.when(F.col("page_id") != F.col("_first"), F.col("_first")).alias("refers_to"))


def record(date: str) -> Column:
    """A page as a record without the empty line that ends it."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    again = F.col("refers_to").isNotNull()
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, "").otherwise(F.col("html")))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", urn("page_id")), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("html"))), line("WARC-Profile", F.when(again, REVISIT_PROFILE)),
        line("WARC-Refers-To", F.when(again, urn("refers_to"))), F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )


def write_streams(pages: DataFrame, path: str, least: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z", rows_a_file: int = 100_000) -> None:
    """Write ``pages`` (``page_id, url, html``) as archives below ``path``, each one gzip stream of at most ``rows_a_file`` records.

    Record ids are ``<urn:page:ID>``; a null id leaves ID out, rows with one id share it, each has a record. Line
    breaks in an address are percent-encoded, a null address leaves its line out. An empty table gives no records;
    further columns, whatever their names, are not read."""
    rows = revisits(pages, least).select(record(date).alias("value"))
    rows.write.option("compression", "gzip").option("lineSep", EMPTY_LINE.decode()).option("maxRecordsPerFile", rows_a_file).text(path)


def _split_records(batches: Iterable[pa.RecordBatch]) -> Iterator[bytes]:
    """Whole records of whole files from what lies between their empty lines, in order; columns ``value`` and ``file``.

    Holds one record. A block may hold and end with line breaks itself: its length says where it ends."""
    file, head, parts, held, length = None, None, [], 0, 0
    for batch in batches:
        for piece, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != file:
                if head is not None:
                    raise ValueError(f"{file} ends within a record")
                file = own
            if head is None:
                head = piece.lstrip(b"\r\n")
                if not head:  # empty lines between records
                    head = None
                    continue
                length, parts, held = _length(head, file), [], 0
            else:
                parts += (piece, EMPTY_LINE)
                held += len(piece) + len(EMPTY_LINE)
            if held >= length:
                block = b"".join(parts)
                if block[length:].strip(b"\r\n"):
                    raise ValueError(f"{file}: a block is longer than its Content-Length of {length}")
                yield head + EMPTY_LINE + block[:length] + EMPTY_LINE
                head = None
    if head is not None:
        raise ValueError(f"{file} ends within a record")


def fields(head: bytes) -> dict[bytes, bytes]:
    """Header lines by lower-case name."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}


def _length(head: bytes, file: str) -> int:
    found = fields(head).get(b"content-length", b"")
    if not head.startswith(b"WARC/") or not found.isdigit():
        raise ValueError(f"{file}: no record where one should start")
    return int(found)


def member(record: bytes, level: int = 6) -> bytes:
    """A record as a gzip member of its own, without a time, so that reruns agree."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return GZIP_HEADER + (z.compress(record) + z.flush())[len(GZIP_HEADER) :]


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite the whole-file streams below ``source`` as archives below ``target``/records, a member a record, and index them in ``target``/index.

    Each stream is inflated once, by one task, which holds a record and a few MB of members; archives of others do as
    well, with any bytes in their blocks. A file that ends within a record or holds something else is an error. The
    index (JSON lines, ``INDEX``) is made by reading the archives back: every record is inflated alone, and the digest
    and size of its payload are compared with its headers. Without records the index is empty."""
    pieces = spark.read.option("lineSep", EMPTY_LINE.decode()).text(source).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))

    def rewrite(batches):
        held, size = [], 0
        for r in _split_records(batches):
            held.append(member(r))
            size += len(held[-1])
            if size >= _SEND:
                yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.binary())})
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.binary())})

    members = pieces.mapInArrow(rewrite, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(f"{target}/records")
    read_back = durable(_located(_members(spark, target)), "warc-located")
    by_split = Window.partitionBy("file").orderBy("split")
    starts = read_back.groupBy("file", "split").agg(F.sum(F.col("length") + len(EMPTY_MEMBER)).alias("_sum")).select(F.col("file").alias("_f"), F.col("split").alias("_s"), (F.sum("_sum").over(by_split) - F.col("_sum")).alias("_before"))
    whole = read_back.join(starts, (F.col("file") == F.col("_f")) & (F.col("split") == F.col("_s"))).withColumn("offset", F.col("_before") + F.col("local"))
    whole.select("file", "offset", "length", *RECORD.replace(",", "").split()[::2]).write.json(f"{target}/index")
    release(read_back)


def _members(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, split``: the members of all archives, in file order within a split."""
    rows = spark.read.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(f"{path}/records")
    return rows.select(F.col("value").cast("binary").alias("value"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("_metadata.file_block_start").alias("split"))


def parsed(record: bytes) -> tuple[tuple, bytes | None]:
    """The columns of ``RECORD`` and the payload (None: it is elsewhere). A payload other than its headers say is an error."""
    head, _, block = record.partition(EMPTY_LINE)
    own = fields(head)
    text = lambda k: own[k].decode("utf-8", "surrogatepass") if k in own else None
    kind = text(b"warc-type")
    http, _, payload = block[: int(own[b"content-length"])].partition(EMPTY_LINE)
    declared = fields(http).get(b"content-length")
    digest, size = (text(b"warc-payload-digest") or "").removeprefix("sha1:"), int(declared) if declared and declared.isdigit() else None
    if kind != "revisit":
        found = hashlib.sha1(payload).hexdigest()
        if (digest and digest.lower() != found) or (size is not None and size != len(payload)):
            raise ValueError(f"the payload of {text(b'warc-record-id')} is not the one its headers name")
        digest, size = found, len(payload)
    return (text(b"warc-record-id"), kind, text(b"warc-target-uri"), text(b"warc-refers-to"), digest, size), payload if kind != "revisit" else None


def _located(members: DataFrame) -> DataFrame:
    """``RECORD`` with ``file, split, length`` and ``local``, the place from the start of the split's first record."""

    def scan(batches):
        now, at = None, 0
        for batch in batches:
            out = []
            for value, file, split in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, split) != now:
                    now, at = (file, split), 0
                out.append((file, split, at, len(value), *parsed(zlib.decompress(value, 31))[0]))
                at += len(value) + len(EMPTY_MEMBER)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, (pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)), strict=True)))

    names = ["file", "split", "local", "length", *RECORD.replace(",", "").split()[::2]]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64()]
    return members.mapInArrow(scan, f"file string, split long, local long, length long, {RECORD}")


def index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index of normalised archives, a row for each record."""
    return spark.read.schema(INDEX).json(f"{path}/index")


def records(spark: SparkSession, path: str) -> DataFrame:
    """``RECORD`` and ``payload`` (binary; null for a revisit) of all records, read in parallel splits."""
    return _opened(_members(spark, path).select("value"))


def fetch(spark: SparkSession, path: str, record_ids: list[str]) -> DataFrame:
    """The records with the given ids, by offset: only archives that hold one are opened, only their members inflated.

    The driver gets the index rows of these ids, so ``record_ids`` is meant to be a short list."""
    wanted = index(spark, path).where(F.col("record_id").isin(record_ids)).select("file", "offset", "length")
    files = sorted(r["file"] for r in wanted.select("file").distinct().collect())
    if not files:
        return records(spark, path).limit(0)
    whole = spark.read.format("binaryFile").load([f"{path}/records/{f}" for f in files]).select(F.element_at(F.split("path", "/"), -1).alias("_f"), "content")
    cut = wanted.join(whole, F.col("file") == F.col("_f")).select(F.substr("content", F.col("offset") + 1, F.col("length")).alias("value"))
    return _opened(cut)


def _opened(members: DataFrame) -> DataFrame:
    def scan(batches):
        for batch in batches:
            held, size = [], 0
            for value in batch.column(0).to_pylist():
                row, payload = parsed(zlib.decompress(value, 31))
                held.append((*row, payload))
                size += len(payload or b"")
                if size >= _SEND:
                    yield as_batch(held)
                    held, size = [], 0
            if held:
                yield as_batch(held)

    def as_batch(rows):
        return pa.RecordBatch.from_pydict(dict(zip(names, (pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)), strict=True)))

    names, kinds = [*RECORD.replace(",", "").split()[::2], "payload"], [*[pa.string()] * 5, pa.int64(), pa.binary()]
    return members.mapInArrow(scan, f"{RECORD}, payload binary")


def page_of(urn: Column) -> Column:
    """The page id that ``<urn:page:ID>`` names; null where ID is missing."""
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")

"""WARC archives: writing captures, reading records back, assembling transactions (operator 9).

Records are written by Spark's text writer with the record separator of the format as line separator,
so any store that Spark writes will do; a file is one gzip member. Reading streams the files through
Spark's text reader, cut at the same separator, and puts records together by content length, so a task
holds one record at a time, whatever the size of a file. The request, response (or revisit) and metadata
records of a capture are joined through their concurrent-to identifiers into one nested row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, shared_dir

EOL = "\r\n"
#: Payloads under this many bytes are never revisits.
LEAST = 1000
#: Records of an archive file at the most, so that reading is spread: a gzip file is one task.
PER_FILE = 15_000
#: Payload bytes of a batch of records that are read.
HELD = 8 << 20
RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, page_id long, payload_bytes long, payload_digest string, payload binary"


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Each row of ``page_id, url, payload`` with ``digest, bytes, copy, keep``: ``keep`` is the page whose response holds the payload.

    Only ids and digests are grouped; the payloads are shuffled once, by id and digest, so a payload
    with very many copies is not one task. Rows equal in id and payload are told apart by ``copy``.
    """
    number = F.coalesce("page_id", F.lit(-(1 << 63))).alias("number")
    rows = pages.select("*", number, F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    keep = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    named = rows.select("number", "digest").distinct().join(keep, "digest").withColumn("repeats", F.lit(True))
    # one exchange of the payloads serves the join and the window
    copy = F.row_number().over(Window.partitionBy("number", "digest").orderBy(F.col("url").asc_nulls_last()))
    found = rows.join(named, ["number", "digest"], "left").withColumn("copy", copy)
    first = F.col("page_id").eqNullSafe(F.col("keep")) & (F.col("copy") == 1)
    return found.select("page_id", "url", "payload", "digest", "bytes", "copy", "keep", (F.coalesce("repeats", F.lit(False)) & ~first).alias("revisit"))


def _id(kind: str, page: str, copy: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(F.col(page).cast("string"), F.lit("null")), F.col("digest"), copy.cast("string")))
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _record(kind: Column, record_id: Column, headers: list[Column], content_type: str, block: Column) -> Column:
    """A record without the separator after it. Null headers are left out."""
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    head = F.concat_ws(EOL, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), *headers, F.lit(f"Content-Type: {content_type}"), length)
    return F.concat(head, F.lit(EOL * 2), block)


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = LEAST) -> None:
    """Writes a request, a response or revisit, and a metadata record for each page, gzipped, under ``path``."""
    rows = revisits(pages, least)
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")
    parts = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", 1), F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", 2)
    target, when = F.concat(F.lit("WARC-Target-URI: "), uri), F.lit(f"WARC-Date: {date}")
    answer = _id("response", "page_id", F.col("copy"))
    beside = F.concat(F.lit("WARC-Concurrent-To: "), answer)
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    refers = F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), _id("response", "keep", F.lit(1))))
    profile = F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(EOL * 2))
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload").cast("string"))
    get = F.concat(F.lit("GET "), F.when(F.coalesce(parts[1], F.lit("")) == "", F.lit("/")).otherwise(parts[1]), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(parts[0], F.lit("")), F.lit(EOL * 2))
    about = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(EOL))
    records = F.array(
        _record(F.lit("request"), _id("request", "page_id", F.col("copy")), [when, target, beside], "application/http; msgtype=request", get),
        _record(F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), answer, [when, target, digest, refers, profile], "application/http; msgtype=response", F.concat(http, body)),
        _record(F.lit("metadata"), _id("metadata", "page_id", F.col("copy")), [when, target, beside], "application/warc-fields", about),
    )
    out = rows.select(F.explode(records).alias("value"))
    out.write.option("lineSep", EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


class Parser:
    """Records from the pieces of an archive between its separators, in order; holds one record at a time."""

    def __init__(self) -> None:
        self.begin()

    def begin(self) -> None:
        self.first, self.head, self.headers, self.need, self.parts = True, b"", None, 0, []

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """Headers (lower-case names) and block of each record that ends in the piece."""
        if not self.first:
            piece = b"\r\n\r\n" + piece
        self.first = False
        while piece or self.headers is not None and not self.need:
            if self.headers is None:
                self.head = (self.head + piece).lstrip(b"\r\n")
                head, found, piece = self.head.partition(b"\r\n\r\n")
                if not found:
                    return
                self.head = b""
                self.headers = _headers(head)
                self.need = int(self.headers.get("content-length", 0))
            self.parts.append(piece[: self.need])
            piece = piece[self.need :]
            self.need -= len(self.parts[-1])
            if not self.need:
                yield self.headers, b"".join(self.parts)
                self.headers, self.parts = None, []

    def end(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """The record that the end of the file leaves open, with the bytes that there are."""
        if self.headers is not None or self.head:
            yield self.headers or _headers(self.head), b"".join(self.parts)
        self.begin()


def _headers(head: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split(EOL)[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _record_row(h: dict[str, str], block: bytes, payloads: bool) -> dict:
    kind = h.get("warc-type")
    full = kind == "response"
    _, _, body = block.partition(b"\r\n\r\n") if full else (b"", b"", b"")
    page = next((x[8:].strip() for x in block.split(b"\r\n") if x.startswith(b"page-id:")), b"") if kind == "metadata" else b""
    return {
        "record_id": h.get("warc-record-id"), "type": kind, "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"), "uri": h.get("warc-target-uri"),
        "page_id": int(page) if page else None, "payload_bytes": len(body) if full else None, "payload_digest": hashlib.sha1(body).hexdigest() if full else None, "payload": body if full and payloads else None,
    }


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the gzip files (``*.gz``) under ``path``. Digests are taken of the payloads read, not from headers.

    Files may hold one gzip member or one for each record. A record cut off by the end of its file comes
    with the bytes that there are. The payload of a response is its HTTP body; without ``payloads`` the
    bodies are dropped once digested.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split(" ") for x in RECORD.split(", "))])
        parser, file, rows, held = Parser(), None, [], 0

        def found() -> Iterator[tuple[dict[str, str], bytes]]:
            nonlocal file
            for batch in batches:
                for name, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if name != file:
                        yield from parser.end()
                        file = name
                    yield from parser.feed(piece.as_py())
            yield from parser.end()

        for headers, block in found():
            rows.append(_record_row(headers, block, payloads))
            held += len(block)
            if len(rows) >= 1000 or held >= HELD:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    pieces = spark.read.option("lineSep", EOL * 2).option("pathGlobFilter", "*.gz").text(path)
    return pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each response or revisit: ``capture_id, request, response, metadata``.

    The records of a transaction meet under the identifier that they are concurrent to; a response is
    its own. A part that is missing is null, and request or metadata records without a response are left out.
    """
    part = F.struct("record_id", "type", "refers_to", "uri", "page_id", "payload_bytes", "payload_digest", "payload")
    answer = F.col("type").isin("response", "revisit")
    keyed = records.where(F.col("type").isin("request", "response", "revisit", "metadata")).select(
        F.when(answer, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture_id"),
        F.when(F.col("type") == "request", part).alias("request"), F.when(answer, part).alias("response"), F.when(F.col("type") == "metadata", part).alias("metadata"),
    )
    parts = ("request", "response", "metadata")
    return keyed.groupBy("capture_id").agg(*(F.first(p, ignorenulls=True).alias(p) for p in parts)).where("response is not null")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page, from archives written and read back.

    Of equal payloads of ``LEAST`` bytes or more the largest page id is the response (a null id is the
    least), the others refer to it; of rows equal in id and payload one is the response. Null html is an
    empty payload, null urls leave the target out, an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")), path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    found = captures(read_records(spark, path, payloads=False))
    found = found.select(
        "capture_id", F.col("metadata.page_id").alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("to"), F.col("response.payload_bytes").alias("n"), F.col("response.payload_digest").alias("digest")
    )
    found = materialize(found, "captures")
    held = found.where("record_type = 'response'").select(F.col("capture_id").alias("held_id"), F.col("page_id").alias("held_page"), F.col("n").alias("held_n"), F.col("digest").alias("held_digest"))
    wanted = found.where("record_type = 'revisit'").join(held, F.col("to") == F.col("held_id")).select("page_id", F.col("held_n").alias("payload_bytes"), F.col("held_digest").alias("payload_digest"), "record_type", F.col("held_page").alias("refers_to"))
    return found.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(wanted)

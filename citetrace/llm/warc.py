"""WARC archives: write captures as records, read them back, assemble transactions by concurrent-to identifiers.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record. Archives are gzip
files that Spark's text writer makes, with the record separator as line separator, so any store that Spark
writes to will do; how many there are follows from their bytes. They are read through Spark's binary reader, unpacked and
parsed piece by piece, so a task holds a packed archive and one record.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citetrace.plans.storage import materialise

CRLF = "\r\n"
#: Smaller payloads are always stored.
LEAST_REVISIT = 100
#: Bytes of payload in an archive, at most on average.
BYTES_A_FILE = 16 << 20
#: Bytes that are unpacked at once, and bytes of payload in a batch of records.
UNPACKED = 1 << 20
BATCH_BYTES = 8 << 20
DATE = "2000-01-01T00:00:00Z"


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]))
    return F.concat(
        F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"),
        F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"),
    )


def _record(kind: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    head = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in fields]
    return F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), kind, F.lit(CRLF), *[F.coalesce(x, F.lit("")) for x in head],
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block,
    )


def captures(pages: DataFrame) -> DataFrame:
    """``pages`` with payload, its bytes and digest, and the page and URL of the capture it revisits (null: it is stored).

    The html is exchanged once, by page, into as many parts as there are to be archives; all that follows keeps that partitioning.
    """
    total = pages.agg(F.sum(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BYTES_A_FILE))
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.col("url").cast("string"), "[\\x00-\\x20\\x7F]", "").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    slim = own.select("page_id", "url", F.octet_length("payload").alias("n"), F.sha2(F.col("payload").cast("binary"), 256).alias("digest"))
    slim = slim.where(F.col("n") >= LEAST_REVISIT)
    first = slim.where("page_id is not null").groupBy("digest", "n").agg(F.min(F.struct("page_id", "url")).alias("first"))
    again = slim.join(first, ["digest", "n"]).where("page_id > first.page_id").select("page_id", F.col("first").alias("revisits")).distinct()
    return own.repartition(parts, "page_id").join(again, "page_id", "left").select(  # sizes decide whether the slim side is broadcast
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2(F.col("payload").cast("binary"), 256).alias("payload_digest")
    )


def write(pages: DataFrame, path: str) -> None:
    """Write three records for each row of ``pages`` (page_id, url, html) as gzip archives below ``path``."""
    c = captures(pages)
    page, url = F.col("page_id"), F.col("url")
    # rows that repeat are captures of their own
    nth = F.row_number().over(Window.partitionBy("page_id", "url", "payload_digest").orderBy("page_id"))
    c = c.withColumn("nth", nth)
    response = lambda page, url, n: _urn(page, url, F.col("payload_digest"), n, F.lit("response"))
    c = c.select(
        "*", response(page, url, F.col("nth")).alias("rid"), F.col("revisits").isNotNull().alias("again"),
        F.when(F.col("revisits").isNotNull(), response(F.col("revisits.page_id"), F.col("revisits.url"), F.lit(1))).alias("to"),
    )
    date, target = ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", url)
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest")))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF)
    )
    stored = _record(
        F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response")),
        [
            ("WARC-Record-ID", F.col("rid")),
            date,
            target,
            digest,
            ("WARC-Refers-To", F.col("to")),
            ("WARC-Refers-To-Target-URI", F.col("revisits.url")),
            ("WARC-Refers-To-Date", F.when(F.col("again"), F.lit(DATE))),
            ("WARC-Profile", F.when(F.col("again"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.when(F.col("again"), http).otherwise(F.concat(http, F.col("payload"))),
    )
    host = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    rest = F.regexp_replace(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*|#.*$", "")
    request = _record(
        F.lit("request"),
        [("WARC-Record-ID", _urn(F.col("rid"), F.lit("request"))), date, target, ("WARC-Concurrent-To", F.col("rid")), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(F.when(rest.startswith("/"), rest), F.concat(F.lit("/"), rest), F.lit("/")), F.lit(" HTTP/1.1" + CRLF + "Host: "), F.coalesce(host, F.lit("")), F.lit(CRLF + CRLF)),
    )
    metadata = _record(
        F.lit("metadata"),
        [("WARC-Record-ID", _urn(F.col("rid"), F.lit("metadata"))), date, target, ("WARC-Concurrent-To", F.col("rid")), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.coalesce(F.concat(F.lit("page-id: "), page.cast("string"), F.lit(CRLF)), F.lit("")), F.lit("payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit(CRLF)),
    )
    records = c.select(F.explode(F.array(request, stored, metadata)).alias("value"))
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


RECORD = pa.schema(
    [
        (n, pa.int64() if n in ("page_id", "payload_bytes", "block_bytes") else pa.string())
        for n in ("record_id", "record_type", "concurrent_to", "url", "digest", "refers_to_id", "page_id", "block_bytes", "payload_bytes", "payload_digest", "payload")
    ]
)


def unpack(archive: bytes):
    """The bytes of all gzip members, piece by piece."""
    at, unpacker = 0, zlib.decompressobj(31)
    rest = b""
    while rest or at < len(archive):
        if not rest:
            rest, at = archive[at : at + UNPACKED], at + UNPACKED
        yield unpacker.decompress(rest, UNPACKED)
        rest = unpacker.unconsumed_tail
        if unpacker.eof:
            rest, unpacker = unpacker.unused_data, zlib.decompressobj(31)


def parse(pieces):
    """The records of an archive that comes in pieces, as (headers, block)."""
    held, at, need = bytearray(), 0, None
    for piece in pieces:
        if at > UNPACKED:
            del held[:at]
            at = 0
        held += piece
        while True:
            if need is None:
                head = held.find(b"\r\n\r\n", at)
                if head < 0:
                    break
                headers = {}
                for line in held[at:head].decode("utf-8", "replace").split(CRLF)[1:]:
                    name, _, value = line.partition(":")
                    headers[name.lower()] = value.strip()
                at, need = head + 4, int(headers["content-length"])
            if len(held) < at + need + 4:
                break
            yield headers, bytes(held[at : at + need])
            at, need = at + need + 4, None


def _read(with_payload: bool):
    def of(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows: list[dict] = []
                size = 0
                for h, block in parse(unpack(content.as_py())):
                    kind = h.get("warc-type")
                    row = {"record_id": h.get("warc-record-id"), "record_type": kind, "concurrent_to": h.get("warc-concurrent-to"), "url": h.get("warc-target-uri"), "block_bytes": len(block)}
                    if kind in ("response", "revisit"):
                        row["digest"] = h.get("warc-payload-digest", "").removeprefix("sha256:")
                        row["refers_to_id"] = h.get("warc-refers-to")
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        row["payload_bytes"], row["payload_digest"] = len(payload), hashlib.sha256(payload).hexdigest()
                        if with_payload:
                            row["payload"] = payload.decode("utf-8", "replace")
                            size += len(payload)
                    if kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode().split(CRLF) if ": " in x)
                        row["page_id"] = int(fields["page-id"]) if "page-id" in fields else None
                    rows.append(row)
                    if size >= BATCH_BYTES or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=RECORD)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=RECORD)

    return of


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``; payloads only if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    kinds = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in RECORD)
    return files.mapInArrow(_read(with_payload), kinds)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its response or revisit with the request and metadata that are concurrent to it.

    A revisit has the page and payload length of the response whose record id it refers to. Records that repeat an id count once; a request or
    metadata record that is concurrent to nothing is left out; a capture without one has null there.
    """
    main = records.where("record_type in ('response', 'revisit')").dropDuplicates(["record_id"])
    beside = lambda kind: (
        records.where(F.col("record_type") == kind).dropDuplicates(["concurrent_to"]).select(
            F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id"), "url", "block_bytes", "page_id").alias(kind)
        )
    )
    c = main.drop("page_id", "concurrent_to").join(beside("request"), "record_id", "left").join(beside("metadata"), "record_id", "left")
    c = c.withColumn("page_id", F.col("metadata.page_id"))
    # page and length are with the stored response alone
    stored = c.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("stored_bytes"))
    asked = c.where("record_type = 'revisit'").select("refers_to_id").distinct()
    c = c.join(stored.join(asked, "refers_to_id", "left_semi"), "refers_to_id", "left")
    return c.select(
        "page_id",
        "url",
        F.coalesce("payload_bytes", "stored_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "digest").alias("payload_digest"),
        "record_type",
        "refers_to",
        F.struct("request", F.struct("record_id", "block_bytes", "payload").alias("response"), "metadata").alias("capture"),
    )


def round_trip(pages: DataFrame, path: str, with_payload: bool = False) -> DataFrame:
    """Write ``pages`` below ``path``, read the archives and assemble them.

    A null html is an empty payload; a null url has no target; rows that repeat page_id, url and html are a capture each. A row
    of a null page_id is stored as a response and never referred to. A very long page makes an archive that is as long, of at most 2 GB packed; other columns are not read and an empty table
    gives no rows.
    """
    write(pages, path)
    return assemble(materialise(read(pages.sparkSession, path, with_payload), "warc-records"))

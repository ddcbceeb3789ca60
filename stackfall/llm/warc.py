"""WARC archives as chunked record tables.

A payload is a run of rows ``(record, chunk_no, data)`` with the digest and size up to each row; no step
holds more than one chunk beside its input cell. Every chunk becomes one WARC record: the first is
a response, later ones are its continuations (segments), so archives are written and read by Spark's
text source record by record, on any file system, and large files can be read in parallel.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1\r\n"
#: Payload bytes of one record, at most.
CHUNK_BYTES = 1 << 16
#: Payloads from this size on are stored once; later pages with the same one revisit it.
REVISIT_BYTES = 100
#: Lists of revisiting pages up to this size are sent to the pages, longer ones are joined.
SEND_ROWS = 1_000_000
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = (
    "record string, page_id long, url string, refers_to long, chunk_no int, data binary, "
    "bytes_so_far long, digest_so_far string, last boolean"
)


def cuts(data: memoryview, size: int) -> Iterator[tuple[int, int]]:
    """Spans of at most ``size`` bytes, none of which holds the version line of a record.

    Readers that split at that line then never split inside a payload.
    """
    mark, n, at = VERSION.encode(), len(data), 0
    while True:
        end = min(n, at + size)
        found = bytes(data[at:end]).find(mark)
        if found >= 0:
            end = at + found + 4
        yield at, end
        at = end
        if at >= n:
            return


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of ``page_id, url, html, refers_to``; a page that refers to another has no data
    but the size and digest of its payload. Null payloads are empty: one empty chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _CHUNK.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(),
                 pa.int64(), pa.string(), pa.bool_()]

        def pack(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names
            )

        for batch in batches:
            rows, held = [], 0
            for page, url, html, first in zip(
                batch.column("page_id").to_pylist(), batch.column("url").to_pylist(),
                batch.column("html"), batch.column("refers_to").to_pylist(),
            ):
                cell = html.as_buffer()
                data = memoryview(cell) if cell is not None else memoryview(b"")
                running, record = hashlib.sha256(), str(uuid.uuid4())
                for k, (a, b) in enumerate(cuts(data, chunk_bytes)):
                    running.update(data[a:b])
                    last = b == len(data)
                    if first is None or last:
                        kept = bytes(data[a:b]) if first is None else b""
                        rows.append((record, page, url, first, k if first is None else 0, kept,
                                     b, running.hexdigest(), last))
                        held += len(kept)
                    if held > 1 << 22:
                        yield pack(rows)
                        rows, held = [], 0
            if rows:
                yield pack(rows)

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, _CHUNK)


def write_archive(chunks: DataFrame, path: str) -> None:
    """One WARC record per chunk row, gzip-compressed files below ``path``."""
    line = lambda name, value: F.concat(
        F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")
    )
    maybe = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    first = F.col("chunk_no") == 0
    header = F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.when(F.col("refers_to").isNotNull(), "revisit")
             .when(first, "response").otherwise("continuation")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.when(first, F.col("record"))
             .otherwise(F.expr("uuid()")), F.lit(">"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        maybe("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        maybe("Page-ID", F.col("page_id")),
        maybe("WARC-Profile", F.when(F.col("refers_to").isNotNull(), F.lit(_PROFILE))),
        maybe("Refers-To-Page-ID", F.col("refers_to")),
        F.when(first & F.col("last"), F.lit("")).otherwise(F.concat(
            line("WARC-Segment-Number", F.col("chunk_no") + 1),
            F.when(first, F.lit("")).otherwise(
                line("WARC-Segment-Origin-ID",
                     F.concat(F.lit("<urn:uuid:"), F.col("record"), F.lit(">")))),
        )),
        F.when(F.col("last"), F.concat(
            line("WARC-Segment-Total-Length", F.col("bytes_so_far")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest_so_far"))),
        )).otherwise(F.lit("")),
        F.lit("Content-Type: text/html\r\n"),
        line("Content-Length", F.octet_length("data")),
        F.lit("\r\n"),
    )
    record = F.concat(header.cast("binary"), F.col("data")).cast("string")
    chunks.select(record.alias("value")).write.option("lineSep", _END).option(
        "compression", "gzip"
    ).text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of archives that :func:`write_archive` wrote; a cut record is an error.

    ``record, type, page_id, refers_to, chunk_no, data, last, total, digest``: the last two, as
    stated in the header, on the last chunk only.
    """
    raw = spark.read.option("lineSep", _END + VERSION).text(path)
    schema = (
        "record string, type string, page_id long, refers_to long, chunk_no int, data binary, "
        "last boolean, total long, digest string"
    )

    def parse(value: bytes) -> tuple:
        value = value.removeprefix(VERSION.encode())
        head, _, body = value.partition(_END.encode())
        fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n"))
        size = int(fields["Content-Length"])
        if len(body) < size:
            raise ValueError(f"record {fields.get('WARC-Record-ID')} ends early")
        number = lambda k: int(fields[k]) if k in fields else None
        return (
            fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]), fields["WARC-Type"],
            number("Page-ID"), number("Refers-To-Page-ID"),
            int(fields.get("WARC-Segment-Number", 1)) - 1, body[:size],
            "WARC-Payload-Digest" in fields, number("WARC-Segment-Total-Length"),
            fields.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(),
                 pa.bool_(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            rows = [parse(v) for v in batch.column(0).to_pylist() if v.strip()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names
                )

    return raw.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, schema)


def digests(chunks: DataFrame) -> DataFrame:
    """``record, type, page_id, refers_to, payload_bytes, payload_digest`` of read chunk rows.

    A record of one chunk is digested where it is. The chunks of longer ones meet in order
    and stream through one running digest. A stored payload must match its header; a revisit states
    the size and digest of the payload it refers to.
    """
    whole = chunks.where("chunk_no = 0 and last").select(
        "record", "type", "page_id", "refers_to",
        F.when(F.col("type") == "revisit", F.col("total")).otherwise(F.octet_length("data"))
        .cast("long").alias("payload_bytes"),
        F.when(F.col("type") == "revisit", F.col("digest")).otherwise(F.sha2("data", 256))
        .alias("payload_digest"),
        F.col("digest").alias("_stated"),
    )

    names = whole.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, running, size, page = None, None, 0, None
        for batch in batches:
            rows = []
            for record, page_id, data, last, digest in zip(
                *(batch.column(c).to_pylist() for c in ("record", "page_id", "data", "last", "digest"))
            ):
                if record != name:
                    name, running, size, page = record, hashlib.sha256(), 0, page_id
                running.update(data)
                size += len(data)
                if last:
                    rows.append((record, "response", page, None, size, running.hexdigest(), digest))
            if rows:
                types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
                         pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names
                )

    parts = (
        chunks.where("not (chunk_no = 0 and last)")
        .repartition("record")
        .sortWithinPartitions("record", "chunk_no")
        .mapInArrow(run, whole.schema)
    )
    checked = F.when(F.col("payload_digest") == F.col("_stated"), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("record")))
    )
    return whole.unionByName(parts).withColumn("payload_digest", checked).drop("_stated")


def with_revisits(pages: DataFrame) -> DataFrame:
    """Adds ``refers_to``: the smallest page with the same payload of ``REVISIT_BYTES`` or more.

    Null for that page itself, for smaller payloads and for pages without id.
    """
    pages = pages.select("page_id", "url", "html")
    sums = pages.where(F.octet_length("html") >= REVISIT_BYTES).select(
        "page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest")
    )
    firsts = (
        sums.groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    later = (
        sums.join(firsts, "digest")
        .where("page_id > refers_to")
        .select("page_id", F.col("digest").alias("_digest"), "refers_to")
        .distinct()
    )
    if later.count() <= SEND_ROWS:
        later = F.broadcast(later)
    own = F.sha2(F.col("html").cast("binary"), 256)
    found = pages.join(
        later.withColumnRenamed("page_id", "_page"),
        (F.col("page_id") == F.col("_page")) & (own == F.col("_digest")),
        "left",
    )
    return found.select("page_id", "url", "html", "refers_to")


def round_trip(pages: DataFrame, path: str, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write ``pages`` below ``path``, read the archives back; one row per row of ``pages``.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. Null html is an empty
    payload, null urls and ids leave their header out, rows that repeat a page and its payload
    are records of their own; an empty table gives an empty archive and no rows.
    """
    spark = pages.sparkSession
    write_archive(chunk_table(with_revisits(pages), chunk_bytes), path)
    return digests(read_archive(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"
    )

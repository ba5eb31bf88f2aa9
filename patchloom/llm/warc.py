"""Write pages as WARC archives, read archives back, and assemble capture transactions.

An archive is a text table whose line separator is a record's end, so Spark's own writer, with
its commit protocol, makes whole records; gzip keeps a file in one task when it is read. Reading
splits at what looks like the border of two records, and Content-Length decides whether it is
one: a payload that holds such a border is put together again. One record is in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patchloom.session import pin

VERSION = "WARC/1.1"
END = "\r\n\r\n"  # after the block of every record
BORDER = END + VERSION + "\r\n"
LEAST_REVISIT = 1000  # bytes of payload from which equal payloads are written once
_RECORD = "type string, record_id string, concurrent_to string, page_id string, uri string, refers_to string, payload_length long, payload_digest string, block binary"


def _text(head: list[tuple[str, Column]], block: Column, length: Column) -> Column:
    """One record without its end; a header whose value is null is left out."""
    lines = F.concat_ws("\r\n", F.lit(VERSION), *(F.concat(F.lit(f"{name}: "), value) for name, value in head),
                        F.concat(F.lit("Content-Length: "), length.cast("string")))
    return F.concat(lines, F.lit("\r\n\r\n"), block)


def _one_line(value: Column) -> Column:
    return F.regexp_replace(value, "[\r\n]", " ")


def elect(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Add ``payload`` columns and ``refers_to``: null for responses, the response's page for revisits.

    Of pages with equal payloads of at least ``least`` bytes the largest page_id is the response.
    Rows that share this page_id are responses all; null ids are smaller than any other.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("payload")).withColumn("payload_length", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", F.sha1(F.col("payload").cast("binary")))
    best = rows.filter(F.col("payload_length") >= least).groupBy(F.col("payload_digest").alias("_digest")).agg(
        F.max("page_id").alias("_best"), F.count(F.lit(1)).alias("_copies")).filter("_copies > 1").drop("_copies")
    best = pin(best)  # its size is known from then on, so Spark broadcasts it only where it is small
    joined = rows.join(best, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_length") >= least), "left")
    revisit = F.col("_best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_best"))
    return joined.withColumn("refers_to", F.when(revisit, F.col("_best"))).drop("_digest", "_best")


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Write request, response or revisit, and metadata records of each row of ``pages`` (page_id, url, html).

    A null html is an empty payload. The record ids of a row are made in the task that writes
    all three records, so a task that runs again writes a consistent set.
    """
    ids = elect(pages, least).withColumns({f"_{kind}": F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")) for kind in ("request", "response", "metadata")})
    page, uri = F.col("page_id").cast("string"), _one_line(F.col("url"))
    revisit = F.col("refers_to").isNotNull()
    target = F.regexp_extract(uri, "^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    host = F.regexp_extract(uri, "^[a-zA-Z]+://([^/?#]*)", 1)
    get = F.concat(F.lit("GET "), F.when(F.coalesce(target, F.lit("")) == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit("\r\n\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_length").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    facts = F.concat(F.lit("payload-length: "), F.col("payload_length").cast("string"), F.lit("\r\n"))
    common = lambda kind, own: [("WARC-Type", kind), ("WARC-Record-ID", F.col(own)), ("WARC-Target-URI", uri), ("X-Page-ID", page)]
    response = [
        *common(F.when(revisit, "revisit").otherwise("response"), "_response"),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("X-Refers-To-Page", F.col("refers_to").cast("string")), ("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    to_response = ("WARC-Concurrent-To", F.col("_response"))
    records = F.array(
        _text([*common(F.lit("request"), "_request"), to_response, ("Content-Type", F.lit("application/http; msgtype=request"))], get, F.octet_length(get)),
        _text(response, block, F.octet_length(block)),
        _text([*common(F.lit("metadata"), "_metadata"), to_response, ("Content-Type", F.lit("application/warc-fields"))], facts, F.octet_length(facts)),
    )
    ids.select(F.explode(records).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _parse(record: bytes) -> tuple[dict[str, str], int, int]:
    """(headers with lower-case names, first byte of the block, its declared length) of a record without version line."""
    stop = record.find(b"\r\n\r\n")
    if stop < 0:
        raise ValueError("a record without end of headers")
    head = {}
    for line in record[:stop].split(b"\r\n"):
        name, _, value = line.partition(b":")
        head[name.strip().lower().decode()] = value.strip().decode()
    return head, stop + 4, int(head["content-length"])


def _glued(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; ``pieces`` is an archive, split at its borders, or at some of them."""
    parts: list[bytes] = []
    size = need = start = 0
    head: dict[str, str] = {}
    for piece in pieces:
        while piece is not None:
            if parts:
                parts.append(BORDER.encode())
                parts.append(piece)
                size += len(BORDER) + len(piece)
            else:
                piece = piece.removeprefix(VERSION.encode() + b"\r\n")
                if not piece.strip():
                    break
                head, start, need = _parse(piece)
                parts, size = [piece], len(piece)
            if size < start + need:
                break
            text = b"".join(parts)
            yield head, text[start:start + need]
            # the reader may miss a border that lies across two of its buffers: what follows is a record too
            parts, piece = [], text[start + need + len(BORDER):] if text.startswith(BORDER.encode(), start + need) else None
    if parts:
        raise ValueError("an archive ends inside a record")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzip archives below ``path``, all types; unknown headers are left out.

    ``block`` is the content as it is; ``payload_length`` comes from its own HTTP header, null for
    other records. A damaged archive (no length, or an end inside a record) ends the job.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one call sees one partition: whole files, one after the other, each with its rows in order
        pieces = (value.as_py() for batch in batches for value in batch.column(0))
        rows, held = [], 0
        for head, block in _glued(pieces):
            length = None
            if "msgtype=response" in head.get("content-type", ""):
                stop = block.find(b"\r\n\r\n")
                for line in block[:max(stop, 0)].split(b"\r\n"):
                    if line.lower().startswith(b"content-length:"):
                        length = int(line.split(b":")[1])
                block = block[stop + 4:]
            rows.append((head.get("warc-type"), head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("x-page-id"), head.get("warc-target-uri"),
                         head.get("x-refers-to-page"), length, head.get("warc-payload-digest", "").removeprefix("sha1:") or None, block))
            held += len(block)
            if held > 1 << 23 or len(rows) >= 4096:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    lines = spark.read.option("lineSep", BORDER).text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, _RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split(" ")[0] for f in _RECORD.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def assemble(records: DataFrame, response_columns: list[str] | None = None) -> DataFrame:
    """One nested row per capture: (capture_id, response, requests, metadata).

    A capture is a response or revisit record; requests and metadata join it through the record
    they are concurrent to, directly or through another of its records. Those whose record is not
    there make a capture without response, named by the record they point to (or by themselves).
    Lists are sorted by record id; a capture has the few records of one exchange.
    """
    columns = response_columns or ["type", "record_id", "page_id", "uri", "refers_to", "payload_length", "payload_digest", "block"]
    main = F.col("type").isin("response", "revisit")
    small = records.filter(~main).select("type", "record_id", "page_id", "uri", "block", F.coalesce("concurrent_to", "record_id").alias("_to"))
    through = small.select(F.col("record_id").alias("_via"), F.col("_to").alias("_far")).filter("_via <> _far").dropDuplicates(["_via"])
    # a metadata record may point to the request instead of the response: one step further then
    small = small.join(through, F.col("_to") == F.col("_via"), "left").withColumn("_to", F.coalesce("_far", "_to")).drop("_via", "_far")
    item = F.struct("record_id", "page_id", "uri", "block")
    lists = small.groupBy(F.col("_to").alias("capture_id")).agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "request", item))).alias("requests"),
        F.array_sort(F.collect_list(F.when(F.col("type") != "request", item))).alias("metadata"))
    responses = records.filter(main).select(F.col("record_id").alias("_id"), F.struct(*columns).alias("response"))
    return responses.join(lists, F.col("_id") == F.col("capture_id"), "full").select(
        F.coalesce("_id", "capture_id").alias("capture_id"), "response", "requests", "metadata")


def captures(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` to archives at ``path``, read them back and assemble the captures."""
    write_archives(pages, path, least)
    return assemble(read_archives(pages.sparkSession, path))


def digests(records: DataFrame) -> DataFrame:
    """(page_id string, payload_bytes, payload_digest, record_type, refers_to string) of each capture that has a response or revisit.

    The digest of a response is taken from its payload, that of a revisit from its headers. The
    length is what the capture's metadata record says. A capture whose request or metadata is
    missing or repeated, or tells another address or length than its response, ends the job with
    an error that names the page.
    """
    stored = F.col("type") == "response"
    records = records.withColumns({
        "payload_length": F.when(stored, F.octet_length("block").cast("long")).otherwise(F.col("payload_length")),
        "payload_digest": F.when(stored, F.sha1("block")).otherwise(F.col("payload_digest")),
    })
    found = assemble(records, ["type", "page_id", "uri", "refers_to", "payload_length", "payload_digest"]).filter("response IS NOT NULL")
    request, metadata = F.get("requests", F.lit(0)), F.get("metadata", F.lit(0))
    told = F.regexp_extract(metadata["block"].cast("string"), "(?m)^payload-length: ([0-9]+)", 1).try_cast("long")
    whole = (F.size("requests") == 1) & (F.size("metadata") == 1) & request["uri"].eqNullSafe(F.col("response.uri")) & (told == F.col("response.payload_length"))
    error = F.raise_error(F.concat(F.lit("records of one capture disagree: page "), F.coalesce("response.page_id", F.lit("without id"))))
    return found.select(
        "response.page_id", F.when(whole, told).otherwise(error.cast("long")).alias("payload_bytes"), "response.payload_digest",
        F.col("response.type").alias("record_type"), "response.refers_to")


def capture_digests(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> DataFrame:
    """``digests`` of the archives written from ``pages``, with page ids of their own type."""
    write_archives(pages, path, least)
    kind = pages.schema["page_id"].dataType
    return digests(read_archives(pages.sparkSession, path)).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})

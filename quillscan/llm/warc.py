"""WARC 1.1 archives of pages, written and read as a table of chunked records.

Writing: of records with equal payloads, that with the largest id is the response, the
others are revisits of it. A payload over ``chunk`` characters is written as a WARC
segment chain: one row, and so one record, for each record identifier and chunk number.
Spark's text writer lays the records down as gzip files; gzip files are not split, so a
chain is read again by one task, in order.

Reading: Spark's text reader cuts the files at the version line that begins each record
(the writer never leaves that line whole inside a block: it cuts a segment there). Each
task streams its records, carries a SHA-1 from chunk to chunk, and holds one chunk at a
time. A broken chain, a wrong length or a wrong digest raises an error.

Defined results: a null payload counts as empty; empty payloads are equal to each other;
rows that repeat the winning id and payload are all responses; a null id is never the
largest unless all ids of a payload are null (then all are responses); a null url is
written as an empty one; an empty table gives an empty archive and result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
CHUNK = 1 << 16
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RFC4648 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(hex40: Column) -> Column:
    """40 hex digits as base 32: each 10 of them are 8 digits."""
    parts = [F.lpad(F.conv(F.substring(hex40, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", RFC4648)


def _urn(*cols: Column) -> Column:
    digest = F.md5(F.concat_ws("\x00", *cols).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def typed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, sha1, bytes, refers_to): refers_to is set for revisits only."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"),
                        payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"))
    shared = (rows.where(F.col("bytes") >= min_bytes).groupBy("sha1").agg(F.max("id").alias("first"), F.count("*").alias("n"))
              .where("n > 1 and first is not null").select("sha1", "first"))
    return rows.join(shared, "sha1", "left").withColumn(
        "refers_to", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def records(rows: DataFrame, chunk: int = CHUNK, date: str | None = None) -> DataFrame:
    """The record table: id, chunk (from 1), chunks, value (the whole WARC record as text)."""
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    # the version never stands whole in a block, not even before the line end that closes it
    apart = F.split("payload", r"(?<=WARC/1\.)(?=1)", -1)
    chunks = F.flatten(F.transform(apart, lambda p: F.regexp_extract_all(p, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))))
    revisit = F.col("refers_to").isNotNull()
    rows = rows.withColumn("parts", F.when(revisit, F.array(F.lit(""))).otherwise(chunks))
    rows = rows.withColumn("parts", F.when(F.size("parts") == 0, F.array(F.lit(""))).otherwise(F.col("parts"))).drop("payload")
    rows = rows.withColumn("chunks", F.size("parts")).select("*", F.posexplode("parts").alias("at", "part")).drop("parts")
    key = lambda i: _urn(F.coalesce(i.cast("string"), F.lit("")), F.col("sha1"))
    first, last, many = F.col("at") == 0, F.col("at") + 1 == F.col("chunks"), F.col("chunks") > 1
    block = F.concat(F.when(first, F.lit(HTTP)).otherwise(""), F.col("part"))
    # control characters and spaces are percent-encoded, and so is the version
    url = F.translate(F.regexp_replace("url", r"[\x00-\x20\x7F]", "\x01"), "\x01", " ")
    url = F.replace(F.replace(url, F.lit(" "), F.lit("%20")), F.lit(VERSION), F.lit("WARC/1%2E1"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    opt = lambda when, name, value: F.when(when, line(name, value)).otherwise("")
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").when(first, "response").otherwise("continuation")),
        line("WARC-Record-ID", F.when(first, key(F.col("id"))).otherwise(_urn(key(F.col("id")), F.col("at").cast("string")))),
        F.lit(f"WARC-Date: {date}\r\n"),
        line("WARC-Target-URI", url),
        opt(first, "WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32(F.col("sha1")))),
        opt(first, "X-Payload-Length", F.col("bytes").cast("string")),
        opt(first & F.col("id").isNotNull(), "X-Page-ID", F.col("id").cast("string")),
        opt(revisit, "WARC-Refers-To", key(F.col("refers_to"))),
        opt(revisit, "X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        opt(revisit, "WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        opt(many, "WARC-Segment-Number", (F.col("at") + 1).cast("string")),
        opt(many & ~first, "WARC-Segment-Origin-ID", key(F.col("id"))),
        opt(many & last, "WARC-Segment-Total-Length", (F.col("bytes") + len(HTTP)).cast("string")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"))
    return rows.select("id", (F.col("at") + 1).alias("chunk"), "chunks", F.concat(head, block, F.lit("\r\n\r\n")).alias("value"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_bytes: int = 0, chunk: int = CHUNK, date: str | None = None) -> None:
    """Write a record for each row of ``pages`` as gzip WARC files in the new folder ``path``."""
    table = records(typed(pages, id_col, url_col, payload_col, min_bytes), chunk, date)
    # the writer ends each row with a line feed: the record's last one
    table = table.select(F.expr("substring(value, 1, length(value) - 1)").alias("value"))
    table.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", 0).text(path)


CHUNKS = pa.schema([("record_id", pa.string()), ("page_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
                    ("chunk", pa.int64()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("data", pa.binary())])
_DDL = ("record_id string, page_id string, record_type string, refers_to string, chunk long, last boolean, "
        "payload_bytes long, payload_digest string, data binary")


def _parse(value: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = value.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n"))
    if len(rest) != int(fields["Content-Length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError(f"record {fields.get('WARC-Record-ID')} has a wrong length")
    return fields, rest[:-4]


def chunk_table(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """A row for each chunk: record_id, page_id, record_type, refers_to, chunk, last,
    payload_bytes and payload_digest (of the payload up to and with this chunk), data.

    A revisit has one row, with its response's length and digest and no data.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin: dict | None = None  # the chain that is open
        for batch in batches:
            rows = []
            for value in batch.column(0).cast(pa.large_binary()):
                value = value.as_py()
                if not value:
                    continue
                f, block = _parse(value)
                if f["WARC-Type"] == "revisit":
                    rows.append((f["WARC-Record-ID"], f.get("X-Page-ID"), "revisit", f["X-Refers-To-Page-ID"], 1, True,
                                 int(f["X-Payload-Length"]), f["WARC-Payload-Digest"][5:], None))
                    continue
                number = int(f.get("WARC-Segment-Number", 1))
                if number == 1:
                    if origin:
                        raise ValueError(f"record {origin['id']} lacks segments")
                    block = block.partition(b"\r\n\r\n")[2]
                    origin = {"id": f["WARC-Record-ID"], "page": f.get("X-Page-ID"), "sha1": hashlib.sha1(), "bytes": 0, "number": 0,
                              "digest": f["WARC-Payload-Digest"][5:], "chain": "WARC-Segment-Number" in f}
                elif not origin or f["WARC-Segment-Origin-ID"] != origin["id"]:
                    raise ValueError(f"record {f['WARC-Record-ID']} continues no open record")
                if number != origin["number"] + 1:
                    raise ValueError(f"record {origin['id']} has its segments out of order")
                origin["number"] = number
                origin["sha1"].update(block)
                origin["bytes"] += len(block)
                last = not origin["chain"] or "WARC-Segment-Total-Length" in f
                digest = base64.b32encode(origin["sha1"].digest()).decode()
                rows.append((origin["id"], origin["page"], "response", None, number, last, origin["bytes"], digest, block if with_data else None))
                if last:
                    if digest != origin["digest"]:
                        raise ValueError(f"record {origin['id']} has a wrong digest")
                    origin = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), CHUNKS.types)] if rows
                                             else [pa.array([], t) for t in CHUNKS.types], schema=CHUNKS)
        if origin:
            raise ValueError(f"record {origin['id']} lacks segments")

    lines = spark.read.schema("value string").option("lineSep", f"{VERSION}\r\n").text(path)
    return lines.mapInArrow(stream, _DDL)


def read(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record."""
    return chunk_table(spark, path, with_data=False).where("last").select(
        F.col("page_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"))

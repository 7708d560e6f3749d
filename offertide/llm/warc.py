"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is up to three records: a response (or a revisit, when an earlier capture has the
same payload), the request and the metadata. The latter two name the first in
WARC-Concurrent-To. Archives are gzipped files that Spark's own text sink writes, so any
shared file system will do. They are read by whole files, each bounded by RECORDS_PER_FILE,
and cut by Content-Length, so payloads may hold anything. Assembly joins the record kinds
on their identifiers; payloads stay where they were read unless they are asked for.

Payloads under MIN_REVISIT bytes are always responses. Of equal payloads the smallest page
id, null last, is the response; a repeated row is a revisit of its copy. Null html is an
empty payload; a null url is "about:blank". An empty table gives an empty result.

`pages` is read once: its rows are stored with their numbers, and all records are built from those.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offertide.functions.storage import shared_folder
from offertide.llm.common import attach_groups, text_or_empty, written

MIN_REVISIT = 100
RECORDS_PER_FILE = 1500
VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
KINDS = {"response": "0", "revisit": "0", "request": "1", "metadata": "2"}

RECORD = ("type string, record_id string, concurrent_to string, refers_to string, target string, date string, "
          "http string, fields string, payload_bytes long, payload_digest string, payload binary")


def _record_id(kind: str, row: str, page: str):
    """A URN in UUID form from the kind of record, its row and its page (f: no page)."""
    digits = F.concat(
        F.lit(KINDS[kind]), F.when(F.col(page).isNull(), "f").otherwise("0"),
        F.lpad(F.lower(F.hex(F.col(row))), 14, "0"),
        F.lpad(F.lower(F.hex(F.coalesce(F.col(page), F.lit(0).cast("long")))), 16, "0"))
    parts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def page_of(record_id):
    """The page of an identifier made by this module."""
    digits = F.regexp_replace(record_id, "<urn:uuid:|-|>", "")
    return F.when(F.substring(digits, 2, 1) == "0", F.conv(F.substring(digits, 17, 16), 16, -10).cast("long"))


def _record(kind: str, headers, block) -> Column:
    head = [F.lit(f"{VERSION}\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n")]
    for name, value in headers:
        head += [F.lit(f"{name}: "), value, F.lit("\r\n")]
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
                    block, F.lit("\r\n\r"))  # the sink's line end completes the mark


def write_archives(pages: DataFrame, path: str) -> None:
    """Write three records per row of `pages(page_id, url, html)`."""
    html = text_or_empty("html")
    # Stored once: a row's number depends on how the input is split, so it may be taken from one read only.
    wide = written(pages.select(
        F.col("page_id").alias("_page"), F.monotonically_increasing_id().alias("_row"),
        F.coalesce("url", F.lit("about:blank")).alias("_url"), html.alias("_html"),
        F.sha2(F.encode(html, "UTF-8"), 256).alias("_sha"), F.octet_length(html).alias("_bytes")), "warc-rows")
    order = F.struct(F.col("_page").isNull().alias("none"), F.col("_page").alias("page"), F.col("_row").alias("row"))
    groups = written(wide.where(F.col("_bytes") >= MIN_REVISIT).groupBy("_sha").agg(
        F.count("*").alias("_n"), F.min(order).alias("_first")).where("_n > 1"), "warc-groups")
    rows = attach_groups(wide, groups, ["_sha"], "_n", wide.count())
    rows = rows.withColumn("_again", F.col("_n").isNotNull() & (F.col("_first.row") != F.col("_row")))
    rows = rows.withColumns({"_first_page": F.col("_first.page"), "_first_row": F.col("_first.row"),
                             "_head": F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                                               F.octet_length("_html").cast("string"), F.lit("\r\n\r\n"))})
    rid, target = _record_id("response", "_row", "_page"), F.regexp_replace("_url", r"[\r\n]", "")
    digest = F.concat(F.lit("sha256:"), F.col("_sha"))
    common = [("WARC-Target-URI", target)]
    response = _record("response", [("WARC-Record-ID", rid), *common, ("WARC-Payload-Digest", digest),
                                    ("Content-Type", F.lit("application/http; msgtype=response"))],
                       F.concat("_head", "_html"))
    revisit = _record("revisit", [("WARC-Record-ID", rid), *common, ("WARC-Payload-Digest", digest),
                                  ("WARC-Refers-To", _record_id("response", "_first_row", "_first_page")),
                                  ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                                  ("Content-Type", F.lit("application/http; msgtype=response"))], F.col("_head"))
    request = _record("request", [("WARC-Record-ID", _record_id("request", "_row", "_page")), *common,
                                  ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/http; msgtype=request"))],
                      F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record("metadata", [("WARC-Record-ID", _record_id("metadata", "_row", "_page")), *common,
                                    ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/warc-fields"))],
                       F.concat(F.lit("fetched-bytes: "), F.octet_length("_html").cast("string"), F.lit("\r\n")))
    records = rows.select(F.explode(F.array(F.when(F.col("_again"), revisit).otherwise(response), request, metadata)).alias("value"))
    records.write.option("lineSep", "\n").option("compression", "gzip").option(
        "maxRecordsPerFile", 3 * RECORDS_PER_FILE).mode("overwrite").text(path)


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of one archive, by their Content-Length."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8").split("\r\n")
        heads = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(heads["content-length"])
        block = view[end + 4:end + 4 + size]
        at = end + 8 + size
        yield {"heads": heads, "block": block}


def _read(batches, with_payload: bool, schema: pa.Schema):
    for batch in batches:
        for data in batch.column("content"):
            rows = {f.name: [] for f in schema}
            for r in parse_records(gzip.decompress(data.as_py())):
                h, kind = r["heads"], r["heads"]["warc-type"]
                block, http, fields, size, digest, payload = r["block"], None, None, None, None, None
                if kind == "metadata":
                    fields = bytes(block).decode("utf-8")
                else:
                    raw = bytes(block)
                    cut = raw.find(b"\r\n\r\n") + 4
                    http = raw[:cut].decode("utf-8")
                    if kind == "response":
                        body = block[cut:]
                        size, digest = len(body), hashlib.sha256(body).hexdigest()
                        payload = bytes(body) if with_payload else None
                    elif kind == "revisit":  # the payload is elsewhere; its size and digest are stated
                        size = next(int(x.split(":")[1]) for x in http.split("\r\n") if x.lower().startswith("content-length:"))
                        digest = h["warc-payload-digest"].partition(":")[2]
                for name, value in zip(rows, (kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"),
                                              h.get("warc-target-uri"), h.get("warc-date"), http, fields, size, digest, payload),
                                       strict=True):
                    rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=schema)


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives under `path`."""
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, types[t]) for n, t in (x.split() for x in RECORD.split(", "))])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(lambda batches: _read(batches, with_payload, schema), RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture. Of several requests to a response the smallest id counts."""
    fields = [c for c in records.columns if c != "type"]
    whole = F.struct(*fields)
    main = records.where("type IN ('response', 'revisit')").select(
        F.col("record_id").alias("_key"), F.col("type").alias("record_type"), whole.alias("response"))
    for kind, kept in (("request", ["record_id", "date", "http"]), ("metadata", ["record_id", "date", "fields"])):
        side = records.where(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("_key")).agg(
            F.min(F.struct(*kept)).alias(kind))
        main = main.join(side, "_key", "left")
    return main.drop("_key")


def capture_report(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives, read them back, and give one row per page."""
    spark = pages.sparkSession
    if path is None:
        import uuid

        path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    records = written(read_records(spark, path).drop("payload"), "warc-records")
    return transactions(records).select(
        page_of(F.col("response.record_id")).alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), "record_type",
        page_of(F.col("response.refers_to")).alias("refers_to"),
        F.col("request").isNotNull().alias("has_request"), F.col("metadata").isNotNull().alias("has_metadata"))

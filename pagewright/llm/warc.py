"""WARC archives: pages written as request, response or revisit, and metadata records; records read and assembled.

Spark's text writer makes the files: a record is one row and the two line ends that close a record are the line
separator, so writes are committed atomically on any file system. Reading takes whole files, whose size the number of
records in a file bounds, and follows each record's Content-Length, so a payload may hold any bytes.

A capture's request and metadata records name the response in WARC-Concurrent-To. Assembly joins on that identifier
and gives one nested row per capture. Revisits of a capture are joined to the response that they refer to.

Defined cases: a null payload is empty; a null url gives no target header; control characters in header values are
percent-encoded; of rows with equal page ids the first by digest and url counts as the smaller one; null page ids come
last; extra columns are ignored; an empty table gives empty archives and no captures. A metadata record that names the
request is followed to the request's response; a capture without request or metadata has null there.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END = "\r\n\r\n"
MIN_REVISIT_BYTES = 100
RECORD_SCHEMA = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, content_type string, headers map<string,string>, payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(kind: str) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.col("copy").cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column | str, record_id: Column, content_type: str, block: Column, *more: Column) -> Column:
    """Text of one record; `more` are header lines, null where absent."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), *more, F.lit(f"Content-Type: {content_type}")]
    return F.concat(F.concat_ws("\r\n", *head, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit(END), block)


def write_warc(pages: DataFrame, out: str, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", records_per_file: int = 12_000) -> None:
    """Write three records per page. Of pages with equal payloads of MIN_REVISIT_BYTES or more, all but the least id are revisits."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    # Null ids share a key that no id has, so that both sides below stay partitioned by one column and payloads move once.
    rows = rows.withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    number = F.row_number().over(Window.partitionBy("key").orderBy("digest", F.col("url").asc_nulls_last()))
    light = rows.select("key", "page_id", "url", "digest", "size").withColumn("copy", number).withColumn("rank", F.struct(F.col("page_id").isNull().alias("none"), "page_id", "copy"))
    repeated = light.filter(F.col("size") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("rank").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    revisits = light.join(repeated, "digest").filter("rank != first").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("copy", "first"))).alias("firsts"))
    rows = rows.withColumn("copy", number).join(revisits, "key", "left").withColumn("first", F.try_element_at("firsts", "copy")).withColumn("revisit", F.col("first").isNotNull())
    response = _urn("response")
    first = F.struct(F.col("first.page_id").alias("page_id"), F.col("first.copy").alias("copy"))
    referred = F.regexp_replace(F.md5(F.concat_ws("|", F.lit("response"), F.coalesce(first["page_id"].cast("string"), F.lit("null")), first["copy"].cast("string"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    clean = F.col("url")
    for c in range(32):
        clean = F.replace(clean, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    uri = F.concat(F.lit("WARC-Target-URI: "), clean)
    when, of = F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Concurrent-To: "), response)
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    path = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(clean, F.lit("")), "^[a-zA-Z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract(F.coalesce(clean, F.lit("")), "^[a-zA-Z]+://([^/?#]*)", 1)
    records = F.array(
        _record("request", _urn("request"), "application/http;msgtype=request", F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)), when, uri, of),
        _record(
            F.when(F.col("revisit"), "revisit").otherwise("response"), response, "application/http;msgtype=response", F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("payload"))), when, uri, digest,
            F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: <urn:uuid:"), referred, F.lit(f">\r\nWARC-Profile: {REVISIT_PROFILE}"))),
        ),
        _record("metadata", _urn("metadata"), "application/warc-fields", F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")), when, uri, of),
    )
    lines = rows.select(F.explode(records).alias("value"))
    lines.write.mode("overwrite").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(out)


def parse(content: bytes) -> Iterator[dict]:
    """Records of one archive, gzip-compressed as a whole or by record, or plain."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while (at := content.find(b"WARC/", at)) >= 0:
        stop = content.index(b"\r\n\r\n", at)
        head = {}
        for line in content[at:stop].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        size = int(head.get("content-length", "0"))
        block = content[stop + 4 : stop + 4 + size]
        at = stop + 4 + size
        payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
        yield {
            "record_id": head.get("warc-record-id"), "type": head.get("warc-type"), "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"),
            "date": head.get("warc-date"), "payload_digest": head.get("warc-payload-digest"), "content_type": head.get("content-type"), "headers": list(head.items()), "payload": payload,
        }


ARROW = pa.schema([(c, pa.string()) for c in ("record_id", "type", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest", "content_type")] + [("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for row in parse(content.as_py() or b""):
                rows.append(row)
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ARROW)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(_parse, RECORD_SCHEMA)


def summarise(records: DataFrame) -> DataFrame:
    """Records without their payloads: size and digest take their place, and the text of metadata records."""
    fields = F.when(F.col("type") == "metadata", F.col("payload").cast("string"))
    return records.select("record_id", "type", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"), fields.alias("fields"))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, type, target_uri, date, refers_to, payload_bytes, payload_digest (of the full
    payload; of a revisit, those of the response it refers to), request and metadata structs."""
    more = ["payload"] if "payload" in records.columns else []
    if "digest" not in records.columns:
        records = records.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256), "fields": F.when(F.col("type") == "metadata", F.col("payload").cast("string"))})
    digest = F.when(F.col("type") == "revisit", F.element_at(F.split("payload_digest", ":"), -1)).otherwise(F.col("digest"))
    captured = records.filter(F.col("type").isin("response", "revisit")).select("record_id", "type", "target_uri", "date", "refers_to", digest.alias("digest"), "size", *more)
    request = records.filter("type = 'request'").select("concurrent_to", "record_id", F.struct("record_id", "target_uri").alias("request"))
    fields = records.filter("type = 'metadata'").select("concurrent_to", F.struct("record_id", "fields").alias("metadata"))
    via = request.select(F.col("record_id").alias("concurrent_to"), F.col("concurrent_to").alias("through"))
    fields = fields.join(via, "concurrent_to", "left").select(F.coalesce("through", "concurrent_to").alias("record_id"), "metadata")
    one = lambda df, c: df.groupBy("record_id").agg(F.min(c).alias(c))  # noqa: E731  of several, that of the least identifier
    request = one(request.select(F.col("concurrent_to").alias("record_id"), "request"), "request")
    captures = captured.join(request, "record_id", "left").join(one(fields, "metadata"), "record_id", "left")
    # A response stands for itself here: without a key of its own, all responses would meet in one task.
    full = captured.filter("type = 'response'").groupBy(F.col("record_id").alias("_to")).agg(F.min("size").alias("full_size"))
    return captures.withColumn("_to", F.coalesce("refers_to", "record_id")).join(full, "_to", "left").select(
        "record_id", "type", "target_uri", "date", "refers_to", F.when(F.col("type") == "revisit", F.col("full_size")).otherwise(F.col("size")).alias("payload_bytes"), F.col("digest").alias("payload_digest"), "request", "metadata", *more
    )


def page_id(metadata: Column) -> Column:
    return F.nullif(F.regexp_extract(metadata["fields"], r"page-id: (-?\d+)", 1), F.lit("")).cast("long")

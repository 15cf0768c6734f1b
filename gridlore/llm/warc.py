"""WARC archives written and read by Spark's own text files, and transactions put together from their records."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, table, written
from .exact_dedup import flagged

END = "\r\n\r\n"
MIN_REVISIT_BYTES = 100
_FIXED_DATE = "2024-01-01T00:00:00Z"
_RECORD = "file string, record_id string, warc_type string, target_uri string, concurrent_to array<string>, refers_to string, payload_digest string, block_length long, payload_length long, payload_sha256 string, block binary"


def record(kind: Column, record_id: Column, uri: Column, content_type: str, block: Column, concurrent_to: Column | None = None, more: dict[str, Column] | None = None) -> Column:
    """One record as text, without the CRLF CRLF that ends it (the writer's line separator)."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    safe = F.regexp_replace(uri, r"[\x00-\x20]", "%20")
    parts = [F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", record_id), line("WARC-Date", F.lit(_FIXED_DATE)), line("WARC-Target-URI", safe)]
    if concurrent_to is not None:
        parts.append(line("WARC-Concurrent-To", concurrent_to))
    parts += [line(name, value) for name, value in (more or {}).items()]
    parts += [line("Content-Type", F.lit(content_type)), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block]
    return F.concat(*parts)


def write_archives(records: DataFrame, path: str) -> None:
    """records (one column, each a record's text) as gzip WARC files, one a partition, by Spark's committed writer."""
    records.write.option("compression", "gzip").option("lineSep", END).text(path)


def read_archives(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """The records of gzip archives under path, in columns of _RECORD.

    Spark's reader streams a compressed file to one task in pieces that end in CRLF CRLF; the pieces are joined again and
    cut by Content-Length, so blocks may hold any bytes, and a task holds one record at a time. block is the payload of
    responses only with keep_payload. For revisits payload_length comes from the HTTP head they keep.

    What is no whole record (no WARC line, no Content-Length, a block cut short or not followed by CRLF CRLF) is an error that names
    the file; nothing is left out. An empty folder gives an empty result.
    """
    end = END.encode()

    def parse(batches):
        file, buf, out = None, bytearray(), []

        def flush():
            cols = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, schema=kinds)

        def records():
            while True:
                blank = len(buf) - len(buf.lstrip(b"\r\n"))  # the separator put back after a file's last piece may not be the file's
                del buf[:blank]
                head_end = buf.find(end)
                if head_end < 0:
                    return
                fields: dict[str, list[str]] = {}
                first, *lines = bytes(buf[:head_end]).decode("utf-8", "replace").split("\r\n")
                for row in lines:
                    name, _, value = row.partition(":")
                    fields.setdefault(name.strip().lower(), []).append(value.strip())
                said = fields.get("content-length", [""])[0]
                if not first.startswith("WARC/") or not said.isdecimal():
                    raise ValueError(f"{file}: no WARC record begins at {first[:60]!r}")
                n = int(said)
                if len(buf) < head_end + 4 + n + 4:
                    return
                if buf[head_end + 4 + n : head_end + 8 + n] != end:
                    raise ValueError(f"{file}: the block of a record is not {n} bytes long")
                block = bytes(buf[head_end + 4 : head_end + 4 + n])
                del buf[: head_end + 8 + n]
                one = lambda name: fields.get(name, [None])[0]  # noqa: B023,E731
                kind, length, digest = one("warc-type"), None, None
                if kind in ("response", "revisit") and (one("content-type") or "").startswith("application/http"):
                    http, _, payload = block.partition(end)
                    if kind == "response":
                        length, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        block = payload if keep_payload else None
                    else:
                        said = [r.partition(b":")[2] for r in http.split(b"\r\n") if r.lower().startswith(b"content-length:")]
                        length = int(said[0]) if said else None
                out.append((file, one("warc-record-id"), kind, one("warc-target-uri"), fields.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-payload-digest"), n, length, digest, block))
                yield

        def whole():
            if buf:
                raise ValueError(f"{file}: {len(buf)} bytes at the end are no whole record")

        for b in batches:
            size = 0
            for name, piece in zip(b.column(0), b.column(1), strict=True):
                name = name.as_py()
                if name != file:
                    whole()
                    file = name
                buf += piece.as_py() + end
                for _ in records():
                    size += len(out[-1][-1] or b"") + 200
                    if size > 8_000_000:
                        yield flush()
                        size = 0
            if out:
                yield flush()
        whole()

    t = pa.string()
    kinds = pa.schema([("file", t), ("record_id", t), ("warc_type", t), ("target_uri", t), ("concurrent_to", pa.list_(t)), ("refers_to", t), ("payload_digest", t), ("block_length", pa.int64()), ("payload_length", pa.int64()), ("payload_sha256", t), ("block", pa.binary())])
    pieces = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary"))
    return pieces.mapInArrow(parse, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture (response, revisit or resource): the capture, its requests and its metadata.

    A request or metadata record belongs to the capture that its WARC-Concurrent-To names; metadata that names a request belongs
    to that request's capture. Requests and metadata are grouped by capture before the join, so rows that repeat a record id
    are kept, one output row each. Records that name no capture here are left out; captures without company keep empty arrays. No
    records give no rows; a null record id is a capture without company.
    """
    captures = records.where(F.col("warc_type").isin("response", "revisit", "resource"))
    others = records.where(F.col("warc_type").isin("request", "metadata")).select("record_id", "warc_type", "block", F.explode("concurrent_to").alias("to"))
    hops = others.where("warc_type = 'request'").groupBy(F.col("record_id").alias("to")).agg(F.min("to").alias("next"))
    others = others.join(hops, "to", "left").select("record_id", "warc_type", "block", F.coalesce("next", "to").alias("capture_id")).distinct()
    item = F.struct("record_id", "block")
    company = others.groupBy("capture_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("warc_type") == "request", item))).alias("requests"), F.array_sort(F.collect_list(F.when(F.col("warc_type") == "metadata", item))).alias("metadata")
    )
    none = F.array().cast("array<struct<record_id:string,block:binary>>")
    return captures.join(company, captures["record_id"] == company["capture_id"], "left").select(
        F.struct(*[F.col(c) for c in captures.columns]).alias("capture"), F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata")
    )


def page_records(pages: DataFrame) -> DataFrame:
    """The records of pages (page_id, url, html) as text, three a page: response or revisit, request, metadata.

    Payload: the html in UTF-8, null as empty. Of equal payloads of at least MIN_REVISIT_BYTES bytes the row with the smallest
    page_id is the response and rows with other ids revisit it; rows that repeat that page_id with the same payload are
    responses too. Only payload digests are grouped; only pages whose digest may repeat are shuffled. A null page_id never revisits and is
    revisited by none unless all copies lack one; a null url counts as about:blank; no pages give no records.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "n": F.octet_length("html")})
    repeated = rows.where(F.col("n") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    repeated = written(repeated, "repeated")
    rows = flagged(rows, repeated.select("digest"), "digest", "may_repeat")
    alone = rows.where("not may_repeat").withColumn("first_id", F.lit(None).cast("long"))
    joined = rows.where("may_repeat").join(repeated, "digest", "left").select(alone.columns)
    rows = alone.unionByName(joined)

    def urn(kind, page, digest):
        h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("none")), digest))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))

    again = F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    digest = {"WARC-Payload-Digest": F.concat(F.lit("sha256:"), "digest")}
    own, uri = urn("capture", F.col("page_id"), F.col("digest")), F.coalesce("url", F.lit("about:blank"))
    response = record(F.lit("response"), own, uri, "application/http; msgtype=response", F.concat(head, "html"), more=digest)
    revisit = record(F.lit("revisit"), own, uri, "application/http; msgtype=response", head, more={"WARC-Profile": F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), "WARC-Refers-To": urn("capture", F.col("first_id"), F.col("digest")), **digest})
    request = record(F.lit("request"), urn("request", F.col("page_id"), F.col("digest")), uri, "application/http; msgtype=request", F.concat(F.lit("GET "), F.regexp_replace(uri, r"[\x00-\x20]", "%20"), F.lit(" HTTP/1.1" + END)), own)
    fields = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")), F.when(again, F.concat(F.lit("refers-to-page-id: "), F.col("first_id").cast("string"), F.lit("\r\n"))).otherwise(""))
    metadata = record(F.lit("metadata"), urn("metadata", F.col("page_id"), F.col("digest")), uri, "application/warc-fields", fields, own)
    return rows.select(F.explode(F.array(F.when(again, revisit).otherwise(response), request, metadata)).alias("value"))


def op2_warc_transactions(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(page_records(table(spark, sf_dir, "pages")), path)
    rows = assemble(written(read_archives(spark, path), "records"))  # the archives are read once, not once for each side of a join
    about = F.col("metadata")[0]["block"].cast("string")
    number = lambda name: F.nullif(F.regexp_extract(about, rf"(?m)^{name}: (-?\d+)\r?$", 1), F.lit("")).cast("long")
    return rows.select(
        number("page-id").alias("page_id"), F.col("capture.payload_length").alias("payload_bytes"),
        F.coalesce("capture.payload_sha256", F.regexp_extract("capture.payload_digest", "sha256:(.*)", 1)).alias("payload_digest"), F.col("capture.warc_type").alias("record_type"), number("refers-to-page-id").alias("refers_to"),
    )


OP2_SQL = """
with p as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n from pages),
d as (select page_id, n, sha256(h) as g from p),
m as (select *, min(page_id) over (partition by g) as f from d)
select page_id, n as payload_bytes, g as payload_digest, case when n >= 100 and page_id <> f then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> f then f end as refers_to from m"""

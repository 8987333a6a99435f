"""WARC archives with revisit records.

Headers (page id, payload length and SHA-1) are shuffled by digest, with a partial aggregate first; of the
captures with one payload of at least ``least`` bytes, that with the largest id stays a response. Each capture is then
joined to its original. Archives are written by Spark's own text writer, whose line separator is the end of a WARC
record, so they go to any store that Spark reaches, a lost task leaves nothing behind, and every header is made anew. A
file's records are limited so that a task can read it whole; a record with a large payload gets a file of its own.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import col, map_arrow, shared_dir, stored

_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Records with a larger payload than this go to files of their own.
_LARGE = 1 << 20


def resolve_revisits(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, sizes: Observation | None = None
) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to and refers_to_url (null for a response), original (others refer to it).

    A null payload is an empty one, and payloads count whole. A capture without an id refers to the largest id of its payload, if there is one.
    Rows that repeat the largest id and its payload are all responses, as each is as much the original. An empty table gives no
    rows; other columns play no part, whatever their names. sizes observes n, bytes and largest of the payloads up to 1 MB.
    """
    payload = F.coalesce(col(html).cast("string"), F.lit("")).cast("binary")
    p = pages.select(
        col(page_id).cast("long").alias("page_id"),
        col(url).cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload).alias("payload_digest"),
    )
    heads = p.drop("payload")
    if sizes is not None:
        n = F.when(F.col("payload_bytes") <= _LARGE, F.col("payload_bytes"))
        heads = heads.observe(sizes, F.count(n).alias("n"), F.sum(n).alias("bytes"), F.max(n).alias("largest"))
    heads = heads.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
    first = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    originals = heads.agg(first.alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    originals = originals.select("payload_digest", "payload_bytes", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    originals = stored(originals)  # the planner sees its true size, and broadcasts it only below Spark's bound
    revisit = ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull()
    return p.join(originals, ["payload_digest", "payload_bytes"], "left").select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, F.col("first_id")).alias("refers_to"),
        F.when(revisit, F.col("first_url")).alias("refers_to_url"),
        (~revisit & F.col("first_id").isNotNull()).alias("original"),
    )


def _record_id(page_id: Column, digest: Column) -> Column:
    """The id of an original, which its revisits can tell."""
    h = F.md5(F.concat(page_id.cast("string"), F.lit(":"), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def _uri(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("urn:unknown")), r"[\x00-\x1F\x7F]+", "%0A"), " ", "%20")


def write_archives(
    resolved: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z", file_records: int = 2000, compression: str = "gzip", mode: str = "overwrite"
) -> None:
    """Writes one WARC 1.1 record per row of resolve_revisits(). Control characters and spaces in a URL are percent-encoded.

    Record ids are new at each run, but for an original's, which follows from its page id and payload, as its revisits refer to it.
    """
    c, eol = F.col, "\r\n"
    revisit = c("refers_to").isNotNull()
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(c("payload"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "),
        c("payload_bytes").cast("string"),
        F.lit(_END),
    )
    head = F.concat(
        F.lit(f"WARC/1.1{eol}WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{eol}WARC-Record-ID: <urn:uuid:"),
        F.when(c("original"), _record_id(c("page_id"), c("payload_digest"))).otherwise(F.uuid()),
        F.lit(f">{eol}WARC-Date: {date}{eol}WARC-Target-URI: "),
        _uri(c("url")),
        F.lit(f"{eol}WARC-Payload-Digest: sha1:"),
        c("payload_digest"),
        F.when(
            revisit,
            F.concat(
                F.lit(f"{eol}WARC-Profile: {_PROFILE}{eol}WARC-Refers-To: <urn:uuid:"),
                _record_id(c("refers_to"), c("payload_digest")),
                F.lit(f">{eol}WARC-Refers-To-Target-URI: "),
                _uri(c("refers_to_url")),
                F.lit(f"{eol}WARC-Refers-To-Date: {date}{eol}X-Refers-To-Page: "),
                c("refers_to").cast("string"),
            ),
        ).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit(f"{eol}X-Page: "), c("page_id").cast("string")), F.lit("")),
        F.lit(f"{eol}X-Payload-Length: "),
        c("payload_bytes").cast("string"),
        F.lit(f"{eol}Content-Type: application/http; msgtype=response{eol}Content-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"),
        F.lit(_END),
        http,
    )
    record = F.concat(head.cast("binary"), body).cast("string").alias("value")
    resolved.select(record).write.option("lineSep", _END).option("maxRecordsPerFile", file_records).option("compression", compression).mode(mode).text(path)


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, by Content-Length, so a payload may hold anything, also ends of records."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, f.read(int(head["content-length"]))


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = False) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisits).

    A response's payload is hashed again; a digest that differs from its header's fails the read.
    """
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    schema += ", payload binary" if with_payload else ""
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows: list[list] = [[] for _ in names]
                for head, block in _records(content.as_py()):
                    payload, digest = block.partition(b"\r\n\r\n")[2], head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{head['warc-record-id']}: the payload isn't that of its digest")
                    page, to = head.get("x-page"), head.get("x-refers-to-page")
                    values = (
                        int(page) if page else None,
                        head["warc-target-uri"],
                        int(head["x-payload-length"]),
                        digest,
                        head["warc-type"],
                        int(to) if to else None,
                        payload if head["warc-type"] == "response" else None,
                    )
                    for r, v in zip(rows, values, strict=False):
                        r.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=False)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return map_arrow(files, run, schema)


def records_per_file(n: int | None, size: int | None, largest: int | None, *, usual_bytes: int = 64 << 20, most_bytes: int = 512 << 20) -> int:
    """Records that make a file of about usual_bytes, and of at most most_bytes even if each were the largest."""
    return max(1, int(min(usual_bytes / ((size or 0) / n + 1000), most_bytes / (largest + 1000)))) if n else 1


def archive_pages(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Writes the pages' archives into path (a new shared folder by default) and reads them back.

    Payloads over 1 MB are written one to a file, so that they don't make the other files small, nor any file too large to be read in one task.
    """
    path = path or f"{shared_dir(pages.sparkSession)}/warc"
    sizes = Observation()
    resolved = resolve_revisits(pages, sizes=sizes, **columns)
    seen = sizes.get
    small = F.col("payload_bytes") <= _LARGE
    write_archives(resolved.where(small), path, file_records=records_per_file(seen["n"], seen["bytes"], seen["largest"]))
    large = pages.where(F.octet_length(F.coalesce(col(columns.get("html", "html")).cast("string"), F.lit(""))) > _LARGE)
    if not large.isEmpty():
        write_archives(resolved.where(~small), path, file_records=1, mode="append")
    return read_archives(pages.sparkSession, path)

"""WARC archives (operator 6): pages written as records, an index of offsets, and coalesced range reads.

Each task writes the pages it reads to one archive of its own (a gzip member per record) in a folder that all
executors share, and returns the index: file, offset, length, URL and digest per record. A task that runs again
writes another file, and the index, which is stored once, names only files of tasks that ended. Reading starts from
the index: selected records are sorted by file and offset, neighbours are coalesced into ranges of bounded size, and
each range is fetched with one read.

Of records with equal payloads of `min_bytes` or more, that with the largest page_id is the response and the others
revisit it. Payload groups are found by digest with map-side combining; payloads are never grouped or shuffled for it
unless the table of repeated payloads is too large to broadcast.

Defined results: a null html is an empty payload; repeated rows with the largest page_id of their payload are all
responses; a payload whose page_ids are all null is all responses; a null url has no target URI; only page_id, url
and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timespan.llm.common import SMALL_ROWS, shared_dir, small, stored, table, utf8

#: Ranges read at once, the gap between two records up to which they are read together, and what a task reads, about.
RANGE_BYTES, GAP_BYTES, TASK_BYTES = 8 << 20, 64 << 10, 32 << 20
#: Schemes that Hadoop has other names for.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}

_INDEX = "page_id long, url string, record_type string, refers_to long, path string, offset long, length long, payload_bytes long, payload_digest string"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(uri: str) -> tuple[FileSystem, str]:
    """The file system of a folder as Spark names it, and the path in it."""
    scheme, colon, rest = uri.partition("://")
    return FileSystem.from_uri(_SCHEMES.get(scheme, scheme) + colon + rest)


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, refers_url: str | None = None) -> bytes:
    """One WARC record as a gzip member. refers_to: None makes a response, else a revisit of that page (and URL) without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, and refers_to and refers_url, which are null for responses."""
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8("html").alias("payload"))
    read = read.withColumn("same", F.sha2("payload", 256))
    repeated = read.filter(F.octet_length("payload") >= min_bytes).groupBy("same").agg(F.max("page_id").alias("holder"), F.max_by("url", F.struct("page_id", "url")).alias("holder_url"), F.count(F.lit(1)).alias("n"))
    repeated = small(stored(repeated.filter("n > 1 and holder is not null").select(F.col("same").alias("same2"), "holder", "holder_url")), SMALL_ROWS // 4)
    joined = read.join(repeated, (F.col("same") == F.col("same2")) & (F.octet_length("payload") >= min_bytes), "left")
    revisit = ~F.col("page_id").eqNullSafe(F.col("holder"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("holder")).alias("refers_to"), F.when(revisit, F.col("holder_url")).alias("refers_url"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the pages to archives in folder (any place that all executors see) and returns the stored index."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, path = filesystem(f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        at = 0
        with fs.open_output_stream(path, compression=None) as out:
            for batch in batches:
                rows = []
                for cells in zip(*batch.columns, strict=True):
                    page_id, url, payload, refers_to, refers_url = (x.as_py() for x in cells)
                    digest = sha1_base32(payload)
                    member = record(page_id, url, payload, digest, refers_to, date, refers_url)
                    out.write(member)
                    rows.append((page_id, url, "response" if refers_to is None else "revisit", refers_to, path, at, len(member), len(payload), digest))
                    at += len(member)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3, pa.string()]
                columns = list(zip(*rows, strict=True)) or [()] * 9
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _INDEX.split(", ")])

    return stored(record_types(pages, min_bytes).mapInArrow(write, _INDEX))


def ranges(selected: DataFrame, range_bytes: int = RANGE_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The index rows to read, coalesced: path, start, end and the records' places. A range holds range_bytes and one record at most."""
    w = Window.partitionBy("path").orderBy("offset")
    end = F.col("offset") + F.col("length")
    far = F.coalesce((F.col("offset") - F.lag(end).over(w) > gap_bytes).cast("int"), F.lit(0))
    islands = selected.select("path", "offset", "length").distinct().withColumn("far", far).withColumn("island", F.sum("far").over(w))
    return islands.groupBy("path", "island", F.floor(F.col("offset") / range_bytes).alias("block")).agg(
        F.min("offset").alias("start"), F.max(end).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records")
    )


def read_records(selected: DataFrame, folder: str, **limits: int) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the selected index rows, from the archives."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, start, end, records in zip(*(batch.column(k) for k in range(4)), strict=True):
                first = start.as_py()
                with fs.open_input_file(path.as_py()) as file:
                    file.seek(first)
                    data = file.read(end.as_py() - first)
                rows = []
                for place in records.as_py():
                    at = place["offset"] - first
                    fields, http, payload = parse(data[at : at + place["length"]])
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response" and sha1_base32(payload) != digest:
                        raise ValueError(f"damaged record in {path.as_py()} at {place['offset']}")
                    page, refers = (int(fields[x]) if x in fields else None for x in ("X-Page-Id", "X-Refers-To-Page-Id"))
                    rows.append((page, len(payload) if kind == "response" else int(http["Content-Length"]), digest, kind, refers))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # ranges are of bounded size, so dealing them out one by one balances the bytes of the tasks, however small the index is
    size = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-size // TASK_BYTES), selected.sparkSession.sparkContext.defaultParallelism)
    planned = ranges(selected, **limits).select("path", "start", "end", "records").repartition(int(tasks))
    return planned.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Every page through an archive and back."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    back = stored(read_records(index, folder))
    remove(spark, folder)
    return back


ORACLE_SQL = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
     bits AS (SELECT page_id, i, ('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4)) & 31 AS v FROM d, range(32) r(i)),
     b32 AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v::INT + 1, 1), '' ORDER BY i) AS payload_digest FROM bits GROUP BY page_id),
     top AS (SELECT body, max(page_id) AS holder FROM d GROUP BY body)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM d JOIN b32 USING (page_id) JOIN top USING (body)
"""

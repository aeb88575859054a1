"""WARC archives: written with an index, then read back through coalesced byte ranges.

Writing: each task writes its pages as one ``.warc.gz`` file (one gzip member per record,
as the format asks) into the archive folder and emits an index row per record: page, URL,
digest, file, offset and length. Files are named by task attempt and the index is stored by
Spark's own commit, so a lost executor's half-written file is never referred to.

Deduplication is by payload: of records with equal payloads of at least ``min_dedup`` bytes,
the one with the largest page id is a ``response`` and the others are ``revisit`` records
(identical-payload-digest profile), which keep the HTTP headers and refer to it. Equal
payloads are found on narrow rows (digest, page id): the maximum per digest is partially
aggregated before the shuffle, so many copies of one payload do not gather in a task.

Reading: the selected records' index rows are sorted by file and offset, ranges with small
gaps are coalesced into reads of bounded size, and each read is one row of work.

The archive folder must be one that all executors share: by default it is in the folder of
``spark.checkpoint.dir``. Python opens it through pyarrow's file systems (local or mounted
paths, hdfs, s3, gs); only Spark's readers touch the input tables.

Defined results: a null html is an empty payload; empty payloads are never revisits unless
``min_dedup`` is 0; a null URL is written as ``urn:pageframe:none`` and read back as null;
repeated page ids each give a record, judged by its own payload (a revisit refers to the id, and
rows that share the largest id are all responses); a null page id is below all others, is written as ``none`` and
read back as null, and rows of which none has an id are all responses; columns other than
id, URL and html are ignored, whatever their names; an empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import _text

MIN_DEDUP = 1000
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
#: Revisits (id, digest, id: some 100 bytes each) are broadcast up to this number, joined by a shuffle beyond it.
BROADCAST_ROWS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URL = "urn:pageframe:none"
NO_ID = "none"
DATE = "1970-01-01T00:00:00Z"
LEVEL = 3

INDEX = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
])


def filesystem(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One gzip member with a whole WARC/1.1 record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:pageframe:page:{NO_ID if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url if url is not None else NO_URL).translate({10: '%0A', 13: '%0D'})}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:pageframe:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers, HTTP header block and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def decided(pages: DataFrame, min_dedup: int = MIN_DEDUP) -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses)."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    strong = F.sha2(F.encode("html", "UTF-8"), 256)
    keyed = source.where(F.octet_length("html") >= min_dedup).select("page_id", strong.alias("strong"))
    groups = keyed.groupBy("strong").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 and response is not null").select("strong", "response")
    # revisits only: few and narrow, one row for each id and payload
    revisits = keyed.join(groups, "strong").where("not page_id <=> response").select(F.col("page_id").alias("id"), "strong", F.col("response").alias("refers_to")).distinct()
    revisits = _text.stored(revisits, "revisits")
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    marked = source.withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "own": strong})
    return marked.join(revisits, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("strong")), "left").drop("id", "own", "strong")


def write(pages: DataFrame, folder: str, min_dedup: int = MIN_DEDUP) -> DataFrame:
    """Write the archive into ``folder``/data and its index, returned, into ``folder``/index."""
    spark = pages.sparkSession
    rows = decided(pages, min_dedup).select("page_id", "url", "html", "digest", "refers_to")

    def run(batches):
        fs, base = filesystem(f"{folder}/data")
        fs.create_dir(base, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for b in _text.pieces(batches, 2):
            ids, urls, digests, refs = (b.column(i).to_pylist() for i in (0, 1, 3, 4))
            index = []
            if out is None:
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            for i, html in enumerate(b.column(2).to_pylist()):
                raw = record(ids[i], urls[i], html.encode(), digests[i], refs[i])
                out.write(raw)
                index.append((ids[i], urls[i], digests[i], "response" if refs[i] is None else "revisit", name, at, len(raw)))
                at += len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), (pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64()), strict=True)], names=INDEX.names)
        if out is not None:
            out.close()

    rows.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


_RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()),
])


def read(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of the given index rows, read from the archive; digests are verified.

    A file is cut into blocks of ``READ_BYTES``, the key of the grouping, so one huge file is
    many groups; in a block, records less than ``GAP_BYTES`` apart share a read. Revisits have no payload of their own; its length is that in the HTTP headers they keep.
    """
    grouped = index.select("file", F.floor(F.col("offset") / READ_BYTES).alias("block"), "offset", "length").groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"))

    def run(batches):
        fs, base = filesystem(f"{folder}/data")
        for b in batches:
            files, records = b.column(0).to_pylist(), b.column(2).to_pylist()
            for name, wanted in zip(files, records, strict=True):
                with fs.open_input_file(f"{base}/{name}") as source:
                    rows = [_row(raw, payload) for raw in _ranges(source, [(r["offset"], r["length"]) for r in wanted])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=_RECORD.names)

    return grouped.mapInArrow(run, _RECORD)


def coalesce(wanted: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[list[tuple[int, int]]]:
    """Sorted (offset, length) in groups to read at once: small gaps, bounded size."""
    group: list[tuple[int, int]] = []
    for offset, length in sorted(wanted):
        if group and (offset - sum(group[-1]) > gap or offset + length - group[0][0] > most):
            yield group
            group = []
        group.append((offset, length))
    if group:
        yield group


def _ranges(source, wanted: list[tuple[int, int]]) -> Iterator[bytes]:
    for group in coalesce(wanted):
        start = group[0][0]
        raw = memoryview(source.read_at(sum(group[-1]) - start, start))
        for offset, length in group:
            yield zlib.decompress(raw[offset - start : offset - start + length], 31)


def _row(raw: bytes, keep: bool) -> tuple:
    fields, http, payload = parse(raw)
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    named = lambda name: fields[name].rpartition(":")[2].rstrip(">") if name in fields else NO_ID
    page = lambda name: None if (x := named(name)) == NO_ID else int(x)
    size = int(http.rpartition(b"Content-Length: ")[2])
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record of page {page('WARC-Record-ID')}")
    url = fields["WARC-Target-URI"]
    return page("WARC-Record-ID"), None if url == NO_URL else url, size, digest, kind, page("WARC-Refers-To"), payload if keep and kind == "response" else None


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _text.scratch(spark, "warc")
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(index, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM d
"""

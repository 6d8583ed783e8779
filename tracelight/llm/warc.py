"""Web archives: one gzip member per record, and a reader that splits archives by byte ranges.

A reading task scans its range for the gzip magic number, accepts a candidate only if the member
decodes to a WARC header, and owns the records that start inside the range; the last of them may end
beyond it. Archives lie in a folder that all executors reach, named by a path or URI.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.llm.common import stored
from tracelight.session import shared_directory

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
SMALLEST_SHARED = 100
DATE = "2000-01-01T00:00:00Z"


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(kind: str, page: int | None, url: str | None, refers_to: int | None, payload: bytes, digest: str) -> bytes:
    """A WARC record as one gzip member; a revisit keeps the response header and leaves the payload out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def classified(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page, url, payload, digest, kind, refers_to: equal payloads of some size share one response."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    own = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    large = own.where(F.octet_length("payload") >= SMALLEST_SHARED)
    first = large.groupBy("digest").agg(F.min("page").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1 AND low IS NOT NULL")
    both = own.join(first.select("digest", "low"), "digest", "left")
    other = F.col("low").isNotNull() & ~F.col("page").eqNullSafe(F.col("low"))
    return both.select(
        "page", "url", "payload", "digest", F.when(other, "revisit").otherwise("response").alias("kind"),
        F.when(other, F.col("low")).alias("refers_to"),
    )


def write(rows: DataFrame, folder: str) -> DataFrame:
    """(path, bytes, records) of the archives written, one per partition.

    A task writes under a name of its own and renames at its end, so a repeated task replaces its archive.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        system, path = filesystem(name)
        system.create_dir(os.path.dirname(path), recursive=True)
        draft, size, count = f"{path}.{uuid.uuid4().hex}", 0, 0
        with system.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    page, low = (None if pd.isna(v) else int(v) for v in (row.page, row.refers_to))
                    member = record(row.kind, page, row.url, low, bytes(row.payload), row.digest)
                    out.write(member)
                    size, count = size + len(member), count + 1
        system.move(draft, path)
        yield pd.DataFrame({"path": [name], "bytes": [size], "records": [count]})

    return rows.mapInPandas(run, "path string, bytes long, records long")


def ranges(archives: DataFrame, split_bytes: int) -> DataFrame:
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    cut = archives.select("path", "bytes", starts.alias("start"))
    return cut.select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("stop"))


def member(source, at: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at a position, or None if there is no whole WARC record."""
    source.seek(at)
    unpack, parts, used = zlib.decompressobj(31), [], 0
    try:
        while not unpack.eof:
            data = source.read(CHUNK)
            if not data:
                return None
            parts.append(unpack.decompress(data))
            used += len(data)
            if sum(map(len, parts[:2])) >= 7 and not b"".join(parts[:2]).startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    whole = b"".join(parts)
    return (whole, at + used - len(unpack.unused_data)) if whole.startswith(b"WARC/1.") else None


def scan(source, start: int, stop: int) -> Iterator[bytes]:
    """Whole records whose gzip member starts in [start, stop)."""
    at, known = start, b""
    begin = start  # position of known[0]
    while at < stop:
        found = known.find(MAGIC, at - begin)
        if found < 0:
            at = max(at, begin + len(known) - len(MAGIC) + 1)
            begin = at
            source.seek(at)
            known = source.read(CHUNK)
            if len(known) < len(MAGIC):
                return
            if known.find(MAGIC) < 0:
                at = begin + len(known) - len(MAGIC) + 1
                known, begin = b"", at
            continue
        at = begin + found
        if at >= stop:
            return
        read = member(source, at)
        if read is None:
            at += 1
            continue
        yield read[0]
        at = read[1]


def parsed(content: bytes) -> tuple[int | None, str, int | None, str, bytes]:
    """page, kind, refers_to, digest named in the header, payload."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = [x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]]
    fields = {k.strip().lower(): v.strip() for k, _, v in lines}
    page, low = (fields.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("warc-record-id", "warc-refers-to"))
    payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    return int(page) if page else None, fields["warc-type"], int(low) if low else None, digest, payload


def read_archives(archives: DataFrame, split_bytes: int = 16 << 20, payloads: bool = False) -> DataFrame:
    """Records of the archives (path, bytes): page_id, record_type, refers_to, named_digest, payload_bytes,
    payload_digest and, if asked for, the payload itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, stop in zip(batch["path"], batch["start"], batch["stop"]):
                system, name = filesystem(path)
                rows = []
                with system.open_input_file(name) as source:
                    for content in scan(source, start, stop):
                        page, kind, low, digest, payload = parsed(content)
                        own = (page, kind, low, digest, len(payload), hashlib.sha256(payload).hexdigest())
                        rows.append((*own, payload) if payloads else own)
                        if len(rows) >= 256:
                            yield frame(rows)
                            rows = []
                yield frame(rows)

    names = ["page_id", "record_type", "refers_to", "named_digest", "payload_bytes", "payload_digest", *["payload"] * payloads]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, record_type string, refers_to long, named_digest string, payload_bytes long, payload_digest string"
    cut = ranges(archives, split_bytes)
    tasks = archives.agg(F.sum(F.greatest(F.ceil(F.col("bytes") / split_bytes), F.lit(1)))).first()[0] or 1
    # A stated number of partitions stays as it is: rows are few and short, the bytes they stand for are not.
    return cut.repartition(int(tasks)).mapInPandas(run, schema + ", payload binary" * payloads)


def round_trip(
    spark: SparkSession,
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    split_bytes: int = 16 << 20,
) -> DataFrame:
    """Writes a record per page, reads the archives back and resolves revisits: one row per page.

    Null html is empty; a null url has no target; pages with a null id revisit a response with an id
    if there is one; rows that repeat a response's id and payload are responses too; an empty table
    gives no record; other columns are not read.
    """
    folder = shared_directory(spark, "warc")
    archives = stored(write(classified(pages, id_col, url_col, html_col), folder), "warc-archives")
    records = stored(read_archives(archives, split_bytes), "warc-records")
    full = records.where("record_type = 'response'").select(
        F.col("page_id").alias("low"), F.col("payload_digest").alias("full_digest"), F.col("payload_bytes").alias("full_bytes")
    )
    same = (F.col("refers_to") == F.col("low")) & (F.col("named_digest") == F.col("full_digest"))
    both = records.join(full.distinct(), same, "left")
    revisit = F.col("record_type") == "revisit"
    return both.select(
        F.col("page_id").alias(id_col),
        F.when(revisit, F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("full_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )

"""WARC archives as a table of chunks.

Pages are written to WARC 1.1 files in the shared folder, each file by one task and
each record as a gzip member of its own. Archives are read back as rows (record_id, chunk_no, body, running digest), a
chunk at a time, so a payload of any length passes without ever being held
whole; each chunk carries the SHA-256 of the payload up to its end, and the last
chunk that of all of it.

Of records with equal payloads the one of the smallest page_id is a response and
the others are revisits of it without a block of their own.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buswright.llm.common import looked_up, materialise, scratch, slices, table

#: Payloads of fewer bytes are always responses.
LEAST_REVISIT = 100
CHUNK = 1 << 16
#: Revisits up to this many are sent to all tasks (some 50 MB); more are joined by a shuffle of the pages.
BROADCAST_REVISITS = 400_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "archive string, record_id string, page_id long, url string, record_type string, refers_to long, chunk_no int, body binary, digest string, bytes_so_far long, declared_bytes long, declared_digest string, is_last boolean"


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store that a path names and the path in it; without a scheme it is a local one."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def record_plan(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to: a row for each of ``pages``.

    Digests are computed once and only they are grouped: a payload that a third of
    all pages share is one row a task before the shuffle. Null html is an empty
    payload. Of equal payloads with equal page_ids all rows are responses; a page
    without page_id is a response. Other columns are left out, whatever their names.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("html")).withColumn("payload_bytes", F.length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    slim = materialise(rows.select("page_id", "payload_bytes", "payload_digest"), "warc-digests")
    long = slim.where(F.col("payload_bytes") >= least)
    first = long.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # copies alone are joined: a row each of two numbers and a digest, not the pages
    revisits = looked_up(long, first, ["payload_digest"], "copies", slim.count()).where("page_id > refers_to")
    revisits = revisits.select("page_id", "payload_digest", "refers_to").distinct()
    revisits = materialise(revisits, "warc-revisits")
    few = revisits.count() <= BROADCAST_REVISITS
    return rows.join(F.broadcast(revisits) if few else revisits, ["page_id", "payload_digest"], "left").select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> tuple[bytes, bytes]:
    """A record's head, and its block without the payload's end.

    A record's name is made from its page_id, so a task that runs again writes the
    same bytes.
    """
    revisit = refers_to is not None
    block_bytes = len(_HTTP) + (0 if revisit else len(payload))
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {urllib.parse.quote(url or f'page:{page_id}', safe=''':/?#[]@!$&'()*+,;=%''')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {block_bytes}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + _HTTP, b"" if revisit else payload


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """Write ``plan`` to WARC files in ``folder``; returns their manifest: path, records, bytes.

    A task writes under a name of its own and moves the whole file to its place, so
    a task that is lost or runs twice leaves one good file. The manifest is a
    written table and names the files that count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, base = _file_system(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{context.partitionId():06d}-{uuid.uuid4().hex}"
        records = 0
        with store.open_output_stream(f"{name}.open", buffer_size=1 << 20) as out:
            for part in slices(batches, "html"):
                for page_id, url, html, digest, refers_to in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to")), strict=True):
                    head, payload = record(page_id, url, html, digest, refers_to)
                    member = zlib.compressobj(wbits=31)
                    out.write(member.compress(head))
                    for at in range(0, len(payload), CHUNK):
                        out.write(member.compress(payload[at : at + CHUNK]))
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    records += 1
            size = out.tell()
        if records:
            store.move(f"{name}.open", f"{name}.warc.gz")
            at = name if base == folder else folder.rstrip("/") + "/" + name.rpartition("/")[2]
            yield pa.RecordBatch.from_pydict({"path": [f"{at}.warc.gz"], "records": [records], "bytes": [size]})
        else:
            store.delete_file(f"{name}.open")

    return materialise(plan.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def _head(stream: io.BufferedIOBase) -> dict[str, str] | None:
    """The named fields of the next record; None at the archive's end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    fields: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("a record head has no end")
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def stream_chunks(stream: io.BufferedIOBase, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of ``CHUNKS`` but for the archive, of all records of one archive, holding one chunk at a time."""
    while (fields := _head(stream)) is not None:
        left = int(fields["content-length"])
        if "msgtype=response" in fields.get("content-type", ""):
            # the HTTP head is small and goes before the payload
            while left:
                line = stream.readline(left)
                left -= len(line)
                if not line or line in (b"\r\n", b"\n"):
                    break
        number = lambda name: int(fields[name]) if name in fields else None
        about = (fields.get("warc-record-id", ""), number("x-page-id"), fields.get("warc-target-uri"), fields.get("warc-type"), number("x-refers-to-page-id"))
        declared = (number("x-payload-length"), fields.get("warc-payload-digest", "").removeprefix("sha256:") or None)
        digest, seen, no = hashlib.sha256(), 0, 0
        while True:
            body = stream.read(min(chunk, left))
            if len(body) < min(chunk, left):
                raise ValueError(f"record {about[0]} is cut short")
            left, seen = left - len(body), seen + len(body)
            digest.update(body)
            yield (*about, no, body, digest.hexdigest(), seen, *declared, left == 0)
            no += 1
            if not left:
                break


def read_archives(spark: SparkSession, manifest: DataFrame, chunk: int = CHUNK, with_bodies: bool = True) -> DataFrame:
    """The chunk table of the archives that ``manifest`` names; an empty payload is one empty chunk."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = pa.schema([("archive", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("body", pa.binary()), ("digest", pa.string()), ("bytes_so_far", pa.int64()), ("declared_bytes", pa.int64()), ("declared_digest", pa.string()), ("is_last", pa.bool_())])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.field(i).type) for i, c in enumerate(zip(*rows, strict=True))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = _file_system(path)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20)) as packed_, io.BufferedReader(packed_, 1 << 18) as stream:
                    for row in stream_chunks(stream, chunk):
                        held += len(row[6])
                        rows.append((path, *(row if with_bodies else (*row[:6], None, *row[7:]))))
                        if held >= 1 << 22 or len(rows) >= 2_000:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    files = manifest.select("path")
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(run, CHUNKS)


def records(chunks: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """One row a record of a chunk table: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are those of its last chunk and must be what its
    head declares; a revisit has what its head declares. With ``manifest`` the
    records read of each archive must be as many as were written, so that an archive cut
    at a record's end is an error. Repeated pages are records of their own, an
    empty payload is one empty chunk, and a table without chunks has no records.
    """
    last = chunks.where("is_last")
    response = F.col("record_type") == "response"
    good = (F.col("digest") == F.col("declared_digest")) & (F.col("bytes_so_far") == F.col("declared_bytes"))
    digest = F.when(~response, F.col("declared_digest")).when(good, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its head: "), F.col("record_id"))))
    out = last.select("archive", "page_id", F.when(response, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
    if manifest is not None:
        out = materialise(out, "warc-records")
        read = out.groupBy("archive").agg(F.count(F.lit(1)).alias("read"))
        short = manifest.select(F.col("path").alias("archive"), "records").join(read, "archive", "left").where("records != coalesce(read, 0)")
        for bad in short.limit(1).collect():
            raise ValueError(f"{bad.archive} has {bad.read or 0} records, not the {bad.records} of its manifest")
    return out.drop("archive")


def op6_warc_chunks(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(record_plan(table(spark, sf_dir, "pages")), scratch(spark, "warc"))
    return records(read_archives(spark, manifest, with_bodies=False), manifest)


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""

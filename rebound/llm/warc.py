"""WARC archives: write, normalise, index, read back (operator 8).

Pages are written where they are read, as WARC response records into archives
of one gzip stream each, the form that cannot be entered in the middle.  The
normaliser inflates such a stream once, from front to back, and rewrites every
record as a gzip member of its own, noting each member's offset and length in
an index file beside the archive.  Reading then goes by the index: one member
at a time.

Files lie in the shared folder.  A task writes under a name that no other
attempt uses and reports it only when the file is closed; the report is
checkpointed before the next step reads it, so a lost executor or a repeated
task leaves at most files that nobody reads.

Equal payloads of at least ``least`` bytes are kept once: the record of the
smallest page id stays the response, the normaliser turns the others into
revisits that name it.  That is settled between the two steps on the digests
that writing reported, so payloads are never shuffled.

Edge cases: a null html is the empty payload; pages without id, and those that
share the smallest id, stay responses; a null url is written as the id's own
name; blanks and control characters in urls are escaped; long pages are one
record; an empty table writes nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebound.llm.words import utf8
from rebound.session import checkpoint_dir, materialize

#: Bytes of records after which a new archive is begun.
ARCHIVE_BYTES = 64 << 20
#: Payloads under so many bytes are always written in full.
LEAST_REVISIT = 100
_END = b"\r\n\r\n"
# Terms of the public archive format.
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def response(page_id, url, payload: bytes, digest: str) -> bytes:
    """One WARC response record."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}"
    lines = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Target-URI: {target}",
             f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def as_revisit(data: bytes, refers_to) -> bytes:
    """A response record without its payload, naming the record that has it."""
    head, _, block = data.partition(_END)
    http = block[:block.find(_END) + len(_END)]
    lines = [x for x in head.decode().split("\r\n") if not x.startswith(("WARC-Type:", "Content-Length:"))]
    lines += ["WARC-Type: revisit", f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_REVISIT_PROFILE}", f"Content-Length: {len(http)}"]
    return "\r\n".join(lines).encode() + _END + http + _END


def headers(head: bytes) -> dict[str, str]:
    """Fields of a header block (names in lower case), its first line under the empty name."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return {"": first} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def inflate(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Raw bytes of a gzip file read in pieces, whether it is one member or many."""
    z = zlib.decompressobj(31)
    for piece in pieces:
        while piece:
            out = z.decompress(piece)
            if out:
                yield out
            piece = z.unused_data if z.eof else b""
            if z.eof:
                z = zlib.decompressobj(31)


def split_records(raw: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """(headers, whole record) of a stream of records, holding one record at a time."""
    held = bytearray()

    def fill(until) -> bool:
        while not until():
            piece = next(raw, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(lambda: held.find(_END) >= 0):
        body = held.find(_END) + len(_END)
        h = headers(bytes(held[:body - len(_END)]))
        size = body + int(h["content-length"]) + len(_END)
        if not h[""].startswith("WARC/") or not fill(lambda: len(held) >= size):
            raise ValueError("damaged archive")
        yield h, bytes(held[:size])
        del held[:size]
    if held.strip():
        raise ValueError("archive ends inside a record")


def _pieces(stream, size: int = 1 << 20) -> Iterator[bytes]:
    while piece := stream.read(size):
        yield piece


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _new(base: str, kind: str) -> str:
    return f"{base}/{kind}-{uuid.uuid4().hex}.warc.gz"


_WRITTEN = pa.schema([("archive", pa.string()), ("nth", pa.int32()), ("page_id", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string())])


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes (page_id, url, html) as whole-file gzip archives; (archive, nth, page_id, bytes, digest) of each record."""

    def write(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        out, rows = None, []

        def closed():
            nonlocal out
            out.write(z.flush())
            out.close()
            out = None
            done = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k.type) for i, k in enumerate(_WRITTEN)], schema=_WRITTEN)
            rows.clear()
            return done

        for batch in batches:
            for page, url, html in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), utf8(batch["html"])):
                if out is None:
                    path, size, z = _new(base, "whole"), 0, zlib.compressobj(6, zlib.DEFLATED, 31)
                    out = fs.open_output_stream(path, compression=None)
                payload = html or b""
                digest = hashlib.sha256(payload).hexdigest()
                data = response(page, url, payload, digest)
                out.write(z.compress(data))
                rows.append((path, len(rows), page, len(payload), digest))
                size += len(data)
                if size >= archive_bytes:
                    yield closed()
        if out is not None:
            yield closed()

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return own.mapInArrow(write, "archive string, nth int, page_id long, bytes long, digest string")


def revisits(written: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(archive, nth, refers_to) of the records that revisit another, from the report of ``write_archives``."""
    large = written.where(F.col("bytes") >= least)
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    return large.join(first, "digest").where(F.col("page_id") > F.col("refers_to")).select("archive", "nth", "refers_to")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites whole-file archives (archive, revisits: array of (nth, refers_to)) with a member
    per record and an index beside; (archive, idx, records)."""

    def rewrite(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            done = []
            for source, again in zip(batch["archive"].to_pylist(), batch["revisits"].to_pylist()):
                path, at, lines = _new(base, "member"), 0, []
                again = {r["nth"]: r["refers_to"] for r in again or ()}
                with fs.open_input_stream(source, compression=None) as f, fs.open_output_stream(path, compression=None) as out:
                    for nth, (h, data) in enumerate(split_records(inflate(_pieces(f)))):
                        member = _gzip(as_revisit(data, again[nth]) if nth in again else data)
                        out.write(member)
                        lines.append(f"{at} {len(member)} {h['warc-record-id']} {'revisit' if nth in again else h['warc-type']}\n")
                        at += len(member)
                with fs.open_output_stream(f"{path}.idx", compression=None) as out:
                    out.write("".join(lines).encode())
                done.append((path, f"{path}.idx", len(lines)))
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))],
                                             names=["archive", "idx", "records"])

    return archives.select("archive", "revisits").mapInArrow(rewrite, "archive string, idx string, records long")


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rows of every record, each read through the index as a member of its own.

    A response's size and digest are taken from its payload (and must agree
    with its headers); a revisit has only the headers.
    """

    def page(name: str | None):
        name = (name or "")[len("<urn:page:"):-1]
        return int(name) if name else None

    def one(data: bytes) -> tuple:
        (h, whole), = split_records(iter([data]))
        block = whole[whole.find(_END) + len(_END):-len(_END)]
        cut = block.find(_END) + len(_END)
        size, digest = int(headers(block[:cut - len(_END)])["content-length"]), h["warc-payload-digest"].removeprefix("sha256:")
        if h["warc-type"] == "response" and (size, digest) != (len(block) - cut, hashlib.sha256(block[cut:]).hexdigest()):
            raise ValueError(f"damaged record {h['warc-record-id']}")
        return page(h["warc-record-id"]), size, digest, h["warc-type"], page(h.get("warc-refers-to"))

    def read(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, idx in zip(batch["archive"].to_pylist(), batch["idx"].to_pylist()):
                with fs.open_input_stream(idx, compression=None) as f:
                    entries = f.read().decode().splitlines()
                with fs.open_input_file(path) as f:
                    rows = []
                    for offset, length, *_ in map(str.split, entries):
                        f.seek(int(offset))
                        rows.append(one(zlib.decompress(f.read(int(length)), 31)))
                        if len(rows) == 5000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k.type) for i, k in enumerate(_READ)], schema=_READ)

    return archives.select("archive", "idx").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html), normalises and indexes the archives; the archives' table."""
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    written = materialize(write_archives(pages, folder))
    again = revisits(written).groupBy("archive").agg(F.collect_list(F.struct("nth", "refers_to")).alias("revisits"))  # of one archive
    todo = written.select("archive").distinct().join(again, "archive", "left")
    return materialize(normalise_archives(_one_each(pages.sparkSession, materialize(todo)), folder))


def _one_each(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """An archive is a task's work, whatever few bytes its row has."""
    return archives.repartition(max(1, archives.count()))


def op8_member_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as read back from the normalised archives."""
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(_one_each(spark, archive_pages(pages, folder)), folder)


SQL = """
WITH p AS (SELECT page_id, strlen(COALESCE(html, '')) AS n, sha256(COALESCE(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""

QUERIES = {"op8_member_index": (op8_member_index, SQL)}

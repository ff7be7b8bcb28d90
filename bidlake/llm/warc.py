"""WARC archives: a normaliser for whole-file gzip streams, and what it takes to
try it.

``write_archives`` writes records into archives that are each one gzip stream, as
some crawlers leave them: nothing in them can be read without inflating all
before it.  ``normalise`` inflates such a stream once, in pieces, rewrites every
record as a gzip member of its own and writes a sidecar offset index beside the
new archive (a line of JSON per record).  ``read_records`` reads single members by
their offsets and checks each payload against its digest.

Records with equal payloads of at least ``min_bytes`` are written once, as the
response with the largest page_id; the others are revisits that refer to it.

Files are named by task, attempt and number, and only those listed in the table a
successful task returned are read, so a lost executor leaves no half archive in
the result.  Folders may be in any store that pyarrow's file systems reach.

Defined results: a null html is an empty payload; smaller or unequal payloads are
all responses; rows of one page_id and equal payloads can't be told apart and come out
alike, both as the response or both as revisits; a null page_id is never the largest; a
null url is written as an empty target; an empty table gives no archive; a page is held
whole in a task, archives are not; a stream that ends early, or an archive with fewer or
more records than were written, is an error.  Only page_id, url and html are read, so
extra columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, salted, small_batches, written

MIN_BYTES = 1000
#: Payload bytes per archive, about; with this a file stays readable by one task.
ARCHIVE_BYTES = 32_000_000
CHUNK = 1 << 18
DATE = "2024-01-01T00:00:00Z"

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
ARCHIVE = "archive string, records long"


def decided(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, html, digest, bytes, refers_to): refers_to is null for a
    response.  The digests are aggregated before the join, so a group of copies is
    one row there; a large group is dealt to several tasks."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    base = base.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html").cast("long"))
    # Small payloads have no response, but their digests may be as frequent.
    response = F.max(F.when(F.col("bytes") >= min_bytes, F.col("page_id")))
    repeated = base.groupBy("digest").agg(response.alias("__response"), F.count("*").alias("n")).where("n > 1")
    repeated = written(repeated, "warc-repeated")
    joined = salted(base, repeated.drop("n"), repeated.drop("__response"), ["digest"], pages.count(), by=["page_id"], how="left")
    refers = F.when(F.col("__response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__response")), F.col("__response"))
    return joined.select("page_id", "url", "html", "digest", "bytes", refers.alias("refers_to"))


def _sha1_field(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def record_bytes(page_id: int | None, url: str | None, html: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit's block is the response's HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + html if refers_to is None else head
    name = "" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}", "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: {_sha1_field(digest)}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _task() -> str:
    """A name no other task or attempt writes under."""
    c = TaskContext.get()
    return f"{c.partitionId():06d}-{c.attemptNumber()}-{uuid.uuid4().hex[:8]}"


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of one gzip stream each; returns (archive, records)."""

    def write(batches):
        fs, root = _store(folder)
        fs.create_dir(root)
        out = squeeze = name = None
        n = size = count = 0
        done = []

        def close():
            out.write(squeeze.flush())
            out.close()
            done.append((name, count))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, count, size = f"{_task()}-{n}.warc.gz", 0, 0
                    n += 1
                    out, squeeze = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(6, wbits=31)
                data = record_bytes(row["page_id"], row["url"], row["html"], row["digest"], row["bytes"], row["refers_to"])
                out.write(squeeze.compress(data))
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["archive", "records"])

    return records.mapInArrow(write, ARCHIVE)


class Records:
    """The records of a WARC stream, from pieces of inflated bytes."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def __iter__(self) -> Iterator[bytes]:
        while self.held or self._more():
            while (end := self.held.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    raise ValueError("a record's head is cut off")
            total = end + 4 + int(fields(bytes(self.held[:end]))["content-length"]) + 4
            while len(self.held) < total:
                if not self._more():
                    raise ValueError("a record's block is cut off")
            yield bytes(self.held[:total])
            del self.held[:total]


def fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode().split("\r\n")[1:]:
        key, _, value = line.partition(":")
        out[key.strip().lower()] = value.strip()
    return out


def inflated(stream) -> Iterator[bytes]:
    """Pieces of a gzip file of one or more members, inflated."""
    d, begun = zlib.decompressobj(wbits=31), False
    while chunk := stream.read(CHUNK):
        while chunk:
            piece = d.decompress(chunk)
            begun = True
            if piece:
                yield piece
            chunk = d.unused_data
            if d.eof:
                d, begun = zlib.decompressobj(wbits=31), False
            else:
                break
    if begun:
        raise ValueError("the gzip stream has no end")


def complete(name: str, found: int, expected: int) -> None:
    if found != expected:
        raise ValueError(f"{name}: {found} records of {expected}")


def parsed(record: bytes) -> dict:
    """A record's named fields, and its HTTP head and payload."""
    end = record.index(b"\r\n\r\n")
    out = fields(record[:end])
    block = record[end + 4 : end + 4 + int(out["content-length"])]
    split = block.index(b"\r\n\r\n")
    return out | {"http": fields(block[:split]), "payload": block[split + 4 :]}


def index_of(archive: str) -> str:
    return archive.removesuffix(".warc.gz") + ".idx"


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites each listed archive of ``source`` into ``target`` with a member per
    record and an offset index beside it; returns (archive, records)."""

    def rewrite(batches):
        fs, root = _store(source)
        to, to_root = _store(target)
        to.create_dir(to_root)
        for batch in batches:
            done = []
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = f"{_task()}-{name}"
                at = count = 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream, to.open_output_stream(f"{to_root}/{new}", compression=None) as out, to.open_output_stream(f"{to_root}/{index_of(new)}") as index:
                    for record in Records(inflated(stream)):
                        squeeze = zlib.compressobj(6, wbits=31)
                        member = squeeze.compress(record) + squeeze.flush()
                        head = fields(record[: record.index(b"\r\n\r\n")])
                        line = {"id": head["warc-record-id"], "type": head["warc-type"], "digest": head["warc-payload-digest"], "offset": at, "length": len(member)}
                        out.write(member)
                        index.write(json.dumps(line).encode() + b"\n")
                        at, count = at + len(member), count + 1
                complete(name, count, expected)
                done.append((new, count))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["archive", "records"])

    return archives.select("archive", "records").mapInArrow(rewrite, ARCHIVE)


def read_records(archives: DataFrame, folder: str) -> DataFrame:
    """The columns of RECORD, a row per record, each member read by its offset."""

    def page(urn: str) -> int | None:
        number = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    def read(batches):
        fs, root = _store(folder)
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with fs.open_input_stream(f"{root}/{index_of(name)}") as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                with fs.open_input_file(f"{root}/{name}") as f:
                    for line in index:
                        f.seek(line["offset"])
                        record = parsed(zlib.decompress(f.read(line["length"]), wbits=31))
                        digest = base64.b32decode(record["warc-payload-digest"].removeprefix("sha1:")).hex()
                        kind, size = record["warc-type"], int(record["http"]["content-length"])
                        if kind == "response" and (hashlib.sha1(record["payload"]).hexdigest(), len(record["payload"])) != (digest, size):
                            raise ValueError(f"{name}: {line['id']} differs from its digest")
                        refers = page(record["warc-refers-to"]) if kind == "revisit" else None
                        rows.append((page(record["warc-record-id"]), size, digest, kind, refers, name, line["offset"], line["length"]))
                complete(name, len(rows), expected)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                names = [c.split()[0] for c in RECORD.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return archives.select("archive", "records").mapInArrow(read, RECORD)


def spread(archives: DataFrame) -> DataFrame:
    """One archive to a partition, about: names are few, the work behind each is not."""
    spark = archives.sparkSession
    listed = written(archives, "warc-list")
    n = max(1, listed.count())
    return listed.repartition(min(n, 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages as whole-stream archives, normalises them, and reads the
    records of the normalised archives back."""
    spark = pages.sparkSession
    small_batches(spark)
    raw, good = new_folder(spark, "warc-raw"), new_folder(spark, "warc")
    streams = spread(write_archives(decided(pages, min_bytes), raw, archive_bytes))
    return read_records(spread(normalise(streams, raw, good)), good)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM r
"""

"""WARC archives: a writer and a sequential reader.

Every record is a gzip member of its own. The reader takes an archive as a stream of bytes: members are decompressed
incrementally, records are framed by Content-Length, and block and payload digests are verified (base32
SHA-1). Of records with equal payloads of ``MIN_REVISIT`` bytes or more the one with the largest page_id is a
response with the payload, the others are revisits that hold the HTTP head only and name that response.

Archives are files in the shared folder, written under a name of their own by each task attempt and listed in
a manifest once complete, so that retried tasks leave nothing that is read. Memory is bounded by one record.

Defined cases: null html is an empty payload; rows with the group's largest page_id are all responses where that id repeats;
a null page_id is a revisit if any equal payload has an id, else a response; null urls are empty; control characters in
urls are percent-encoded; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm._tables import filesystem, new_path, written

MIN_REVISIT = 0
SALTS = 16
ARCHIVE = 64 << 20  # bytes of an archive, compressed, after which a new one begins
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _number(name: str | None) -> int | None:
    digits = (name or "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Target-URI: {_safe(url)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"] if revisit else []),
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + made.flush()


def members(read: Callable[[int], bytes], step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a stream, decompressed one after the other."""
    rest = read(step)
    while rest:
        unzip, out = zlib.decompressobj(31), []
        while not unzip.eof:
            if not rest:
                raise ValueError("the archive ends within a gzip member")
            out.append(unzip.decompress(rest))
            rest = unzip.unused_data if unzip.eof else read(step)
        yield b"".join(out)
        rest = rest or read(step)


def parse(member: bytes) -> dict[str, object]:
    """A record's fields; raises ValueError where framing or a digest is wrong."""
    head, _, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(fields["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the record")
    if fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = fields["warc-type"] == "revisit"
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != length or digest != sha1_base32(payload)):
        raise ValueError("payload digest or length differs")
    return {
        "page_id": _number(fields["warc-record-id"]),
        "url": fields["warc-target-uri"],
        "record_type": fields["warc-type"],
        "payload_bytes": length,
        "payload_digest": digest,
        "refers_to": _number(fields.get("warc-refers-to")),
        "payload": None if revisit else payload,
    }


def with_targets(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Adds revisit and refers_to to pages (page_id, url, html)."""
    base = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("digest", F.when(F.length("payload") >= min_revisit, F.sha1("payload")))
    # only payloads that repeat are kept, and no payload moves to find them
    again = base.where("digest IS NOT NULL").groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    again = written(again.select("digest", "last"), "repeated")
    # where it is too large to be sent to all, payloads move: those of one digest, say of empty pages, in SALTS parts
    base = base.withColumn("__salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    again = again.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    out = base.join(again, ["digest", "__salt"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return out.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes archives of ``pages`` below ``folder``; returns the written manifest (path, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        out, path, n, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, revisit, refers_to = (c[i].as_py() for c in batch.columns)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    # without the file system's own compression by suffix
                    out = fs.open_output_stream(path, compression=None)
                made = record(page_id, url or "", payload, refers_to, revisit)
                out.write(made)
                n, size = n + 1, size + len(made)
                if size >= ARCHIVE:
                    out.close()
                    out = done.append((path, n, size))
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "records", "bytes"])

    return written(with_targets(pages, min_revisit).mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives in a manifest, read one by one: the columns of ``READ``."""
    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[dict[str, object]] = []
                n, size = 0, 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for member in members(stream.read):
                        row = parse(member)
                        size += len(member) if with_payload else 0
                        rows.append(row if with_payload else row | {"payload": None})
                        n += 1
                        if len(rows) == 1000 or size > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types)], names=names)
                            rows, size = [], 0
                if n != expected:
                    raise ValueError(f"{path} holds {n} records, its manifest says {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types)], names=names)

    # an archive is a task's work; its path is a key of its own
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "records").repartition(n).mapInArrow(run, READ)


def round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Pages written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = new_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    found = read_archives(write_archives(pages, folder, min_revisit), folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""WARC archives: one gzip member a record, read back in sequence.

Of records with equal payloads of at least MIN_REVISIT bytes one is a response and the others are
revisits, which hold the HTTP header alone and name the response. The reader decompresses a member
bit by bit, frames the block by Content-Length, and checks the block and payload digests.

A null payload is empty. A null key is written as ``-`` and comes after all others when the response is
chosen; of rows that repeat a key, one. Null or odd URLs are escaped. An empty table makes no archive.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealstone.llm.common import fresh_path, table
from sealstone.llm.components import join_spread

MIN_REVISIT = 100
ROLL = 64 << 20  #: bytes after which a task begins its next archive
LEVEL = 4
CHUNK = 256 << 10
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"


def _escaped(url: str) -> str:
    return "".join(c if " " < c != "\x7f" and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(key: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None, date: str = DATE) -> bytes:
    """One record as a gzip member. ``refers_to``: the response's key, if this is a revisit."""
    urn = lambda k: f"<{URN}{'-' if k is None else k}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(key)}", f"WARC-Date: {date}"]
    head += [] if url is None else [f"WARC-Target-URI: {_escaped(url)}"]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"] * revisit
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload_bytes: int  #: of the full payload, for revisits too
    payload_digest: str
    payload: bytes | None


class ArchiveError(ValueError):
    pass


class _Member:
    """The bytes of one gzip member, as they come."""

    def __init__(self, source, rest: bytes) -> None:
        self.source, self.raw, self.out, self.z = source, rest, b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        while not self.z.eof:
            raw = self.raw or self.source.read(CHUNK)
            if not raw:
                raise ArchiveError("the archive ends within a record")
            got = self.z.decompress(raw, CHUNK)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                self.out += got
                return True
        return False

    def upto(self, mark: bytes) -> bytes:
        """What comes before ``mark``, however long."""
        seen, done = bytearray(self.out), 0
        while (at := seen.find(mark, done)) < 0:
            self.out, done = b"", max(0, len(seen) - len(mark) + 1)
            if not self._more():
                raise ArchiveError("a header has no end")
            seen += self.out
        self.out = bytes(seen[at + len(mark) :])
        return bytes(seen[:at])

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out and not self._more():
                raise ArchiveError("a block is shorter than its Content-Length")
            got, self.out = self.out[:n], self.out[n:]
            n -= len(got)
            yield got

    def end(self) -> bytes:
        """Checks that the record ends here; returns what follows the member."""
        if b"".join(self.take(4)) != b"\r\n\r\n" or self.out or self._more():
            raise ArchiveError("a block is longer than its Content-Length")
        return self.raw


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_archive(source, keep_payload: bool = False) -> Iterator[Record]:
    """All records of an open binary stream, in order; ArchiveError if one is damaged."""
    rest = b""
    while rest or (rest := source.read(CHUNK)):
        m = _Member(source, rest)
        first, *lines = m.upto(b"\r\n\r\n").decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ArchiveError("a record has no WARC version")
        headers = _fields(lines)
        length = int(headers["content-length"])
        block, payload, kept, seen, http, size = hashlib.sha256(), hashlib.sha256(), [], b"", None, 0
        for part in m.take(length):
            block.update(part)
            if http is None:
                seen += part
                at = seen.find(b"\r\n\r\n")
                if at < 0:
                    continue
                http, part = _fields(seen[:at].decode().split("\r\n")[1:]), seen[at + 4 :]
            payload.update(part)
            size += len(part)
            if keep_payload:
                kept.append(part)
        rest = m.end()
        if http is None:
            raise ArchiveError("a block has no HTTP header")
        digest = headers["warc-payload-digest"].removeprefix("sha256:")
        if block.hexdigest() != headers["warc-block-digest"].removeprefix("sha256:"):
            raise ArchiveError("a block does not have its digest")
        if headers["warc-type"] == "response" and (payload.hexdigest() != digest or size != int(http["content-length"])):
            raise ArchiveError("a payload does not have its digest or length")
        yield Record(headers, http, int(http["content-length"]), digest, b"".join(kept) if keep_payload else None)


def write_archives(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = MIN_REVISIT, roll: int = ROLL, out: str | None = None) -> DataFrame:
    """Writes all rows; returns the manifest: path, n_records, n_bytes, a row for each archive.

    Which record is the response is found over narrow rows (partial counts for each digest and key), then joined to the payloads
    by digest: sent to every task, or each digest in several parts, so no number of copies meets in one task with its payloads. Files have names of their own attempt."""
    spark = pages.sparkSession
    out = out or fresh_path(spark, "warc")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_revisit, F.sha2("payload", 256)))
    each = rows.filter("digest is not null").groupBy("digest", "key").count()
    own = F.struct(F.col("key").isNull().alias("last"), "key", F.col("count").alias("rows"))
    firsts = each.groupBy("digest").agg(F.min(own).alias("first"), F.sum("count").alias("n")).filter("n > 1")
    firsts = table(firsts.select("digest", F.col("first.key").alias("refers_to"), F.col("first.rows").alias("first_rows")), "warc-firsts")
    # Nothing but the digest and the key decides, so no row is numbered, and payloads stay where they are while the copied digests are few.
    told = join_spread(rows, firsts, "digest", "key", firsts.count(), "left")
    told = told.withColumn("first_rows", F.coalesce("first_rows", F.lit(0))).withColumn("revisit", (F.col("first_rows") > 0) & ~F.col("key").eqNullSafe(F.col("refers_to")))
    joined = told.select("key", "url", "payload", "revisit", F.when(F.col("revisit"), F.col("refers_to")).alias("refers_to"))
    if firsts.filter("first_rows > 1").limit(1).count():  # rows repeat the key of a response: the one of the first URL is it
        again = (F.col("first_rows") > 1) & ~F.col("revisit")
        order = F.row_number().over(Window.partitionBy("digest", "key").orderBy("url"))
        repeated = told.filter(again).withColumn("revisit", order > 1).select("key", "url", "payload", "revisit", F.when(F.col("revisit"), F.col("refers_to")).alias("refers_to"))
        joined = told.filter(~again).select("key", "url", "payload", "revisit", F.when(F.col("revisit"), F.col("refers_to")).alias("refers_to")).union(repeated)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(out)
        part, stream, n, size, done = TaskContext.get().partitionId(), None, 0, 0, []
        for batch in batches:
            for k, u, p, again, r in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "payload", "revisit", "refers_to")), strict=True):
                if stream is None:
                    fs.create_dir(base, recursive=True)
                    name = f"part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.gz"
                    stream, n, size = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                raw = p.encode()
                size += stream.write(got := record(k, u, raw, hashlib.sha256(raw).hexdigest(), again, r)) or len(got)
                n += 1
                if size >= roll:
                    stream.close()
                    done.append((f"{out}/{name}", n, size))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((f"{out}/{name}", n, size))
        if done:
            yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "n_records": pa.array([d[1] for d in done], pa.int64()), "n_bytes": pa.array([d[2] for d in done], pa.int64())})

    return table(joined.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, *, key: str = "page_id") -> DataFrame:
    """Per record: key, payload_bytes, payload_digest, record_type, refers_to, url. Archives are dealt evenly to the tasks."""

    def number(urn: str | None) -> int | None:
        got = (urn or "").strip("<>").removeprefix(URN)
        return int(got) if got not in ("", "-") else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(at, compression=None) as f:
                    got = [(number(r.headers["warc-record-id"]), r.payload_bytes, r.payload_digest, r.headers["warc-type"], number(r.headers.get("warc-refers-to")), r.headers.get("warc-target-uri")) for r in read_archive(f)]
                cols = list(zip(*got, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [key, "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    n = manifest.count()
    return manifest.select("path").repartition(max(1, n)).mapInArrow(read, f"{key} long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")

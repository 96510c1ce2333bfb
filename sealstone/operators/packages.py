"""Office packages (zip archives of parts) as segments: one a part, in order of names; redaction by emptied parts; verification from the artifact alone.

A package's canonical form is the stored archive of its parts in order of their names, with no times, flags or extra fields, so it depends on names and payloads only.
A segment is a part: its id is its place there, its offset that of its payload in the canonical form, and its digest binds id, name and payload. The root folds the digests in order.
Redaction empties a part and leaves its name, so the artifact does not tell how long it was; all others keep their bytes, and their digests can be made again from the artifact.

Files are read one by one where they lie, so nothing but rows of parts is shuffled. What cannot be a package is a verdict, never an error:
``not-an-archive``, ``malformed`` (damaged, encrypted, or packed in an unknown way), ``duplicate-part``, ``too-many-parts``, ``too-large`` (more than ``most_bytes`` when unpacked; no more than that is ever unpacked),
``no-parts``; null and empty contents are no archives. Rows that repeat a key are files of their own only if their contents differ in no way that matters to the caller: keys are expected to be unique."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealstone.functions.batches import pieces
from sealstone.functions.framing import REDACTION_OBJECT, digest, joined, lp, u32
from sealstone.operators import merkle
from sealstone.operators.segments import verify_shown

MOST_PARTS, MOST_BYTES = 65_535, 64 << 20
#: Fixed values of the format.
TYPES, RELATIONS, NAMESPACE = "[Content_Types].xml", "_rels/.rels", "http://schemas.openxmlformats.org/package/2006/relationships"
DAMAGED = (zipfile.BadZipFile, NotImplementedError, RuntimeError, zlib.error, EOFError, OSError, UnicodeDecodeError, struct.error, ValueError, IndexError)


class Refused(ValueError):
    """What a file is not; the verdict."""


def read_parts(raw: bytes | None, most_parts: int = MOST_PARTS, most_bytes: int = MOST_BYTES) -> list[tuple[str, bytes]]:
    """(name, payload) in order of names; folders left out."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw or b""))
    except DAMAGED as e:
        raise Refused("not-an-archive") from e
    entries = [x for x in archive.infolist() if not x.is_dir()]
    if len(archive.infolist()) > most_parts:
        raise Refused("too-many-parts")
    if not entries:
        raise Refused("no-parts")
    if len({x.filename for x in entries}) < len(entries):
        raise Refused("duplicate-part")
    out, left = [], most_bytes
    for entry in entries:
        try:
            with archive.open(entry) as f:
                payload = f.read(left + 1)
        except DAMAGED as e:
            raise Refused("malformed") from e
        left -= len(payload)
        if left < 0:
            raise Refused("too-large")
        out.append((entry.filename, payload))
    return sorted(out, key=lambda x: x[0].encode(errors="surrogatepass"))


def write_package(parts: list[tuple[str, bytes]]) -> bytes:
    """The canonical form: local headers with payloads, then the directory."""
    body, directory = bytearray(), bytearray()
    for name, payload in parts:
        raw = name.encode()
        common = struct.pack("<HHHHHIIIHH", 20, 0 if raw.isascii() else 0x800, 0, 0, 33, zlib.crc32(payload), len(payload), len(payload), len(raw), 0)
        directory += b"PK\x01\x02" + struct.pack("<H", 0x314) + common + struct.pack("<HHHII", 0, 0, 0, 0o100644 << 16, len(body)) + raw
        body += b"PK\x03\x04" + common + raw + payload
    end = struct.pack("<HHHHIIH", 0, 0, len(parts), len(parts), len(directory), len(body), 0)
    return bytes(body + directory + b"PK\x05\x06" + end)


def main_part(relations: bytes) -> str:
    """Name of the document's main part, by the package's relations."""
    found: list[str] = []
    inside = False

    def begin(name: str, attributes: dict[str, str]) -> None:
        nonlocal inside
        if any(":" in a for a in attributes) or (name == "Relationships") != (not inside) and name in ("Relationships", "Relationship"):
            raise Refused("malformed")
        if name == "Relationships":
            if attributes.get("xmlns") != NAMESPACE:
                raise Refused("malformed")
            inside = True
        elif name == "Relationship":
            if "xmlns" in attributes:
                raise Refused("malformed")
            if attributes.get("Type", "").endswith("/officeDocument"):
                target = attributes.get("Target", "").lstrip("/")
                if attributes.get("TargetMode", "").lower() == "external" or "\\" in target or any(x in ("", ".", "..") for x in target.split("/")):
                    raise Refused("malformed")
                found.append(target)

    def no_entities(*_) -> None:
        raise Refused("malformed")

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EntityDeclHandler = begin, no_entities
    try:
        parser.Parse(relations, True)
    except expat.ExpatError as e:
        raise Refused("malformed") from e
    if len(found) != 1:
        raise Refused("malformed")
    return found[0]


def structural(parts: list[tuple[str, bytes]]) -> set[str]:
    """Names that must not be emptied: every XML part, for an empty one is no XML, and the main part, whatever its name."""
    held = dict(parts)
    if TYPES not in held or RELATIONS not in held:
        raise Refused("malformed")
    target = main_part(held[RELATIONS])
    if target not in held:
        raise Refused("malformed")
    return {n for n in held if n.lower().endswith((".xml", ".rels"))} | {target}


PARTS = "verdict string, segment_id int, label string, byte_offset long, byte_length long, redactable boolean, payload binary"


def _parts(files: DataFrame, key: str, content: str, most_parts: int, most_bytes: int) -> DataFrame:
    """A row for each part with its payload, or one with the verdict."""
    schema = f"`{key}` {files.schema[key].dataType.simpleString()}, {PARTS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for i in range(batch.num_rows):  # a file at a time: its parts may be large
                own = batch.column(0).slice(i, 1)
                try:
                    parts = read_parts(batch.column(1)[i].as_py(), most_parts, most_bytes)
                except Refused as e:
                    yield pa.RecordBatch.from_arrays([own, pa.array([str(e)]), *(pa.nulls(1, t) for t in (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=[key, *NAMES])
                    continue
                try:
                    fixed = structural(parts)
                except Refused:
                    fixed = {n for n, _ in parts}  # a package without a main part that can be told is not redacted at all
                size, at = [len(p) for _, p in parts], 0
                offsets = []
                for name, payload in parts:
                    at += 30 + len(name.encode(errors="surrogatepass"))
                    offsets.append(at)
                    at += len(payload)
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array(own.to_pylist() * n, own.type), pa.array(["ok"] * n), pa.array(range(n), pa.int32()), pa.array([x for x, _ in parts], pa.string()), pa.array(offsets, pa.int64()), pa.array(size, pa.int64()), pa.array([x not in fixed for x, _ in parts]), pa.array([p for _, p in parts], pa.binary())], names=[key, *NAMES])

    return files.select(key, F.col(content).cast("binary")).mapInArrow(run, schema)


NAMES = ("verdict", "segment_id", "label", "byte_offset", "byte_length", "redactable", "payload")


def part_digest(segment_id: Column, label: Column, payload: Column, alg: str) -> Column:
    """What a segment commits to: its id, its part's name and payload."""
    return digest(joined(REDACTION_OBJECT, lp(u32(segment_id)), lp(label), payload), alg)


def segments(files: DataFrame, *, key: str = "path", content: str = "content", alg: str = "blake3", most_parts: int = MOST_PARTS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(key, verdict, segment_id, label, byte_offset, byte_length, redactable, digest hex): a row for each part, verdict ``ok``; or one row with another verdict."""
    rows = _parts(files, key, content, most_parts, most_bytes)
    return rows.select(key, "verdict", "segment_id", "label", "byte_offset", "byte_length", "redactable", F.lower(F.hex(part_digest(F.col("segment_id"), F.col("label"), F.col("payload"), alg))).alias("digest"))


def roots(segment_rows: DataFrame, *, key: str = "path", alg: str = "blake3") -> DataFrame:
    """(key, n, root hex) over the digests of each file's segments. Files of a single part have nothing to hide behind and no root."""
    leaves = segment_rows.filter("verdict = 'ok'").select(key, F.col("segment_id").alias("position"), F.unhex("digest").alias("data"))
    return merkle.zero_padded_roots(leaves, by=key, alg=alg).select(key, "n", F.lower(F.hex("root")).alias("root"))


def redact(files: DataFrame, segment_rows: DataFrame, wanted: DataFrame, *, key: str = "path", content: str = "content", most_parts: int = MOST_PARTS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``wanted(key, segment_id)`` emptied: (key, verdict, artifact) for each file that is asked for. The first fault of a file is its verdict and it has no artifact: the file's own verdict, ``unknown-segment``, ``structural-part``, ``label-mismatch`` (the file is not the one that ``segment_rows`` describe); else ``ok``."""
    told = wanted.select(key, "segment_id").distinct().join(segment_rows.filter("verdict = 'ok'").select(key, "segment_id", "label", "redactable"), [key, "segment_id"], "left")
    of_file = told.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("segment_id", "label", "redactable"))).alias("asked"))
    schema = f"`{key}` {files.schema[key].dataType.simpleString()}, verdict string, artifact binary"

    def one(raw: bytes | None, asked: list[dict]) -> tuple[str, bytes | None]:
        try:
            parts = read_parts(raw, most_parts, most_bytes)
        except Refused as e:
            return str(e), None
        if any(x["label"] is None for x in asked):
            return "unknown-segment", None
        if any(x["segment_id"] >= len(parts) or parts[x["segment_id"]][0] != x["label"] for x in asked):
            return "label-mismatch", None
        try:
            fixed = structural(parts)
        except Refused as e:
            return str(e), None
        if any(not x["redactable"] or x["label"] in fixed for x in asked):
            return "structural-part", None
        gone = {x["segment_id"] for x in asked}
        return "ok", write_package([(n, b"" if i in gone else p) for i, (n, p) in enumerate(parts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for i in range(batch.num_rows):
                verdict, artifact = one(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([verdict]), pa.array([artifact], pa.binary())], names=[key, "verdict", "artifact"])

    return files.select(key, F.col(content).cast("binary").alias("content")).join(of_file, key).mapInArrow(run, schema)


def verify(artifacts: DataFrame, segment_rows: DataFrame, wanted: DataFrame, stated: DataFrame, *, key: str = "path", alg: str = "blake3") -> DataFrame:
    """Artifacts (key, artifact) against the segments, what was redacted, and the stated roots (key, root): (key, verdict).

    Every part that was not redacted must give its digest again from the artifact, every redacted one must be there and empty, and the digests, those of redacted parts as stated, must fold to the root."""
    found = segments(artifacts, key=key, content="artifact", alg=alg).filter("verdict = 'ok'").withColumn("emptied", F.col("byte_length") == 0)
    return verify_shown(found, segment_rows.filter("verdict = 'ok'").select(key, "segment_id", "label", "digest"), wanted, stated, artifacts, key=key, alg=alg)

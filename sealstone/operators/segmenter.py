"""Segments of files of any known format as a table function, for SQL and lateral joins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealstone.functions import pdf
from sealstone.functions.batches import pieces
from sealstone.functions.blake3 import hash_many
from sealstone.functions.framing import REDACTION_OBJECT
from sealstone.operators import packages
from sealstone.operators.pdf import _object_rows, _word_rows
from sealstone.operators.segments import MOST, block_label, line_blocks

NAME = "segment_spans"
SCHEMA = "verdict string, segment_id int, label string, byte_offset long, byte_length long, redactable boolean, digest string"
MOST_BYTES = 64 << 20


def _lp(raw: bytes) -> bytes:
    return len(raw).to_bytes(4, "big") + raw


def _text(raw: bytes) -> Iterator[tuple]:
    """(label, offset, length, redactable, what the digest binds besides the id)."""
    raw.decode()
    own = np.frombuffer(raw, np.uint8)
    bounds, per = line_blocks(own)
    lines = int((own == 10).sum()) + (not raw.endswith(b"\n"))
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        yield i, block_label(i, per, lines), a, b - a, True, raw[a:b]


def _office(raw: bytes) -> Iterator[tuple]:
    parts, at = packages.read_parts(raw), 0
    try:
        fixed = packages.structural(parts)
    except packages.Refused:
        fixed = {n for n, _ in parts}
    for i, (name, payload) in enumerate(parts):
        at += 30 + len(name.encode(errors="surrogatepass"))
        yield i, name, at, len(payload), name not in fixed, _lp(name.encode(errors="surrogatepass")) + payload
        at += len(payload)


def _pdf(raw: bytes, by_words: bool) -> Iterator[tuple]:
    for r in (_word_rows if by_words else _object_rows)(raw, MOST, MOST_BYTES):
        yield r["segment_id"], r["label"], r.get("byte_offset"), r["byte_length"], r["redactable"], r["payload"]


READERS = {"text": _text, "text-line": _text, "ooxml": _office, "ooxml-part": _office, "pdf": lambda raw: _pdf(raw, False), "pdf-object": lambda raw: _pdf(raw, False), "pdf-xref-stream": lambda raw: _pdf(raw, False), "pdf-textrun": lambda raw: _pdf(raw, True)}


def _cut(content: bytes | None, format_: str | None) -> tuple[str, list[tuple]]:
    """Verdict of a file, and its segments."""
    read = READERS.get(format_)
    if read is None:
        return "unknown-format", []
    try:
        return "ok", list(read(bytes(content or b"")))
    except (packages.Refused, pdf.Refused) as e:
        return str(e), []
    except UnicodeDecodeError:
        return "not-text", []


def _digests(rows: list[tuple], alg: str) -> list[bytes]:
    bound = [REDACTION_OBJECT + _lp(i.to_bytes(4, "big")) + payload for i, *_, payload in rows]
    return hash_many(bound) if alg == "blake3" else [hashlib.sha256(b).digest() for b in bound]


class SegmentSpans:
    """The segments of one file, as ``segments``, ``packages.segments``, ``pdf.objects`` and ``pdf.words`` have them; or a row with a verdict: that of the format, ``not-text``, ``unknown-format``. A null or empty text has no rows; a null format is unknown."""

    def eval(self, content: bytes, format: str, alg: str) -> Iterator[tuple]:  # noqa: A002
        verdict, rows = _cut(content, format)
        if verdict != "ok":
            yield verdict, None, None, None, None, None, None
        for (i, label, offset, length, redactable, _), d in zip(rows, _digests(rows, alg), strict=True):
            yield "ok", i, label, offset, length, redactable, d.hex()


def spans(files: DataFrame, *, content: str = "content", format: str = "format", alg: str = "blake3") -> DataFrame:  # noqa: A002
    """``files`` without their content, and the columns of ``segment_spans``: the same rows as by a lateral join, but the digests of many files, about 1 MB of them, are made together, which BLAKE3 needs."""
    kept = [c for c in files.columns if c != content]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            owner, verdicts, rows = [], [], []
            for i, (raw, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                verdict, own = _cut(raw, kind)
                if verdict != "ok":
                    own = [(None,) * 5 + (b"",)]
                owner += [i] * len(own)
                verdicts += [verdict] * len(own)
                rows += own
            made = iter(_digests([r for r in rows if r[0] is not None], alg))
            digests = [None if r[0] is None else next(made).hex() for r in rows]
            columns = [verdicts, *([r[k] for r in rows] for k in range(5)), digests]
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(2 + k).take(at) for k in range(len(kept))), *map(pa.array, columns, types)], names=[*kept, *names])

    fields = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept)
    return files.select(F.col(content).cast("binary").alias("content_"), F.col(format).alias("format_"), *kept).mapInArrow(run, f"{fields}, {SCHEMA}")


segment_spans = F.udtf(SegmentSpans, returnType=SCHEMA)


def register(spark: SparkSession) -> None:
    """For SQL: ``FROM files, LATERAL segment_spans(files.content, files.format, 'blake3')``."""
    spark.udtf.register(NAME, segment_spans)

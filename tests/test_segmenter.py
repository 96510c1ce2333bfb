"""Text blocks and the table function, against plain splitting and the operators."""

import random

from pyspark.sql import functions as F

from sealstone.operators import packages, pdf, segmenter, segments
from sealstone.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def plain(text, most):
    lines = [x for x in (text or "").splitlines(keepends=True)] if "\r" not in (text or "") else None
    per = max(1, -(-len(lines) // most))
    out, at = [], 0
    for i in range(0, len(lines), per):
        own = "".join(lines[i : i + per])
        last = min(i + per, len(lines))
        out.append((i // per, at, len(own.encode()), f"line {i + 1}" if last == i + 1 else f"lines {i + 1}-{last}", own))
        at += len(own.encode())
    return out


def test_blocks_of_lines(spark):
    r = random.Random(5)
    texts = [None, "", "\n", "one", "one\n", "é日\n\n𝒳", "\n" * 9, *("".join(r.choice("ab\né") for _ in range(r.randrange(60))) for _ in range(60))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, label string")
    for most in (1, 3, 7, 65_536):
        got = {}
        for x in segments.segments(docs, most=most).collect():
            got.setdefault(x.doc_id, []).append(tuple(x)[1:])
        assert {k: sorted(v) for k, v in got.items()} == {i: plain(t, most) for i, t in enumerate(texts) if t}
    assert segments.segments(docs.limit(0)).count() == 0 and "Exchange" not in segments.segments(docs)._jdf.queryExecution().executedPlan().toString()


def test_the_table_function_has_the_operators_rows(spark):
    office, files = fx.office_files(spark, SF), fx.pdf_files(spark, SF)
    by = lambda t, f: t.lateralJoin(segmenter.segment_spans(F.col("content").outer(), F.lit(f), F.lit("sha256"))).select("path", "verdict", "segment_id", "byte_offset", "byte_length", "redactable", "digest")
    rows = lambda t: sorted(map(tuple, t.select("path", "verdict", "segment_id", "byte_offset", "byte_length", "redactable", "digest").collect()), key=repr)
    assert rows(by(office, "ooxml-part")) == rows(packages.segments(office, alg="sha256"))
    assert rows(by(files, "pdf-object")) == rows(pdf.objects(files, alg="sha256"))
    assert rows(by(files, "pdf-textrun")) == rows(pdf.words(files, alg="sha256"))


def test_unknown_and_odd_contents(spark):
    segmenter.register(spark)
    got = spark.sql("SELECT n, s.verdict, s.segment_id FROM VALUES (1, CAST('a' AS BINARY), 'tar'), (2, X'FF', 'text'), (3, CAST(NULL AS BINARY), 'text'), (4, X'', 'pdf'), (5, CAST('a' AS BINARY), CAST(NULL AS STRING)), (6, CAST('a' AS BINARY), 'text') AS t(n, c, f), LATERAL segment_spans(c, f, 'blake3') s")
    assert {(x.n, x.verdict, x.segment_id) for x in got.collect()} == {(1, "unknown-format", None), (2, "not-text", None), (4, "not-a-pdf", None), (5, "unknown-format", None), (6, "ok", 0)}


def test_files_cut_together(spark, monkeypatch):
    """Spans of many files have the rows of the lateral join; BLAKE3 is called for the files of a batch together."""
    files = fx.office_files(spark, SF).withColumn("format", F.lit("ooxml-part")).union(fx.pdf_files(spark, SF).withColumn("format", F.lit("pdf-object")))
    odd = spark.createDataFrame([(-1, b"a", "tar"), (-2, b"\xff", "text"), (-3, None, "text"), (-4, b"", "pdf"), (-5, b"a", None), (-6, b"a\nb", "text")], "path long, content binary, format string")
    files = files.union(odd)
    rows = lambda t: sorted(map(tuple, t.select("path", "format", "verdict", "segment_id", "label", "byte_offset", "byte_length", "redactable", "digest").collect()), key=repr)
    assert rows(segmenter.spans(files)) == rows(files.lateralJoin(segmenter.segment_spans(F.col("content").outer(), F.col("format").outer(), F.lit("blake3"))))


def test_batches_in_pieces(spark):
    """A batch of any size is worked on about so many bytes at a time, in order, a large row by itself."""
    import pyarrow as pa

    from sealstone.functions import batches
    from sealstone.functions.canonical import nfc

    texts = pa.array(["a" * 5, None, "b" * 30, "", "c", "d" * 4, None])
    assert batches.bounds(texts, 10) == [(0, 2), (2, 1), (3, 4)] and batches.bounds(texts.slice(2), 10) == [(0, 1), (1, 4)] and batches.bounds(texts[:0]) == []
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), texts], names=["k", "t"])
    got = list(batches.pieces(iter([batch]), most=10))
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(7)) and max(b.column(1).nbytes for b in got) < 120
    made = spark.createDataFrame([(1, "é" * 400_000), (2, None), (3, "abc"), (4, "é" * 700_000)], "k int, t string").coalesce(1).select("k", nfc("t").alias("t"))
    assert {r.k: r.t for r in made.collect()} == {1: "é" * 400_000, 2: None, 3: "abc", 4: "é" * 700_000}

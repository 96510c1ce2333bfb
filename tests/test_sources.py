"""Directory scans, sinks, Poseidon and snapshot paths."""

import hashlib
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from sealstone.functions.blake3 import hash_many
from sealstone.functions.poseidon import chain, leaf, node, poseidon, tagged
from sealstone.operators import merkle
from sealstone.operators.streams import hash_stream
from sealstone.sources import files


def test_scan_directory(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.txt").write_bytes(b"abc")
    (tmp_path / "top.txt").write_bytes(b"q" * 3000)
    got = {(r.shard_id, r.record_id): (r.content_hash, r.byte_size) for r in files.scan_directory(spark, str(tmp_path)).collect()}
    assert got == {("a", "b/x.txt"): (hash_many([b"abc"])[0].hex(), 3), ("root", "top.txt"): (hash_many([b"q" * 3000])[0].hex(), 3000)}
    assert {r.record_id for r in files.scan_directory(spark, str(tmp_path), shard="s").collect()} == {"a/b/x.txt", "top.txt"}
    (tmp_path / "a" / "empty é %.txt").write_bytes(b"")
    got = {(r.shard_id, r.record_id): (r.content_hash, r.byte_size) for r in files.scan_directory(spark, f"file://{tmp_path}", streamed=1000).collect()}  # a file of 3,000 bytes as a stream
    assert got == {("a", "b/x.txt"): (hash_many([b"abc"])[0].hex(), 3), ("root", "top.txt"): (hash_many([b"q" * 3000])[0].hex(), 3000), ("a", "empty é %.txt"): (hash_many([b""])[0].hex(), 0)}


def test_a_scan_takes_hidden_files_and_no_links(spark, tmp_path):
    root = tmp_path / "it's a folder %20 é"
    (root / ".git" / "deep" / "er").mkdir(parents=True)
    (root / "_private").mkdir()
    (root / "none").mkdir()
    files_ = {"top": b"1", ".hidden": b"2", ".git/config": b"3", ".git/deep/er/x'y": b"4" * 100, "_private/_a": b"", "_private/b c%41.txt": b"5"}
    for name, content in files_.items():
        (root / name).write_bytes(content)
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "secret").write_bytes(b"no")
    (root / "link").symlink_to(tmp_path / "outside" / "secret")
    (root / "folder").symlink_to(tmp_path / "outside")
    (root / "loop").symlink_to(root)
    (root / "broken").symlink_to(root / "gone")
    os.mkfifo(root / "pipe")
    got = {(r.shard_id, r.record_id): (r.content_hash, r.byte_size) for r in files.scan_directory(spark, str(root), streamed=50).collect()}
    assert got == {(n.split("/", 1)[0] if "/" in n else "root", n.split("/", 1)[-1]): (hash_many([c])[0].hex(), len(c)) for n, c in files_.items()}
    again = {r.record_id: r.content_hash for r in files.scan_directory(spark, root.as_uri(), alg="sha256", shard="s", streamed=50).collect()}
    assert again == {n: hashlib.sha256(c).hexdigest() for n, c in files_.items()}
    assert {(r.path, r.size) for r in files.walk(spark, str(root)).collect()} == {(n, len(c)) for n, c in files_.items()}
    assert files.scan_directory(spark, str(root / "none")).count() == 0
    with open(os.fsencode(root) + b"/bad\xff", "wb"):
        pass
    with pytest.raises(Exception, match="no UTF-8"):
        files.scan_directory(spark, str(root)).collect()


def test_streamed_digests():
    data = bytes(i * 7 % 251 for i in range(70_000))
    for n in (0, 1, 1024, 1025, 4096, 4097, 8192, 9000, 12_288, 70_000):
        assert hash_stream(io.BytesIO(data[:n]), 4096) == (hash_many([data[:n]])[0], n)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1"), (2, 'say "x", y')], "k int, t string")
    files.write_csv(df, str(tmp_path / "csv"))
    assert {r.t for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()} == {"'=1+1", 'say "x", y'}
    files.write_canonical_json(spark.createDataFrame([('{"b":1,"a":2}',)], "j string"), "j", str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).first()[0] == json.dumps({"a": 2, "b": 1}, separators=(",", ":"))
    with pytest.raises(Exception, match="no canonical form"):
        files.write_canonical_json(spark.createDataFrame([("{",)], "j string"), "j", str(tmp_path / "bad"))
    new = spark.createDataFrame([(2, "z"), (3, "b"), (3, "a")], df.schema)
    assert [tuple(r) for r in files.insert_or_ignore(df, new, ["k"], ["t"]).collect()] == [(3, "a")]
    assert {tuple(r) for r in files.upsert(df, new, ["k"], ["t"]).collect()} == {(1, "=1+1"), (2, "z"), (3, "b")}


def test_write_once(spark):
    old = spark.createDataFrame([(bytearray(b"a"), bytearray(b"1"))], "key binary, value_hash binary")
    same = spark.createDataFrame([(bytearray(b"a"), bytearray(b"1")), (bytearray(b"b"), bytearray(b"2"))], old.schema)
    assert [bytes(r.key) for r in files.write_once(old, same).collect()] == [b"b"]
    with pytest.raises(Exception, match="another value"):
        files.write_once(old, spark.createDataFrame([(bytearray(b"a"), bytearray(b"9"))], old.schema)).collect()


def test_poseidon_known_value():
    # Fixed value: the hash of (1, 2) that public implementations of these parameters give.
    assert poseidon(1, 2) == 0x115CC0F5E7D690413DF64C6B9662E9CF2A3617F2743245519E19607A4417189A
    assert node(5, 6) == poseidon(poseidon(2, 5), 6) and chain([]) == 0 and chain([7]) == tagged(3, 1, 7) and leaf(bytes(32)) != leaf(bytes(31) + b"\x01")


@pytest.mark.parametrize("n", [1, 2, 3, 8, 13])
def test_snapshot_paths(spark, n):
    data = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    rows = spark.createDataFrame([("g", i, bytearray(d)) for i, d in enumerate(data)], "g string, position int, data binary")
    (r,) = merkle.snapshot_paths(rows, by="g", depth=6, alg="sha256").collect()
    root = bytes(merkle.fixed_depth_roots(rows, by="g", depth=6, alg="sha256").first().root)
    assert bytes(r.root) == root and bytes(r.leaf) == data[-1] and len(r.siblings) == 6
    prev = merkle.zeros("sha256", 6)[6] if n == 1 else bytes(merkle.fixed_depth_roots(rows.filter(F.col("position") < n - 1), by="g", depth=6, alg="sha256").first().root)
    snap = spark.createDataFrame([(bytearray(prev), r.root, r.leaf, r.siblings, n)], "prev_root binary, root binary, leaf binary, siblings array<binary>, size long")
    verdict = lambda df: merkle.append_transition(df, "sha256").first().verdict
    assert verdict(snap) == "valid"
    assert verdict(snap.withColumn("prev_root", F.lit(bytes(32)))) == "not-an-append"
    assert verdict(snap.withColumn("root", F.lit(bytes(32)))) == "root-mismatch"


def test_snapshot_faults(spark):
    rows = spark.createDataFrame([(g, i if (g, i) != ("gap", 2) else 5, bytearray(hashlib.sha256(str(i).encode()).digest())) for g in ("ok", "gap", "size", "leaf", "root") for i in range(3)], "g string, position int, data binary")
    stated = merkle.snapshot_paths(rows, by="g", depth=4, alg="sha256").select("g", F.col("n").alias("size"), "leaf", "root")
    bad = lambda name, c, v: F.when(F.col("g") == name, v).otherwise(F.col(c)).alias(c)
    stated = stated.select("g", bad("size", "size", F.lit(9)), bad("leaf", "leaf", F.lit(bytes(32))), bad("root", "root", F.lit(bytes(32))))
    got = {r.g: r.verdict for r in merkle.snapshot_faults(rows, stated, by="g", depth=4, alg="sha256").collect()}
    assert got == {"ok": "valid", "gap": "not-contiguous", "size": "size-mismatch", "leaf": "leaf-mismatch", "root": "root-mismatch"}

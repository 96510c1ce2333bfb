"""Digests, trees, proofs, canonical JSON, segments: fixed values and brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sealstone.functions import framing
from sealstone.functions.blake3 import blake3, derive_key, hash_equal, hash_many
from sealstone.functions.canonical import NotCanonical, canonical, canonical_json
from sealstone.functions.fields import BN254, canonical_below, canonical_hex
from sealstone.operators import diff, merkle, segments, smt
from sealstone.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_blake3_against_the_jvm(spark):
    jvm = spark._jvm.org.apache.commons.codec.digest.Blake3
    r = random.Random(1)
    sizes = [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3073, 5000, 8193, 33000]
    messages = [r.randbytes(n) for n in sizes]

    def one(h, m):
        h.update(m)
        return bytes(h.doFinalize(32))

    assert hash_many(messages) == [one(jvm.initHash(), m) for m in messages]
    for n in (0, 1, 64, 65, 77, 128, 1024):
        rows = np.frombuffer(r.randbytes(3 * n), np.uint8).reshape(3, n)
        assert [x.tobytes() for x in hash_equal(rows)] == [one(jvm.initHash(), x.tobytes()) for x in rows]
    assert derive_key("a context", messages[:5]) == [one(jvm.initKeyDerivationFunction(b"a context"), m) for m in messages[:5]]
    rows = spark.createDataFrame([(1, bytearray(b"abc")), (2, None)], "k int, m binary").select("k", blake3("m").alias("h")).orderBy("k").collect()
    assert bytes(rows[0].h) == one(jvm.initHash(), b"abc") and rows[1].h is None


def test_fixed_digests(spark):
    key = framing.record_key(F.lit("document"), F.lit("abc"), F.lit(7), "blake3")
    assert bytes(spark.range(1).select(key.alias("k")).first().k).hex() == "151a2e1d110b263ba596902e6360a2142bdfeecc20d0c1d54465eec9ab5d78c8"
    assert smt.empties("blake3")[0].tobytes().hex() == "0c51a9c6fd8dd8847ba1053a17f62943c59052f4e311ab4e93867c4280579f29"


@pytest.mark.parametrize("alg", ["sha256", "blake3"])
def test_seal_prove_verify(spark, alg, monkeypatch):
    r = fx.records(spark, SF).limit(60).cache()
    root = smt.seal(r, alg).first().manifest_root
    pairs = {bytes(x.key): bytes(x.leaf) for x in smt.leaves(r, alg).select("key", "leaf").collect()}
    assert smt.reference_root(pairs, alg).hex() == root
    prefix = {s: hashlib.sha256(framing.SHARD_PREFIX + s.encode()).digest()[:8] if alg == "sha256" else hash_many([framing.SHARD_PREFIX + s.encode()])[0][:8] for s in {x.shard_id for x in r.collect()}}
    for x in smt.seal(r, alg).collect():
        own = {k: v for k, v in pairs.items() if k[:8] == prefix[x.shard_id]}

        def sub(p, depth):
            if not p:
                return smt.empties(alg)[256 - depth].tobytes()
            if depth == 256:
                return next(iter(p.values()))
            left, right = ({k: v for k, v in p.items() if k[depth // 8] >> (7 - depth % 8) & 1 == b} for b in (0, 1))
            return smt.many([framing.NODE + b"|" + sub(left, depth + 1) + b"|" + sub(right, depth + 1)], alg)[0]

        assert sub(own, 64).hex() == x.shard_root
        break
    monkeypatch.setattr(smt, "layout", lambda most, size=0: 3)
    assert smt.seal(r, alg).first().manifest_root == root
    there = r.select("shard_id", "record_id", "version")
    absent = spark.createDataFrame([("src0", "nope", 1), ("zz", "1", 1), ("src1", "5", 9)], there.schema)
    proofs = smt.prove(r, there.union(absent), alg).cache()
    count = lambda df: {(x.kind, x.verdict): x["count"] for x in smt.verify(df, root, alg).groupBy("kind", "verdict").count().collect()}
    assert count(proofs) == {("inclusion", "valid"): 60, ("exclusion", "valid"): 3}
    assert count(proofs.withColumn("manifest_root", F.lit("00" * 32))) == {("inclusion", "root-mismatch"): 60, ("exclusion", "root-mismatch"): 3}
    assert count(proofs.withColumn("kind", F.lit("?"))) == {("?", "kind-mismatch"): 63}
    assert count(proofs.withColumn("version", F.col("version") + 1)) == {("inclusion", "key-mismatch"): 60, ("exclusion", "key-mismatch"): 3}
    stated = proofs.withColumn("committed_hash", F.col("content_hash")).withColumn("content_hash", F.lit("11" * 32))
    assert count(stated.filter("kind = 'inclusion'")) == {("inclusion", "content-mismatch"): 60}
    assert count(proofs.withColumn("siblings", F.concat(F.unhex(F.lit("00" * 32)), F.substring("siblings", 33, 8192)))) == {("inclusion", "proof-invalid"): 60, ("exclusion", "proof-invalid"): 3}
    assert count(proofs.withColumn("siblings", F.substring("siblings", 33, 8192))) == {("inclusion", "proof-invalid"): 60, ("exclusion", "proof-invalid"): 3}


def test_seal_refuses_a_repeated_identity(spark):
    r = fx.records(spark, SF).limit(3)
    with pytest.raises(Exception, match="one key"):
        smt.seal(r.union(r), "sha256").collect()


def test_extended_tree_is_the_whole_one(spark, monkeypatch):
    r = fx.records(spark, SF).limit(90).cache()
    monkeypatch.setattr(smt, "layout", lambda most, size=0: 3)
    first = r.filter("cast(record_id as long) % 3 > 0")
    tree = smt.build(first, "sha256")
    again = smt.extend(tree, r)  # records that are there already change nothing
    assert again.root() == smt.build(r, "sha256").root() == smt.seal(r, "sha256").first().manifest_root
    assert again.leaves.count() == 90 and again.buckets.count() == smt.build(r, "sha256").buckets.count()
    with pytest.raises(Exception, match="another value"):
        smt.extend(tree, first.withColumn("content_hash", F.sha2("content_hash", 256)))
    none = smt.build(r.limit(0), "sha256")
    assert none.root() == smt.empties("sha256")[256].tobytes().hex() and none.seal().count() == 0
    asked = r.select("shard_id", "record_id", "version").limit(2)
    assert {x.verdict for x in smt.verify(smt.prove(none, asked), none.root(), "sha256").collect()} == {"valid"}
    assert {x.verdict for x in smt.verify_in_shard(smt.prove(tree, asked), tree.seal(), "sha256").collect()} == {"valid"}


def test_packed_paths():
    for bits in ([], [1], [0, 1, 1, 0, 1, 0, 0, 1, 1], [1] * 16):
        assert smt.unpack_bits(smt.pack_bits(bits), len(bits)) == bits
    assert smt.pack_bits([1, 0, 1]) == b"\xa0" and smt.unpack_bits(b"\xbf", 3) == [1, 0, 1]
    with pytest.raises(ValueError):
        smt.pack_bits([2])


def test_prefixes_of_keys(spark):
    key = bytes(range(160, 192))
    for depth in (0, 3, 8, 16, 64, 67, 71):
        got = bytes(spark.createDataFrame([(bytearray(key),)], "key binary").select(smt.prefix("key", depth).alias("p")).first().p)
        assert got.ljust(32, b"\0") == smt._cut(key, depth)


def test_streams_of_rows_have_the_digest_of_the_whole(spark, monkeypatch):
    """Heads, parts and chunks of all sizes against the digest of the joined bytes."""
    from sealstone.operators import streams
    from sealstone.sources.tables import table

    r = random.Random(9)
    monkeypatch.setattr(streams, "STEP", 2)
    for n, most, parts, head in ((0, 1, 1, b"h"), (3, 40, 2, b"head"), (40, 900, 3, b"head"), (30, 5000, 6, b""), (400, 90, 9, b"x" * 1024), (5, 2048, 5, b"y" * 24)):
        rows = [(i, bytearray(r.randbytes(r.randint(0, most)))) for i in range(n)]
        df = spark.createDataFrame(rows, "i long, entry binary").repartitionByRange(parts, "i").withColumn("part", F.spark_partition_id())
        assert streams.blake3_of_parts(table(df, "rows"), ["i"], "entry", head) == hash_many([head + b"".join(bytes(x) for _, x in rows)])[0]


def test_a_tree_that_is_too_full_is_an_error(spark):
    rows = spark.createDataFrame([("g", i, bytearray(32)) for i in range(9)], "g string, position int, data binary")
    with pytest.raises(Exception, match="more rows than its tree holds"):
        merkle.fixed_depth_roots(rows, by="g", depth=3, alg="sha256").collect()


def test_ordered_trees(spark):
    one = lambda m: hashlib.sha256(m).digest()
    join = lambda a, b: one(framing.NODE + b"|" + a + b"|" + b)
    for n in (1, 2, 3, 5, 17, 1100):
        data = [one(str(i).encode()) for i in range(n)]
        rows = spark.createDataFrame([("g", i, bytearray(d)) for i, d in enumerate(data)], "g string, position int, data binary")
        level = [one(framing.LEGACY_LEAF + b"|" + d) for d in data]
        while len(level) > 1:
            level = [join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        assert bytes(merkle.binary_roots(rows, by="g", alg="sha256").first().root) == level[0]
        level, empty = list(data), bytes(32)
        for _ in range(20):
            level = [join(level[i], level[i + 1] if i + 1 < len(level) else empty) for i in range(0, len(level), 2)]
            empty = join(empty, empty)
        assert bytes(merkle.fixed_depth_roots(rows, by="g", depth=20, alg="sha256").first().root) == level[0]
        if n > 1:
            level = data + [bytes(32)] * ((1 << (n - 1).bit_length()) - n)
            while len(level) > 1:
                level = [join(level[i], level[i + 1]) for i in range(0, len(level), 2)]
            assert bytes(merkle.zero_padded_roots(rows, by="g", alg="sha256").first().root) == level[0]


def test_diff_root_is_order_free(spark):
    a, b = fx.records(spark, SF), fx.records_v2(spark, SF)
    one = diff.diff_root(diff.diff(a, b)).first()
    assert one == diff.diff_root(diff.diff(a, b).repartition(7).union(diff.diff(a, b))).first()
    assert (one.added, one.removed) == (sum(i % 13 == 0 for i in range(200)), sum(i % 17 == 0 for i in range(200)))
    empty = diff.diff_root(diff.diff(a, a)).first()
    assert (empty.added, empty.diff_root) == (0, hash_many([framing.DIFF + bytes(4)])[0].hex())


def test_canonical_json(spark):
    assert canonical('{"b":1.50e3,"a":[1e21,1e-7,0.000001,-0.0,12300]}') == '{"a":[1e+21,1e-7,0.000001,0,12300],"b":1500}'
    assert canonical('"e\\u0301\\u0001\\n"') == '"é\\u0001\\n"'
    assert canonical('{"\\ud83d\\ude00":1,"\\uffee":2}') == '{"😀":1,"￮":2}'
    assert canonical("100000000000000000000") == "100000000000000000000" and canonical("1000000000000000000000") == "1e+21"
    for bad in ('{"a":1,"a":2}', '{"é":1,"e\\u0301":2}', "NaN", "01", "[1,]", '"\\ud800"', "{} x", b"\xff", '"\x01"', "1e999999999999999999999", "[" * 66 + "]" * 66):
        with pytest.raises(NotCanonical):
            canonical(bad)
    rows = spark.createDataFrame([("[1.0]",), (None,), ("{",)], "t string").select(canonical_json("t").alias("c")).collect()
    assert [r.c for r in rows] == ["[1]", None, None]


def test_field_texts(spark):
    rows = [("0", True), ("01", False), (BN254, False), (str(int(BN254) - 1), True), ("-1", False), ("9" * 77, False)]
    out = spark.createDataFrame(rows, "t string, want boolean").select("want", canonical_below(F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in out)
    assert spark.range(1).select(canonical_hex(F.lit("f" * 64)).alias("a"), canonical_hex(F.lit("0" * 64)).alias("b")).first() == (False, True)


def test_segments_round_trip(spark):
    docs = spark.createDataFrame([(1, "a\nbé\n\nc"), (2, ""), (3, None), (4, "one line"), (5, "x\n" * 10)], "doc_id long, text string")
    for most in (65536, 3):
        s = segments.segments(docs, most=most)
        got = {}
        for r in s.orderBy("doc_id", "segment_id").collect():
            at = got.setdefault(r.doc_id, b"")
            assert r.byte_offset == len(at) and r.byte_length == len(r.content.encode())
            got[r.doc_id] = at + r.content.encode()
        assert got == {1: "a\nbé\n\nc".encode(), 4: b"one line", 5: b"x\n" * 10}
    assert segments.segments(docs, most=3).filter("doc_id = 5").count() == 3
    s = segments.segments(docs)
    out = segments.reemit(s, F.col("segment_id") == 1).filter("doc_id = 1").orderBy("segment_id").collect()
    assert [r.emitted for r in out] == ["a\n", "[REDACTED]\n", "\n", "c"] and [r.artifact_offset for r in out] == [0, 2, 13, 14]
    assert segments.unknown_segments(spark.createDataFrame([(1, 9), (1, 0)], "doc_id long, segment_id int"), s).count() == 1
    kinds = spark.createDataFrame([(bytearray(b"%PDF-1"),), (bytearray(b"text"),), (bytearray(b"\xff\xfe"),), (bytearray(b""),), (bytearray(b"PK\x03\x04..[Content_Types].xml"),)], "b binary").select(segments.detect_format(F.col("b")).alias("f")).collect()
    assert [r.f for r in kinds] == ["pdf", "text", None, None, "ooxml"]


def plain_siblings(pairs, query, alg, low):
    """Siblings from the leaf up to depth ``low``, each by recursion over the leaves below it."""
    bits = lambda k: "".join(f"{x:08b}" for x in k)
    own, out = bits(query), []
    for depth in range(256, low, -1):
        beside = own[: depth - 1] + ("0" if own[depth - 1] == "1" else "1")
        out.append(smt.reference_root({k: v for k, v in pairs.items() if bits(k).startswith(beside)}, alg, depth))
    return b"".join(out)


def test_siblings_are_read_off_the_branches():
    """Keys that part early, late and anywhere between, and absent ones that part from them anywhere."""
    r, low = random.Random(9), 64
    base = [bytes(8) + r.randbytes(24) for _ in range(5)]

    def flipped(key):
        at = r.randrange(low, 256)
        return bytes(x ^ (128 >> at % 8 if i == at // 8 else 0) for i, x in enumerate(key))

    for n in (0, 1, 2, 14):
        keys = list(base[: min(n, 5)])
        while len(keys) < n:
            keys.append(flipped(r.choice(keys)))
        keys = sorted(set(keys))
        pairs = {k: r.randbytes(32) for k in keys}
        matrix, splits = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 32), []
        if keys:
            smt.fold(matrix, np.frombuffer(b"".join(pairs[k] for k in keys), np.uint8).reshape(-1, 32), 256, low, "sha256", None, lambda d, first, a, b: splits.extend((smt._cut(keys[i], d), d, x.tobytes(), y.tobytes()) for i, x, y in zip(first.tolist(), a, b)))
        assert len(splits) == max(0, len(keys) - 1)
        queries = [*keys, *(flipped(k) for k in keys for _ in range(4)), base[0], bytes(8) + r.randbytes(24)]
        above = r.randbytes(32 * low)
        rows = [(k, 256, pairs[k], k[::-1]) for k in keys] + splits + [(bytes(8) + bytes(24), -1, above, b"r" * 32)]
        table = pa.table({c: pa.chunked_array([pa.array([x[i] for x in rows], t)]) for i, (c, t) in enumerate((("key", pa.binary()), ("depth", pa.int32()), ("left", pa.binary()), ("right", pa.binary())))})
        got = smt._prover(low, "sha256", ["key"])(table, pa.table({"key": pa.chunked_array([pa.array(queries, pa.binary())])})).to_pylist()
        for q, x in zip(queries, got, strict=True):
            assert x["key"] == q and x["value"] == (q[::-1] if q in pairs else None) and x["shard_root"] == b"r" * 32
            assert x["siblings"] == plain_siblings(pairs, q, "sha256", low) + above


def test_trees_of_many_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(smt, "BUCKET", 4)
    records = spark.range(300).selectExpr("concat('s', id % 3) shard_id", "cast(id as string) record_id", "1L version", "sha2(cast(id as string), 256) content_hash", "id byte_size")
    tree = smt.build(records, "sha256")
    assert tree.bits > 3 and tree.branches.count() == 300 - tree.buckets.count()
    pairs = {bytes(x.key): bytes(x.leaf) for x in tree.leaves.collect()}
    assert tree.root() == smt.reference_root(pairs, "sha256").hex()
    extended = smt.extend(smt.build(records.filter("byte_size < 270"), "sha256"), records)
    asked = records.select("shard_id", "record_id", "version")
    asked = asked.union(asked.selectExpr("shard_id", "concat(record_id, '-')", "version"))
    for t in (tree, extended):
        assert t.root() == tree.root()
        got = smt.verify(smt.prove(t, asked), tree.root(), "sha256").groupBy("kind", "verdict").count().collect()
        assert {(x.kind, x.verdict): x["count"] for x in got} == {("inclusion", "valid"): 300, ("exclusion", "valid"): 300}


def test_a_stored_tree_reads_what_is_asked_for(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(smt, "BUCKET", 16)
    records = spark.range(600).selectExpr("concat('s', id % 3) shard_id", "cast(id as string) record_id", "1L version", "sha2(cast(id as string), 256) content_hash", "id byte_size")
    tree = smt.build(records.filter("byte_size < 560"), "sha256")
    whole = smt.build(records, "sha256")
    ask = lambda rows: rows.select("shard_id", "record_id", "version")
    absent = ask(records.withColumn("record_id", F.concat("record_id", F.lit("-"))))
    for most in (0, 2, 1024):  # all deep branches kept, some, none
        tree.store(f"{tmp_path}/{most}", most)
        stored = smt.load(spark, f"{tmp_path}/{most}")
        assert stored.branches.count() + (0 if most else 1) > 0 and (stored.branches.count() == tree.branches.count()) == (most == 0)
        assert stored.root() == tree.root() and stored.seal().count() == 3
        got = smt.verify(smt.prove(stored, ask(records.filter("byte_size < 560")).union(absent)), tree.root(), "sha256").groupBy("kind", "verdict").count().collect()
        assert {(x.kind, x.verdict): x["count"] for x in got} == {("inclusion", "valid"): 560, ("exclusion", "valid"): 600}
        longer = smt.extend(stored, records)
        assert longer.root() == whole.root() and longer.leaves.count() == 600
        got = smt.verify(smt.prove(longer, ask(records).union(absent)), whole.root(), "sha256").groupBy("kind", "verdict").count().collect()
        assert {(x.kind, x.verdict): x["count"] for x in got} == {("inclusion", "valid"): 600, ("exclusion", "valid"): 600}
    one = spark.createDataFrame([("s1", "x", 1, "00" * 32, 5)], records.schema)
    with pytest.raises(Exception, match="another value"):
        smt.extend(stored, records.filter("record_id = '5'").withColumn("content_hash", F.sha2("content_hash", 256)))
    few = smt.extend(stored, one)
    key = smt.leaves(one, "sha256").select(smt.part_of("key", stored.bits).alias("p")).first().p
    plan = stored.near(stored.leaves, smt.leaves(one, "sha256"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and f"= {key})" in plan
    assert few.leaves.count() == 561


@pytest.mark.parametrize("alg", ["sha256", "blake3", "poseidon"])
def test_every_append_has_its_root_and_path(spark, monkeypatch, alg):
    """Against inserting leaf after leaf; runs of one, two and more levels."""
    r, depth, sizes = random.Random(3), 7, {"a": 1, "b": 2, "c": 37 if alg == "poseidon" else 128, "d": 16}
    data = {k: [bytes(1) + r.randbytes(31) for _ in range(n)] for k, n in sizes.items()}
    rows = spark.createDataFrame([(k, i * 3, x) for k, xs in data.items() for i, x in enumerate(xs)], "g string, position long, data binary")
    empty, want = merkle.zeros(alg, depth), {}
    for k, xs in data.items():
        tree = {}
        for i, x in enumerate(xs):
            node, path = x, []
            for h in range(depth):
                tree[h, i >> h] = node
                beside = tree.get((h, i >> h ^ 1), empty[h])
                path.append(beside)
                node = merkle.parents([(beside, node) if i >> h & 1 else (node, beside)], alg)[0]
            want[k, i] = (x, path, node)
    for step in (1, 3, 10):
        monkeypatch.setattr(merkle, "STEP", step)
        got = {(x.g, x.i): (bytes(x.leaf), [bytes(s) for s in x.siblings], bytes(x.root)) for x in merkle.append_paths(rows, by="g", depth=depth, alg=alg).collect()}
        assert got == want
    assert merkle.append_paths(rows.limit(0), by="g", depth=depth, alg=alg).count() == 0


def test_digest_of_a_difference_in_one_task_and_in_many(spark, monkeypatch):
    import struct

    a, b = fx.records(spark, SF), fx.records_v2(spark, SF)
    rows = diff.diff(a, b)
    lp = lambda x: struct.pack(">I", len(x.encode())) + x.encode()
    found = sorted({(r.kind, r.shard_id, r.record_id, r.version, r.content_hash) for r in rows.collect()})
    body = b"".join(bytes([k]) + lp(s) + lp(i) + struct.pack(">Q", v) + bytes.fromhex(h) for k, s, i, v, h in found)
    whole = framing.DIFF + struct.pack(">I", len(found)) + body
    for piece in (32 << 20, 300):
        monkeypatch.setattr(diff, "PIECE", piece)
        assert diff.diff_root(rows).first().diff_root == hash_many([whole])[0].hex()
        assert diff.diff_root(rows, "sha256").first().diff_root == hashlib.sha256(whole).hexdigest()
    none = framing.DIFF + bytes(4)
    assert diff.diff_root(rows.limit(0)).first().diff_root == hash_many([none])[0].hex() and diff.diff_root(rows.limit(0), "sha256").first().diff_root == hashlib.sha256(none).hexdigest()


def test_trees_follow_one_another(spark):
    """More leaves than a tree holds: each full tree is followed by the next, and paths and roots are those within each."""
    rows = [(g, i, hashlib.sha256(f"{g}{i}".encode()).digest()) for g, n in (("a", 19), ("b", 8), ("c", 1)) for i in range(n)]
    leaves = merkle.in_trees(spark.createDataFrame(rows, "g string, position long, data binary"), by="g", depth=3)
    node = lambda a, b: hashlib.sha256(b"OLY:NODE:V1|" + a + b"|" + b).digest()

    def root(level: list[bytes]) -> bytes:
        level = level + [bytes(32)] * (8 - len(level))
        while len(level) > 1:
            level = [node(*level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0]

    want = {(g, k): (root([x for h, i, x in rows if h == g and i >> 3 == k]), sum(h == g and i >> 3 == k for h, i, _ in rows)) for g, i, _ in rows for k in [i >> 3]}
    roots = {(r.tree.g, r.tree.number): (bytes(r.root), r.n) for r in merkle.fixed_depth_roots(leaves, by="tree", depth=3, alg="sha256").collect()}
    assert roots == want
    last = {(r.tree.g, r.tree.number): (bytes(r.root), r.n) for r in merkle.snapshot_paths(leaves, by="tree", depth=3, alg="sha256").collect()}
    assert last == want
    paths = merkle.append_paths(leaves, by="tree", depth=3, alg="sha256").collect()
    assert len(paths) == len(rows)
    for r in paths:
        assert bytes(r.root) == root([x for h, i, x in rows if h == r.tree.g and i >> 3 == r.tree.number and i & 7 <= r.i])


@pytest.mark.parametrize("name", ["snapshot_append_roots", "snapshot_append_transition", "snapshot_validation", "append_paths_sha256", "append_transitions"])
def test_more_snapshots_than_a_tree_holds(spark, monkeypatch, name):
    """With trees of 64 leaves every shard fills some, and the queries still give a row, or path, for all."""
    from sealstone.plans import analytics, catalog

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(analytics, "SNAPSHOT_DEPTH", 6)
    held = {r.event_type: r["count"] for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()}
    assert max(held.values()) > 64
    got = catalog.QUERIES[name](spark, sf).collect()
    if name == "snapshot_append_roots":
        assert sorted(r.shard_id for r in got) == sorted(s for s, n in held.items() for _ in range(-(-n // 64))) and all(r.n == held[r.shard_id] for r in got)
    elif name == "append_paths_sha256":
        assert sorted((r.shard_id, r.i) for r in got) == sorted((s, i) for s, n in held.items() for i in range(n))
    else:
        verdicts = {r.shard_id: r.verdict for r in got}
        want = {"click": "size-mismatch", "signup": "not-contiguous", "view": "leaf-mismatch", "error": "root-mismatch"} if name == "snapshot_validation" else {"click": "not-an-append", "view": "root-mismatch"}
        assert len(got) == len(held) and verdicts == {s: want.get(s, "valid") for s in held}


def test_proofs_folded_a_few_at_a_time(spark, monkeypatch):
    """The node that siblings lead to does not depend on how many proofs are folded at once; a null leaf is an empty one, siblings of another length have no node."""
    r = random.Random(8)
    rows = [(i, r.randbytes(32), None if i == 2 else r.randbytes(32), r.randbytes(32 * (3 if i != 3 else 2)) if i != 4 else None) for i in range(6)]
    want = {}
    for i, key, start, siblings in rows:
        state = start or smt.empties("sha256")[0].tobytes()
        for level in range(3):
            other = (siblings or b"")[32 * level : 32 * level + 32]
            pair = (other, state) if key[31] >> level & 1 else (state, other)
            state = hashlib.sha256(b"OLY:NODE:V1|" + pair[0] + b"|" + pair[1]).digest()
        want[i] = state if siblings and len(siblings) == 96 else None
    df = spark.createDataFrame(rows, "i int, key binary, start binary, siblings binary").coalesce(1)
    for few in (2, 4096):
        monkeypatch.setattr(smt, "FOLDED", few)
        got = {x.i: x.node and bytes(x.node) for x in df.select("i", smt.folded(F.col("key"), F.col("start"), F.col("siblings"), 3, "sha256").alias("node")).collect()}
        assert got == want


def test_paths_are_verified_where_they_are_made(spark, monkeypatch):
    """Of every append's path only roots are written and joined: no table of this query holds siblings."""
    from sealstone.plans import analytics, catalog

    written = []
    for module in (analytics, merkle):
        monkeypatch.setattr(module, "table", lambda df, name, f=module.table: written.append((name, df.columns)) or f(df, name))
    monkeypatch.setattr(merkle, "STEP", 6)  # some shards are several runs
    got = {r.shard_id: (r.verdict, r.n) for r in catalog.QUERIES["append_transitions"](spark, "/root/testdata/sf0.001").collect()}
    held = {r.event_type: r["count"] for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy("event_type").count().collect()}
    assert got == {s: ({"click": "not-an-append", "view": "root-mismatch"}.get(s, "valid"), n) for s, n in held.items()} and max(held.values()) > 64
    assert {"append-roots", "runs"} <= {name for name, _ in written} and not any("siblings" in columns for _, columns in written)


def test_paths_of_any_length_and_width(spark, monkeypatch):
    """Folded in pieces, beside nulls and paths of other lengths; hashes that are not of 32 bytes have nodes too."""
    r = random.Random(12)
    for width in (32, 20):
        rows = [(i, bytearray(r.randbytes(width)) if i != 3 else None, [bytearray(r.randbytes(width)) for _ in range(i % 5)] if i != 4 else None, r.randrange(32) if i != 5 else None) for i in range(13)]
        want = {}
        for i, leaf, path, place in rows:
            state = None if None in (leaf, path, place) else bytes(leaf)
            for h, x in enumerate(path or []) if state else ():
                a, b = (bytes(x), state) if place >> h & 1 else (state, bytes(x))
                state = hashlib.sha256(b"OLY:NODE:V1|" + a + b"|" + b).digest()
            want[i] = state
        df = spark.createDataFrame(rows, "i int, leaf binary, path array<binary>, place long").coalesce(1)
        for few in (3, 4096):
            monkeypatch.setattr(merkle, "PATHS", few)
            assert {x.i: x.node and bytes(x.node) for x in df.select("i", merkle.fold_path(F.col("leaf"), F.col("path"), F.col("place"), "sha256").alias("node")).collect()} == want

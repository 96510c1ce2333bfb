"""Chunks of a file: mask, redaction in place, root and commitments."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from sealstone.functions import lanes
from sealstone.functions import poseidon as field
from sealstone.functions.blake3 import hash_many
from sealstone.operators import chunks

RANGES = "array<struct<s: bigint, e: bigint>>"


def test_masks(spark):
    rows = [
        ("one", 32, [(0, 1)], "0111111111111111"), ("edge", 32, [(1, 3), (30, 32)], "0011111111111110"), ("short", 3, [(0, 2)], "0011111111111111"),
        ("all", 3, [(0, 3)], None), ("none", 32, [], None), ("empty", 0, [(0, 1)], None), ("beyond", 8, [(0, 9)], None), ("inverted", 8, [(4, 4)], None),
    ]
    out = spark.createDataFrame(rows, f"k string, n long, r {RANGES}, want string").select("k", "want", F.array_join(chunks.reveal_mask(F.col("n"), F.col("r")).cast("array<string>"), "").alias("got")).collect()
    assert all(r.got == r.want for r in out), out


def test_redaction_in_place(spark):
    rows = [(bytearray(b"0123456789"), [(2, 4), (9, 10)], b"01\0\x00456789"[:9] + b"\0"), (bytearray("é日".encode()), [(0, 5)], bytes(5))]
    out = spark.createDataFrame([(a, b) for a, b, _ in rows], f"c binary, r {RANGES}").select(chunks.redact_ranges(F.col("c"), F.col("r")).alias("x")).collect()
    assert [bytes(r.x) for r in out] == [bytes(w) for _, _, w in rows]


def test_chunk_tree(spark):
    data = bytes(range(100))
    size = 7
    want = [hash_many([data[i * size : (i + 1) * size].ljust(size, b"\0")])[0] for i in range(16)]
    row = spark.createDataFrame([(bytearray(data),)], "c binary")
    got = row.select(*(chunks.chunk_hash(F.col("c"), F.lit(i)).alias(f"h{i}") for i in range(16)))
    assert [bytes(x) for x in got.first()] == want
    assert bytes(row.select(chunks.chunk_hash(F.col("c"), F.lit(3), "sha256").alias("h")).first().h) == hashlib.sha256(data[21:28]).digest()
    level = [field.leaf(h) for h in want]
    while len(level) > 1:
        level = [field.tagged(1, level[i], level[i + 1]) for i in range(0, len(level), 2)]
    assert got.select(chunks.chunk_root(F.array(*(f"h{i}" for i in range(16)))).alias("r")).first().r == str(level[0])


def test_commitments():
    a, b = chunks.commitments([5, 6], [1, 0], 1)
    assert a == field.tagged(3, field.tagged(3, 1, 5), 0) and b == field.tagged(4, field.tagged(4, 0, 1), 0)


def test_commitments_as_columns(spark):
    r = random.Random(4)
    hashes = [[r.randbytes(32) for _ in range(16)] for _ in range(3)]
    masks = [[1] * 16, [0] * 16, [r.randrange(2) for _ in range(16)]]
    rows = list(zip(range(3), hashes, masks)) + [(3, None, masks[0]), (4, hashes[0], None), (5, hashes[0][:15], masks[0]), (6, hashes[0], [2] * 16)]
    out = {x.k: x.c for x in spark.createDataFrame(rows, "k int, h array<binary>, m array<int>").select("k", chunks.commitment_columns(F.col("h"), F.col("m")).alias("c")).collect()}
    for k in range(3):
        a, b = chunks.commitments([field.leaf(h) for h in hashes[k]], masks[k], sum(masks[k]))
        assert (out[k].leaves, out[k].mask) == (str(a), str(b))
    assert all(out[k].leaves is None and out[k].mask is None for k in (3, 4, 5, 6))


def test_poseidon_with_fewer_products():
    r = random.Random(5)
    for a, b in [(0, 0), (field.P - 1, field.P + 3), *((r.randrange(field.P), r.randrange(field.P)) for _ in range(60))]:
        assert field.poseidon(a, b) == field.poseidon_plain(a, b)


def test_hashes_of_a_batch_go_through_together(spark, monkeypatch):
    """BLAKE3 is called once for many rows, not once a chunk; a mask's commitment is made once; a null hash has no result."""
    calls, real = [], field.tagged
    hashes = [[bytes([k, i] * 16) for i in range(16)] for k in range(3)]
    monkeypatch.setattr("sealstone.functions.blake3.hash_many", lambda m, f=__import__("sealstone.functions.blake3", fromlist=["x"]).hash_many: calls.append(len(m)) or f(m))
    rows = chunks._leaves([*hashes, None])
    assert calls == [48] and rows[3] is None
    monkeypatch.undo()
    assert rows[:3] == [[field.leaf(h) for h in row] for row in hashes]
    made = []
    monkeypatch.setattr(field, "tagged", lambda d, a, b: made.append(d) or real(d, a, b))
    mask = [1, 0, 0, 1, 1, 0, 1, 1, 0, 0, 0, 1, 0, 1, 1, 1]
    assert chunks.commitments(rows[0], mask, 8) == chunks.commitments(rows[0], mask, 8)
    assert made.count(field.MASK) <= 16 and made.count(field.COMMITMENT) == 32
    monkeypatch.undo()
    got = spark.createDataFrame([(0, [*hashes[0][:15], None]), (1, hashes[0])], "k int, h array<binary>")
    out = {r.k: (r.root, r.c.leaves) for r in got.select("k", chunks.chunk_root("h").alias("root"), chunks.commitment_columns(F.col("h"), F.array(*[F.lit(1)] * 16)).alias("c")).collect()}
    assert out[0] == (None, None) and None not in out[1]


def test_poseidon_by_lanes(monkeypatch):
    """Many pairs at once have the hashes of each by the definition, whatever the number of lanes; numbers at and beyond the order, and 0, among them."""
    r = random.Random(9)
    edge = [0, 1, field.P - 1, field.P, field.P // 2, field.P // 2 + 1, 2**256 - 1, 1 << 253]
    a, b = [*edge, *(r.randrange(1 << 256) for _ in range(32))], [*reversed(edge), *(r.randrange(field.P) for _ in range(32))]
    assert lanes.numbers(lanes.elements(a)) == [x % field.P for x in a]
    want = [field.poseidon_plain(x, y) for x, y in zip(a, b)]
    for few in (1024, 7):
        monkeypatch.setattr(lanes, "LANES", few)
        assert lanes.numbers(lanes.hashed(lanes.elements(a), lanes.elements(b))) == want
    assert lanes.numbers(lanes.hashed(3, lanes.elements(b))) == [field.poseidon_plain(3, y) for y in b]
    monkeypatch.setattr(field, "MANY", 1)
    assert field.nodes(list(zip(a, b))) == [field.node(x, y) for x, y in zip(a, b)]
    assert field.leaves([bytes([i] * 32) for i in range(5)]) == [field.poseidon(field.LEAF, int.from_bytes(h, "big")) for h in hash_many([field.FIELD_ELEMENT + bytes([i] * 32) for i in range(5)])]


def test_sums_of_lanes_are_exact():
    """No sum of a map, its quotient times the order taken away, and none of the products reaches 2 ** 53 of its unit."""
    known, half = lanes.bases(), float(1 << 23)
    limb = np.array([*[2.0**lanes.BITS] * (lanes.LIMBS - 1), 2.0**26])
    terms = np.array([half] * lanes.BASE + [lanes.BASE])
    for name, all_ in lanes.maps().items():
        for m in all_:
            if name == "start":
                held = np.concatenate([np.ldexp(limb, lanes.BITS * np.arange(lanes.LIMBS))] * 2 + [[1]])
            else:  # rows of ones stand behind two elements (partial rounds), or last
                n = m.shape[1] // lanes.TERMS
                held = np.concatenate([terms] * 2 + [[1]] + [terms] * (n - 2)) if name in ("steps", "both") else np.concatenate([terms] * n + [[1]])
            size, at = np.abs(m) @ held, 0
            both, base = lanes.BOTH, lanes.BASE
            for rows in [base] if name == "end" else {2 * base + 2: [base] * 2, both + 2 * base + 3: [both, base, base]}.get(len(m)) or [both] * (len(m) // (both + 1)):
                order, unit = (np.abs(lanes._order()[:, 0]), np.ldexp(1.0, lanes.BITS * np.arange(rows))) if name == "end" else (half, 1.0)
                assert ((size[at : at + rows] + (size[at + rows] + 1) * order) / unit).max() < 2.0**53, name
                at += rows + 1
            assert at == len(m)
    assert half * half + np.abs(known.added).sum(axis=1).max() * half < 2.0**53 and (np.abs(known.back) @ terms).max() < 2.0**53
    assert known.by_a > 64 * field.P and known.by_b > 64 * field.P  # a product stays within six orders


def test_rows_are_hashed_together(monkeypatch):
    """Roots and commitments of many rows take no hash of a single pair but those of new masks, and are those made pair by pair."""
    import pandas as pd

    r = random.Random(14)
    hashes = pd.Series([[r.randbytes(32) for _ in range(16)] for _ in range(70)])
    masks = pd.Series([[(k + x) % 3 > 0 for x in range(16)] for k in range(70)])
    hashes.iloc[3] = masks.iloc[5] = None
    want, real, calls = {}, field.poseidon, []
    for k in (0, 1, 69):
        level = chunks._leaves([hashes[k]])[0]
        a, b = chunks.commitments([x * m for x, m in zip(level, masks[k])], [int(m) for m in masks[k]], sum(masks[k]))
        while len(level) > 1:
            level = [field.tagged(field.LEAF, *level[i : i + 2]) for i in range(0, len(level), 2)]
        want[k] = (str(level[0]), str(a), str(b))
    chunks.mask_commitment.cache_clear()
    monkeypatch.setattr(field, "poseidon", lambda *a: calls.append(a) or real(*a))
    monkeypatch.setattr(chunks, "ROWS", 30)
    roots, made = chunks.chunk_root.func(hashes), chunks.commitment_columns.func(hashes, masks)
    assert len(calls) <= 3 * 16 * 2
    assert {k: (roots[k], made.leaves[k], made["mask"][k]) for k in want} == want
    assert [k for k in range(70) if roots[k] is None] == [3] and [k for k in range(70) if made.leaves[k] is None and made["mask"][k] is None] == [3, 5]

"""Manifests, bindings, updates, approvals and packed paths: named cases and plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sealstone.functions.canonical import nfc
from sealstone.operators import bindings, merkle, segments, smt
from sealstone.plans import catalog

SF = "/root/testdata/sf0.001"


def manifest(**changes):
    shards = [{"shard_id": "a", "shard_root": "0" * 64, "record_count": 2, "byte_size": 9}, {"shard_id": "b", "shard_root": "1" * 64, "record_count": 3}]
    return {"schema": "s/v1", "dataset_id": "d", "version": 1, "created_at": 5, "metadata": {"name": "n"}, "shards": shards, "manifest_root": "2" * 64, "record_count": 5} | changes


def test_manifests(spark):
    good = manifest()
    texts = {
        "ok": json.dumps(good), "parent": json.dumps(manifest(parent={"version": 1, "manifest_root": "f" * 64}, diff={"added": 1, "removed": 0, "diff_root": "e" * 64})), "unknown field": json.dumps(manifest(more=[1])), "empty": json.dumps(manifest(shards=[], record_count=0)),
        "null": None, "text": "no", "cut": json.dumps(good)[:-4], "kind": json.dumps(manifest(version="one")), "list": "[1]", "no shards": json.dumps({k: v for k, v in good.items() if k != "shards"}), "no root in shard": json.dumps(manifest(shards=[{"shard_id": "a", "record_count": 5}])),
        "half parent": json.dumps(manifest(parent={"version": 1})), "schema": json.dumps(manifest(schema="s/v2")), "upper": json.dumps(manifest(manifest_root="A" * 64)), "short": json.dumps(manifest(diff={"added": 1, "removed": 1, "diff_root": "a"})), "count": json.dumps(manifest(record_count=6)), "order": json.dumps(manifest(shards=good["shards"][::-1])), "twice": json.dumps(manifest(shards=[good["shards"][0]] * 2, record_count=4)),
    }
    rows = spark.createDataFrame(list(texts.items()), "id string, json string")
    got = {r.id: (r.verdict, r.manifest) for r in bindings.parse_manifests(rows, key="id", schema_name="s/v1").collect()}
    want = dict.fromkeys(("ok", "parent", "unknown field", "empty"), "ok") | dict.fromkeys(("null", "text", "cut", "kind", "list"), "not-json") | dict.fromkeys(("no shards", "no root in shard", "half parent"), "missing-field")
    assert {k: v for k, (v, _) in got.items()} == want | {"schema": "other-schema", "upper": "bad-root", "short": "bad-root", "count": "bad-count", "order": "bad-order", "twice": "bad-order"}
    assert got["ok"][1].shards[0].byte_size == 9 and got["ok"][1].parent is None and got["parent"][1].diff.added == 1
    assert {r.verdict for r in bindings.parse_manifests(rows.filter("id = 'schema'"), key="id").collect()} == {"ok"} and bindings.parse_manifests(rows.limit(0), key="id").count() == 0


def test_all_binding_verdicts_occur(spark):
    assert {r.verdict for r in catalog.QUERIES["anchor_bindings"](spark, SF).collect()} >= {"bound", "other-root", "other-shard", "unknown-content"}
    records = spark.createDataFrame([("h", "s", "AB", True, 2, 1), ("h", "s", "ab", True, 1, 2), ("h", "s", "ab", False, 0, 3), ("g", "s", "ab", False, 0, 4), ("g", "s", None, True, 0, 5), (None, "s", "ab", True, 0, 6)], "content_hash string, shard_id string, original_root string, snapshot_committed boolean, ts long, proof_id long")
    asked = spark.createDataFrame([(1, "h", "s", "Ab"), (2, "h", "s", "cd"), (3, "h", "t", "ab"), (4, "g", "s", "ab"), (5, "x", "s", "ab"), (6, None, "s", "ab"), (7, "h", "s", None)], "id long, content_hash string, shard_id string, original_root string")
    got = {r.id: (r.verdict, r.proof_id) for r in bindings.anchor_bindings(asked, records).collect()}
    assert got == {1: ("bound", 2), 2: ("other-root", None), 3: ("other-shard", None), 4: ("not-committed", None), 5: ("unknown-content", None), 6: ("unknown-content", None), 7: ("other-root", None)}


def test_an_update_with_two_outcomes_is_an_error(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, t string, v int")
    one = spark.createDataFrame([(2, None), (9, "z")], "k int, t string")
    assert {tuple(r) for r in bindings.update_from(rows, one, keys=["k"], columns=["t"]).collect()} == {(1, "a", 5), (2, None, 6)}
    with pytest.raises(Exception, match="more than one change"):
        bindings.update_from(rows, one.union(one), keys=["k"], columns=["t"]).collect()


def test_a_chain_is_accepted_up_to_its_first_fault(spark):
    links = spark.createDataFrame([("c", 1, 2, "valid"), ("c", 2, 1, "valid"), ("c", 3, 1, "valid"), ("c", 4, 1, "valid"), ("d", 1, 1, "missing-genesis"), ("d", 2, 1, "valid"), ("e", 1, 0, "valid")], "chain_id string, sequence long, threshold long, verdict string")
    members = spark.createDataFrame([("c", s, m) for s, ms in ((1, "ab"), (2, "b"), (3, "x"), (4, "x")) for m in ms] + [("d", 1, "a")], "chain_id string, sequence long, signer string")
    votes = [("c", 1, "a", True), ("c", 1, "b", True), ("c", 1, "b", True), ("c", 2, "a", True), ("c", 2, "b", True), ("c", 3, "b", True), ("c", 4, "x", False), ("c", 4, "b", True), ("d", 1, "a", True), ("d", 2, "a", True)]
    out = bindings.approved_chain(links, spark.createDataFrame(votes, "chain_id string, sequence long, signer string, valid boolean"), members).collect()
    assert {(r.chain_id, r.sequence): (r.n_approvals, r.accepted) for r in out} == {("c", 1): (2, True), ("c", 2): (2, True), ("c", 3): (1, True), ("c", 4): (0, False), ("d", 1): (1, False), ("d", 2): (1, False), ("e", 1): (0, False)}


def test_paths_in_columns_are_those_of_lists(spark):
    r = random.Random(6)
    paths = [[r.randrange(2) for _ in range(n)] for n in (0, 1, 7, 8, 9, 63, 256)]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)] + [(90, None), (91, [0, 2]), (92, [None])], "i int, bits array<int>")
    out = {x.i: x for x in rows.withColumn("raw", bindings.packed_path(F.col("bits"))).withColumn("again", bindings.unpacked_path(F.col("raw"), F.size("bits"))).collect()}
    assert all(bytes(out[i].raw) == smt.pack_bits(p) and out[i].again == p for i, p in enumerate(paths)) and all(out[i].raw is None for i in (90, 91, 92))
    assert spark.createDataFrame([(bytearray(b"a"),)], "b binary").select(bindings.unpacked_path(F.col("b"), F.lit(9)).alias("x")).first().x is None


def test_composed_form(spark):
    assert [r.x for r in spark.createDataFrame([("é",), (None,), ("",), ("Å",)], "t string").select(nfc(F.col("t")).alias("x")).collect()] == ["é", None, "", "Å"]


def test_bundle_structure(spark):
    rows = [("good", i, i, 10 * i, 10) for i in range(3)] + [("gap", 0, 0, 0, 10), ("gap", 1, 1, 11, 5)] + [("back", 0, 2, 0, 5), ("back", 1, 1, 5, 5)] + [("twice", 0, 1, 0, 5), ("twice", 1, 1, 5, 5)] + [("late", 0, 0, 3, 5)]
    out = segments.structure_faults(spark.createDataFrame(rows, "doc_id string, seq long, segment_id long, byte_offset long, byte_length long"))
    assert {r.doc_id: (r.bad_order, r.gap) for r in out.collect()} == {"good": (False, False), "gap": (False, True), "back": (True, False), "twice": (True, False), "late": (False, True)}


@pytest.mark.parametrize("alg", ["sha256", "blake3", "poseidon"])
def test_zero_padded_trees_like_a_plain_one(spark, alg):
    r = random.Random(8)
    groups = {n: [bytes(1) + r.randbytes(31) for _ in range(n)] for n in (0, 1, 2, 3, 5, 8, 9, 40)}
    rows = spark.createDataFrame([(n, i, x) for n, xs in groups.items() for i, x in enumerate(xs)], "g long, position long, data binary")

    def plain(level):
        level = level + [bytes(32)] * ((1 << (len(level) - 1).bit_length()) - len(level))
        while len(level) > 1:
            level = merkle.parents([(level[i], level[i + 1]) for i in range(0, len(level), 2)], alg)
        return level[0]

    got = {x.g: bytes(x.root) for x in merkle.zero_padded_roots(rows, by="g", alg=alg).collect()}
    assert got == {n: plain(xs) for n, xs in groups.items() if n >= 2}

"""Office packages against archives made here."""

import hashlib
import io
import random
import struct
import zipfile

import pytest

from sealstone.functions.blake3 import hash_many
from sealstone.operators import packages
from sealstone.operators.merkle import parents
from sealstone.sources.fixtures import RELATIONS

TYPES = ("[Content_Types].xml", b"<Types/>")
RELS = ("_rels/.rels", RELATIONS.encode())


def archive(parts, method=zipfile.ZIP_DEFLATED, folders=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for f in folders:
            z.mkdir(f)
        for name, payload in parts:
            z.writestr(name, payload)
    return out.getvalue()


def sample(secret=b"hello secret world"):
    return [("word/document.xml", b"<w:document>hello public world</w:document>"), TYPES, RELS, ("word/media/secret.bin", secret), ("word/médias/é.png", bytes(range(256)) * 9)]


def of(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content binary")


def digest(i, name, payload, alg):
    lp = lambda b: struct.pack(">I", len(b)) + b
    raw = b"OLY:REDACTION:OBJ:V1" + lp(struct.pack(">I", i)) + lp(name.encode()) + payload
    return (hash_many([raw])[0] if alg == "blake3" else hashlib.sha256(raw).digest()).hex()


def root(digests, alg):
    level = [bytes.fromhex(x) for x in digests]
    level += [bytes(32)] * ((1 << (len(level) - 1).bit_length()) - len(level))
    while len(level) > 1:
        level = parents([(level[i], level[i + 1]) for i in range(0, len(level), 2)], alg)
    return level[0].hex()


@pytest.mark.parametrize("alg", ["blake3", "sha256"])
def test_parts_are_segments_in_order_of_names(spark, alg):
    parts = sample()
    files = of(spark, {"a": archive(parts), "b": archive(parts[::-1], zipfile.ZIP_STORED, ("word", "empty")), "c": packages.write_package(sorted(parts))})
    rows = packages.segments(files, alg=alg).orderBy("path", "segment_id").collect()
    canonical = packages.write_package(sorted(parts))
    for path in "abc":  # neither order, packing nor folders matter
        own = [r for r in rows if r.path == path]
        assert [(r.segment_id, r.label, r.digest) for r in own] == [(i, n, digest(i, n, p, alg)) for i, (n, p) in enumerate(sorted(parts))]
        assert [canonical[r.byte_offset : r.byte_offset + r.byte_length] for r in own] == [p for _, p in sorted(parts)]
        assert [r.redactable for r in own] == [False, False, False, True, True]
    got = {r.path: (r.n, r.root) for r in packages.roots(packages.segments(files, alg=alg), alg=alg).collect()}
    assert got == {p: (5, root([digest(i, n, x, alg) for i, (n, x) in enumerate(sorted(parts))], alg)) for p in "abc"}


def test_the_canonical_form_is_pinned():
    raw = packages.write_package(sorted(sample()))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and [x.filename for x in z.infolist()] == [n for n, _ in sorted(sample())]
        assert all((x.compress_type, x.date_time, x.extra, x.flag_bits & ~0x800, x.file_size) == (0, (1980, 1, 1, 0, 0, 0), b"", 0, x.compress_size) for x in z.infolist())
        assert {n: z.read(n) for n in z.namelist()} == dict(sample())
    assert raw == packages.write_package(sorted(sample()))


def test_what_is_no_package_is_a_verdict(spark):
    parts = sample()
    good = archive(parts)
    bomb = archive([*parts, ("word/media/zeros.bin", bytes(3_000_000))])
    many = archive([(f"p{i}", b"") for i in range(40)])
    with pytest.warns(UserWarning):
        twice = archive([*parts, parts[0]])
    name = good.index(b"word/document.xml")
    secret = bytearray(archive(parts, zipfile.ZIP_STORED))
    at = secret.index(b"hello secret")
    secret[at] ^= 1  # no longer what its checksum says
    locked = bytearray(good)
    for mark, place in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        i = -1
        while (i := locked.find(mark, i + 1)) >= 0:
            locked[i + place] |= 1
    files = {"good": good, "null": None, "empty": b"", "text": b"plain text", "cut": good[: len(good) // 2], "bomb": bomb, "many": many, "twice": twice, "changed": bytes(secret), "locked": bytes(locked), "none": archive([], folders=("a",)), "odd": good[:name] + b"\xff\xfe" + good[name + 2 :]}
    got = {r.path: r.verdict for r in packages.segments(of(spark, files), most_parts=30, most_bytes=1 << 20).select("path", "verdict").distinct().collect()}
    assert got == {"good": "ok", "null": "not-an-archive", "empty": "not-an-archive", "text": "not-an-archive", "cut": "not-an-archive", "bomb": "too-large", "many": "too-many-parts", "twice": "duplicate-part", "changed": "malformed", "locked": "malformed", "none": "no-parts", "odd": "malformed"}
    assert packages.segments(of(spark, {"x": None}).limit(0)).count() == 0
    one = packages.segments(of(spark, {"one": archive([("only", b"x")])}))
    assert one.count() == 1 and packages.roots(one).count() == 0


def test_damaged_bytes_never_stop_the_job(spark):
    r, good = random.Random(2), archive(sample())
    files = {}
    for i in range(300):
        raw = bytearray(good)
        for _ in range(r.choice((1, 2, 8))):
            raw[r.randrange(len(raw))] = r.randrange(256)
        files[str(i)] = bytes(raw[: r.choice((len(raw), len(raw), r.randrange(len(raw))))])
    rows = packages.segments(of(spark, files)).select("path", "verdict").distinct().collect()
    assert len(rows) == 300 and {x.verdict for x in rows} <= {"ok", "malformed", "not-an-archive", "duplicate-part", "no-parts"}


def test_redaction_empties_and_tells_no_length(spark):
    artifacts = {}
    for size in (1, 4096):
        secret = b"s3cr" * size
        files = of(spark, {"a": archive(sample(secret))})
        rows = packages.segments(files)
        wanted = spark.createDataFrame([("a", 3), ("a", 3)], "path string, segment_id int")
        out = packages.redact(files, rows, wanted).first()
        assert out.verdict == "ok" and secret not in out.artifact
        artifacts[size] = bytes(out.artifact)
        got = dict(packages.read_parts(artifacts[size]))
        assert got == {n: b"" if n == "word/media/secret.bin" else p for n, p in sample(secret)}
        shown = spark.createDataFrame([("a", out.artifact)], "path string, artifact binary")
        assert packages.verify(shown, rows, wanted, packages.roots(rows)).first().verdict == "valid"
        spans = packages.segments(shown, content="artifact").collect()
        for x in spans:
            assert artifacts[size][x.byte_offset : x.byte_offset + x.byte_length] == got[x.label]
    assert artifacts[1] == artifacts[4096]


def test_refused_redactions(spark):
    def rels(inner):
        return ("_rels/.rels", f'<Relationships xmlns="{packages.NAMESPACE}">{inner}</Relationships>'.encode())

    office = '<Relationship Type="x/officeDocument" Target="{}"{}/>'
    main = ("main.bin", b"<w/>")
    image = ("z.png", b"png")
    files = {
        "structural": [TYPES, RELS, ("word/document.xml", b"<w/>"), image], "odd main": [TYPES, rels(office.format("/main.bin", "")), main, image], "external": [TYPES, rels(office.format("main.bin", ' TargetMode="External"')), main, image],
        "up": [TYPES, rels(office.format("../main.bin", "")), main, image], "two": [TYPES, rels(office.format("main.bin", "") * 2), main, image], "absent": [TYPES, rels(office.format("gone.bin", "")), main, image], "no rels": [TYPES, main, image],
        "entity": [TYPES, ("_rels/.rels", b'<!DOCTYPE a [<!ENTITY b "c">]>' + rels(office.format("main.bin", ""))[1]), main, image], "broken": [TYPES, ("_rels/.rels", b"<Relationships"), main, image], "unknown": [TYPES, RELS, ("word/document.xml", b"<w/>"), image],
        "other file": [TYPES, RELS, ("word/document.xml", b"<w/>"), image],
    }
    frame = of(spark, {k: archive(p) for k, p in files.items()})
    rows = packages.segments(frame)
    rows = rows.withColumn("label", packages.F.when((rows.path == "other file") & (rows.segment_id == 3), "y.png").otherwise(rows.label)).withColumn("redactable", packages.F.lit(True))
    ask = {"structural": 2, "odd main": 2, "unknown": 9}
    wanted = spark.createDataFrame([(k, ask.get(k, 3 if k != "no rels" else 2)) for k in files], "path string, segment_id int")
    got = {r.path: r.verdict for r in packages.redact(frame, rows, wanted).collect()}
    assert got == {"structural": "structural-part", "odd main": "structural-part", "unknown": "unknown-segment", "other file": "label-mismatch"} | dict.fromkeys(("external", "up", "two", "absent", "no rels", "entity", "broken"), "malformed")

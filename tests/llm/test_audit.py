"""Fingerprints, filter audit and source divergence against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from sealstone.llm import audit, divergence, spotsigs
from sealstone.llm.common import documents
from sealstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def chains(text, anchors=frozenset(spotsigs.ANCHORS), c=spotsigs.CHAIN):
    ws = re.findall(spotsigs.WORD, (text or "").lower())
    at = [i for i, w in enumerate(ws) if w not in anchors]
    after = lambda j: tuple(ws[i] for i in at[j : j + c])
    out = {(ws[p - 1], *after(j)) for j, p in enumerate(at) if p and ws[p - 1] in anchors}
    return out or {after(j) for j in range(len(at))} or ({tuple(ws)} if ws else set())


def alike(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def next_texts(rows):
    """(key, text, next) in descending key order, null keys last; rows of one key in any order."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    return [(k, t or "", order[(i + 1) % len(order)][1] or "") for i, (k, t) in enumerate(order)]


def edited(text, after):
    h = len(text) // 2
    return text[: len(text) - h] + after[:h]


def test_fingerprints_follow_edits(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF).collect()] + [(-5, ""), (-4, None), (-3, "the of and"), (-2, "日本語 é x"), (-1, "The Cat sat the cat SAT")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (7, 64, 10_000):
        got = spotsigs.edits(docs, rows=size).withColumns({"a": spotsigs.likeness(F.col("signatures"), F.col("edited_signatures")), "b": spotsigs.likeness(F.col("signatures"), F.col("next_signatures"))})
        got = {r.doc_id: r for r in got.collect()}
        assert len(got) == len(rows)
        for k, text, after in next_texts(rows):
            r, new = got[k], edited(text, after)
            assert (r.n_chars, r.edited, len(r.signatures)) == (len(text), new, len(chains(text)))
            assert abs(r.a - alike(chains(text), chains(new))) < 1e-12 and abs(r.b - alike(chains(text), chains(after))) < 1e-12


def test_fingerprint_query(spark):
    got = QUERIES["op11_spotsigs"](spark, SF).collect()
    by_text = defaultdict(set)
    text = {r.doc_id: r.text for r in documents(spark, SF).collect()}
    for r in got:
        by_text[text[r.doc_id]].add(r.fingerprint)
        by_text[hash(r.edited_sha256)].add(r.edited_fingerprint)
    assert len(got) == len(text) and all(len(x) == 1 for x in by_text.values())
    want = {k: hashlib.sha256(edited(t, n).encode()).hexdigest() for k, t, n in next_texts(list(text.items()))}
    assert {r.doc_id: r.edited_sha256 for r in got} == want


def test_fingerprints_are_native(spark):
    plan = QUERIES["op11_spotsigs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows_have_fingerprints(spark, odd, none):
    got = spotsigs.edits(odd, rows=3).collect()
    texts = [r.text or "" for r in odd.collect()]
    assert sorted(r.n_chars for r in got) == sorted(map(len, texts)) and spotsigs.edits(none).count() == 0
    one = spark.createDataFrame([(1, "abc de")], "doc_id long, text string")
    assert [(r.edited, r.next_signatures == r.signatures) for r in spotsigs.edits(one).collect()] == [("abcabc", True)]


def test_similar_sets_like_all_pairs(spark):
    r, rows = random.Random(4), []
    words = ["the", "of", "a"] + [f"w{i}" for i in range(60)]
    for base in range(12):
        ws = [r.choice(words) for _ in range(r.choice((5, 30, 120)))]
        for _ in range(8):
            rows.append((len(rows), " ".join(w if r.random() > 0.01 else r.choice(words) for w in ws)))
    sigs = spotsigs.fingerprints(spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string"))
    for percent in (80, 50, 100):
        got = {(x.query, x.found): x.likeness for x in spotsigs.similar(sigs.filter("doc_id % 2 = 0"), sigs, percent=percent).collect()}
        held = {k: chains(t) for k, t in rows}
        want = {(a, b): alike(held[a], held[b]) for a in held for b in held if a % 2 == 0 and a != b and held[a] and 100 * alike(held[a], held[b]) >= percent}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want) and len(want) > 10


def brute_audit(rows, labels):
    """Steps by applying the filters one after another to the rows themselves."""
    word = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    fails = [
        {
            f
            for f, x in zip(
                "ABCDE",
                (len(word(t)) < 200, 100 * len(set(word(t))) < 50 * len(word(t)), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), k is not None and any(o == t and j is not None and j < k for j, o, _ in rows)),
                strict=True,
            )
            if x
        }
        for k, t, _ in rows
    ]
    out, shapley = {}, Counter()
    for part in {p for *_, p in rows}:
        own = [(rows[i][0], fails[i]) for i in range(len(rows)) if rows[i][2] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                before = [x for x in own if f in x[1] and x not in left] if len(left) < len(own) else []
                left = [x for x in left if f not in x[1]]
                count = lambda which, rows_: sum((k in labels and labels[k][which] == 1) for k, _ in rows_)
                out[part, order, step] = [len(left), len(gone), len(before), sum(x[1] == {f} for x in own), count(0, gone), count(1, gone)]
                shapley[part, f] += len(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def audit_rows(seed):
    r = random.Random(seed)
    texts = ["", "Some Text", "a# b", "x " * 300, " ".join(f"w{i}" for i in range(250)), "AB " + " ".join(f"w{i}" for i in range(220)) + " |", "tie"]
    return [(i, r.choice(texts), r.choice(("en", "de", ""))) for i in range(90)]


def test_audit_like_one_filter_after_another(spark):
    rows = audit_rows(1)
    labels = {i: (i % 2, i % 3 == 0) for i in range(0, 90, 2)}
    docs = spark.createDataFrame([(k, t or None, p or None) for k, t, p in rows], "doc_id long, text string, lang string")
    said = spark.createDataFrame([(k, q, int(t)) for k, (q, t) in labels.items()], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit.audit(docs, said).collect()}
    assert got == brute_audit(rows, labels) and len(got) == 3 * 600


def test_copies_over_the_bounds_of_ranges(spark):
    """One text, and few keys, over many ranges: decided in all of them, as in one."""
    r = random.Random(2)
    rows = [(r.randrange(60), r.choice(["same"] * 8 + ["other", "third"]), "en") for _ in range(400)] + [(None, "same", "en")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    least = {t: min(k for k, o, _ in rows if o == t and k is not None) for t in {t for _, t, _ in rows}}
    want = Counter((k, bool(k is not None and k > least[t])) for k, t, _ in rows)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 5, 60):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = Counter()
            for x in audit.masks(docs).collect():
                got[x.key, bool(x.mask & audit.E_BIT)] += x.n
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_waiting_rows_are_given_out(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(audit, "TOGETHER", 4)
    rows = pa.RecordBatch.from_pydict({"print": [1] * 20 + [2] * 9 + [3] * 5, "text": ["a"] * 20 + ["b"] * 9 + ["c"] * 5, "key": [*range(20), *[1] * 9, *range(5)], "part": ["p"] * 34})
    out = [x for b in audit.compared(iter([rows.slice(0, 7), rows.slice(7)])) for x in b.to_pylist()]
    assert sum(x["n"] for x in out) == 34 and sum(x["n"] for x in out if x["mask"] & audit.E_BIT) == 19 + 4
    assert [(x["key"], x["run"]) for x in out if x["text"] is not None] == [(0, True), (0, True)]


def test_audit_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text or "", r.lang or "") for r in odd.collect()]
    want = brute_audit(rows, {1: (1, 1)})
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit.audit(odd, labels).collect()}
    assert {k: (v[0], v[1], v[3:]) for k, v in got.items()} == {k: (v[0], v[1], v[3:]) for k, v in want.items()}
    assert audit.audit(none, labels).count() == 0 and audit.audit(odd, labels.limit(0)).filter("good_lost > 0").count() == 0


def brute_divergence(rows, least, top):
    terms = [(p, s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) for p, s, t in rows]
    out = set()
    for part in {p for p, *_ in terms}:
        docs = Counter(w for p, _, ws in terms if p == part for w in set(ws))
        kept = sorted(w for w, n in docs.items() if n >= least)
        sources = {s for p, s, _ in terms if p == part}
        count = {s: Counter(w for p, o, ws in terms if (p, o) == (part, s) for w in ws if w in set(kept)) for s in sources}
        all_ = sum(count.values(), Counter())
        p_of = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        p, q = {s: p_of(count[s]) for s in sources}, p_of(all_)
        for s in sources:
            far = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s)
            most = sorted((q[w] - p[s][w], w.encode()) for w in kept if count[s][w] and p[s][w] > q[w])[:top]
            out |= {(part, s, "pair", o, -v, r + 1) for r, (v, o) in enumerate(far)} | {(part, s, "term", w.decode(), -v, r + 1) for r, (v, w) in enumerate(most)}
    return out


def test_divergence_like_plain_counts(spark, odd, none, monkeypatch):
    r = random.Random(3)
    words = [f"{a}{b}" for a in "abcdé日" for b in "xyzÄ-"] + ["The", "THE", "𝒳x", "ﬁx"]
    rows = [(r.choice(("en", "de")), f"s{r.randrange(5)}", " ".join(r.choice(words[: r.choice((5, len(words)))]) for _ in range(30))) for _ in range(200)] + [("xx", "a", ""), ("xx", "b", "rare"), ("yy", "a", "1 2")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    plain = lambda t: {tuple(x) for x in t.collect()}
    for terms, held in ((512, 1 << 19), (4, 50)):  # one block, and many
        monkeypatch.setattr(divergence, "TERMS", terms)
        monkeypatch.setattr(divergence, "TERMS_LEAST", 2)
        monkeypatch.setattr(divergence, "HELD", held)
        assert plain(divergence.divergence(docs, least=8, top=3)) == brute_divergence(rows, 8, 3)
    got = plain(divergence.divergence(odd, least=1))
    assert got == brute_divergence([(x.lang or "", x.source or "", x.text or "") for x in odd.collect()], 1, 50) and divergence.divergence(none).count() == 0


def test_probabilities_are_exact():
    r = random.Random(5)
    for most in (10, 10**6, 10**14):
        total = [r.randrange(1, most) for _ in range(200)]
        count = [r.randrange(t + 1) for t in total]
        want = [1 + 10**9 * (c + 5) // (t + 5 * 77) for c, t in zip(count, total, strict=True)]
        assert divergence.probabilities(np.array(count), np.array(total), 77).tolist() == want

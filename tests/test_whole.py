"""Queries that take whole texts and all records."""

from sealstone.plans import catalog
from sealstone.sources.fixtures import read

SF = "/root/testdata/sf0.001"


def test_whole_texts(spark):
    texts = {r.doc_id: r.text for r in read(spark, SF, "documents").collect()}
    words = {}
    for r in catalog.QUERIES["all_elements_with_ordinality"](spark, SF).collect():
        words.setdefault(r.doc_id, {})[r.ordinal] = r.word
    assert {k: " ".join(w[i] for i in range(len(w))) for k, w in words.items()} == {k: t for k, t in texts.items() if t is not None}
    cells = {r.doc_id: r.cell for r in catalog.QUERIES["sanitised_whole_cells"](spark, SF).collect()}
    assert all(t is None or cells[k] in (t, "'" + t) for k, t in texts.items())
    assert catalog.QUERIES["all_chunk_hashes_sha256"](spark, SF).groupBy("doc_id").count().filter("count = 16").count() == len(texts)
    roots = {r.doc_id: r.root for r in catalog.QUERIES["chunk_roots"](spark, SF).collect()}
    same = {}
    for k, t in texts.items():
        assert same.setdefault(t, roots[k]) == roots[k]
    assert len(set(same.values())) == len(same)


def test_all_records_are_proven(spark):
    n = read(spark, SF, "documents").count()
    assert {r.kind: r["count"] for r in catalog.QUERIES["prove_records"](spark, SF).groupBy("kind").count().collect()} == {"inclusion": n, "exclusion": n}

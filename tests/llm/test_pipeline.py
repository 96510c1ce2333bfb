"""The stages: whole, in order, each on what the one before kept."""

import corpus_pipeline
from sealstone.llm import jaccard, quality
from sealstone.llm.common import documents, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, SF)
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = table(stage(spark, docs, SF), "stage")
        kept[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    first = kept["quality rules"]
    assert 0 < first.count() < documents(spark, SF).count()
    assert kept["n-gram Jaccard join"].count() == jaccard.join(first).select("component_id").distinct().count()
    assert kept["PII"].filter("text rlike '[a-z]@mail'").count() == 0
    assert docs.filter("offset + length > 2048").count() == 0 and docs.count() > 0


def test_quality_stage_is_the_operator(spark):
    docs = documents(spark, SF)
    from sealstone.llm.queries import BYTE_BPE, PIECES, bands

    own = bands(spark, SF, docs)
    want = {r.doc_id for r in quality.quality(docs, BYTE_BPE, PIECES, bands=own).filter("kept").collect()}
    assert {r.doc_id for r in quality.keep_good(docs, BYTE_BPE, PIECES, bands=own).collect()} == want


def test_stages_on_odd_tables(spark, odd, none):
    """Nulls, empty and long texts, repeated rows, clashing names; an empty table; a table without languages: as a chain."""
    for docs, least in ((odd, 1), (none, 0), (odd.drop("lang", "n", "size"), 1)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = table(stage(spark, docs, SF), "stage")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == columns
        assert docs.count() >= least


def test_runs_do_not_touch_each_other(spark, monkeypatch):
    """A second run leaves what a result of the first still reads."""
    docs = documents(spark, SF).limit(30)
    first = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        first = table(stage(spark, first, SF), "stage")
    packed = corpus_pipeline.STAGES[-1][1](spark, first, SF)
    corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert packed.count() > 0

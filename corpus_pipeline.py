"""A training corpus from documents, in five stages; each takes what the one before kept and decided.

STAGES: quality rules, one document of each near-duplicate group, personal data redacted, sources mixed to target
weights, packing into sequences. All but the last return the columns of documents. A stage's result is written before the
next stage is called; the next one then deletes what the stage before had written for itself. The first stage begins anew and deletes nothing, and runs in
other threads or on other folders have tables of their own, so no run touches what another still reads."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession

from sealstone.llm import jaccard, mixing, packing, pii, quality
from sealstone.llm.common import Scratch, table
from sealstone.llm.queries import BYTE_BPE, PIECES, WORD_BPE, bands

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_last: dict[tuple[int, str], Scratch] = {}


def stage(f: Stage) -> Stage:
    """Keeps at most one stage's intermediate tables on disk."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run_of = (get_ident(), sf_dir)
        if f is STAGES[0][1].__wrapped__:
            _last[run_of] = Scratch()
        own = _last.setdefault(run_of, Scratch())
        own.drop(spark)
        with own:
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, BYTE_BPE, PIECES, bands=bands(spark, sf_dir, docs))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


@stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_pieces(docs, WORD_BPE))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("mixing sources", source_mix), ("packing", sequences)]

#: EM, hash-based packing and tokenisation have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = table(step(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs

"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them.

Each applies its operator to the whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealstone.llm import ann, audit, divergence, html, jaccard, licenses, mixing, packing, pii, quality, spotsigs, tokenids, warc
from sealstone.llm.common import documents

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _spans(only_base: bool):
    kept = "filter(spans, x -> x.base)" if only_base else "spans"
    return F.expr(f"array_join(transform({kept}, x -> concat_ws(':', x.kind, cast(x.s as string), cast(x.e as string))), ',')")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(_spans(True), 256).alias("base_sha256"), _spans(False).alias("spans"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir), percent=85, words=4)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries="vec_id % 50 = 0", k=5)


def bands(spark: SparkSession, sf_dir: str, docs: DataFrame) -> dict[str, quality.Band]:
    return quality.fit_bands(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), BYTE_BPE, PIECES)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.quality(docs, BYTE_BPE, PIECES, bands=bands(spark, sf_dir, docs))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_pieces(documents(spark, sf_dir), WORD_BPE))


def op9_tokenids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.read_shards(tokenids.write_shards(documents(spark, sf_dir), BYTE_BPE))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op11_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spotsigs.edits(documents(spark, sf_dir))
    own, edited, after = (F.col(c) for c in ("signatures", "edited_signatures", "next_signatures"))
    text = (F.sha2("edited", 256).alias("edited_sha256"), spotsigs.as_text(own).alias("fingerprint"), spotsigs.as_text(edited).alias("edited_fingerprint"))
    return found.select("doc_id", "n_chars", *text, spotsigs.likeness(own, edited).alias("near_edited"), spotsigs.likeness(own, after).alias("near_next"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = divergence.divergence(documents(spark, sf_dir))
    return found.select(F.col("part").alias("lang"), "source", F.col("kind").alias("part"), "item", "value", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_warc, op3_jaccard, op4_ann, op5_quality, op6_mixing, op7_html, op8_packing, op9_tokenids, op10_licenses, op11_spotsigs, op12_audit, op13_divergence, pipeline)}

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
            CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
    "op3_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2)
            JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.doc_id)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r USING (doc_id) GROUP BY 1, 2""",
    "op6_mixing": f"""
        WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format('text')}) AS BIGINT) AS size, substr(md5('17:' || CAST(doc_id AS VARCHAR)), 1, 15) AS k FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0 * sum(size) AS cap,
            ([5.0, 2.0, 1.0])[1 + CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER)]::DOUBLE AS weight FROM d GROUP BY source),
        o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS r FROM s),
        l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
        f AS (SELECT min(r) AS r FROM l WHERE cap > level * weight),
        t AS (SELECT l.source, source_size, CASE WHEN f.r IS NULL OR l.r < f.r THEN cap ELSE (SELECT level FROM l m WHERE m.r = f.r) * weight END::DOUBLE AS target FROM l, f),
        c AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
            CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN least(budget // source_size, 2) ELSE 0 END AS rounds FROM c)
        SELECT doc_id, size, source_size, target, CAST(least(rounds * size + greatest(0, least(size, budget - rounds * source_size - before)), 2 * size) AS BIGINT) AS taken FROM e""",
    "op12_audit": rf"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
        m AS (SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
            + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask FROM w),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
        c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        p AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own, coalesce(list_sum([1 << (ascii(filter_order[i]) - 65) for i in range(1, step)]), 0) AS before
            FROM p, (SELECT unnest(range(1, 6))::INT AS step)),
        r AS (SELECT part, filter_order, step, own,
            coalesce(sum(n) FILTER (mask & (own | before) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS removed,
            coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
            coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS toxic_lost
            FROM c, (SELECT filter_order, step, own, CASE WHEN step = 1 THEN 0 ELSE before END AS before FROM s) GROUP BY 1, 2, 3, 4)
        SELECT part, filter_order, step, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
            CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
    "op13_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        t AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        v AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT i) >= 30),
        c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY 1, 2, 3),
        g AS (SELECT DISTINCT lang, source FROM d),
        e AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, v.n AS all_n FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
        p AS (SELECT *, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p,
            1 + 1000000000::HUGEINT * (all_n + 5) // (sum(all_n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS q FROM e),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
            UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50""",
}

"""The relational reads around a ledger: projections, predicates, joins, aggregates, windows, top-k, sets, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sealstone.operators import ledger
from sealstone.plans.registry import query
from sealstone.sources import fixtures as fx
from sealstone.sources.fixtures import AS_OF, ctes, read


@query("SELECT o_orderkey AS order_id, o_custkey AS customer, substr(o_orderpriority, 1, 5) AS priority FROM orders")
def project_rename(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer"), F.substring("o_orderpriority", 1, 5).alias("priority"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity < 10 AND l_discount >= 0.05")
def filter_conjunction(spark, d):
    return read(spark, d, "lineitem").filter("l_returnflag = 'R' and l_linestatus = 'F' and l_quantity < 10 and l_discount >= 0.05D").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_between(spark, d):
    return read(spark, d, "part").filter(F.col("p_size").between(10, 20)).select("p_partkey", "p_size")


@query(ctes("receipts") + f" SELECT id, next_attempt_at FROM receipts WHERE next_attempt_at IS NULL OR next_attempt_at <= {AS_OF}")
def filter_null_or_due(spark, d):
    return fx.receipts(spark, d).filter(F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= AS_OF)).select("id", "next_attempt_at")


@query(ctes("receipts") + " SELECT id, supersedes_id FROM receipts WHERE supersedes_id IS DISTINCT FROM id - 1")
def filter_is_distinct(spark, d):
    return fx.receipts(spark, d).filter(~F.col("supersedes_id").eqNullSafe(F.col("id") - 1)).select("id", "supersedes_id")


@query(ctes("receipts") + " SELECT id FROM receipts WHERE supersedes_id <> 100")
def filter_not_equal_drops_null(spark, d):
    return fx.receipts(spark, d).filter("supersedes_id <> 100").select("id")


@query("SELECT source AS shard_id, count(*) AS n FROM documents WHERE regexp_full_match(source, '[A-Za-z0-9:._-]{1,128}') GROUP BY 1")
def filter_valid_shard_id(spark, d):
    return read(spark, d, "documents").filter(F.col("source").rlike(r"^[A-Za-z0-9:._-]{1,128}$")).groupBy(F.col("source").alias("shard_id")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = lower('Building')")
def filter_case_insensitive(spark, d):
    return read(spark, d, "customer").filter(F.lower("c_mktsegment") == F.lower(F.lit("Building"))).select("c_custkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owing' WHEN c_acctbal < 5000 THEN 'fair' ELSE 'rich' END AS class, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer")
def case_and_coalesce(spark, d):
    bal = F.col("c_acctbal")
    return read(spark, d, "customer").select("c_custkey", F.when(bal < 0, "owing").when(bal < 5000, "fair").otherwise("rich").alias("class"), F.coalesce(F.expr("nullif(c_mktsegment, 'BUILDING')"), F.lit("none")).alias("segment"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN ((1, 1), (2, 1), (3, 2), (7, 3), (32, 1))")
def lookup_tuples(spark, d):
    """Composite-key look-up: a fixed list of keys, joined as a relation."""
    keys = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (7, 3), (32, 1)], "l_orderkey long, l_linenumber int")
    return read(spark, d, "lineitem").join(F.broadcast(keys), ["l_orderkey", "l_linenumber"], "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (1, 5, 17, 99, 400)")
def lookup_keys(spark, d):
    return read(spark, d, "documents").filter(F.col("doc_id").isin(1, 5, 17, 99, 400)).select("doc_id", "lang")


@query("SELECT event_id, user_id FROM events WHERE event_id BETWEEN 100 AND 900 ORDER BY event_id LIMIT 50")
def range_scan_limit(spark, d):
    return read(spark, d, "events").filter(F.col("event_id").between(100, 900)).orderBy("event_id").limit(50).select("event_id", "user_id")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def join_inner(spark, d):
    return read(spark, d, "orders").filter("o_totalprice > 100000").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT event_type, doc_id FROM (SELECT event_type, event_id AS doc_id FROM events) JOIN labels USING (doc_id) WHERE quality = 1")
def join_using(spark, d):
    return read(spark, d, "events").select("event_type", F.col("event_id").alias("doc_id")).join(read(spark, d, "labels").filter("quality = 1"), "doc_id").select("event_type", "doc_id")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_left(spark, d):
    each = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))  # counted before the join
    return read(spark, d, "customer").join(each, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_done FROM customer")
def join_exists_flag(spark, d):
    done = read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return read(spark, d, "customer").join(done, "c_custkey", "left").select("c_custkey", F.col("hit").isNotNull().alias("has_done"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query(ctes("receipts") + " SELECT id FROM receipts r WHERE NOT EXISTS (SELECT 1 FROM receipts s WHERE s.supersedes_id = r.id)")
def join_anti_self(spark, d):
    r = fx.receipts(spark, d)
    return r.join(r.select(F.col("supersedes_id").alias("gone")), F.col("id") == F.col("gone"), "left_anti").select("id")


@query("SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def join_small_dimensions(spark, d):
    named = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).join(named, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "n")


@query(ctes("records", "records_v2") + " SELECT coalesce(a.shard_id, b.shard_id) AS shard_id, coalesce(a.record_id, b.record_id) AS record_id, coalesce(a.version, b.version) AS version, CASE WHEN b.record_id IS NULL THEN 'removed' WHEN a.record_id IS NULL THEN 'added' ELSE 'kept' END AS state FROM records a FULL JOIN records_v2 b ON a.shard_id = b.shard_id AND a.record_id = b.record_id AND a.version = b.version")
def join_full_outer(spark, d):
    by = ["shard_id", "record_id", "version"]
    a, b = fx.records(spark, d).select(*by).withColumn("a", F.lit(True)), fx.records_v2(spark, d).select(*by).withColumn("b", F.lit(True))
    return a.join(b, by, "full_outer").select(*by, F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").otherwise("kept").alias("state"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN (SELECT item_id, sha256(text) AS h FROM benchmark) b ON sha256(d.text) = b.h")
def join_computed_hash(spark, d):
    b = read(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("h"))
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")).join(b, "h").select("doc_id", "item_id")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS n_good, CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) / count(*) * 100 ELSE 0 END AS percent FROM labels")
def count_filtered_ratio(spark, d):
    n, good = F.count("*"), F.count_if(F.col("quality") == 1)
    return read(spark, d, "labels").agg(n.alias("n"), good.alias("n_good"), F.when(n > 0, good / n * 100).otherwise(0.0).alias("percent"))


@query("SELECT count(DISTINCT event_type || ':' || CAST(user_id % 100 AS VARCHAR)) AS n, max(ts) AS last, coalesce(max(event_id) FILTER (WHERE value < -1e18), 0) AS none FROM events")
def count_distinct_expression(spark, d):
    return read(spark, d, "events").agg(F.countDistinct(F.concat("event_type", F.lit(":"), (F.col("user_id") % 100).cast("string"))).alias("n"), F.max("ts").alias("last"), F.coalesce(F.max(F.when(F.col("value") < -1e18, F.col("event_id"))), F.lit(0)).alias("none"))


@query("SELECT count(*) AS n_shards FROM (SELECT source AS s FROM documents UNION SELECT event_type FROM events UNION SELECT lang FROM documents)")
def distinct_over_tables(spark, d):
    docs = read(spark, d, "documents")
    return docs.select(F.col("source").alias("s")).union(read(spark, d, "events").select("event_type")).union(docs.select("lang")).distinct().agg(F.count("*").alias("n_shards"))


@query("SELECT sum(n)::BIGINT AS total FROM (SELECT count(*) AS n FROM documents UNION ALL SELECT count(*) FROM pages UNION ALL SELECT count(*) FROM conversations)")
def sum_of_counts(spark, d):
    counts = [read(spark, d, t).agg(F.count("*").alias("n")) for t in ("documents", "pages", "conversations")]
    return counts[0].union(counts[1]).union(counts[2]).agg(F.sum("n").alias("total"))


@query(ctes("records") + " SELECT shard_id, count(*) AS record_count, CAST(sum(byte_size) AS BIGINT) AS byte_size FROM records GROUP BY 1")
def shard_totals(spark, d):
    return fx.records(spark, d).groupBy("shard_id").agg(F.count("*").alias("record_count"), F.sum("byte_size").alias("byte_size"))


@query("SELECT doc_id, string_agg(t, ',' ORDER BY i) AS kept FROM (SELECT conv_id AS doc_id, turn AS i, role AS t FROM conversations WHERE role <> 'system') GROUP BY 1")
def ordered_aggregate(spark, d):
    c = read(spark, d, "conversations").filter("role <> 'system'")
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("kept"))


@query(ctes("records") + " SELECT substr(content_hash, 1, 2) AS prefix, count(*) AS n FROM records GROUP BY 1")
def leaves_per_prefix(spark, d):
    return fx.records(spark, d).groupBy(F.substring("content_hash", 1, 2).alias("prefix")).agg(F.count("*").alias("n"))


@query("SELECT p_size AS depth, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY p_size) AS BIGINT) AS cumulative FROM part GROUP BY 1")
def depth_histogram(spark, d):
    each = read(spark, d, "part").groupBy(F.col("p_size").alias("depth")).agg(F.count("*").alias("n"))
    return each.withColumn("cumulative", F.sum("n").over(Window.orderBy("depth")))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus) HAVING count(*) > 10")
def rollup_having(spark, d):
    return read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty")).filter("n > 10")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_of_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, d, "orders").withColumn("r", F.row_number().over(w)).filter("r = 1").select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT event_type AS shard_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def latest_of_shard(spark, d):
    return ledger.latest(read(spark, d, "events").select(F.col("event_type").alias("shard_id"), "ts", "event_id"), ("shard_id",), ("ts", "event_id"))


@query(ctes("ingest_records") + " SELECT shard_id, count(*) AS n, bool_and(snapshot_index = r) AS contiguous FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY snapshot_index) - 1 AS r FROM ingest_records) GROUP BY 1")
def contiguity(spark, d):
    """Indices are 0 .. n - 1 without a sort: distinct, from 0, and as many as the largest and one."""
    r = fx.ingest_records(spark, d).groupBy("shard_id").agg(F.count("*").alias("n"), F.min("snapshot_index").alias("lo"), F.max("snapshot_index").alias("hi"), F.countDistinct("snapshot_index").alias("k"))
    return r.select("shard_id", "n", ((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("k") == F.col("n"))).alias("contiguous"))


@query("SELECT o_orderkey, sha256(CAST(coalesce(p, 0) AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR)) AS link, p IS NULL AS genesis FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)")
def hash_chain(spark, d):
    p = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = read(spark, d, "orders").select("o_orderkey", p.alias("p"))
    return o.select("o_orderkey", F.sha2(F.concat(F.coalesce("p", F.lit(0)).cast("string"), F.lit(":"), F.col("o_orderkey").cast("string")), 256).alias("link"), F.col("p").isNull().alias("genesis"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 1")
def top_one(spark, d):
    return read(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(1).select("event_id", "ts")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, d):
    return read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query(ctes("receipts") + " SELECT id, lease_until FROM receipts ORDER BY lease_until DESC NULLS LAST, id LIMIT 40")
def top_k_nulls_last(spark, d):
    return fx.receipts(spark, d).orderBy(F.desc_nulls_last("lease_until"), "id").limit(40).select("id", "lease_until")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def page_of_results(spark, d):
    return read(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").offset(40).limit(20).select("c_custkey", "c_name")


@query(ctes("records", "records_v2") + " SELECT record_id, content_hash, false AS is_new FROM records WHERE content_hash IN (SELECT content_hash FROM records_v2) UNION ALL SELECT record_id, content_hash, true FROM records_v2 WHERE content_hash NOT IN (SELECT content_hash FROM records)")
def insert_or_existing(spark, d):
    """What an insert-or-return-existing answers: rows already there, and the new ones."""
    old, new = fx.records(spark, d), fx.records_v2(spark, d)
    there = old.join(new.select("content_hash").distinct(), "content_hash", "left_semi").select("record_id", "content_hash", F.lit(False).alias("is_new"))
    return there.unionByName(new.join(old.select("content_hash").distinct(), "content_hash", "left_anti").select("record_id", "content_hash", F.lit(True).alias("is_new")))


@query(ctes("records", "records_v2") + " SELECT shard_id, record_id, max(version) AS version FROM (SELECT * FROM records UNION ALL SELECT * FROM records_v2) GROUP BY 1, 2")
def upsert_latest(spark, d):
    """Bulk upsert: of old and new rows the latest by key."""
    rows = fx.records(spark, d).unionByName(fx.records_v2(spark, d))
    return ledger.latest(rows, ("shard_id", "record_id"), ("version", "content_hash")).select("shard_id", "record_id", "version")


@query(ctes("records", "records_v2") + " SELECT shard_id, count(*) AS n FROM (SELECT DISTINCT shard_id, content_hash FROM records EXCEPT SELECT shard_id, content_hash FROM records_v2) GROUP BY 1")
def set_except(spark, d):
    by = ["shard_id", "content_hash"]
    return fx.records(spark, d).select(*by).subtract(fx.records_v2(spark, d).select(*by)).groupBy("shard_id").agg(F.count("*").alias("n"))


@query(ctes("records", "records_v2") + " SELECT shard_id, count(*) AS n FROM (SELECT shard_id, content_hash FROM records INTERSECT SELECT shard_id, content_hash FROM records_v2) GROUP BY 1")
def set_intersect(spark, d):
    by = ["shard_id", "content_hash"]
    return fx.records(spark, d).select(*by).intersect(fx.records_v2(spark, d).select(*by)).groupBy("shard_id").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quarter, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)")
def ranks_of_group(spark, d):
    w, one = Window.partitionBy("o_custkey").orderBy("o_orderdate"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(one).cast("long").alias("quarter"), F.lead("o_orderkey").over(one).alias("next"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100 OFFSET 0")
def page_clamped(spark, d):
    """A client's page 0 of 5,000 rows, clamped to page 1 of 100."""
    return ledger.page(read(spark, d, "customer"), [F.desc("c_acctbal"), "c_custkey"], 0, 5000).select("c_custkey", "c_name")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_field(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).filter("k is not null")


@query("SELECT doc_id, i - 1 AS ordinal, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)")
def elements_with_ordinality(spark, d):
    """Every line of the whole text."""
    return read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line")).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("SELECT doc_id, i - 1 AS ordinal, ws[i] AS word FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents), unnest(range(1, len(ws) + 1)) AS u(i)")
def all_elements_with_ordinality(spark, d):
    """Every word of the whole text."""
    return read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("ordinal", "word")).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("SELECT doc_id, list_contains(['en', 'fr'], lang) AS has, lower(hex(encode(lang))) AS bytes, CAST(octet_length(encode(text)) AS BIGINT) AS octets, lang || ':' || source AS joined, substr(source, 1, 3) AS head FROM documents")
def string_functions(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_contains(F.array(F.lit("en"), F.lit("fr")), F.col("lang")).alias("has"), F.lower(F.hex("lang")).alias("bytes"), F.octet_length("text").cast("long").alias("octets"), F.concat("lang", F.lit(":"), "source").alias("joined"), F.substring("source", 1, 3).alias("head"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, CAST(floor(epoch(ts + INTERVAL 90 MINUTE)) AS BIGINT) AS later FROM events")
def time_functions(spark, d):
    return read(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.unix_timestamp("ts").alias("seconds"), F.unix_timestamp(F.expr("ts + make_dt_interval(0, 0, 90, 0)")).alias("later"))


@query("SELECT l_orderkey, l_linenumber, CAST(least(60 * power(2, least(l_linenumber - 1, 16)), 21600) AS BIGINT) AS submit_wait, CAST(least(300 * power(2, least(l_linenumber, 16)), 21600) AS BIGINT) AS upgrade_wait FROM lineitem")
def retry_backoff(spark, d):
    n = F.col("l_linenumber")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ledger.backoff(n, 60).alias("submit_wait"), ledger.backoff(n, 300, first_is_zero=False).alias("upgrade_wait"))


@query("SELECT event_id, CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || 's' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h' ELSE CAST(s // 86400 AS VARCHAR) || 'd' END AS uptime FROM (SELECT event_id, event_id * event_id % 200000 AS s FROM events)")
def uptime_buckets(spark, d):
    return read(spark, d, "events").select("event_id", ledger.uptime(F.col("event_id") * F.col("event_id") % 200000).alias("uptime"))


@query("SELECT p_partkey, CASE WHEN p_partkey <= 1 THEN 0 ELSE length(ltrim(bin(p_partkey - 1), '0')) END::INTEGER AS depth FROM part")
def tree_geometry(spark, d):
    return read(spark, d, "part").select("p_partkey", ledger.tree_depth(F.col("p_partkey")).alias("depth"))


@query("SELECT doc_id, substr(regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g'), 1, 255) AS name, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END AS cell FROM documents")
def sanitised_cells(spark, d):
    """Names (255 characters, the ledger's own bound) and cells of whole texts."""
    return read(spark, d, "documents").select("doc_id", ledger.clean_filename(F.col("text")).alias("name"), ledger.csv_safe(F.col("text")).alias("cell"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END AS cell FROM documents")
def sanitised_whole_cells(spark, d):
    """Cells of whole texts."""
    return read(spark, d, "documents").select("doc_id", ledger.csv_safe(F.col("text")).alias("cell"))


@query("SELECT o_orderkey, regexp_full_match(CAST(o_totalprice::BIGINT AS VARCHAR), '(0|[1-9][0-9]*)') AND (length(CAST(o_totalprice::BIGINT AS VARCHAR)) < 6 OR (length(CAST(o_totalprice::BIGINT AS VARCHAR)) = 6 AND CAST(o_totalprice::BIGINT AS VARCHAR) < '200000')) AS canonical FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def canonical_decimal(spark, d):
    """A decimal text below a bound, without converting it: length first, then code points."""
    from sealstone.functions.fields import canonical_below

    return read(spark, d, "orders").select("o_orderkey", canonical_below(F.floor("o_totalprice").cast("long").cast("string"), "200000").alias("canonical"))

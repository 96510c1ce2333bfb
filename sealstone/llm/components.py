"""Connected components of an edge table, by minimum labels and pointer jumping over written tables.

A node with very many edges is not one task: nodes beyond a share of all edges, a bounded number of them, have their labels sent to
every task, and labels that move are sent where they are few and joined in salted parts where they are not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstone.llm.common import table

#: Nodes of more than edges / HUBS edges (and HUB_LEAST) are hubs, so there are HUBS at most.
HUBS, HUB_LEAST = 100_000, 64
#: Rows that are sent to every task; beyond, a join by key in SALTS parts.
SENT, SALTS = 1_000_000, 16


def join_spread(big: DataFrame, small: DataFrame, on: str, by: str, n: int, how: str = "inner") -> DataFrame:
    """``big`` with ``small`` (``n`` rows, one a key): sent to every task, or each key in SALTS parts told apart by ``by``, so one key of many rows is not one task."""
    if n <= SENT:
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("salt", F.pmod(F.xxhash64(by, F.lit(29)), F.lit(SALTS)))
    parts = small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(parts, [on, "salt"], how).drop("salt")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges(a long, b long)`` to ``(node, root)``, root the smallest node reachable. Rounds grow with the logarithm of the longest path; stars take one."""
    both = table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    hub = max(HUB_LEAST, -(-both.count() // HUBS))
    hubs = table(both.groupBy("b").count().filter(F.col("count") > hub).select("b"), f"{name}-hubs")
    some = hubs.count() > 0
    plain = both.join(F.broadcast(hubs), "b", "left_anti") if some else both
    labels = table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), f"{name}-labels")
    while True:
        # The smallest label among a node's own and its neighbours', then the label of that label.
        label_of = labels.select(F.col("node").alias("b"), "root")
        seen = plain.join(label_of, "b").select("a", "root")
        if some:
            seen = seen.union(both.join(F.broadcast(hubs.join(label_of, "b")), "b").select("a", "root"))
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = table(labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old")), f"{name}-hooked")
        if hooked.filter("root <> old").limit(1).count() == 0:
            return labels  # no edge joins two labels
        tops = hooked.select("root").distinct()
        moved = table(tops.join(labels.select(F.col("node").alias("root"), F.col("root").alias("beyond")), "root").filter("beyond < root"), f"{name}-moved")
        step = join_spread(hooked.select("node", "root"), moved, "root", "node", moved.count(), "left")
        labels = table(step.select("node", F.coalesce("beyond", "root").alias("root")), f"{name}-labels")

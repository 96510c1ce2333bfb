"""Nearest neighbours by cosine, over balanced posting lists.

Centroids are fitted on a bounded sample. Every vector goes to the list of its nearest centroid, and near a
boundary to those of others too. Lists are kept in parts of bounded size, so neither a large cluster nor thousands of copies of a vector
meet in one task. A query walks a graph over the centroids, in memory, and takes all lists whose distance is within
a ratio of the nearest one's; the ratio is found on the sample, for the recall asked for. If these hold too few vectors for k neighbours, the next
nearest lists are taken too. Parts are joined with the queries that want them, each gives its own best, and the best of these are kept.

Vectors that are null or zero, or hold null or non-finite components, take no part, nor do null keys. All others do, however large or small their components: each is
scaled by a power of two before it is squared, which changes no digit of a cosine. The cosine of vectors of two lengths is not defined: those of another
length than most are left out. Equal scores go to the smaller key. Rows that repeat a key are candidates each; a query has no candidate of its own key.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealstone.llm.common import table

SAMPLE = 65_536  #: vectors that centroids and ratio are fitted on, at most: SAMPLE_EACH for a list, SAMPLE_LEAST while lists are few
SAMPLE_LEAST, SAMPLE_EACH = 20_000, 8
SAMPLE_BYTES = 64 << 20
LIST = 512  #: vectors of a list, about, while there are few enough lists
LISTS = 8192  #: lists at most: the centroids go to every task
PART = 2048  #: vectors, or queries, of a part of a list
REPLICAS, REPLICA_RATIO = 4, 1.05
DEGREE = 16
RECALL = 0.98  #: asked for on the sample


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component between 1/2 and 1, so that no square is lost or infinite."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0))[1][:, None])


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of unit vectors: the chord, which orders as the cosine does."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means; a cluster without members starts again at the vector worst served."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    k = min(k, len(distinct))
    centroids = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(sample[a : a + 4096] @ centroids.T, axis=1) for a in range(0, len(sample), 4096)])
        total = np.zeros_like(centroids)
        np.add.at(total, near, sample)
        size = np.sqrt((total * total).sum(axis=1))
        empty = size < 1e-9
        if empty.any():
            worst = np.argsort((sample * centroids[near]).sum(axis=1))[: int(empty.sum())]
            total[empty], size[empty] = sample[worst], 1.0
        centroids = total / size[:, None]
    return centroids


class Centroids:
    """The centroids and a graph over them."""

    def __init__(self, centroids: np.ndarray, ratio: float = 1.0, seed: int = 9) -> None:
        self.vectors, self.ratio = centroids, ratio
        k = len(centroids)
        rng = np.random.default_rng(seed)
        sets: list[set[int]] = [set() for _ in range(k)]
        for a in range(0, k, 1024):
            near = np.argsort(_distance(centroids[a : a + 1024], centroids), axis=1, kind="stable")[:, : DEGREE + 1]
            for i, row in enumerate(near.tolist(), a):
                for j in row:
                    if i != j:
                        sets[i].add(j)
                        sets[j].add(i)
        ring = rng.permutation(k)  # long links, and no list out of reach
        for i, j in zip(ring, np.roll(ring, 1), strict=True):
            if i != j:
                sets[i].add(int(j))
                sets[j].add(int(i))
        self.near = [np.array(sorted(s), np.int64) for s in sets]
        self.entries = ring[: min(k, 4)]

    def walk(self, unit: np.ndarray, sizes: np.ndarray, need: int, beam: int = 32) -> list[int]:
        """Lists within the ratio of the nearest one, nearest first: best-first search of the graph. If they hold fewer than ``need`` vectors, the next nearest as well."""
        seen = np.zeros(len(self.vectors), bool)
        seen[self.entries] = True
        d = _distance(unit[None], self.vectors[self.entries])[0]
        ahead = [(x, i) for x, i in zip(d.tolist(), self.entries.tolist(), strict=True)]
        heapq.heapify(ahead)
        found, best = list(ahead), [-x for x, _ in ahead]  # best: the nearest ``beam`` distances, negated
        heapq.heapify(best)
        nearest = min(d)
        while ahead:
            x, i = heapq.heappop(ahead)
            if len(best) >= beam and x > max(-best[0], self.ratio * nearest):
                break
            new = self.near[i][~seen[self.near[i]]]
            seen[new] = True
            for y, j in zip(_distance(unit[None], self.vectors[new])[0].tolist(), new.tolist(), strict=True):
                found.append((y, j))
                heapq.heappush(ahead, (y, j))
                nearest = min(nearest, y)
                heapq.heappush(best, -y) if len(best) < beam else heapq.heappushpop(best, -y)
        near = [j for y, j in sorted(found) if y <= self.ratio * nearest + 1e-12]
        if sizes[near].sum() >= need:
            return near
        every = np.argsort(_distance(unit[None], self.vectors)[0], kind="stable")
        rest = every[~np.isin(every, near)]
        held = sizes[near].sum() + np.cumsum(sizes[rest])
        return near + rest[: int(np.searchsorted(held, need)) + 1].tolist()

    def lists(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector its lists: that of the nearest centroid first, and up to REPLICAS in all within REPLICA_RATIO. Returns (row, list)."""
        d = _distance(units, self.vectors)
        k = min(REPLICAS, d.shape[1])
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        there = np.take_along_axis(d, near, axis=1)
        order = np.argsort(there, axis=1, kind="stable")
        near, there = np.take_along_axis(near, order, axis=1), np.take_along_axis(there, order, axis=1)
        keep = there <= REPLICA_RATIO * there[:, :1] + 1e-12
        keep[:, 0] = True
        row = np.repeat(np.arange(len(units)), keep.sum(axis=1))
        return row, near[keep]

    def calibrate(self, sample: np.ndarray, k: int, recall: float, queries: int = 256) -> None:
        """The smallest ratio at which queries of the sample find that share of their k nearest there."""
        row, list_ = self.lists(sample)
        start = np.searchsorted(row, np.arange(len(sample) + 1))
        need = []
        for q in range(0, len(sample), max(1, len(sample) // queries)):
            cosine = sample @ sample[q]
            cosine[q] = -2
            d = _distance(sample[q : q + 1], self.vectors)[0]
            for v in np.argsort(-cosine)[: min(k, len(sample) - 1)]:
                need.append(d[list_[start[v] : start[v + 1]]].min() / max(d.min(), 1e-6))
        self.ratio = max(1.0, float(np.quantile(need, recall))) if need else 1.0


def usable(df: DataFrame, vector: str) -> DataFrame:
    return df.filter(F.expr(f"{vector} is not null and size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vector}, x -> x <> 0)"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best(own: np.ndarray, keys: np.ndarray, query: np.ndarray, query_keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, key, score) of the k nearest of ``own`` to each query. A product of matrices finds who may be among them, the score is summed anew."""
    own, query = scaled(own), scaled(query)
    norm, qnorm = np.sqrt((own * own).sum(axis=1)), np.sqrt((query * query).sum(axis=1))
    rows, out_keys, scores = [], [], []
    order = np.argsort(keys, kind="stable")
    own, norm, keys = own[order], norm[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))  # rows that repeat a key count once, by their nearest
    for a in range(0, len(query), 256):
        rough = (query[a : a + 256] @ own.T) / (qnorm[a : a + 256, None] * norm)
        rough[query_keys[a : a + 256, None] == keys] = -3
        of_key = np.maximum.reduceat(rough, first, axis=1) if len(first) < len(keys) else rough
        take = min(k, of_key.shape[1])
        least = np.partition(of_key, of_key.shape[1] - take, axis=1)[:, of_key.shape[1] - take] - 1e-9
        for i in range(len(rough)):
            at = np.flatnonzero((rough[i] >= least[i]) & (rough[i] > -2.5))
            score = (own[at] * query[a + i]).sum(axis=1) / (norm[at] * qnorm[a + i])
            at_best = np.lexsort((keys[at], -score))
            at_best = at_best[np.sort(np.unique(keys[at[at_best]], return_index=True)[1])][:k]
            rows.append(np.full(len(at_best), a + i))
            out_keys.append(keys[at[at_best]])
            scores.append(score[at_best])
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(rows, np.int64), join(out_keys, np.int64), join(scores, np.float64)


def fit(df: DataFrame, *, key: str, vector: str, k: int, recall: float = RECALL, sample: int = SAMPLE, list_size: int = LIST, lists: int = LISTS) -> tuple[Centroids, int] | None:
    """Centroids, graph and ratio from a sample by hash of the key of at most ``sample`` rows and SAMPLE_BYTES; None if no vector is usable."""
    facts = df.groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not facts:
        return None
    dim, n = facts[0]
    count = min(lists, -(-n // list_size))
    most = max(64, min(sample, max(SAMPLE_LEAST, SAMPLE_EACH * count), SAMPLE_BYTES // (8 * dim)))
    like = df.filter(F.size(vector) == dim).select(F.col(key).alias("key"), F.xxhash64(key, vector).alias("at"), F.col(vector).cast("array<double>").alias("v"))
    # A little more than is wanted, so that few rows are put in order; all, if few rows or none are drawn, for copies fall together.
    some = like.filter(F.col("at") < F.lit(int(-(2**63) + 2**64 * 1.2 * most / n))) if n > 2 * most else like
    drawn = some.orderBy("at", "key", "v").select("v").limit(most).toArrow()
    if drawn.num_rows < min(n, most) // 2:
        drawn = like.orderBy("at", "key", "v").select("v").limit(most).toArrow()
    units = _units(_matrix(drawn.column("v").combine_chunks()))
    count = max(1, min(count, len(units) // SAMPLE_EACH + 1))
    index = Centroids(fit_centroids(units, count))
    index.calibrate(units, k, recall)
    return index, dim


def search(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", queries: str = "vec_id % 50 = 0", k: int = 5, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which ``queries`` holds its k nearest, nearest first."""
    spark = df.sparkSession
    rows = usable(df.filter(F.col(key).isNotNull()), vector)
    fitted = fit(rows, key=key, vector=vector, k=k, recall=recall)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, dim = fitted
    sent = spark.sparkContext.broadcast(index)  # at most LISTS centroids, whatever the number of vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                row, list_ = sent.value.lists(_units(_matrix(part.column("v"))))
                yield pa.RecordBatch.from_pydict({"list": pa.array(list_, pa.int32()), "key": part.column("key").take(pa.array(row)), "v": part.column("v").take(pa.array(row)), "own": pa.array(np.diff(row, prepend=-1) > 0)})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [sent.value.walk(u, held.value, need) for u in _units(_matrix(batch.column("v")))]
            row = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
            yield pa.RecordBatch.from_pydict({"list": pa.array([j for c in chosen for j in c], pa.int32()), "key": batch.column("key").take(pa.array(row)), "v": batch.column("v").take(pa.array(row))})

    schema = "list int, key long, v array<double>"
    placed = rows.filter(F.size(vector) == dim)
    own = table(placed.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(assign, f"{schema}, own boolean"), "posting-lists")
    # How many keys have each list for their own: LISTS numbers at most.
    once_each = own.filter("own").select("list", "key").distinct()
    sizes = np.zeros(len(index.vectors), np.int64)
    for list_, n in once_each.groupBy("list").count().collect():
        sizes[list_] = n
    n_keys = once_each.select("key").distinct().count()
    held, need = spark.sparkContext.broadcast(sizes), k + 1
    asked = table(placed.filter(queries).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(ask, schema), "list-queries")
    parts = lambda t, name: t.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias(name))
    # At most LISTS rows each. Every part of a list meets every part of its queries.
    spread = lambda t, split, mine, other: t.join(F.broadcast(split), "list").withColumn("part", F.pmod(F.xxhash64("key", "v", F.lit(mine)), F.col(mine)).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    by = ("list", "own_part", "query_part")

    def meet(own_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        if not own_rows.num_rows or not query_rows.num_rows:
            got = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64))
            query_keys = np.zeros(0, np.int64)
        else:
            flat = lambda t: _matrix(t.column("v").combine_chunks())
            query_keys = query_rows.column("key").to_numpy()
            got = best(flat(own_rows), own_rows.column("key").to_numpy(), flat(query_rows), query_keys, k)
        return pa.table({"query_id": query_keys[got[0]], "vec_id": got[1], "score": got[2]})

    def met(asked: DataFrame) -> DataFrame:
        split = parts(own, "own_parts").join(parts(asked, "query_parts"), "list")
        left = spread(own.drop("own"), split, "own_parts", "query_parts").select("list", F.col("part").alias("own_part"), F.col("with").alias("query_part"), "key", "v")
        right = spread(asked, split, "query_parts", "own_parts").select("list", F.col("with").alias("own_part"), F.col("part").alias("query_part"), "key", "v")
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "query_id long, vec_id long, score double")

    once = table(met(asked).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")
    # Where keys lie in many lists, those that were read may hold fewer than k others: such queries look into all lists.
    short = once.groupBy("query_id").count().filter(F.col("count") >= min(k, n_keys - 1))
    late = asked.join(short.select(F.col("query_id").alias("key")), "key", "left_anti") if n_keys > 1 else asked.limit(0)
    late = table(late.select("key", "v").distinct(), "short-queries")
    if late.count():
        everywhere = late.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(len(index.vectors) - 1)))).select("list", "key", "v")
        once = once.union(met(everywhere)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def expected_recall(exact: dict[int, list[int]], got: dict[int, list[int]]) -> float:
    """Share of the exact neighbours that were found."""
    total = sum(map(len, exact.values()))
    return sum(len(set(v) & set(got.get(q, ()))) for q, v in exact.items()) / total if total else math.nan

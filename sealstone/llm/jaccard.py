"""Similarity join of documents as sets of word shingles: size-aware, heavy and light.

Two documents link if the Jaccard similarity of their sets reaches the threshold. Equal sets are one class,
joined by its digest. For the rest, shingles have one order over the corpus: common ones last, else by digest. Similar
sets share their first shingles in that order:

- light sets, up to the boundary, list all subsets of two shingles among their first ones: similar light sets share one;
- heavy sets scan the inverted lists of their first shingles one by one, in which all sets large enough to be like a heavy one are listed.

The boundary minimises the subsets and list entries made, from the sizes of all sets and the mean length of lists. Lists with the
same members are one. In each list a parity sketch (a lower bound of the difference) rules out pairs without loss; what it leaves
connected is a candidate group, and there the sets themselves are intersected, most alike first, pairs already connected left out.
So neither lists nor groups ever give rise to all their pairs as rows, and no link between different components is missed.

Lists and groups are kept in cells of at most PART members (and PART_BYTES), by their measured length. Each cell is connected by itself; then one member of each
connected piece meets those of other cells, and so on; only where pieces stay apart do their members meet, in bands of like size (a set links with none beyond the next band) and
there in pairs of parts. Many copies alike thus cost their number. Members that are candidates of each other and yet not linked are copied three times as long as a band of a list
has no more than CROSS of them, beyond that once for each CROSS; and they cost the square of their number in comparisons of sketches.

Shingles are compared by 64-bit digests, made from digests of their words that are keyed by a secret of the job (two of one document pair clash about once in 10^13, and none at will).
Sets are one class if their sizes and two 64-bit sums of their digests agree. Null and empty texts have no set
and link with nothing. Rows that repeat a key count each by its own text. A null key has no number to lend: it takes the others' component.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstone.llm.common import buffers, hashes, mixed, shingles, slices, split_words, table
from sealstone.llm.components import HUBS, components, join_spread

PERCENT = 80
WORDS = 5
COMMON, COMMON_LEAST = 1_000_000, 16  #: common shingles that go to every task, and the documents that such a one is in at least
LIGHT_MOST = 1024
PART, PART_BYTES = 64, 16 << 20  #: members of a cell of a list or group, and bytes of their sets
CROSS = 4096  #: of those that stay apart, members of a part of a band: two parts meet in a cell, so each member is copied once for each part of the three bands it meets
BUCKET = 400_000  #: entries of a task, about
TASKS = 256  #: tasks that cells are dealt to, at least
LONG = 100_000  #: documents from which on a shingle's list is not dealt as one
BROADCAST_KEYS = 1_000_000  #: keys that are sent to every task rather than shuffled
SLICE = 2 << 20  #: bytes of text that a worker cuts into shingles at once
SKETCH = 10  #: the shortest sketches have 2 ** SKETCH bits


def new_secret() -> bytes:
    return os.urandom(16)


def least_overlap(n, percent: int):
    """Shingles that a set of n must share with any set it links to."""
    return (percent * n + 99) // 100


def most_apart(total, percent: int):
    """Size of the symmetric difference that two linked sets of that total size have at most."""
    return total - 2 * ((percent * total + 99 + percent) // (100 + percent))


def sets_of(texts: pa.Array, words: int, secret: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle digests of each text in order, end to end, and where each text's start."""
    data, off = buffers(texts)
    split = split_words(data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32), off)
    codes, distinct = split.codes()
    digest, start = shingles(hashes(distinct, secret)[codes] if len(codes) else np.zeros(0, np.uint64), split.doc, words)
    each = [np.unique(digest[a:b]) for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
    size = np.fromiter(map(len, each), np.int64, len(each))
    return np.concatenate(each) if each else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(size)])


def set_digests(digest: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of each set: sums of two independent mixings, whatever the order."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(digest + np.uint64(c)))]) for c in (11, 1234567)]
    one, two = (mixed(s[off[1:]] - s[off[:-1]]).view(np.int64) for s in sums)
    return one, two


def dealt(bucket: np.ndarray, values: np.ndarray, n: int) -> pa.RecordBatch:
    """Values as one packed row for each bucket that has some."""
    order = np.argsort(bucket, kind="stable")
    values, edge = values[order], np.searchsorted(bucket[order], np.arange(n + 1))
    some = np.flatnonzero(np.diff(edge))
    return pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "packed": pa.array([values[edge[b] : edge[b + 1]].tobytes() for b in some], pa.binary())})


def _bytes(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def bucket_of(x: np.ndarray, n: int) -> np.ndarray:
    return ((mixed(x ^ np.uint64(0x632BE59BD9B4E019)) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def n_buckets(n_docs: int, each: int) -> int:
    """Buckets for ``each`` entries a document: BUCKET entries in one, ten times as many where there would be over a thousand."""
    n = -(-n_docs * each // BUCKET)
    return max(8, min(n, 1024), n // 10)


def place_of(digest: np.ndarray, n: int) -> np.ndarray:
    """Bucket and low half of each digest: what shingles are counted by. Two shingles of one place are counted together, which changes their order and no result."""
    return bucket_of(digest, n).astype(np.uint64) << np.uint64(32) | digest & np.uint64(0xFFFFFFFF)


def packed(values: np.ndarray) -> bytes:
    """``uint32`` values in order, as steps of three bytes if all are short enough."""
    step = np.diff(values)
    if len(step) and int(step.max()) >= 1 << 24:
        return b"4" + values.astype("<u4").tobytes()
    return b"3" + values[:1].astype("<u4").tobytes() + step.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if raw[:1] == b"4":
        return np.frombuffer(raw, "<u4", offset=1)
    steps = np.zeros(((len(raw) - 5) // 3, 4), np.uint8)
    steps[:, :3] = np.frombuffer(raw, np.uint8, offset=5).reshape(-1, 3)
    return np.cumsum(np.concatenate([np.frombuffer(raw, "<u4", 1, 1), steps.view("<u4").ravel()]), dtype=np.uint32)


def common_shingles(docs: DataFrame, n_docs: int, words: int, secret: bytes) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Places of the most common shingles in order, the documents each is in, the number of buckets, and the mean length of the list an entry is in.

    Every shingle of every document is counted. At most COMMON are returned: they only order the others, whatever they are the result is the same. A shingle that is not
    among them is in at most entries / COMMON documents or so, which bounds the lists that are not dealt entry by entry."""
    n = n_buckets(n_docs, 200)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            place = np.sort(np.concatenate(held))
            edge = np.searchsorted(place, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
            some, low = np.flatnonzero(np.diff(edge)), (place & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            return pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "packed": pa.array([packed(low[edge[b] : edge[b + 1]]) for b in some.tolist()], pa.binary())})

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                held.append(place_of(sets_of(part.column("text"), words, secret)[0], n))
                size += len(held[-1])
                if size >= 1 << 20:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def count(rows: pa.Table) -> pa.Table:
        bucket = np.uint64(rows.column("bucket")[0].as_py() if rows.num_rows else 0)
        low, held = np.unique(np.concatenate([unpacked(x) for x in rows.column("packed").to_pylist()] or [np.zeros(0, np.uint32)]), return_counts=True)
        most = held >= COMMON_LEAST
        plain = held[~most].astype(float)
        place = (bucket << np.uint64(32) | low[most].astype(np.uint64)).view(np.int64)
        return pa.table({"place": np.append(place, 0), "held": np.append(held[most], 0), "entries": np.append(np.zeros(most.sum()), plain.sum()), "squares": np.append(np.zeros(most.sum()), (plain**2).sum())})

    counted = table(docs.select("text").mapInArrow(deal, "bucket int, packed binary").groupBy("bucket").applyInArrow(count, "place long, held long, entries double, squares double"), "shingle-counts")
    entries, squares = counted.agg(F.sum("entries"), F.sum("squares")).first()
    most = counted.filter("held > 0")
    size = F.floor(F.log2("held") * 256)  # classes of like counts, a few thousand
    classes = sorted(((r[0], r[1]) for r in most.groupBy(size.alias("size")).count().collect()), reverse=True)
    many = np.cumsum([n for _, n in classes])
    fits = int(np.searchsorted(many, COMMON, side="right"))  # whole classes only
    most = most.filter(size >= (classes[fits - 1][0] if fits else float("inf"))).select("place", "held").toArrow()
    place, held = most.column("place").to_numpy().view(np.uint64), most.column("held").to_numpy()
    order = np.argsort(place)
    return place[order], held[order], n, (squares / entries if entries else 1.0)


def is_common(digest: np.ndarray, common: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each shingle is a common one, and the documents it is in (0 if it is not)."""
    hot, held, n = common
    if not len(hot):
        return np.zeros(len(digest), bool), np.zeros(len(digest), np.int64)
    place = place_of(digest, n)
    at = np.minimum(np.searchsorted(hot, place), len(hot) - 1)
    same = hot[at] == place
    return same, np.where(same, held[at], 0)


def boundary(sizes: dict[int, int], mean_list: float, percent: int) -> int:
    """The size up to which sets are light, for which least is made: pairs of first shingles of light sets, list entries of the others."""
    n = np.arange(LIGHT_MOST + 1)
    many = np.array([sizes.get(int(i), 0) for i in n], float)
    first = n - least_overlap(n, percent) + 1
    pairs = np.cumsum(many * first * (first + 1) / 2)
    lists = many * first * (1 + mean_list)
    beyond = np.cumsum(lists[::-1])[::-1]
    return int(np.argmin([pairs[b] + beyond[min(LIGHT_MOST, percent * b // 100)] for b in n]))


class Forest:
    """Union-find over 0 .. n - 1; roots are smallest members."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], np.int64)


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Logarithm of a sketch's length: as many bits as shingles or up to four times as many, so long sets are told apart as well as short ones."""
    return SKETCH + 2 * np.maximum(0, np.ceil((np.log2(np.maximum(n, 1)) - SKETCH) / 2)).astype(np.int64)


def sketches(digest: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Parity sketch of each set: bit i tells whether an odd number of shingles fall on i. Halves laid over each other (xor) are the sketch of half the length."""
    at, bits = mixed(digest), sketch_bits(np.diff(off)).tolist()
    out = []
    for k, x, y in zip(bits, off[:-1].tolist(), off[1:].tolist(), strict=True):
        parity = np.bincount((at[x:y] & np.uint64((1 << k) - 1)).astype(np.int64), minlength=1 << k).astype(np.uint8) & 1
        out.append(np.packbits(parity).tobytes())
    return out


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while sketch.shape[1] > words:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def near_pairs(size: np.ndarray, sketch: list[bytes], percent: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows that sizes and sketches leave possible, with the sketches' distance, a block at a time. Sets of like length are compared only."""
    kinds = sketch_bits(size)
    rows = {k: np.flatnonzero(kinds == k) for k in np.unique(kinds).tolist()}
    held = {k: np.frombuffer(b"".join(sketch[i] for i in r), np.uint64).reshape(len(r), -1) for k, r in rows.items()}
    for k, m in [(k, m) for k in rows for m in (k, k + 2) if m in rows]:  # sets beyond the next length are too unlike
        left, right = held[k], _folded(held[m], held[k].shape[1])
        for a in range(0, len(left), block):
            for c in range(a if k == m else 0, len(right), 4 * block):
                i, j = rows[k][a : a + block], rows[m][c : c + 4 * block]
                x, y = size[i][:, None], size[j][None, :]
                fits = (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & ((i[:, None] < j[None, :]) if k == m else True)
                if not fits.any():
                    continue
                apart = np.zeros(fits.shape, np.int32)
                for w in range(left.shape[1]):
                    apart += np.bitwise_count(left[a : a + block, None, w] ^ right[None, c : c + 4 * block, w])
                p, q = np.nonzero(fits & (apart <= most_apart(x + y, percent)))
                yield i[p], j[q], apart[p, q]


def link(size: np.ndarray, sketch: list[bytes], sets: list[np.ndarray] | None, percent: int, piece: np.ndarray | None = None) -> np.ndarray:
    """Root of each set among its links: sets most alike by sketch first, pairs in one component already left out; without ``sets`` by sketches alone. ``piece``: what is connected beforehand."""
    forest = Forest(len(size))
    if piece is not None:
        first = np.unique(piece, return_index=True, return_inverse=True)
        for i, j in enumerate(first[1][first[2]].tolist()):
            forest.join(i, j)
    for i, j, apart in near_pairs(size, sketch, percent):
        root = forest.roots()
        open_ = root[i] != root[j]
        i, j, apart = i[open_], j[open_], apart[open_]
        for at in np.argsort(apart, kind="stable").tolist():
            x, y = int(i[at]), int(j[at])
            if forest.root(x) != forest.root(y):
                if sets is None:
                    forest.join(x, y)
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    forest.join(x, y)
    return forest.roots()


CELLS = "list long, node long, root long, wide boolean"


def stars(percent: int, exact: bool, paired: bool = False):
    """A function for ``applyInArrow`` on rows (cell, list, wide, node, n, sketch, and held if ``exact``, piece if ``paired``): the root of each member among those of its cell.

    Rows whose root is their own are left out unless the list is ``wide``, that is in several cells."""

    def run(rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"list": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "wide": pa.array([], pa.bool_())})
        cell, list_, node, n = (rows.column(c).to_numpy() for c in ("cell", "list", "node", "n"))
        wide = rows.column("wide").to_numpy(zero_copy_only=False)
        order = np.lexsort((node, n, list_, cell))
        same = lambda x: x[order][1:] == x[order][:-1]
        again = same(cell) & same(list_) & same(node)  # rows that repeat a document bring its set twice
        order = order[np.concatenate([[True], ~again])]
        edge = np.flatnonzero(np.concatenate([[True], ~(same(cell) & same(list_)), [True]]))
        size, n_, raw = np.diff(edge), n[order], rows.column("sketch").to_pylist()
        sketch = [raw[i] for i in order.tolist()]
        held = rows.column("held").to_pylist() if exact else None
        piece = rows.column("piece").to_numpy() if paired else None
        root = np.arange(len(order))
        done = size == 1
        if not exact and not paired:  # lists of two short sets, of which there are many, all at once
            two = edge[:-1][(size == 2) & (sketch_bits(n_[edge[:-1]]) == SKETCH) & (sketch_bits(n_[edge[1:] - 1]) == SKETCH)]
            first, second = (np.frombuffer(b"".join(sketch[i] for i in (two + k).tolist()), np.uint64).reshape(len(two), (1 << SKETCH) // 64) for k in (0, 1))
            x, y = n_[two], n_[two + 1]
            apart = np.bitwise_count(first ^ second).sum(axis=1).astype(np.int64)
            good = two[(apart <= most_apart(x + y, percent)) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))]
            root[good + 1] = good
            done |= np.isin(edge[:-1], two)
        for i in np.flatnonzero(~done).tolist():
            a, b = int(edge[i]), int(edge[i + 1])
            at = order[a:b]
            sets = [np.frombuffer(held[j], np.uint64) for j in at.tolist()] if exact else None
            root[a:b] = a + link(n[at], sketch[a:b], sets, percent, piece[at] if paired else None)
        keep = np.flatnonzero((root != np.arange(len(root))) | wide[order])
        return pa.table({"list": list_[order][keep], "node": node[order][keep], "root": node[order][root[keep]], "wide": pa.array(wide[order][keep])})

    return run


def connect(rows: DataFrame, percent: int, exact: bool, name: str, task: int) -> DataFrame:
    """Edges (a, b) over the members of each list, as connected as all their possible (``exact``: real) links. ``rows`` is a written table (list, node, n, sketch, and held if ``exact``); ``task``: rows of a task, about."""
    weight = F.octet_length("held") if exact else F.lit(0)
    n_parts = F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum(weight) / PART_BYTES)).cast("int")
    run = stars(percent, exact)

    def meet(t: DataFrame, run, rows_: int) -> DataFrame:
        tasks = max(TASKS, -(-rows_ // task))
        return t.withColumn("task", F.pmod(F.xxhash64("cell", F.lit(7)), F.lit(tasks))).groupBy("task").applyInArrow(run, CELLS)

    def in_cells(t: DataFrame, seed: int) -> tuple[DataFrame, int]:
        """Rows with their cell; and the number of lists of several cells."""
        many = table(t.groupBy("list").agg(n_parts.alias("parts")).filter("parts > 1"), f"{name}-long")
        n = many.count()
        if not n:
            return t.withColumn("cell", F.col("list")).withColumn("wide", F.lit(seed > 0)), 0
        told = join_spread(t, many, "list", "node", n, "left")
        own = F.pmod(F.xxhash64("node", F.lit(seed)), F.col("parts"))
        return told.withColumn("cell", F.when(F.col("parts") > 1, F.xxhash64("list", own)).otherwise(F.col("list"))).withColumn("wide", F.col("parts").isNotNull() | F.lit(seed > 0)).drop("parts"), n

    n_rows = rows.count()
    celled, n_wide = in_cells(rows, 0)
    found = table(meet(celled, run, n_rows), f"{name}-stars")
    edges = found.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    if not n_wide:
        return edges
    piece = table(found.filter("wide").select("list", "node", F.col("root").alias("piece")), f"{name}-pieces")
    count, seed = piece.count(), 0
    while True:  # one member of each piece meets those of others
        heads = table(rows.join(piece.filter("node = piece").select("list", "node"), ["list", "node"]).dropDuplicates(["list", "node"]), f"{name}-heads")
        before, count, seed = count, heads.count(), seed + 1
        celled, n_wide = in_cells(heads, seed)
        found = table(meet(celled, run, count), f"{name}-stars")
        new = found.filter("node <> root")
        edges = edges.union(new.select(F.col("root").alias("a"), F.col("node").alias("b")))
        moved = new.select("list", F.col("node").alias("piece"), F.col("root").alias("to"))
        n_moved = moved.count()
        piece = table(piece.join(moved, ["list", "piece"], "left").select("list", "node", F.coalesce("to", "piece").alias("piece")), f"{name}-pieces")
        if not n_wide or n_moved < 0.05 * count:
            break
    # Pieces still apart meet with all their members, but those of the largest with each other: they are connected. Only bands of like size meet.
    sizes = table(piece.groupBy("list", "piece").count(), f"{name}-sizes")
    largest = table(sizes.groupBy("list").agg(F.max(F.struct("count", "piece")).alias("top"), F.count("*").alias("n_pieces")).filter("n_pieces > 1").select("list", F.col("top.piece").alias("top")), f"{name}-apart")
    n_apart = largest.count()
    if not n_apart:
        return edges
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(max(1e-3, -math.log(percent / 100 - 1e-9)))).cast("int")
    left = join_spread(piece, largest, "list", "node", n_apart).join(rows.select("list", "node", band.alias("band"), weight.alias("bytes")).dropDuplicates(["list", "node"]), ["list", "node"])
    left = table(left.select("list", "node", "piece", "band", (F.col("piece") == F.col("top")).alias("is_top"), "bytes"), f"{name}-members")
    # Members of a band in parts, those of the largest piece by themselves.
    parts = F.greatest(F.ceil(F.count("*") / CROSS), F.ceil(F.sum("bytes") / PART_BYTES))
    bands = left.groupBy("list", "band", "is_top").agg(parts.cast("int").alias("parts")).groupBy("list", "band")
    bands = table(bands.agg(*(F.coalesce(F.max(F.when(c, F.col("parts"))), F.lit(0)).alias(k) for k, c in (("in_top", F.col("is_top")), ("others", ~F.col("is_top"))))), f"{name}-bands")
    n_bands = bands.count()
    of = lambda t, b: join_spread(t.withColumn("key", F.xxhash64("list", b)), bands.select(F.xxhash64("list", "band").alias("key"), "in_top", "others"), "key", "node", n_bands).drop("key")
    place = F.pmod(F.xxhash64("node", F.lit(-1)), F.when(F.col("is_top"), F.col("in_top")).otherwise(F.col("others"))) + F.when(F.col("is_top"), 0).otherwise(F.col("in_top"))
    own = of(left, "band").withColumn("own", F.struct("band", place.cast("int").alias("part"))).drop("in_top", "others")
    meets = of(own.withColumn("other", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))), "other")
    meets = meets.withColumn("first", F.when(F.col("is_top"), F.col("in_top")).otherwise(0)).filter("first < in_top + others")
    meets = meets.withColumn("part", F.explode(F.sequence("first", F.col("in_top") + F.col("others") - 1))).withColumn("with", F.struct(F.col("other").alias("band"), "part"))
    cell = F.xxhash64("list", F.least("own", "with"), F.greatest("own", "with"), F.lit("pair"))
    pairs = table(meets.select("list", "node", "piece", cell.alias("cell"), F.lit(False).alias("wide")), f"{name}-pairs")
    last = table(meet(rows.join(pairs, ["list", "node"]), stars(percent, exact, True), pairs.count()), f"{name}-stars")
    return edges.union(last.select(F.col("root").alias("a"), F.col("node").alias("b")))


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """A row for each document: key, n_shingles, component_id (smallest key reachable by links, its own included)."""
    spark = docs.sparkSession
    own = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    n_docs = own.count()
    secret = new_secret()  # of this job; it decides nothing but the order of shingles
    *common_, mean_list = common_shingles(own, n_docs, words, secret)
    common = spark.sparkContext.broadcast(tuple(common_))  # at most COMMON

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                digest, off = sets_of(part.column("text"), words, secret)
                n = np.diff(off)
                doc = np.repeat(np.arange(len(n)), n)
                last, _ = is_common(digest, common.value)
                # Place of each shingle in the corpus's order: rare ones by digest, then common ones by digest.
                rare = np.concatenate([[0], np.cumsum(~last)])
                before = rare[:-1] - rare[off[:-1]][doc]
                total = rare[off[1:]] - rare[off[:-1]]
                order = np.where(last, total[doc] + (np.arange(len(digest)) - off[:-1][doc] - before), before)
                most = np.minimum(n, n - least_overlap(n, percent) + 2)
                first = np.flatnonzero(order < most[doc])
                first = first[np.lexsort((order[first], doc[first]))]
                edge = np.concatenate([[0], np.cumsum(most)]).tolist()
                raw = digest[first].tobytes()
                one, two = set_digests(digest, off)
                yield pa.RecordBatch.from_pydict({"key": part.column("key"), "n": pa.array(n), "one": pa.array(one, mask=n == 0), "two": pa.array(two), "first": pa.array([raw[8 * x : 8 * y] for x, y in zip(edge[:-1], edge[1:], strict=True)], pa.binary()), "sketch": pa.array(sketches(digest, off), pa.binary())})

    every = table(own.mapInArrow(sets, "key long, n long, one long, two long, first binary, sketch binary"), "shingle-sets")
    same = every.filter("one is not null").groupBy("one", "two", "n").agg(F.min("key").alias("rep"), F.count("*").alias("copies"), F.first("first").alias("first"), F.first("sketch").alias("sketch"))
    classes = table(same.withColumn("node", F.monotonically_increasing_id()), "set-classes")
    sizes = {r[0]: r[1] for r in classes.filter(F.col("n") <= LIGHT_MOST).groupBy("n").count().collect()}  # LIGHT_MOST rows at most
    light = boundary(sizes, mean_list, percent)
    n_lists = n_buckets(n_docs, 120)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs, nodes, weight = [], [], []
            for node, n, raw in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("first").to_pylist(), strict=True):
                first = np.frombuffer(raw, np.uint64)
                if n > percent * light // 100:
                    one = first[: n - least_overlap(n, percent) + 1]
                    signs.append(mixed(one + np.uint64(1)))
                    nodes.append(np.full(len(one), node))
                    weight.append(one)
                if n <= light and len(first) > 1:
                    a, b = np.triu_indices(len(first), 1)
                    low, high = np.minimum(first[a], first[b]), np.maximum(first[a], first[b])
                    signs.append(mixed(low * np.uint64(0x9E3779B97F4A7C15) + mixed(high + np.uint64(2))))
                    nodes.append(np.full(len(a), node))
                    weight.append(first[a])  # the rarer of two, or as common: lists of pairs are no longer than its own
            if not signs:
                continue
            sign, node, shingle = np.concatenate(signs), np.concatenate(nodes), np.concatenate(weight)
            # What may be a long list is dealt entry by entry, as buckets beyond n_lists; no such list meets in one task.
            long_ = is_common(shingle, common.value)[1] > LONG
            spread_ = bucket_of(sign ^ mixed(node.view(np.uint64)), n_lists) + n_lists
            yield dealt(np.where(long_, spread_, bucket_of(sign, n_lists)), np.stack([sign, node.view(np.uint64)], axis=1), 2 * n_lists)

    def lists(rows: pa.Table) -> pa.Table:
        """Lists of two members and more, each set of members once in a task; entries of long lists as they are."""
        entry = _bytes(rows.column("packed"), np.uint64).reshape(-1, 2)
        if rows.num_rows and rows.column("bucket")[0].as_py() >= n_lists:
            return pa.table({"list": mixed(entry[:, 0]).view(np.int64), "node": entry[:, 1].view(np.int64)})
        entry = entry[np.lexsort((entry[:, 1], entry[:, 0]))]
        edge = np.flatnonzero(np.concatenate([[True], entry[1:, 0] != entry[:-1, 0], [True]]))
        size = np.diff(edge)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(entry[:, 1] + np.uint64(5)))])
        name = mixed((sums[edge[1:]] - sums[edge[:-1]]) + size.astype(np.uint64))
        many = np.flatnonzero(size > 1)
        many = many[np.unique(name[many], return_index=True)[1]]
        row = np.repeat(np.arange(len(many)), size[many])
        at = np.arange(len(row)) - np.repeat(np.cumsum(size[many]) - size[many], size[many]) + edge[:-1][many][row]
        return pa.table({"list": name[many][row].view(np.int64), "node": entry[at, 1].view(np.int64)})

    posted = classes.select("node", "n", "first").mapInArrow(post, "bucket int, packed binary").groupBy("bucket").applyInArrow(lists, "list long, node long")
    member = posted.dropDuplicates(["list", "node"])
    described = table(member.join(classes.select("node", "n", "sketch"), "node"), "lists")
    maybe = table(connect(described, percent, False, "possible", 20_000).distinct(), "possible-links")
    groups = components(maybe, "groups")
    wanted = table(groups.join(classes.select("node", "rep", "one", "two", "n", "sketch"), "node"), "wanted")
    n_wanted = wanted.count()
    # One text of each class: that of a row with its smallest key and its set. Rows of that key with another set bring none along.
    chosen = wanted.select(F.col("rep").alias("key"), "node", "one", "two", "n")
    chosen = F.broadcast(chosen) if n_wanted <= BROADCAST_KEYS else chosen.hint("shuffle_hash")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                digest, off = sets_of(part.column("text"), words, secret)
                one, two = set_digests(digest, off)
                own_ = (one == part.column("one").to_numpy()) & (two == part.column("two").to_numpy()) & (np.diff(off) == part.column("n").to_numpy())
                raw, edge = digest.tobytes(), (off * 8).tolist()
                at = np.flatnonzero(own_).tolist()
                yield pa.RecordBatch.from_pydict({"node": part.column("node").take(pa.array(at, pa.int64())), "held": pa.array([raw[edge[i] : edge[i + 1]] for i in at], pa.binary())})

    texts = own.join(chosen, own["key"].eqNullSafe(chosen["key"])).select("node", "one", "two", "n", "text")
    held = texts.mapInArrow(whole, "node long, held binary")
    checked = table(wanted.select(F.col("root").alias("list"), "node", "n", "sketch").join(held, "node"), "candidate-sets")
    links = table(connect(checked, percent, True, "links", 1000), "links")
    linked = components(links, "linked")
    least = table(linked.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("component")), "linked-least")
    named = join_spread(linked, least, "root", "node", least.count()).select("node", "component")
    of_class = table(classes.select("node", "one", "two", "n", "rep", "copies").join(named, "node", "left").select(F.col("one"), F.col("two"), F.col("n"), F.coalesce("component", "rep").alias("component"), "copies"), "class-components")
    # Classes of very many copies, HUBS at most, are sent to every task; the others are joined by key.
    often = max(1000, -(-n_docs // HUBS))
    by = ["one", "two", "n"]
    rows = every.select("key", "n", "one", "two")
    many = of_class.filter(F.col("copies") > often).drop("copies")
    out = [rows.filter("one is null").withColumn("component", F.lit(None).cast("long")).select("key", "n", "component")]
    out += [rows.join(F.broadcast(many), by).select("key", "n", "component")]
    out += [rows.filter("one is not null").join(F.broadcast(many.select(*by)), by, "left_anti").join(of_class.filter(F.col("copies") <= often), by).select("key", "n", "component")]
    both = out[0].union(out[1]).union(out[2])
    return both.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The documents with one row of each component: that of its smallest key. Rows without words stay. Of rows that repeat a key, one stays."""
    numbered = table(docs.withColumn("sealstone_row", F.monotonically_increasing_id()), "numbered")
    joined = join(numbered.select(F.col("sealstone_row"), F.col(text)), key="sealstone_row", text=text, percent=percent, words=words)
    named = joined.join(numbered.select("sealstone_row", F.col(key).alias("sealstone_key")), "sealstone_row")
    best = F.min(F.struct(F.col("sealstone_key").isNull().alias("last"), "sealstone_key", "sealstone_row")).alias("best")
    keep = named.groupBy("component_id").agg(best).select(F.col("best.sealstone_row").alias("sealstone_row"))
    return numbered.join(keep, "sealstone_row", "left_semi").select(*docs.columns)

"""Quality rules on whole texts: counts of words, signs, repeated lines and windows, and tokeniser fertility.

Fertility: two public vocabularies are run over the whole text. Characters a token (byte-level BPE)
tells text that the vocabulary knows from noise, the share of byte-fallback pieces (sentencepiece)
tells foreign scripts and broken encodings, the entropy of token ids tells repetition. Each has a band
for the language or, where that is not known, the script; a text outside a band is rejected.

Measures of a short text vary more, so every limit widens with the square root of its number of tokens; no length
goes unjudged. A null or empty text has no words and fails. A table without a language column, or a null language, is
judged by script. Rows are judged each by itself, so ties and repeated rows change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstone.llm.common import Words, buffers, mixed, shingles, slices, split_words
from sealstone.llm.encoding import Encoder, Met

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT = 20  #: percent of the words


@dataclass(frozen=True)
class Band:
    """What is kept, ends included, of texts long enough; see ``fits`` for shorter ones. With a centre, characters a token must also
    be within WIDTH deviations of it; the variance is a + b / tokens."""

    chars_per_token: tuple[float, float] = (1.2, 7.0)
    byte_share: float = 0.35
    entropy: float = 3.0  #: bits a token, of the document's own ids
    per_token_entropy: float = 0.3  #: entropy over that of equally many different ids
    centre: float | None = None
    variance: tuple[float, float] = (0.0, 0.0)
    floors: tuple[float, ...] = ()  #: least entropy of texts of 1, 2, 4, 8 ... tokens and more, where fitted (nan: not)


WIDTH = 5.0
#: Variance of the characters of one token, for limits that are not fitted; tokens from which the least entropy holds in full.
TOKEN_VARIANCE, FULL_ENTROPY = 6.0, 64
#: By language and script ("sr/latin"), else by language, else by script, else "".
BANDS = {"": Band(), "latin": Band((1.25, 6.5), 0.10), "cyrillic": Band((0.4, 4.0), 0.35), "cjk": Band((0.25, 3.0), 0.95), "other": Band((0.2, 6.0), 0.98)}
#: Labelled documents that bands are fitted on at most, and so many that the given band counts for beside those of a language.
FIT_ROWS, GIVEN = 4096, 10
#: A further script of a language is one of its own from this share of its labelled documents on.
SCRIPT_SHARE = 0.02
#: Bytes of text that a worker measures at once.
SLICE = 1 << 20


def n_of(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of set flags in each stretch."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def duplicate_lines(data: np.ndarray, off: np.ndarray, words: Words) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of it."""
    ends = np.flatnonzero(data == 10)
    start = np.union1d(np.append(off[:-1], ends + 1), np.zeros(0, np.int64))
    start = start[start < len(data)]
    if not len(start):
        return np.zeros(len(off) - 1, np.int64)
    upto = np.append(start[1:], len(data))
    has_word = np.searchsorted(words.start, upto) > np.searchsorted(words.start, start)
    kept = np.concatenate([[0], np.cumsum(data != 10)])
    line_off = np.append(kept[start], kept[-1]).astype(np.int64)
    codes = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(line_off), pa.py_buffer(data[data != 10])).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    doc = np.searchsorted(off, start, side="right") - 1
    pair = (doc * (int(codes.max()) + 1) + codes)[has_word]
    distinct = np.unique(pair) // (int(codes.max()) + 1)
    rows = len(off) - 1
    return np.bincount(doc[has_word], minlength=rows) - np.bincount(distinct, minlength=rows)


def repeated_words(word_hash: np.ndarray, words: Words, k: int = WINDOW) -> np.ndarray:
    """Per text, the words inside windows of k words that the text holds twice or more."""
    rows, counts = len(words.doc) - 1, words.counts
    digest, off = shingles(word_hash, words.doc, k)
    doc = np.repeat(np.arange(rows), np.diff(off))
    digest = mixed(digest + doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(digest, kind="stable")
    same = digest[order][1:] == digest[order][:-1]
    twice = np.zeros(len(digest), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    twice &= (counts >= k)[doc]
    begin = (np.arange(len(digest)) - off[:-1][doc] + words.doc[:-1][doc])[twice]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.subtract.at(edge, begin + k, 1)
    return n_of(np.cumsum(edge)[:-1] > 0, words.doc)


class PieceCounter:
    """Pieces, and byte-fallback pieces, of each word under a sentencepiece vocabulary; short words met again are remembered."""

    _open: dict[str, PieceCounter] = {}

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.met = Met(np.int32)

    @classmethod
    def of(cls, path: str) -> PieceCounter:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _count(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self.model.encode(words, num_threads=1)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = self.is_byte[np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))]
        return np.stack([sizes, n_of(flat, np.concatenate([[0], np.cumsum(sizes)]))], axis=1).astype(np.int32).ravel(), np.full(len(words), 2)

    def count(self, distinct: pa.Array) -> np.ndarray:
        """``int32[n, 2]``: pieces and byte pieces of each distinct word."""
        return self.met.arrays(distinct, self._count)[0].reshape(-1, 2)


def entropy(ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits a token of each document's own distribution of ids."""
    rows, size = len(off) - 1, np.diff(off)
    pair, n = np.unique(np.repeat(np.arange(rows), size) << 20 | ids, return_counts=True)
    doc = pair >> 20
    total = np.maximum(size, 1)[doc]
    return np.bincount(doc, -(n / total) * np.log2(n / total), minlength=rows).astype(float)  # of no ids at all it counts in integers


def scripts(data: np.ndarray, off: np.ndarray) -> list[str]:
    """The script that most letters of each text are in, by the leading bytes of their UTF-8."""
    latin = n_of(((data | 32) - np.uint8(97) < 26) | (data >= 0xC3) & (data <= 0xC9), off)
    cyrillic = n_of((data >= 0xD0) & (data <= 0xD3), off)
    cjk = n_of((data >= 0xE3) & (data <= 0xED), off)
    other = n_of((data >= 0xCE) & (data <= 0xCF) | (data >= 0xD4) & (data <= 0xE2), off)
    names = np.array(["latin", "cyrillic", "cjk", "other"])
    return names[np.argmax(np.stack([latin, cyrillic, cjk, other]), axis=0)].tolist()


def band_of(bands: dict[str, Band], lang: str | None, script: str) -> Band:
    return next(bands[x] for x in ((f"{lang}/{script}", lang) if lang else ()) + (script, "") if x in bands)


def fits(band: list[Band], got: dict[str, np.ndarray], n_pieces: np.ndarray) -> np.ndarray:
    """Whether each text's measures lie in its band.

    With n tokens the limits of characters a token and of the byte share are WIDTH standard errors of a mean of n wider, and the least entropy is in proportion to the largest that n tokens can have, up to FULL_ENTROPY."""
    x, n = got["chars_per_token"], np.maximum(got["n_tokens"], 1)
    low, high = np.array([b.chars_per_token for b in band], float).reshape(-1, 2).T
    slack = WIDTH * np.sqrt(TOKEN_VARIANCE / n)
    good = (x >= low - slack) & (x <= high + slack)
    share = np.array([b.byte_share for b in band], float)
    good &= got["byte_share"] <= share + WIDTH * np.sqrt(share * (1 - share) / n_pieces)
    bits = np.log2(np.maximum(n, 2))
    good &= got["token_entropy"] >= np.array([b.entropy for b in band], float) * np.minimum(1, bits / np.log2(FULL_ENTROPY))
    good &= got["token_entropy"] >= np.array([b.per_token_entropy for b in band], float) * bits
    at = np.floor(np.log2(n)).astype(int).tolist()
    floor = np.array([b.floors[i] if i < len(b.floors) else np.nan for b, i in zip(band, at, strict=True)], float)
    good &= np.isnan(floor) | (got["token_entropy"] >= floor)
    centre = np.array([np.nan if b.centre is None else b.centre for b in band], float)
    a, b = np.array([b.variance for b in band], float).reshape(-1, 2).T
    return good & (np.isnan(centre) | (np.abs(x - centre) <= WIDTH * np.sqrt(a + b / n)))


def measured(texts: pa.Array, langs: list, bpe: str, pieces: str, bands: dict[str, Band]) -> dict[str, np.ndarray]:
    """All measures and the verdict for a batch of texts."""
    data, off = buffers(texts)
    words = split_words(data, off)
    codes, distinct = words.codes()
    n = words.counts
    chars = n_of((data & 0xC0) != 0x80, off)
    gaps = n_of((data == 32) | ((data - np.uint8(9)) < 5), off)
    sign = np.zeros(256, bool)
    sign[list(SYMBOLS)] = True
    out = {"n_words": n, "word_chars": chars - gaps, "n_symbols": n_of(sign[data], off), "n_dup_lines": duplicate_lines(data, off, words), "n_repeat_words": repeated_words(mixed(codes.astype(np.uint64) + np.uint64(1)), words)}
    ids, ids_off = Encoder.of(bpe).encode(texts)
    tokens = np.diff(ids_off)
    counted = PieceCounter.of(pieces).count(distinct)[codes] if len(codes) else np.zeros((0, 2), np.int32)
    n_pieces, n_bytes = (np.concatenate([[0], np.cumsum(counted[:, i], dtype=np.int64)]) for i in (0, 1))
    n_pieces, n_bytes = (x[words.doc[1:]] - x[words.doc[:-1]] for x in (n_pieces, n_bytes))
    out |= {"n_tokens": tokens, "chars_per_token": chars / np.maximum(tokens, 1), "byte_share": n_bytes / np.maximum(n_pieces, 1), "token_entropy": entropy(ids, ids_off)}
    out["script"] = scripts(data, off)
    fit = fits([band_of(bands, a, b) for a, b in zip(langs, out["script"], strict=True)], out, np.maximum(n_pieces, 1))
    out["base_failed"] = (n < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT * n)
    out["kept"] = ~out["base_failed"] & fit
    return out


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double"


def quality(docs: DataFrame, bpe: str, pieces: str, *, key: str = "doc_id", text: str = "text", lang: str | None = "lang", bands: dict[str, Band] = BANDS, measures: str = MEASURES, also_lang: bool = False) -> DataFrame:
    """A row for each document: key, the measures (and the language). No shuffle; a task holds a slice of bounded size and the words it remembers."""
    names = [x.split()[0] for x in measures.split(", ")]
    more = ["lang"] * also_lang

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                got = measured(part.column("text"), part.column("lang").to_pylist(), bpe, pieces, bands)
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(got[c]) for c in names), *(part.column(c) for c in more)], [key, *names, *more])

    known = F.col(lang).cast("string") if lang and lang in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), known.alias("lang")).mapInArrow(run, f"{key} long, {measures}" + ", lang string" * also_lang)


def _spread(x: np.ndarray, least: float) -> tuple[float, float]:
    """Median, and a deviation that a few odd documents do not widen."""
    middle = float(np.median(x))
    return middle, max(least, 1.4826 * float(np.median(np.abs(x - middle))))


def fitted(base: Band, x: np.ndarray, n: np.ndarray, share: np.ndarray, bits: np.ndarray) -> Band:
    """The band with the centre and variance of characters a token ``x`` in documents of ``n`` tokens, and limits of their byte shares and entropies.

    The given band's deviations and limits count for GIVEN documents beside them: a few documents narrow it a little, and one more never turns it over."""
    trust = len(x) / (len(x) + GIVEN)
    low, high = base.chars_per_token
    centre = float(np.median(x[n >= np.median(n)]))
    off = (x - centre) ** 2 / (1 / n + 1 / np.median(n))  # in units of about like size, so that short texts do not rule
    off = np.minimum(off, 9 * np.median(off) / 0.455) * (1 / n + 1 / np.median(n))  # a few odd documents do not widen the band
    weight = 1 / (1 / n + 1 / np.median(n))
    a, b = (max(float(v), 0.0) for v in np.linalg.lstsq(np.stack([weight, weight / n], 1), off * weight, rcond=None)[0])
    blend = lambda own, given: trust * own + (1 - trust) * given
    middle, wide = _spread(share, 0.02)
    floors = [float("nan")] * (int(np.log2(n.max())) + 1)
    for i in range(len(floors)):
        like = bits[np.floor(np.log2(n)) == i]
        if len(like):
            at, off_ = _spread(like, 0.15)
            floors[i] = max(0.0, at - WIDTH * off_ * (1 + GIVEN / len(like)))
    variance = (blend(max(a, 1e-4) ** 0.5, (high - low) / 2 / WIDTH) ** 2, blend(b**0.5, TOKEN_VARIANCE**0.5) ** 2)
    return replace(base, centre=centre, variance=variance, byte_share=blend(min(base.byte_share, middle + WIDTH * wide), base.byte_share), floors=tuple(floors))


def fit_bands(docs: DataFrame, labels: DataFrame, bpe: str, pieces: str, *, key: str = "doc_id", text: str = "text", lang: str = "lang", good: str = "quality = 1", bands: dict[str, Band] = BANDS, rows: int = FIT_ROWS) -> dict[str, Band]:
    """Bands with a centre for each language and script of the good documents among at most ``rows`` labelled ones, drawn by hash of the key.

    The fixed limits are those of the script. A language's texts in a script rare among its good documents (SCRIPT_SHARE) are judged by the band of its most frequent script.
    Documents that the base rules fail take no part. Languages without good ones keep the given bands, as do all where there is no language column.
    Of rows that repeat a key one takes part, the same one in each run: that of the smallest text."""
    if lang not in docs.columns:
        return dict(bands)
    drawn = labels.filter(good).select(F.col(key).cast("long").alias("drawn")).dropDuplicates().orderBy(F.xxhash64("drawn"), "drawn").limit(rows)
    sample = docs.join(F.broadcast(drawn), docs[key] == drawn["drawn"])  # at most ``rows`` keys
    once = sample.select(F.col("drawn").alias("key"), F.struct(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang")).alias("row")).groupBy("key").agg(F.min("row").alias("row"))
    own = once.select("key", "row.text", "row.lang")
    got = quality(own, bpe, pieces, key="key", bands=bands, measures=f"{MEASURES}, script string", also_lang=True)
    got = got.filter("not base_failed").select("lang", "chars_per_token", "n_tokens", "script", "byte_share", "token_entropy").collect()  # at most ``rows``
    out = dict(bands)
    for name in sorted({r[0] for r in got} - {""}):
        of = {script: sorted(tuple(r) for r in got if r[0] == name and r[3] == script) for script in sorted({r[3] for r in got if r[0] == name})}
        main = max(of, key=lambda script: len(of[script]))
        for script, rows_of in of.items():
            if len(rows_of) >= SCRIPT_SHARE * sum(map(len, of.values())):
                out[f"{name}/{script}"] = fitted(bands.get(script, bands[""]), *(np.array([r[i] for r in rows_of], float) for i in (1, 2, 4, 5)))
        out[name] = out[f"{name}/{main}"]
    return out


def keep_good(docs: DataFrame, bpe: str, pieces: str, *, text: str = "text", lang: str | None = "lang", bands: dict[str, Band] = BANDS) -> DataFrame:
    """The documents that are kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE):
                langs = part.column(lang).to_pylist() if lang in docs_columns else [None] * part.num_rows
                yield part.filter(pa.array(measured(part.column(text), langs, bpe, pieces, bands)["kept"]))

    docs_columns = docs.columns
    return docs.mapInArrow(run, docs.schema)

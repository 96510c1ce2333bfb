"""Main-text extraction: a recurrent labeller reads a page's blocks in order.

A page is cut into leaf blocks at block-level tags. Each block has a vector of its tag path (tags,
class and id words of what it stands in), of its hashed words, and a few measures. A bidirectional LSTM,
in numpy, runs over all blocks of the page and labels each; blocks labelled main are joined. The weights
come from ``html_train`` (pages made there, with labels known by construction) and lie beside this file.

Script, style, title, textarea and the like are left out to their end tags, as browsers do; so are noscript (what a browser with scripts never shows), template and select where they have one. A comment ends as browsers end it, a quote
opens a value only right after the equals sign. Of a
drawing (svg) nothing is read, up to its end or the next block of the page; formulas and the fallback of objects are text. A page costs time and
memory in proportion to its length, however its tags are nested or broken.

A null or empty page has an empty text. Pages are read one by one: ties, repeated rows and other columns change nothing.
The weights have seen pages with usual names of classes; how well they do on pages of the open web has not been measured.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstone.llm.common import buffers, mixed, slices, split_words

PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 32, 16, 6, 24
DIM = 2 * PATH_DIM + WORD_DIM + MEASURES
WEIGHTS = Path(__file__).with_name("models") / "html_blocks.npz"
PAGES_AT_ONCE = 512

_TOKEN = re.compile(
    r"""<!--(?:(?P<ended>-?>|.*?--!?>)|.*\Z)
    |<(?P<raw>script|style|iframe|textarea|title|xmp|noembed|noframes)(?=[\s/>])[^>]*+>.*?(?:(?P<shut></(?P=raw)(?=[\s/>])[^>]*+>)|\Z)
    |<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>
    |<[a-z/!?][^>]*+>""",
    re.S | re.I | re.X,
)
_OPEN = re.compile(r"<[a-z/!?]", re.I)
#: Left out with all they hold, if they have an end tag.
SKIPPED = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in ("noscript", "template", "select")}
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
MATH = "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd maction semantics annotation"
INLINE = frozenset(f"{MATH} a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of the same set, but no further out than the boundary given.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = frozenset("address article aside blockquote body div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html main nav ol p pre section table ul".split())


class Place:
    """An element of a tag path, as ``tag word word``, below another. Like paths are one object, so a page deep in elements has as many as it has elements."""

    __slots__ = ("parent", "name", "depth", "below", "vector")
    made = 0

    def __init__(self, parent: Place | None, name: str) -> None:
        self.parent, self.name, self.depth, self.below, self.vector = parent, name, parent.depth + 1 if parent else 0, {}, None
        Place.made += 1

    def child(self, name: str) -> Place:
        got = self.below.get(name)
        if got is None:
            got = self.below[name] = Place(self, name)
        return got

    def __iter__(self) -> Iterator[str]:
        """Names from the outermost element."""
        names, at = [], self
        while at.parent:
            names.append(at.name)
            at = at.parent
        return reversed(names)


_root = Place(None, "")


def top() -> Place:
    """What all paths are below. Begins anew when PLACES have been made since."""
    global _root
    if Place.made > PLACES:
        Place.made, _root = 0, Place(None, "")
    return _root


PLACES = 100_000


def blocks(page: str) -> list[tuple[Place, str, float]]:
    """Leaf blocks in order: tag path, text, share of its characters inside links."""
    out: list[tuple[Place, str, float]] = []
    place = top()
    stack: list[tuple[str, Place]] = []  # open elements, each with the place it is in
    where: dict[str, list[int]] = {}  # heights in the stack of open elements of each tag
    parts: list[str] = []
    linked, in_link, in_drawing = 0, False, False
    endless: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((place, text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not in_drawing:
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def close(height: int) -> None:
        """Close all elements from that height up."""
        nonlocal place
        while len(stack) > height:
            tag, place = stack.pop()
            where[tag].pop()

    end, at, ended = page.rfind(">") + 1, 0, True  # no tag ends beyond
    while m := _TOKEN.search(page, at, end):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if m["raw"]:
            ended = bool(m["shut"])
            if not in_drawing:
                flush()
            continue
        if not tag:
            ended = not m[0].startswith("<!--") or bool(m["ended"])
            continue
        closes = m["attrs"].endswith("/")
        if tag in SKIPPED and not m["close"] and tag not in endless:
            until = SKIPPED[tag].search(page, at, end)
            if until:
                flush()
                at = until.end()
            else:
                endless.add(tag)
            continue
        if tag == "svg":
            in_drawing = not m["close"] and not closes
            continue
        if tag in INLINE or tag in SKIPPED:
            in_link = not m["close"] if tag == "a" else in_link
            continue
        if in_drawing and tag not in ENDS_P:
            continue
        in_drawing = False
        flush()
        if m["close"]:
            if where.get(tag):
                close(where[tag][-1])
                in_link = False
            continue
        if tag in ENDS_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in IMPLIED:
            ends, upto = IMPLIED[tag]
            least = max((where[t][-1] for t in upto if where.get(t)), default=-1)
            inside = [h for t in ends if where.get(t) for h in where[t][bisect_right(where[t], least) :][:1]]
            if inside:
                close(min(inside))
        if tag not in VOID and not closes:
            marks = " ".join(w for x in _MARK.findall(m["attrs"]) for w in _SPLIT.split("".join(x).lower()) if w and not w.isdigit()) if m["attrs"] else ""
            stack.append((tag, place))
            where.setdefault(tag, []).append(len(stack) - 1)
            place = place.child(f"{tag} {marks}".strip())
    if ended:  # beyond the last tag, up to one that has no end
        broken = _OPEN.search(page, at)
        add(page[at : broken.start() if broken else len(page)])
    flush()
    return out


@cache
def _unit(name: str, dim: int) -> np.ndarray:
    """A fixed random direction for a name."""
    x = np.random.Generator(np.random.PCG64(zlib.crc32(name.encode()))).standard_normal(dim)
    return (x / np.sqrt(dim)).astype(np.float32)


#: Multipliers and byte values of the feature hash that the weights were trained with: fixed values.
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, (2, 256), np.uint64)


def word_slots(distinct: pa.Array) -> np.ndarray:
    """Feature hash of each word. Words that share a slot share a vector, no more; nothing takes it for the word itself."""
    data, off = buffers(distinct)
    size = np.diff(off)
    out = size.astype(np.uint64)
    for base, values in zip(_BASES, _BYTES, strict=True):
        place = np.arange(len(data)) - np.repeat(off[:-1], size)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(1, int(size.max(initial=0))), base)]))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * powers[place])])
        out = mixed(out * base + (total[off[1:]] - total[off[:-1]]))
    return out


_WORDS = np.random.Generator(np.random.PCG64(7)).standard_normal((4096, WORD_DIM)).astype(np.float32)


@cache
def _own_vector(name: str) -> np.ndarray:
    tag, *words = name.split()
    return sum((_unit(n, PATH_DIM) for n in sorted({tag, *(f".{w}" for w in words)})), np.zeros(PATH_DIM, np.float32))


def _path_vector(path: Place) -> np.ndarray:
    """Sum of the vectors of all elements of the path, and that of the last one."""
    above = []
    while path.vector is None and path.parent:
        above.append(path)
        path = path.parent
    vector = path.vector if path.parent else np.zeros(2 * PATH_DIM, np.float32)
    for path in reversed(above):
        own = _own_vector(path.name)
        path.vector = vector = np.concatenate([vector[:PATH_DIM] + own, own])
    return vector


def features(pages: list[list]) -> list[np.ndarray]:
    """``float32[blocks, DIM]`` for each page, from its blocks."""
    for names in (_own_vector, _unit):
        if names.cache_info().currsize > PLACES:
            names.cache_clear()
    flat = [b for page in pages for b in page]
    out = np.empty((len(flat), DIM), np.float32)
    data, off = buffers(pa.array([t for _, t, _ in flat], pa.large_utf8()))
    words = split_words(data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32), off)
    codes, distinct = words.codes()
    ids = (word_slots(distinct) & np.uint64(4095)).astype(np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
    n = np.maximum(words.counts, 1)
    if len(ids):
        held = words.counts > 0
        total = np.zeros((len(flat), WORD_DIM), np.float32)
        total[held] = np.add.reduceat(_WORDS[ids], words.doc[:-1][held], axis=0)
        out[:, 2 * PATH_DIM : 2 * PATH_DIM + WORD_DIM] = total / n[:, None]
    else:
        out[:, 2 * PATH_DIM : 2 * PATH_DIM + WORD_DIM] = 0
    ends = np.array([t.count(". ") + t.endswith((".", "!", "?")) for _, t, _ in flat], np.float32)
    sizes = [len(p) for p in pages]
    place = np.concatenate([np.arange(s) / max(1, s) for s in sizes]) if flat else np.zeros(0)
    for i, (path, _, _) in enumerate(flat):
        out[i, : 2 * PATH_DIM] = _path_vector(path)
    if flat:
        out[:, 2 * PATH_DIM + WORD_DIM :] = np.stack([np.minimum(1, n / 50), np.log1p(n) / 6, [b[2] for b in flat], np.minimum(1, ends / 5), place, [b[0].depth / 10 for b in flat]], axis=1)
    return np.split(out, np.cumsum(sizes)[:-1]) if pages else []


class Labeller:
    """Forward pass of the two LSTMs and the output unit."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights

    @classmethod
    @cache
    def load(cls, path: str = str(WEIGHTS)) -> Labeller:
        with np.load(path) as f:
            return cls({k: f[k].astype(np.float32) for k in f.files})

    @staticmethod
    def run(x: np.ndarray, live: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``x[steps, pages, DIM]``, ``live[steps, pages]``: state after each step; dead steps keep the state."""
        steps, pages, _ = x.shape
        n = u.shape[0]
        h, c, out = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32), np.empty((steps, pages, n), np.float32)
        for t in range(steps):
            if t % 4096 == 0:
                drive = x[t : t + 4096] @ w + b
            z = drive[t % 4096] + h @ u
            gate = 1 / (1 + np.exp(-z[:, : 3 * n]))
            c2 = gate[:, n : 2 * n] * c + gate[:, :n] * np.tanh(z[:, 3 * n :])
            h2 = gate[:, 2 * n :] * np.tanh(c2)
            on = live[t][:, None]
            c, h = np.where(on, c2, c), np.where(on, h2, h)
            out[t] = h
        return out

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of each block of each page to be main text. Pages of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        a = 0
        while a < len(order):
            most = max(1, min(64, 200_000 // max(1, len(pages[order[min(len(order) - 1, a + 63)]]))))
            group = order[a : a + most]
            a += most
            size = np.array([len(pages[i]) for i in group])
            x = np.zeros((int(size.max()), len(group), DIM), np.float32)
            for j, i in enumerate(group):
                x[: size[j], j] = pages[i]
            live = np.arange(len(x))[:, None] < size
            ahead = self.run(x, live, self.w["wf"], self.w["uf"], self.w["bf"])
            back = self.run(x[::-1], live[::-1], self.w["wb"], self.w["ub"], self.w["bb"])[::-1]
            z = np.concatenate([ahead, back], axis=2) @ self.w["wo"] + self.w["bo"]
            for j, i in enumerate(group):
                out[i] = 1 / (1 + np.exp(-z[: size[j], j, 0]))
        return out


def extract(pages: list[str | None], labeller: Labeller) -> list[tuple[str, int, int]]:
    """Per page: main text, number of blocks, number of main blocks."""
    cut = [blocks(p or "") for p in pages]
    scored = labeller.scores(features(cut))
    main = [[t for (_, t, _), s in zip(b, p, strict=True) if s >= 0.5] for b, p in zip(cut, scored, strict=True)]
    return [(" ".join(m), len(b), len(m)) for m, b in zip(main, cut, strict=True)]


def main_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row for each page: key, url, text, n_chars, n_blocks, n_main. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller.load()
        for batch in batches:
            for big in slices(batch, "html"):
                for a in range(0, big.num_rows, PAGES_AT_ONCE):
                    part = big.slice(a, PAGES_AT_ONCE)
                    got = extract(part.column("html").to_pylist(), labeller)
                    yield pa.RecordBatch.from_pydict({key: part.column("key"), "url": part.column("url"), "text": pa.array([g[0] for g in got], pa.string()), "n_chars": pa.array([len(g[0]) for g in got], pa.int64()), "n_blocks": pa.array([g[1] for g in got], pa.int64()), "n_main": pa.array([g[2] for g in got], pa.int64())})

    return pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(run, f"{key} long, url string, text string, n_chars long, n_blocks long, n_main long")

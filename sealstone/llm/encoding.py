"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once per worker.

Both public BPE vocabularies cut a text by a regular expression before any merge, so ids never
depend on what stands beyond such a cut. Texts are cut where every one of those expressions
must cut: before a single ASCII space character between two visible ones, and between a letter
and an ASCII sign. The pieces are encoded by the library; a piece met again costs a table look-up.
"""

from __future__ import annotations

import json
import os
from itertools import chain
from weakref import WeakSet

import numpy as np
import pyarrow as pa

from sealstone.llm.common import buffers, is_space, mixed

#: Bytes of pieces (of SHORT bytes at most) and their ids that a worker remembers, about.
REMEMBERED = 36 << 20
SHORT = 48


def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces start, and the end of the data."""
    n = len(data)
    at = np.zeros(n, dtype=bool)
    if n:
        gap = is_space(data)
        letter = ((data | np.uint8(32)) - np.uint8(97)) < 26
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        # A multi-byte character may be a space itself: then there is no cut beside it.
        starts_odd = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))
        ends_odd = (data >= 0x80) & ~letter
        at[1:-1] = gap[1:-1] & ~(gap[:-2] | ends_odd[:-2]) & ~(gap[2:] | starts_odd[2:])
        sign = (data > 32) & (data < 127) & ~letter & ~((data - np.uint8(48)) < 10)
        at[1:] |= sign[1:] & letter[:-1]
        at[off[:-1][np.diff(off) > 0]] = True
    return np.append(np.flatnonzero(at), n)


#: Pre-tokenisation (and, with it, normalisation) of the public vocabularies for which the cuts are right: fixed values of their files.
CUT_SAFE = (
    (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    ),
)


class Met:
    """Arrays of short strings met before, one for each string, in a few flat arrays. A digest finds a string, its bytes decide. Beyond REMEMBERED bytes it starts anew."""

    every: WeakSet[Met] = WeakSet()

    def __init__(self, kind) -> None:
        self.kind = kind
        self.forget()
        Met.every.add(self)

    def forget(self) -> None:
        self.known, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # digests in order, and the number of each one's string
        self.text, self.text_off = np.zeros(0, np.uint8), np.zeros(1, np.int32)
        self.values, self.off = np.zeros(0, self.kind), np.zeros(1, np.int32)

    def held(self) -> int:
        return sum(x.nbytes for x in (self.known, self.where, self.text, self.text_off, self.values, self.off))

    def find(self, digest: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each string, -1 if it is not there, and whether another has its digest."""
        number = np.full(len(digest), -1, np.int64)
        place = np.searchsorted(self.known, digest)
        inside = np.flatnonzero(place < len(self.known))
        inside = inside[self.known[place[inside]] == digest[inside]]
        at, size = self.where[place[inside]].astype(np.int64), np.diff(off)[inside]
        same = np.diff(self.text_off)[at] == size
        maybe, at, size = inside[same], at[same], size[same]
        differs = self.text[spread(self.text_off[:-1][at], size)] != data[spread(off[:-1][maybe], size)]
        total = np.concatenate([[0], np.cumsum(differs)])
        end = np.cumsum(size)
        good = total[end] == total[end - size]
        number[maybe[good]] = at[good]
        taken = np.zeros(len(digest), bool)
        taken[inside] = True
        return number, taken

    def add(self, digest: np.ndarray, data: np.ndarray, off: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
        """Remember strings with new digests, each digest once; their arrays lie in ``values`` end to end."""
        digest, first = np.unique(digest, return_index=True)
        n, long_ = len(self.off) - 1, np.diff(off)[first]
        begin = np.cumsum(sizes) - sizes
        self.text = np.concatenate([self.text, data[spread(off[:-1][first], long_)]])
        self.text_off = np.concatenate([self.text_off, (self.text_off[-1] + np.cumsum(long_)).astype(np.int32)])
        self.values = np.concatenate([self.values, values[spread(begin[first], sizes[first])]])
        self.off = np.concatenate([self.off, (self.off[-1] + np.cumsum(sizes[first])).astype(np.int32)])
        known, where = np.concatenate([self.known, digest]), np.concatenate([self.where, np.arange(n, n + len(first), dtype=np.int32)])
        order = np.argsort(known, kind="stable")  # of two runs in order
        self.known, self.where = known[order], where[order]

    def arrays(self, distinct: pa.Array, make) -> tuple[np.ndarray, np.ndarray]:
        """Array of each of the ``distinct`` strings, end to end, and where each begins; ``make`` gives (values, sizes) of a list of those not met before."""
        if self.held() > REMEMBERED:
            self.forget()
        data, off = buffers(distinct)
        short = np.diff(off) <= SHORT
        digest = np.zeros(len(distinct), np.uint64)
        digest[short] = quick_digests(data, off[:-1][short], np.diff(off)[short])
        number, taken = self.find(digest, data, off)
        number[~short] = -1
        met, new = number >= 0, np.flatnonzero(number < 0)
        size = np.zeros(len(distinct), np.int64)
        size[met] = self.off[number[met] + 1] - self.off[number[met]]
        if len(new):
            made, sizes = make(distinct.take(pa.array(new)).to_pylist())
            size[new] = sizes
        begin = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(begin[-1], self.kind)
        if met.any():
            out[spread(begin[:-1][met], size[met])] = self.values[spread(self.off[number[met]], size[met])]
        if len(new):
            out[spread(begin[new], sizes)] = made
            keep = short[new] & ~taken[new]
            self.add(digest[new][keep], *gathered(data, off, new[keep]), made[np.repeat(keep, sizes)], sizes[keep])
        return out, begin


def quick_digests(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A digest of each short string, eight bytes at a time; only to find it by."""
    out, place = size.astype(np.uint64), np.arange(8)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    for at in range(0, int(size.max(initial=0)), 8):
        on = np.flatnonzero(size > at)
        lane = np.where(place < size[on][:, None] - at, data[np.minimum(begin[on] + at, len(data) - 8)[:, None] + place], 0).astype(np.uint8).view("<u8").ravel()
        out[on] = mixed(out[on] * np.uint64(0x9E3779B97F4A7C15) + lane)
    return out


def gathered(data: np.ndarray, off: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of those strings end to end, and where each begins."""
    size = np.diff(off)[at]
    return data[spread(off[:-1][at], size)], np.concatenate([[0], np.cumsum(size)])


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the stretches that begin there and have those sizes, in order."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(begin - (end - size), size)


class Encoder:
    """Encodes batches of texts; keeps the ids of pieces it has met. A vocabulary that cuts texts in another way than those known encodes whole texts."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        stated = json.loads(self.tokenizer.to_str())
        self.may_cut = (stated["normalizer"], stated["pre_tokenizer"]) in CUT_SAFE
        self.met = Met(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """That of a file, opened once as long as a worker process stays with it. With another one a worker begins another stage: what it held for the one before is let go."""
        if path not in cls._open:
            cls._open.clear()
            for met in Met.every:
                met.forget()
            cls._open[path] = cls(path)
        return cls._open[path]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = []
        for a in range(0, len(texts), 50_000):
            lists += [x.ids for x in self.tokenizer.encode_batch_fast(texts[a : a + 50_000], add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids start (null: empty): ``(uint32[n], int64[rows + 1])``."""
        data, off = buffers(texts)
        start = cuts(data, off) if self.may_cut else np.append(off[:-1][np.diff(off) > 0], len(data))
        if len(start) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(start) - 1, pa.py_buffer(start), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        ids, begin = self.met.arrays(coded.dictionary, self._encode)
        number = coded.indices.to_numpy(zero_copy_only=False)
        size = np.diff(begin)[number]
        end = np.cumsum(size)
        piece_of = np.searchsorted(start[:-1], off)
        return ids[spread(begin[:-1][number], size)].astype(np.uint32), np.concatenate([[0], end])[piece_of]

"""Poseidon over many pairs at once, in numpy: a lane a pair, each step a row of all lanes.

Inside, an element stands in Montgomery form by its residues modulo two bases of small primes, A and B: products are made residue by residue, and what is linear (the rounds' matrices, the ways
between the bases) is a matrix product. Residues by B, weighted so that with the cofactors they add up to the number, and how often B's product is too much in that sum, are its terms (``TERMS``): a
map leads from them to any linear form of elements modulo the field's order, its last row being the quotient by the order. Residues are signed; all sums stay below 2 ** 53 and are exact.
Outside, an element is a column of limbs: doubles with their weight, multiples of 2 ** (BITS * i)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache
from itertools import count, islice
from math import isqrt, prod

import numpy as np

from sealstone.functions.poseidon import PARTIAL, WIDTH, P, constants, partial_rounds

BITS, LIMBS = 23, 11
#: Primes of a base, of 24 bits; rows of an element's terms, and of its residues by both bases.
BASE = 11
TERMS, BOTH = BASE + 1, 2 * BASE
#: Lanes that go through together, so that they stay in the cache.
LANES = 1024
#: Partial rounds between two updates of the elements that these do not raise.
TOGETHER = 3


def _signed(x: int, m: int) -> int:
    return (x + m // 2) % m - m // 2


def _column(x: Sequence[float]) -> np.ndarray:
    return np.array(x, float)[:, None]


def _limbs(x: int) -> list[int]:
    """Signed limbs; the last takes what is left."""
    out, half = [], 1 << BITS - 1
    for _ in range(LIMBS - 1):
        out.append((x + half) % (1 << BITS) - half)
        x = (x - out[-1]) >> BITS
    return [*out, x]


class _Bases:
    """The primes, and what is fixed by them."""

    def __init__(self) -> None:
        primes = lambda first: list(islice((x for x in count(first, -4) if all(x % d for d in range(3, isqrt(x) + 1, 2))), BASE))
        a, b = primes((1 << 24) - 1), primes((1 << 24) - 3)  # 3 modulo 4, where one of x and -x is a square
        self.by_a, self.by_b = prod(a), prod(b)
        away = [-pow(P * (self.by_a // m), -1, m) for m in a]
        root = [pow(x % m, (m + 1) // 4, m) for x, m in zip(away, a, strict=True)]
        sign = [1 if (r * r - x) % m == 0 else -1 for r, x, m in zip(root, away, a, strict=True)]
        #: Factors of residues: by A a product is then a term of the multiple of the order to be added, by B the product is divided by A's.
        self.both = (root + [pow(self.by_a, -1, m) for m in b], a + b)
        #: Factors of terms, and what leads to terms from residues by B.
        self.terms = ([pow(self.by_b // m, -1, m) for m in b], b)
        self.weights = _column([_signed(self.by_a * f, m) for f, m in zip(*self.terms, strict=True)])
        self.values = [*(self.by_b // m for m in b), -self.by_b]
        self.share = 1 / _column(b).T
        self.added = np.array([[_signed(s * P * pow(m * self.by_a, -1, n), n) for m, s in zip(a, sign, strict=True)] for n in b], float)
        self.back = np.array([[_signed(x * f, m) for x in self.values] for f, m in zip(root, a, strict=True)], float)
        self.moduli = _column(a + b)
        self.order = {n: _column([_signed(P * f, m) for f, m in zip(*own, strict=True)]) for n, own in {"both": self.both, "b": self.terms}.items()}


@cache
def bases() -> _Bases:
    return _Bases()


def _map(to: str, parts: Sequence[tuple[int, str]]) -> np.ndarray:
    """The matrix to the sum of ``factor * input``, a quotient below. Inputs: ``terms``, ``limbs``, or ``one``; results: ``both`` residues, those of terms (``b``), or ``limbs``."""
    known, columns = bases(), []
    inputs = {"terms": [(x, 0) for x in known.values], "limbs": [(1 << BITS * i, BITS * i) for i in range(LIMBS)], "one": [(1, 0)]}
    for factor, name in parts:
        for value, weight in inputs[name]:
            x = _signed(factor * value, P)
            if to == "limbs":
                own = [np.ldexp(float(limb), BITS * i) for i, limb in enumerate(_limbs(x))]
            else:
                own = [float(_signed(x * f, m)) for f, m in zip(*(known.both if to == "both" else known.terms), strict=True)]
            columns.append(np.ldexp([*own, x / P], -weight))
    return np.array(columns).T.copy()


@cache
def maps() -> dict[str, list[np.ndarray]]:
    """The matrices in order of the rounds; constants stand in a row of ones, those of a next full round are added by the one before."""
    before, after, first, rows, power, g = partial_rounds()
    m, by = constants()[1], bases().by_a
    raised = before[0][0] ** 5  # the first element is the same for all pairs
    start = [_map("both", [((1 - i) * by, "limbs"), (i * by, "limbs"), (before[0][1 + i] * by, "one")]) for i in (0, 1)]
    full = lambda adds, kinds: np.concatenate([_map(kinds[i], [*((x, "terms") for x in m[i]), (adds[i] * by, "one")]) for i in range(WIDTH)])
    head = np.concatenate([_map("both", [(m[i][1], "terms"), (m[i][2], "terms"), ((m[i][0] * raised + before[1][i]) * by, "one")]) for i in range(WIDTH)])
    all_ = ["both"] * WIDTH
    steps, both = [], []
    for at in range(0, PARTIAL, TOGETHER):
        own, last = rows[at : at + TOGETHER], at + TOGETHER >= PARTIAL
        for k, (a1, a2, e, _, _) in enumerate(own):
            add = e + (after[0][0] if at + k == PARTIAL - 1 else 0)
            steps.append(_map("both", [(a1, "terms"), (a2, "terms"), (add * by, "one"), *((a1 * b1 + a2 * b2, "terms") for *_, b1, b2 in own[:k]), (m[0][0], "terms")]))
        left = [(*power[i], g[i] + after[0][1 + i]) for i in (0, 1)] if last else [(1, 0, 0), (0, 1, 0)]
        both.append(np.concatenate([_map("both" if last else "b", [(x, "terms"), (y, "terms"), (add * by, "one"), *((x * b1 + y * b2, "terms") for *_, b1, b2 in own)]) for x, y, add in left]))
    return {
        "start": [np.concatenate(start)], "head": [head, *(full(k, all_) for k in before[2:]), full([first, 0, 0], ["both", "b", "b"])], "steps": steps, "both": both, "tail": [full(k, all_) for k in after[1:]],
        "end": [_map("limbs", [*((x * pow(by, -1, P), "terms") for x in m[0]), (0, "one")])],
    }


class _Lanes:
    """Room for some lanes, and the hash."""

    def __init__(self, n: int) -> None:
        self.known, self.maps = bases(), maps()
        wide = lambda x: np.repeat(x, n, axis=1)  # noqa: E731  numpy is slower at columns
        all_, a, b = wide(self.known.moduli), slice(0, BASE), slice(BASE, BOTH)
        inverse = 1 / all_
        self.moduli = {"a": (all_[a], inverse[a]), "b": (all_[b], inverse[b]), "both": (all_, inverse)}
        self.order, self.weights = {by: wide(x) for by, x in self.known.order.items()}, wide(self.known.weights)
        self.spare, self.product, self.powers = np.empty((BOTH, n)), np.empty((BOTH, n)), np.empty((2, BOTH, n))
        self.terms, self.added = np.empty((TERMS, n)), np.empty((BASE, n))
        self.states = np.empty((WIDTH * (BOTH + 1), n))
        self.full, self.held = np.ones((WIDTH * TERMS + 1, n)), np.ones(((2 + TOGETHER) * TERMS + 1, n))

    def reduce(self, x: np.ndarray, by: str) -> None:
        moduli, inverse = self.moduli[by]
        times = np.multiply(x, inverse, out=self.spare[: len(x)])
        np.rint(times, out=times)
        times *= moduli
        x -= times

    def settle(self, x: np.ndarray, by: str) -> np.ndarray:
        """Residues of a map's result, of an element no farther from 0 than about half the order."""
        own, quotient = x[:-1], x[-1]
        np.rint(quotient, out=quotient)
        own -= np.multiply(self.order[by], quotient, out=self.spare[: len(own)])
        self.reduce(own, by)
        return own

    def overflow(self, terms: np.ndarray) -> None:
        np.matmul(self.known.share, terms[:BASE], out=terms[BASE:])
        np.rint(terms[BASE:], out=terms[BASE:])

    def times(self, x: np.ndarray, y: np.ndarray, out: np.ndarray, terms: np.ndarray) -> None:
        """The terms of the product, and in ``out`` its residues by B."""
        np.multiply(x, y, out=out)
        low, high = out[:BASE], out[BASE:]
        self.reduce(low, "a")
        high += np.matmul(self.known.added, low, out=self.added)
        self.reduce(high, "b")
        np.multiply(high, self.weights, out=terms[:BASE])
        self.reduce(terms[:BASE], "b")
        self.overflow(terms)

    def fifth(self, x: np.ndarray, terms: np.ndarray) -> None:
        """The terms of the fifth power."""
        state = x
        for power in self.powers:
            self.times(state, state, power, self.terms)
            np.matmul(self.known.back, self.terms, out=power[:BASE])
            self.reduce(power[:BASE], "a")
            state = power
        self.times(state, x, self.product, terms)

    def state(self, i: int) -> np.ndarray:
        return self.states[i * (BOTH + 1) : (i + 1) * (BOTH + 1)]

    def raise_all(self) -> None:
        for i in range(WIDTH):
            self.fifth(self.settle(self.state(i), "both"), self.full[i * TERMS : (i + 1) * TERMS])

    def keep(self, at: int) -> None:
        """The second and third element, as their terms, from a row of the states on."""
        for i in (0, 1):
            terms = self.held[i * TERMS : (i + 1) * TERMS]
            terms[:BASE] = self.settle(self.states[at + i * TERMS : at + (i + 1) * TERMS], "b")
            self.overflow(terms)

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        held, full, known, ones = self.held, self.full, self.maps, 2 * TERMS
        held[:LIMBS], held[LIMBS : 2 * LIMBS], held[2 * LIMBS] = a, b, 1
        np.matmul(known["start"][0], held[: 2 * LIMBS + 1], out=self.states[: 2 * (BOTH + 1)])
        for i in (0, 1):
            self.fifth(self.settle(self.state(i), "both"), full[i * TERMS : (i + 1) * TERMS])
        full[ones] = 1
        np.matmul(known["head"][0], full[: ones + 1], out=self.states)
        full[-1] = held[ones] = 1
        for matrix in known["head"][1:]:
            self.raise_all()
            np.matmul(matrix, full, out=self.states[: len(matrix)])
        self.keep(BOTH + 1)
        steps = iter(known["steps"])
        for both in known["both"]:
            at = ones + 1
            while at < both.shape[1]:
                self.fifth(self.settle(self.state(0), "both"), held[at : at + TERMS])
                at += TERMS
                np.matmul(next(steps), held[:at], out=self.state(0))
            rest = self.states[BOTH + 1 : BOTH + 1 + len(both)]
            np.matmul(both, held[:at], out=rest)
            if len(both) == 2 * TERMS:
                self.keep(BOTH + 1)
        for matrix in known["tail"]:
            self.raise_all()
            np.matmul(matrix, full, out=self.states)
        self.raise_all()
        return _settled(np.matmul(known["end"][0], full, out=self.states[: LIMBS + 1]))


@cache
def _order() -> np.ndarray:
    return np.ldexp(_column(_limbs(P)), BITS * np.arange(LIMBS)[:, None])


def _settled(x: np.ndarray) -> np.ndarray:
    """Limbs of a map's result, each but the last at most about half of its unit's power."""
    own, magic = x[:-1] - _order() * np.rint(x[-1]), np.ldexp(1.5, 52 + BITS * np.arange(1, LIMBS))[:, None]
    for _ in range(2):
        over = (own[:-1] + magic) - magic  # what a row carries
        own[:-1] -= over
        own[1:] += over
    return own


def elements(numbers: Sequence[int]) -> np.ndarray:
    """``float64[LIMBS, n]`` of numbers from 0 to below 2 ** 256."""
    raw = np.zeros((len(numbers), 36), np.uint8)
    raw[:, :32] = np.frombuffer(b"".join(x.to_bytes(32, "little") for x in numbers), np.uint8).reshape(-1, 32)
    out = np.empty((LIMBS, len(numbers)))
    for i in range(LIMBS):
        begin, shift = divmod(BITS * i, 8)
        word = np.ascontiguousarray(raw[:, begin : begin + 4]).view("<u4")[:, 0] >> np.uint32(shift)
        out[i] = np.ldexp((word & np.uint32((1 << BITS) - 1) if i < LIMBS - 1 else word).astype(float), BITS * i)
    return out


def numbers(limbs: np.ndarray) -> list[int]:
    """The elements, from 0 to below the field's order."""
    plain = np.ldexp(limbs, -BITS * np.arange(LIMBS)[:, None]).astype(np.int64)
    return [sum(x << BITS * i for i, x in enumerate(own)) % P for own in plain.T.tolist()]


def hashed(a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    """``poseidon`` of pairs of elements; ``a`` may be one number for all."""
    n = b.shape[1]
    a = np.broadcast_to(elements([a]), b.shape) if isinstance(a, int) else a
    out, room = np.empty((LIMBS, n)), None
    for own in np.array_split(np.arange(n), -(-n // LANES)) if n else ():
        part = slice(own[0], own[-1] + 1)
        if room is None or room.spare.shape[1] != len(own):
            room = _Lanes(len(own))
        out[:, part] = room.hash(a[:, part], b[:, part])
    return out


def tagged(domain: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return hashed(hashed(domain, left), right)

"""Canonical JSON text: NFC strings, keys in UTF-16 order, exact decimals; anything ambiguous is refused.

The parser is Python's, with hooks that keep number literals as they stand and see every pair of an object."""

from __future__ import annotations

import json
import re
import unicodedata
from decimal import Decimal, InvalidOperation

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sealstone.functions.batches import bounds, give_back

# Fixed values of the format.
DEPTH = 64
FIXED_EXPONENTS = range(-6, 21)
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_ESCAPED = re.compile(r'["\\\x00-\x1f]')


class NotCanonical(ValueError):
    pass


class _Number(str):
    pass


class _Object(list):
    pass


def _number(text: str) -> str:
    d = Decimal(text)
    if not d:
        return "0"
    sign, digits, exponent = d.as_tuple()
    shown = "".join(map(str, digits)).rstrip("0")
    exponent += len(digits) - len(shown)
    if not -(2**63) <= exponent < 2**63:
        raise NotCanonical("exponent out of range")
    scale = len(shown) - 1 + exponent
    if scale not in FIXED_EXPONENTS:
        out = shown[0] + ("." + shown[1:] if len(shown) > 1 else "") + f"e{'+' if scale >= 0 else ''}{scale}"
    elif exponent >= 0:
        out = shown + "0" * exponent
    else:
        padded = shown.rjust(1 - exponent, "0")
        out = padded[:exponent] + "." + padded[exponent:]
    return "-" * sign + out


def _string(text: str) -> str:
    text = unicodedata.normalize("NFC", text)
    if any("\ud800" <= c <= "\udfff" for c in text):
        raise NotCanonical("a lone surrogate")
    return '"' + _ESCAPED.sub(lambda m: _ESCAPES.get(m[0], f"\\u{ord(m[0]):04x}"), text) + '"'


def _encoded(x, depth: int) -> str:
    if depth > DEPTH:
        raise NotCanonical("nested too deeply")
    if isinstance(x, _Number):
        return _number(x)
    if isinstance(x, str):
        return _string(x)
    if x is None or isinstance(x, bool):
        return {None: "null", True: "true", False: "false"}[x]
    if not isinstance(x, _Object):
        return "[" + ",".join(_encoded(v, depth + 1) for v in x) + "]"
    named = [(unicodedata.normalize("NFC", k), v) for k, v in x]
    if len({k for k, _ in named}) < len(named):
        raise NotCanonical("a key occurs twice")
    named.sort(key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{_string(k)}:{_encoded(v, depth + 1)}" for k, v in named) + "}"


def _refuse(name: str):
    raise NotCanonical(f"{name} is not JSON")


def canonical(text: str | bytes) -> str:
    """The canonical form; NotCanonical if there is none."""
    try:
        text = text.decode("utf-8") if isinstance(text, bytes) else text
        if text[:1] == "﻿":
            raise NotCanonical("a byte-order mark")
        return _encoded(json.loads(text, object_pairs_hook=_Object, parse_int=_Number, parse_float=_Number, parse_constant=_refuse), 0)
    except (json.JSONDecodeError, UnicodeDecodeError, InvalidOperation, RecursionError) as e:
        raise NotCanonical(str(e)) from None


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Canonical form of each text; null for null and for texts without one."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical(t)
        except NotCanonical:
            return None

    return texts.map(one, na_action="ignore")


@F.arrow_udf(StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """Each text in Unicode's composed form; null stays null. Texts that are so already, which nearly all are, are found by a quick check. About 1 MB of texts are Python's at a time."""
    one = lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)
    out = [pa.array([one(t) for t in texts.slice(at, n).to_pylist()], pa.string()) for at, n in bounds(texts)]
    give_back()
    return pa.concat_arrays(out) if out else pa.array([], pa.string())

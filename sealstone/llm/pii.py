"""Personal data by weak supervision, in DataFrame operations alone.

Candidates are spans of four base patterns and of a few looser ones. Labelers vote on each: its own
regular expression and check digits, gazetteers (issuers, calling codes, reserved networks, placeholders),
context cues before it, its borders, and its shape. Votes are counted by pattern of votes, of which there are a few hundred at
most whatever the corpus; expectation-maximisation on these counts estimates each labeler's reliabilities
without any labels. A logistic span classifier is trained on the posteriors that these give; besides the votes it sees the span itself: its hashed shape, its
length, and the hashed word before it. Base spans that pass their own checks always stay; the classifier decides on all other candidates.

Positions are code points, the end exclusive. Null and empty texts have no spans. Each row is judged by itself, but for the
reliabilities, which are the corpus's; repeated rows count as often as they occur. A text with n candidates costs about n * sqrt(n) small steps at worst.
The classifier is fitted on the TRAIN most frequent patterns of votes and features; the reliabilities are estimated from all candidates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealstone.llm.common import table

#: Leftmost matches of the base patterns. Possessive parts and the look-behind change no match; they keep long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass to have a match.
GUARDS = {"email": "instr(text, '@') > 0", "phone": "instr(text, '+') > 0"}
#: Looser candidates: kind, and the pattern of the whole span. Borders before it keep a look-up at each place short; no part has a largest length that is not the format's own.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)++",
    "phone": r"\(?\b[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "secret": r"""\b(?i:password|passwd|pwd|secret|token|api[_-]?key)["']? ?[=:] ?(?:"[^"\n]{6,}+"|'[^'\n]{6,}+'|["']?[^\s,;"']{6,}+)|-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]++(?:-----END [A-Z ]*PRIVATE KEY-----)?"""
    r"""|\b(?i:bearer) [A-Za-z0-9._~+/-]{16,}+=*+|\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*+|\bAKIA[0-9A-Z]{16}\b""",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")
LABELERS = ("check", "gazetteer", "context", "border", "shape")
CONTEXT = 40
#: What the classifier sees of a span besides votes: name, and number of values. TRAIN: patterns that it is fitted on, at most.
FEATURES = {"form": 16, "long": 6, "word": 16}
TRAIN = 20_000
#: Largest share of real numbers of these kinds that fail their own check digits or ranges. EM alone could take any two clusters for its classes.
CHECKED, FAILS = ("ip", "card", "iban"), 0.005
#: Characters of the blocks that a text with spans is cut from.
BLOCK = 4096

#: Gazetteers: fixed values of public registers.
CALLING_CODES = r"^\+ ?\(?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|36|6011|62|64|65)"
RESERVED_IP = r"^(?:0|10|127|255)\.|^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\."
TOP_DOMAINS = r"(?i)(?:\.| ?[\[(]dot[\])] ?)(?:com|org|net|edu|gov|info|io|co|de|fr|es|it|nl|uk|ch|at|be|se|pl|ru|jp|cn|in|br|us|ca|au|eu)$"
PLACEHOLDERS = r"""(?i)[=:] ?["']?(?:x+|\*+|change.?me|example|none|null|true|false|your.*|<.*)["']?$"""
CUES = {
    "email": r"(?i)(?:mail|contact|write|kontakt|correo|courriel)\W",
    "ip": r"(?i)(?:\bip\b|server|host|address|login|from|client)",
    "card": r"(?i)(?:card|visa|master|amex|pay|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|telefon|appel|llama)",
    "iban": r"(?i)(?:iban|bank|account|konto|compte|cuenta)",
    "secret": r"(?i)(?:login|user|account|credential|key)",
    "ssn": r"(?i)(?:ssn|social|security|insurance)",
}
AGAINST = r"(?i)(?:version|isbn|order|invoice|serial|build|release|doi|part)\W{0,3}(?:no\.?|#)?\W{0,3}$"


def _found(pattern: str, guard: str | None) -> Column:
    """All matches of a text."""
    text = F.col("text") if guard is None else F.when(F.expr(guard), F.col("text")).otherwise(F.lit(""))
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _running(rows: DataFrame, of: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Adds, under each name, the running value of an array column before each of its elements. ``of``: name to (array column, SQL that joins ``a`` and ``x``, value before all).

    An array is taken in about sqrt(n) blocks of about sqrt(n), so that growing arrays are copied n * sqrt(n) times over, not n * n."""
    none = "cast(array() as array<bigint>)"
    width = lambda c: f"cast(greatest(16, ceil(sqrt(size({c})))) as int)"
    step = lambda op: f"(a, x) -> named_struct('t', {op.format(a='a.t', x='x')}, 'out', concat(a.out, array(a.t)))"
    rows = rows.select("*", *(F.expr(f"if(size({c}) <= 0, null, transform(sequence(0, cast((size({c}) - 1) / {width(c)} as int)), b -> slice({c}, b * {width(c)} + 1, {width(c)})))").alias(f"block_{k}") for k, (c, _, _) in of.items()))
    rows = rows.select("*", *(F.expr(f"transform(block_{k}, c -> aggregate(c, named_struct('t', {zero}, 'out', {none}), {step(op)}))").alias(f"part_{k}") for k, (_, op, zero) in of.items()))
    begin = {k: f"aggregate(transform(part_{k}, y -> y.t), named_struct('t', {zero}, 'out', {none}), {step(op)}).out" for k, (_, op, zero) in of.items()}
    out = {k: f"coalesce(flatten(zip_with(part_{k}, {begin[k]}, (y, o) -> transform(y.out, z -> {op.format(a='o', x='z')}))), {none})" for k, (_, op, _) in of.items()}
    return rows.select("*", *(F.expr(out[k]).alias(k) for k in of)).drop(*(f"{x}_{k}" for k in of for x in ("block", "part")))


SUM, MOST, LEAST = ("{a} + {x}", "0L"), ("greatest({a}, {x})", "0L"), ("least({a}, {x})", "9223372036854775807L")
SPAN = "array<struct<s: int, e: int, t: string, l: string, r: string>>"


def _spans(kind: str) -> Column:
    """Array of (start, end, text, left, right) of all matches, from the matches, the stretches before and after each, and the length of all before."""
    return F.expr(f"""if(size(m_{kind}) <= 0, cast(array() as {SPAN}), zip_with(zip_with(m_{kind}, slice(g_{kind}, 1, size(m_{kind})), (m, g) -> named_struct('m', m, 'g', g)),
        zip_with(at_{kind}, slice(g_{kind}, 2, size(m_{kind})), (p, n) -> named_struct('p', p, 'n', n)),
        (x, y) -> named_struct('s', cast(y.p + length(x.g) as int), 'e', cast(y.p + length(x.g) + length(x.m) as int), 't', x.m, 'l', right(x.g, {CONTEXT}), 'r', left(y.n, 1))))""")


def _digits(t: str) -> str:
    return f"regexp_replace({t}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """Whether the digits ``d`` have a right check digit: every second from the end counts double, less 9 if over 9."""
    return f"""aggregate(transform(split(reverse({d}), ''), (c, i) -> if(c = '', 0, if(i % 2 = 0, int(c), int(c) * 2 - if(int(c) > 4, 9, 0)))), 0, (a, b) -> a + b) % 10 = 0"""


def _check(kind: str) -> str:
    """The base check of a match ``x``."""
    d = _digits("x.t")
    return {
        "email": "true",
        "ip": r"forall(split(x.t, '[.]'), p -> length(regexp_replace(p, '^0+(?=[0-9])', '')) <= 3 and int(right(p, 3)) <= 255)",
        "card": f"length({d}) between 16 and 19 and {_luhn(d)}",
        "phone": f"length({d}) between 8 and 15",
    }[kind]


def _mod97(t: str) -> str:
    """Whether the account number ``t`` has a right check number: the first four signs last, letters as 10 to 35, the whole leaves 1 on division by 97."""
    own = f"replace({t}, ' ', '')"
    return f"aggregate(split(concat(substr({own}, 5), left({own}, 4)), ''), 0, (a, c) -> case when c = '' then a when c between '0' and '9' then (a * 10 + int(c)) % 97 else (a * 100 + ascii(c) - 55) % 97 end) = 1"


def _features() -> dict[str, str]:
    """SQL of the features of a candidate ``x``."""
    form = r"regexp_replace(regexp_replace(regexp_replace(x.t, '[0-9]+', '0'), '[a-z]+', 'a'), '[A-Z]+', 'A')"
    word = "lower(regexp_extract(x.l, '([A-Za-z]+)[^A-Za-z]*$', 1))"
    return {"form": f"crc32({form}) % {FEATURES['form']}", "long": f"least({FEATURES['long'] - 1}, greatest(0, floor(log2(greatest(length(x.t), 1)) - 2)))", "word": f"crc32({word}) % {FEATURES['word']}"}


def candidates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: key, and ``found``: array of (kind, base, s, e, votes and features)."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    carried = [F.col(f"carry_{c}") for c in carry]
    patterns = {**PATTERNS, "loose": "|".join(LOOSE.values())}
    rows = rows.select("*", *(_found(p, GUARDS.get(k)).alias(f"m_{k}") for k, p in patterns.items()))
    rows = rows.select("*", *(F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).alias(f"g_{k}") for k, p in patterns.items()))
    rows = rows.select("*", *(F.expr(f"if(size(m_{k}) <= 0, cast(array() as array<bigint>), zip_with(m_{k}, slice(g_{k}, 1, size(m_{k})), (m, g) -> cast(length(m) + length(g) as bigint)))").alias(f"size_{k}") for k in patterns))
    rows = _running(rows, {f"at_{k}": (f"size_{k}", *SUM) for k in patterns})
    rows = rows.select("key", *carried, *(_spans(k).alias(k) for k in patterns))
    base = ", ".join(f"transform({k}, x -> named_struct('kind', '{k}', 'base', {_check(k)}, 's', x.s, 'e', x.e, 't', x.t, 'l', x.l, 'r', x.r))" for k in PATTERNS)
    kind_of = "case " + " ".join(f"when x.t rlike '^(?:{_sql(p)})$' then '{k}'" for k, p in LOOSE.items()) + " end"
    loose = f"transform(loose, x -> named_struct('kind', {kind_of}, 'base', false, 's', x.s, 'e', x.e, 't', x.t, 'l', x.l, 'r', x.r))"
    rows = rows.select("key", *carried, F.expr(f"concat({base}, {loose})").alias("all"))
    # In order of their starts: the largest end of the base spans before, and the smallest start of those after. A secret may hold a base span; redaction joins the two.
    rows = rows.withColumn("all", F.expr("array_sort(filter(all, x -> x.kind is not null), (p, q) -> case when p.s <> q.s then p.s - q.s when p.base = q.base then 0 when p.base then -1 else 1 end)"))
    rows = rows.withColumn("ends", F.expr("transform(all, x -> if(x.base, cast(x.e as bigint), 0L))")).withColumn("starts", F.expr("reverse(transform(all, x -> if(x.base, cast(x.s as bigint), 9223372036854775807L)))"))
    rows = _running(rows, {"end_before": ("ends", *MOST), "start_after": ("starts", *LEAST)})
    apart = "zip_with(all, zip_with(end_before, reverse(start_after), (p, q) -> named_struct('p', p, 'q', q)), (x, y) -> if(x.base or x.kind = 'secret' or (y.p <= x.s and y.q >= x.e), x, null))"
    rows = rows.select("key", *carried, F.expr(f"filter({apart}, x -> x is not null)").alias("found"))
    votes = ", ".join(f"'{name}', cast({_vote(name)} as tinyint)" for name in LABELERS)
    seen = ", ".join(f"'{name}', cast({sql} as tinyint)" for name, sql in _features().items())
    return rows.select("key", *carried, F.expr(f"transform(found, x -> named_struct('kind', x.kind, 'base', x.base, 's', x.s, 'e', x.e, {votes}, {seen}))").alias("found"))


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _by_kind(cases: dict[str, str], otherwise: str = "0") -> str:
    return "case x.kind " + " ".join(f"when '{k}' then {v}" for k, v in cases.items()) + f" else {otherwise} end"


def _vote(labeler: str) -> str:
    """+1: personal data; -1: not; 0: no vote. Clean borders and a likely shape are had by most numbers, so they speak for nothing; their opposites speak against."""
    d = _digits("x.t")
    yes_no = lambda test: f"if({test}, 1, -1)"
    rl = lambda t, p: f"{t} rlike '{_sql(p)}'"
    if labeler == "check":
        strict = {"iban": yes_no(f"length(replace(x.t, ' ', '')) between 15 and 34 and {_mod97('x.t')}"), "ssn": yes_no(rl("x.t", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)")), "secret": yes_no(rl("x.t", r"""^[^=:]*+[=:] ?["']?(?=[^0-9]*+[0-9])[^"']{8,}["']?$|^-----BEGIN|^eyJ|^AKIA|^(?i:bearer) (?=[^0-9]*+[0-9])"""))}
        return f"if(x.base, 1, {_by_kind({'ip': yes_no(rl('x.t', ':.*[0-9]|[0-9].*:')), 'card': '-1', 'phone': f'if(length({d}) = 10, 1, -1)', 'email': '1', **strict})})"
    if labeler == "gazetteer":
        return _by_kind({"email": f"if({rl('x.t', TOP_DOMAINS)}, 1, 0)", "ip": f"if({rl('x.t', RESERVED_IP)}, -1, 1)", "card": yes_no(rl("x.t", ISSUERS)), "phone": f"if({rl('x.t', CALLING_CODES)}, 1, 0)", "secret": f"if({rl('x.t', PLACEHOLDERS)}, -1, 0)"})
    if labeler == "context":
        return f"case when {rl('x.l', AGAINST)} then -1 when {_by_kind({k: rl('x.l', p) for k, p in CUES.items()}, 'false')} then 1 else 0 end"
    if labeler == "border":
        return f"if({rl('right(x.l, 1)', '[A-Za-z0-9_./#]')} or {rl('x.r', '[A-Za-z0-9_/]')}, -1, 0)"
    digits = {"ip": "4 and 12", "card": "13 and 19", "phone": "7 and 15", "ssn": "9 and 9"}
    return f"if(instr(x.t, ':') > 0, 0, {_by_kind({k: f"if(length({d}) between {n} and size(array_distinct(split({d}, ''))) >= 4, 0, -1)" for k, n in digits.items()})})"


Pattern = tuple[str, tuple[int, ...], tuple[int, ...]]  #: kind, votes, features


@dataclass
class Classifier:
    """Weights of the span classifier, and each labeler's reliability for each kind as EM found it: its share of yes among what is personal data, of no among the rest."""

    bias: float
    weights: dict[str, float]
    reliability: dict[tuple[str, str], tuple[float, float]]

    def probability(self) -> str:
        """SQL for a candidate ``x``."""
        terms = [repr(float(self.bias))] + [f"if({name}, {float(w)!r}D, 0D)" for name, w in sorted(self.weights.items()) if abs(w) > 1e-3]
        return f"1 / (1 + exp(-({' + '.join(terms)})))"


def _names(kind: str, votes: tuple[int, ...], features: tuple[int, ...]) -> list[str]:
    return [f"x.kind = '{kind}'"] + [f"x.{name} = {v}" for name, v in zip(LABELERS, votes, strict=True) if v] + [f"(x.kind = '{kind}' and x.{name} = {v})" for name, v in zip(FEATURES, features)]


def reliabilities(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 60) -> tuple[dict, dict]:
    """EM with two classes for each kind, over (kind, votes) to number of candidates: the posterior of each pattern, and the reliabilities.

    A class's votes are independent given the class; counts are smoothed by one vote of each sort, so empty and tiny corpora have a result."""
    post, reliability = {}, {}
    for kind in sorted({k for k, _ in counts}):
        rows = sorted((v, n) for (k, v), n in counts.items() if k == kind)
        q = {v: min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v, _ in rows}  # begins with the vote of the most
        for _ in range(rounds):
            yes = sum(n * q[v] for v, n in rows)
            total = sum(n for _, n in rows)
            prior = (yes + 1) / (total + 2)
            of = {}
            for j in range(len(LABELERS)):
                for vote in (-1, 0, 1):
                    # smoothing leans to a labeler that is right more often than not
                    a = sum(n * q[v] for v, n in rows if v[j] == vote) + 1 + 2 * (vote == 1)
                    b = sum(n * (1 - q[v]) for v, n in rows if v[j] == vote) + 1 + 2 * (vote == -1)
                    share = a / (yes + 5)
                    of[j, vote] = (min(share, FAILS) if LABELERS[j] == "check" and vote == -1 and kind in CHECKED else share, b / (total - yes + 5))
            for v, _ in rows:
                odds = math.log(prior / (1 - prior)) + sum(math.log(of[j, x][0] / of[j, x][1]) for j, x in enumerate(v))
                q[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        reliability |= {(kind, name): (of[j, 1][0], of[j, -1][1]) for j, name in enumerate(LABELERS)}
        post |= {(kind, v): q[v] for v, _ in rows}
    return post, reliability


def learn(counts: dict[tuple[str, tuple[int, ...]], int], patterns: list[tuple[Pattern, int]] | None = None, steps: int = 300) -> Classifier:
    """EM on the counts of votes, then logistic regression of the posteriors on the votes and features of ``patterns`` (with how often each occurs)."""
    post, reliability = reliabilities(counts)
    patterns = patterns if patterns is not None else [((k, v, ()), n) for (k, v), n in sorted(counts.items())]
    if not patterns:
        return Classifier(0.0, {}, reliability)
    rows = [_names(*p) for p, _ in patterns]
    names = sorted({f for r in rows for f in r})
    number = {f: i for i, f in enumerate(names)}
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([number[f] for r in rows for f in r])
    target, weight = np.array([post[p[0], p[1]] for p, _ in patterns]), np.sqrt([n for _, n in patterns])  # rare patterns count too
    weight = weight / weight.sum()
    ridge = np.where(np.char.find(names, " and ") >= 0, 3e-3, 1e-4)  # a vote weighs more readily than a feature of the span
    w, bias = np.zeros(len(names)), 0.0
    for _ in range(steps):
        odds = np.clip(bias + np.bincount(row, w[col], minlength=len(rows)), -30, 30)
        off = (1 / (1 + np.exp(-odds)) - target) * weight
        bias -= off.sum()
        w -= np.bincount(col, off[row], minlength=len(names)) + ridge * w
    return Classifier(float(bias), dict(zip(names, w.tolist(), strict=True)), reliability)


def vote_counts(found: DataFrame) -> tuple[dict[tuple[str, tuple[int, ...]], int], list[tuple[Pattern, int]]]:
    """Candidates by kind and votes (len(KINDS) * 3 ** len(LABELERS) rows at most, whatever the corpus), and the TRAIN most frequent patterns of votes and features."""
    by = ["kind", *LABELERS, *FEATURES]
    each = table(found.select(F.explode("found").alias("x")).groupBy(*(F.col(f"x.{c}").alias(c) for c in by)).count(), "pii-patterns")
    votes = {(r[0], tuple(r[1:-1])): r[-1] for r in each.groupBy("kind", *LABELERS).agg(F.sum("count")).collect()}
    most = each.orderBy(F.desc("count"), *by).limit(TRAIN).collect()
    n = 1 + len(LABELERS)
    return votes, sorted(((r[0], tuple(r[1:n]), tuple(r[n:-1])), r[-1]) for r in most)


def _decided(rows: DataFrame, least: float) -> DataFrame:
    p = learn(*vote_counts(rows)).probability()
    rank = "array_position(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), x.kind)"
    kept = f"transform(filter(found, x -> x.base or ({p}) >= {least}), x -> named_struct('rank', cast({rank} as int), 's', x.s, 'e', x.e, 'kind', x.kind, 'base', x.base))"
    return rows.withColumn("spans", F.expr(f"array_sort({kept})"))


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """A row for each document: key, n_email, n_ip, n_card, n_phone (base), ``spans``: array of (rank, s, e, kind, base) by kind, then start."""
    rows = _decided(table(candidates(docs, key=key, text=text), "pii-candidates"), least)
    return rows.select(F.col("key").alias(key), *(F.expr(f"cast(size(filter(spans, x -> x.base and x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in PATTERNS), "spans")


def redact(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; overlapping spans become one, of the first one's kind."""
    names = docs.columns
    rows = _decided(table(candidates(docs, key=key, text=text, carry=tuple(names)), "pii-candidates"), least)
    # In order of their starts: a span that begins before the largest end so far adds to the one before it. Texts with spans are cut from blocks, in which a place is found at once.
    rows = rows.withColumn("cover", F.expr("array_sort(transform(spans, x -> named_struct('s', cast(x.s as bigint), 'e', cast(x.e as bigint), 'kind', x.kind)))"))
    own = f"`carry_{text}`"
    rows = rows.withColumn("upto", F.expr("transform(cover, x -> x.e)")).withColumn("cut", F.expr(f"if(size(cover) = 0, cast(array() as array<string>), regexp_extract_all({own}, '(?s).{{1,{BLOCK}}}', 0))"))
    rows = _running(rows, {"before": ("upto", *MOST)})
    i, j = (f"cast({x} div {BLOCK} as int)" for x in ("p", "x.s"))
    stretch = f"""if({i} = {j}, substring(element_at(cut, {i} + 1), cast(p % {BLOCK} as int) + 1, cast(x.s - p as int)), concat(
        substring(element_at(cut, {i} + 1), cast(p % {BLOCK} as int) + 1), array_join(slice(cut, {i} + 2, {j} - {i} - 1), ''), coalesce(left(try_element_at(cut, {j} + 1), cast(x.s % {BLOCK} as int)), '')))"""
    last = "array_max(upto)"
    tail = f"concat(coalesce(substring(try_element_at(cut, cast({last} div {BLOCK} as int) + 1), cast({last} % {BLOCK} as int) + 1), ''), array_join(slice(cut, cast({last} div {BLOCK} as int) + 2, size(cut)), ''))"
    new = F.expr(f"if(size(cover) = 0, {own}, concat(array_join(zip_with(cover, before, (x, p) -> if(x.s < p, '', concat({stretch}, '<', upper(x.kind), '>'))), ''), {tail}))")
    out = rows.withColumn(f"carry_{text}", new)
    if "n_chars" in names:
        out = out.withColumn("carry_n_chars", F.when(F.size("cover") > 0, F.length(F.col(f"carry_{text}")).cast("long")).otherwise(F.col("carry_n_chars")))
    return out.select(*(F.col(f"carry_{c}").alias(c) for c in names))

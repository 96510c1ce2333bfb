"""Words, encoding, quality, licences against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sealstone.llm import encoding, licenses, quality
from sealstone.llm.common import buffers, documents, hashes, shingles, split_words
from sealstone.llm.encoding import Encoder
from sealstone.llm.queries import BYTE_BPE, PIECES, bands

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALPHABET = [*" \n\t\r\x0b\x0c\x1c'.,!-_<=", "ab", "z", "é", "ß", "ñ", "×", "÷", "09", "²", "'s", "'ll", "  ", " ", " ", "　", "\u0085", "é", "̸", "日本", "Σ", "İ", "<|endoftext|>", "👍🏽", "‍"]


def fuzz(n, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 50))) for _ in range(n)] + ["", None]


def test_words_match_the_pattern():
    texts = fuzz(2000)
    w = split_words(*buffers(pa.array(texts)))
    codes, distinct = w.codes()
    words = distinct.take(pa.array(codes)).to_pylist()
    for i, t in enumerate(texts):
        assert words[w.doc[i] : w.doc[i + 1]] == WORD.findall(t or "")


def test_digests_depend_on_words_alone():
    a, b = hashes(pa.array(["ab", "ba", "é", "abc"], pa.large_utf8()), b"k"), hashes(pa.array(["abc", "ab"], pa.large_utf8()), b"k")
    assert len(set(a.tolist())) == 4 and b.tolist() == [a[3], a[0]]
    one, off = shingles(np.arange(3, dtype=np.uint64), np.array([0, 3, 3]), 4)
    assert off.tolist() == [0, 1, 1] and len(one) == 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_as_whole_texts(name, spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    texts = fuzz(3000) + [r.text for r in documents(spark, SF).limit(40).collect()]
    ids, off = Encoder.of(public_tokenizers.path(name)).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_pieces_met_before_are_compared(monkeypatch):
    """Words that a polynomial digest takes for one, in two batches; and strings that all have one digest."""
    from tokenizers import Tokenizer

    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    plain = Tokenizer.from_file(BYTE_BPE)
    own = lambda t: plain.encode(t, add_special_tokens=False).ids
    for each in (None, lambda data, begin, size: np.zeros(len(size), np.uint64)):
        if each:
            monkeypatch.setattr(encoding, "quick_digests", each)
        encoder, pieces = encoding.Encoder(BYTE_BPE), quality.PieceCounter(PIECES)
        for t in (a, a.translate(str.maketrans("ab", "ba")), "one two three", "two one", "one two three", "longword" * 9, "x"):
            ids, off = encoder.encode(pa.array([t]))
            assert ids.tolist() == own(t) and off.tolist() == [0, len(ids)]
            got = pieces.count(pa.array(t.split(), pa.large_utf8()))
            assert got[:, 0].tolist() == [len(pieces.model.encode(w)) for w in t.split()]


def test_what_is_remembered_is_bounded(monkeypatch):
    """Texts without spaces are pieces of their own length, and are not kept; many short ones make a worker start anew."""
    encoder = encoding.Encoder(BYTE_BPE)
    encoder.encode(pa.array(["日本語" * 5000, "文" * 4000]))
    assert encoder.met.held() < 1000
    monkeypatch.setattr(encoding, "REMEMBERED", 100_000)
    for i in range(30):
        encoder.encode(pa.array([" ".join(f"w{i}x{j}" for j in range(500))]))
        assert encoder.met.held() < 100_000 + 500 * 200


def test_other_vocabularies_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"a b": 0, "c": 1, "?": 2}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.Split("c", "isolated")
    t.save(str(tmp_path / "own.json"))
    encoder = encoding.Encoder(str(tmp_path / "own.json"))
    assert not encoder.may_cut and encoder.encode(pa.array(["a bc", None, "c"]))[0].tolist() == [0, 1, 1]


def test_short_words_have_digests_of_their_own():
    r = np.random.default_rng(2)
    words = sorted({bytes(r.integers(97, 100, r.integers(1, 9))).decode() for _ in range(20_000)} | {"\0", "\0\0", "a\0"})
    assert len(set(hashes(pa.array(words, pa.large_utf8()), b"").tolist())) == len(words)


def base_quality(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


def test_quality_base_and_bands(spark, odd, none):
    docs = documents(spark, SF)
    own = bands(spark, SF, docs)
    texts = {r.doc_id: r for r in docs.collect()}
    out = quality.quality(docs, BYTE_BPE, PIECES, bands=own).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_quality(texts[r.doc_id].text)
        assert not (r.base_failed and r.kept)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1 and toxic = 0").collect()}
    clean = [r for r in out if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)
    got = Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(odd, BYTE_BPE, PIECES).collect())
    assert got == Counter(base_quality(r.text) for r in odd.collect())
    assert quality.quality(none, BYTE_BPE, PIECES).count() == 0
    assert quality.keep_good(none, BYTE_BPE, PIECES).columns == odd.columns


def plain_verdict(t, lang, bands_):
    """Measures by the libraries on the whole text, and the band's rules one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(plain_verdict, "libraries"):
        plain_verdict.libraries = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    bpe, sp = plain_verdict.libraries
    bpe.encode_special_tokens = True
    ids = bpe.encode(t, add_special_tokens=False).ids
    pieces = [i for w in WORD.findall(t) for i in sp.encode(w)]
    n, k, n_bytes = max(1, len(ids)), max(1, len(pieces)), sum(sp.is_byte(i) for i in pieces)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
    x, share = len(t) / n, n_bytes / k
    script = quality.scripts(*buffers(pa.array([t])))[0]
    b = quality.band_of(bands_, lang, script)
    slack = 5 * math.sqrt(6 / n)
    good = b.chars_per_token[0] - slack <= x <= b.chars_per_token[1] + slack
    good &= share <= b.byte_share + 5 * math.sqrt(b.byte_share * (1 - b.byte_share) / k)
    good &= bits >= b.entropy * min(1, math.log2(max(n, 2)) / 6) and bits >= b.per_token_entropy * math.log2(max(n, 2))
    at = int(math.log2(n))
    good &= not (at < len(b.floors) and bits < b.floors[at])
    good &= b.centre is None or abs(x - b.centre) <= 5 * math.sqrt(b.variance[0] + b.variance[1] / n)
    return len(ids), x, share, bits, bool(good)


def test_quality_verdict_by_plain_libraries(spark, odd):
    docs = documents(spark, SF).select("doc_id", "text", "lang").union(odd.select("doc_id", "text", "lang").filter("doc_id > 1"))
    own = bands(spark, SF, docs)
    texts = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    out = Counter((r.doc_id, r.n_tokens, round(r.chars_per_token, 6), round(r.byte_share, 6), round(r.token_entropy, 6), r.kept) for r in quality.quality(docs, BYTE_BPE, PIECES, bands=own).collect())
    want = Counter()
    for k, t, lang in texts:
        t = t or ""
        n, x, share, bits, good = plain_verdict(t, lang, own)
        want[k, n, round(x, 6), round(share, 6), round(bits, 6), good and not base_quality(t)[-1]] += 1
    assert out == want


def test_quality_rejects_foreign_bytes(spark):
    noise = " ".join("".join(chr(0x2800 + (i * 7 + j * 13) % 256) for j in range(6)) for i in range(200))
    (r,) = quality.quality(spark.createDataFrame([(1, noise)], "doc_id long, text string"), BYTE_BPE, PIECES, bands={"": quality.Band(), "other": quality.Band(byte_share=0.5)}).collect()
    assert r.byte_share > 0.9 and not r.base_failed and not r.kept


PLAIN = {
    "ru": "в этом году летом мы долго жили у моря недалеко от старого города и каждый вечер гуляли вдоль берега потому что погода была очень хорошая",
    "el": "το καλοκαίρι μείναμε πολύ καιρό κοντά στη θάλασσα έξω από την παλιά πόλη και κάθε βράδυ περπατούσαμε στην παραλία γιατί έκανε ζέστη",
    "ar": "في الصيف سكنا مدة طويلة قرب البحر خارج المدينة القديمة وكنا نمشي كل مساء على الشاطئ لأن الجو كان جميلا جدا",
    "ja": "夏の間 私たちは 海の 近くの 古い 町に 長く 住んで 毎晩 浜辺を 散歩しました 天気が とても 良かった からです",
    "zh": "夏天 我们 在 老城 外面的 海边 住了 很久 每天 晚上 沿着 海岸 散步 因为 天气 非常 好",
    "sr": "tokom leta smo dugo živeli pored mora nedaleko od starog grada i svake večeri šetali uz obalu jer je vreme bilo veoma lepo",
    "sr/cyrillic": "током лета смо дуго живели поред мора недалеко од старог града и сваке вечери шетали уз обалу јер је време било веома лепо",
}


def test_quality_judges_short_texts_and_tables_without_languages(spark):
    noise = "".join(chr(0x2800 + i * 7 % 256) for i in range(3))
    texts = [" ".join([noise] * 3 + [f"{noise}{chr(0x2900 + i)}" for i in range(9)]), "A few plain words make one short text that nobody would reject today."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bands_ = quality.BANDS | {"other": quality.Band((0.9, 6.0), 0.3)}
    out = quality.quality(docs, BYTE_BPE, PIECES, bands=bands_).orderBy("doc_id").collect()
    assert [(x.base_failed, x.kept) for x in out] == [(False, False), (False, True)] and out[1].n_tokens < 20
    assert quality.fit_bands(docs, docs.select("doc_id", F.lit(1).alias("quality")), BYTE_BPE, PIECES) == quality.BANDS


def test_bands_move_a_little_with_each_document():
    r = np.random.default_rng(5)
    n = np.floor(2 ** r.uniform(4, 9, 400))
    x, share, bits = r.normal(4.4, 0.15, 400) + r.normal(0, 1.5, 400) / np.sqrt(n), np.abs(r.normal(0.01, 0.01, 400)), r.normal(5.5, 0.2, 400)
    base = quality.BANDS["latin"]
    fit = [quality.fitted(base, x[:k], n[:k], share[:k], bits[:k]) for k in range(1, 400)]
    wide = [5 * math.sqrt(b.variance[0] + b.variance[1] / 200) for b in fit]
    assert wide[0] > 2.3 and wide[-1] < 1.2 and max(abs(a - b) for a, b in zip(wide[20:], wide[21:])) < 0.12
    assert max(abs(a.byte_share - b.byte_share) for a, b in zip(fit[20:], fit[21:])) < 0.02 and fit[0].byte_share > 0.09
    assert all(abs(b.centre - 4.4) < wide[i] for i, b in enumerate(fit)) and all(f != f or f >= 0 for b in fit for f in b.floors)


def test_quality_fits_each_script(spark):
    """Plain texts of any script stay, and texts of a script that the language has not do not."""
    r = random.Random(7)
    rows = [(lang.split("/")[0], " ".join(r.choice(words.split()) for _ in range(r.randint(60, 200)))) for lang, words in PLAIN.items() for _ in range(130)]
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, lang string, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    own = quality.fit_bands(docs, labels, BYTE_BPE, PIECES)
    out = quality.quality(docs, BYTE_BPE, PIECES, bands=own).join(docs, "doc_id").collect()
    for lang in {x for x, _ in rows}:
        plain = [x for x in out if x.lang == lang and not x.base_failed]
        assert len(plain) >= 100 and sum(x.kept for x in plain) >= 0.97 * len(plain), lang
    assert all(own[x].centre is not None for x in PLAIN)
    foreign = docs.filter("lang = 'ru'").withColumn("lang", F.lit("zh"))
    assert quality.quality(foreign, BYTE_BPE, PIECES, bands=own).filter("kept").count() == 0
    unknown = docs.filter("lang = 'ru'").withColumn("lang", F.lit(None).cast("string"))
    assert quality.keep_good(unknown, BYTE_BPE, PIECES, bands=own).count() == quality.keep_good(docs.filter("lang = 'ru'"), BYTE_BPE, PIECES).count()


def base_license(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses_base(spark, odd, none):
    docs = documents(spark, SF).select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame([(900001, "GNU\nGENERAL public, License! CC-BY mit\tlicense Apache License")], "doc_id long, text string"))
    got = Counter((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect())
    assert got == Counter(base_license(r.text) for r in docs.collect())
    assert licenses.scan(none).count() == 0


def test_licenses_join_is_exact(spark):
    """Against counting every template in every block of every text; templates of 5 to over 200 words."""
    r = random.Random(3)
    pool = [w for _, t in licenses.TEMPLATES for w in licenses.words_of(t)] + ["some", "other", "words", "here"]
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 400))) for _ in range(60)]
    texts += [" ".join(["lorem"] * 50 + licenses.words_of(t) + ["ipsum"] * 90) for _, t in licenses.TEMPLATES]
    out = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), phrases=()).collect()}
    for i, t in enumerate(texts):
        w, want, n = t.split(), set(), 0
        for label, template in licenses.TEMPLATES:
            words, size = licenses.words_of(template), licenses.block_of(len(licenses.words_of(template)))
            for a in range(-size // 2, max(1, len(w)), size // 2):
                if len(set(words) & set(w[max(0, a) : a + size])) >= licenses.THRESHOLD * len(set(words)) - 1e-9 and (a >= 0):
                    want.add(label)
                    n += 1
        assert (out[i].contained, out[i].n_blocks) == (",".join(sorted(want)), n), i
        assert 0 <= out[i].score <= 1 and set(out[i].labels.split(",")) <= want | {""}
    assert all(licenses.TEMPLATES[k][0] in out[60 + k].labels.split(",") for k in range(len(licenses.TEMPLATES)))


def test_long_templates_are_found(spark):
    """A template of 900 words, whole and with a tenth of its words changed."""
    r = random.Random(4)
    long_ = [f"term{i}" for i in range(900)]
    changed = [w if r.random() > 0.1 else "other" for w in long_]
    texts = [" ".join(["x"] * 700 + w + ["y"] * 700) for w in (long_, changed, long_[:450], long_[::-1])]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=(("own", " ".join(long_)),)).orderBy("doc_id").collect()
    assert [(x.labels, x.contained) for x in got] == [("own", "own"), ("own", "own"), ("", ""), ("", "own")]


def test_license_labels_are_specific(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3"
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    texts = {gpl.format(""): "gpl", gpl.format("Lesser "): "lgpl", gpl.format("Affero "): "agpl", cc.format(""): "cc-by", cc.format("-ShareAlike"): "cc-by-sa"}
    texts |= {"We released the cat today under the desk of the mit lab, and a driving license was found": "", "license mit the under released": "", "Released under the MIT License.": "mit"}
    texts |= {gpl.format("Lesser ") + " " + "word " * 300 + cc.format(""): "cc-by,lgpl"}
    texts |= {f"Licensed under {v.upper().replace('-', ' ', 1)} 4.0": v if v != "cc-by" else "cc-by" for v in licenses.CREATIVE}
    texts |= {cc.format(n.removeprefix("Attribution")) + " ": v for v, n in licenses.CREATIVE.items()}
    texts |= {"Released under the BSD License": "bsd", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.": "cc0"}
    texts |= {"GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.": "lgpl"}
    out = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    # Base labels come by phrase, whatever the template says.
    base = {i: {x for x in r.base_labels.split(",") if x} for i, r in enumerate(out)}
    assert [set(x.labels.split(",")) - base[i] - {""} for i, x in enumerate(out)] == [set(x.split(",")) - base[i] - {""} for i, x in enumerate(texts.values())]

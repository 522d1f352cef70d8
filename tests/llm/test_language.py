import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from docket.llm import language as L

SYLLABLES = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "ein", "to"], "cc": ["é", "ou", "ka", "ñi"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + ". 12"


def plain(text):
    out = ""
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or (out and out[-1] != " "):
            out += c
    return out


def test_symbols_follow_the_definition():
    texts = ["Ab, c!", None, "", "12 !", "é😀x", "𝔘b", " A"]
    keys, sizes = L.symbols(texts)
    want = []
    for t in texts:
        p = [ord(c) if ord(c) < 0x10000 else 0xFFFF for c in plain(t or "")]
        p = p if any(x != 32 for x in p) else []
        chars = [1, 1, 1, *p]
        want.append([sum(chars[i - 3 + k] << (16 * (3 - k)) for k in range(4)) for i in range(3, len(chars))])
    assert sizes.tolist() == [len(w) for w in want] and keys.tolist() == [k for w in want for k in w]


def kneser_ney(grams, history):
    """Brute-force interpolated model of one language as a function of (history, char)."""
    tables = [grams]
    for order in (3, 2, 1):
        tables.append(Counter({g[-order:]: 0 for g in tables[-1]}))
        for g in tables[-2]:
            tables[-1][g[-order:]] += 1
    tables = {len(next(iter(t))): t for t in tables}

    def p(h, c, order, vocabulary):
        if order == 0:
            return 1 / (vocabulary + 1)
        t = tables[order]
        ones, twos = (sum(v == k for v in t.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        h = h[len(h) - (order - 1) :]
        total = sum(v for g, v in t.items() if g[:-1] == h)
        below = p(h, c, order - 1, vocabulary)
        if not total:
            return below
        kinds = sum(g[:-1] == h for g in t)
        return max(t.get((*h, c), 0) - d, 0) / total + d * kinds / total * below

    return p


def test_probabilities_against_brute_force():
    rng = random.Random(1)
    train = {x: [prose(rng, x, 12) for _ in range(4)] for x in ("aa", "bb")}
    grams, rows = {}, []
    for i, (lang, texts) in enumerate(sorted(train.items())):
        keys, _ = L.symbols(texts)
        grams[lang] = Counter(tuple((int(k) >> (16 * (3 - j))) & 0xFFFF for j in range(4)) for k in keys)
        rows += [(i, sum(c << (16 * (3 - j)) for j, c in enumerate(g)), n) for g, n in grams[lang].items()]
    model = L.KneserNey(["aa", "bb"], *(np.array(x, t) for x, t in zip(zip(*rows), (np.int64, np.uint64, np.int64))))
    vocabulary = len({g[-1] for t in grams.values() for g in t})
    keys, _ = L.symbols(["kato mizz schré", prose(rng, "bb", 5)])
    got = model.log_probabilities(keys)
    for k, row in zip(keys.tolist(), got):
        g = tuple((k >> (16 * (3 - j))) & 0xFFFF for j in range(4))
        for j, lang in enumerate(("aa", "bb")):
            assert math.isclose(row[j], math.log(kneser_ney(grams[lang], None)(g[:3], g[3], 4, vocabulary)), abs_tol=1e-4)


def test_hash_array():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 62, 5000, dtype=np.uint64))
    table = L.HashArray(keys)
    assert (table.rows(keys) == np.arange(len(keys))).all()
    assert (table.rows(keys + np.uint64(1 << 62)) == -1).all()
    assert L.HashArray(keys[:0]).rows(keys[:3]).tolist() == [-1] * 3


def test_held_out_accuracy_and_defined_cases(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, lang, 30), lang, 1.0) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=300))]
    rows += [(1000, None, "aa", 0.0), (1001, "", "bb", 0.0), (1002, "12 !", None, 0.0), (None, "kato", "aa", 0.0)]
    rows += [(1003, "x" * 50_000, None, 0.0), (1003, "x" * 50_000, None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    docs = docs.withColumn("held", L.held_out(F.col("doc_id")))
    out = L.identify(docs, L.fit(docs.where("not held"))).collect()
    assert len(out) == len(rows)
    right = defaultdict(list)
    for r in out:
        if r.doc_id is not None:
            assert r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id is not None and r.doc_id < 1000:
            right[r.held].append(r.lang_pred == r.lang and r.score > 0.5)
    assert np.mean(right[True]) > 0.97 and len(right[True]) > 50
    assert {(r.lang_pred, r.score, r.accepted) for r in out if r.doc_id in (1000, 1001, 1002)} == {("und", 0.0, False)}
    assert {r.accepted for r in out if r.doc_id == 1003} == {False}
    none = L.fit(docs.where("lang is null"))
    assert {r.lang_pred for r in L.identify(docs, none).collect()} == {"und"}
    assert L.identify(docs.limit(0), none).count() == 0


def test_model_size_is_bounded(spark):
    counted = spark.createDataFrame([("a", i, n) for i, n in enumerate([1, 1, 2, 3, 4, 7, 8, 8, 9, 1000])], "lang string, gram long, n long")
    assert L.least_count(counted, 10) == 1 and L.least_count(counted, 4) == 8
    assert L.least_count(counted, 3) == 16 and L.least_count(counted, 6) == 4
    assert L.least_count(counted.limit(0), 5) == 1


def test_more_grams_than_the_driver_takes_change_nothing(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, lang, 8), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=60))]
    rows += [(100, "žluť qwx", "zz"), (100, "žluť qwx", None), (101, None, "aa"), (102, "12 !", "bb"), (None, "qwx", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("accepted", F.lit(1))
    outs = []
    for most in (1_000_000, 10):
        identifier = L.fit(docs, max_grams=most)
        assert isinstance(identifier.model, L.GramTables if most == 10 else L.KneserNey)
        out = L.identify(docs, identifier)
        assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "cross_entropy", "accepted"]
        outs.append(sorted(out.collect(), key=str))
    assert len(outs[0]) == len(outs[1]) == len(rows)
    for a, b in zip(*outs):
        assert a[:4] == b[:4] and a.accepted == b.accepted and math.isclose(a.score, b.score, abs_tol=1e-4)
        assert a.cross_entropy == b.cross_entropy or math.isclose(a.cross_entropy, b.cross_entropy, abs_tol=1e-4)
    assert {r.lang_pred for r in outs[1] if r.doc_id in (100, None)} == {"zz"}

"""Phrase mining against counts by loops over texts."""

import re
from collections import Counter

import pytest

from docket.llm import phrases


def counted(rows):
    counts, words = {k: Counter() for k in range(1, 5)}, Counter()
    for text, lang in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            words[lang or "und"] += len(w)
            for k in counts:
                counts[k].update((lang or "und", " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    return counts, words


def brute(rows, least, percent=80, most=2000):
    counts, words = counted(rows)
    every = {x: n for c in counts.values() for x, n in c.items() if n >= least}
    found = {}
    for (lang, phrase), a in every.items():
        w = phrase.split(" ")
        longer = [n for (g, p), n in every.items() if g == lang and p.count(" ") > phrase.count(" ") and f" {phrase} " in f" {p} "]
        if len(w) < 2 or any(100 * n >= percent * a for n in longer):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = every[lang, " ".join(w[:k])], every[lang, " ".join(w[k:])]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, phrase.encode(), phrase, a, left, right, words[lang], score))
    return sorted((lang, rank + 1, *x[3:]) for lang, all_of in found.items() for rank, x in enumerate(sorted(all_of)[:most]))


def texts():
    rows = []
    for i in range(60):
        rows.append((f"In the Middle of the night; the cat{i % 3} of the house. zä zä zä zä zä zä\tzä {'x' * (i % 2)} in the middle of", ("en", "de", None)[i % 3]))
    rows += [(None, "en"), ("", "fr"), ("one two three four five six " * 40, "fr"), (" \t ", "es"), ("of the\x0bof the of the", "en")] * 2
    return rows


def columns(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_collocations(spark):
    df = spark.createDataFrame([(*r, 1) for r in texts()], "text string, lang string, phrase int").repartition(3)
    assert columns(phrases.collocations(df, least=10)) == brute(texts(), 10)
    assert columns(phrases.collocations(df, least=10, most=2)) == brute(texts(), 10, most=2)
    assert phrases.collocations(df.limit(0)).count() == 0


@pytest.mark.parametrize("bucket_words, fan_out", [(10**6, 4), (40, 4), (300, 2)])
def test_counts_in_several_rounds(spark, monkeypatch, bucket_words, fan_out):
    """Frequent words spread their edges, so that counts are partial sums; small bounds make further rounds."""
    monkeypatch.setattr(phrases, "BLOCK", 500)
    df = spark.createDataFrame(texts(), "text string, lang string").repartition(3)
    found, words = phrases.phrase_counts(df, 10, bucket_words, fan_out)
    counts, all_words = counted(texts())
    want = sorted((lang, p, k, n) for k, c in counts.items() for (lang, p), n in c.items() if n >= 10)
    assert sorted((r.lang, r.phrase, r.k, r.n) for r in found.collect()) == want
    assert {r.lang: r.n for r in words.collect()} == {x: n for x, n in all_words.items() if n}


def test_edges_survive_packing():
    block = phrases.Block()
    for text, lang in texts():
        block.add(text or "", lang)
    edges = block.edges()
    parts = [p for _, p in phrases.dealt(edges, phrases.buckets_of(edges, frozenset(block.words[1:4]), 5)[0])]
    merged = phrases.Edges.merged(parts * 2, at_once=10)

    def plain(e):
        return sorted((tuple(e.words[i] for i in row), n) for row, n in zip(e.rows.tolist(), e.weights.tolist()))

    assert plain(merged) == [(row, 2 * n) for row, n in plain(edges)]
    assert int(edges.weights.sum()) == sum(counted(texts())[1].values())

import random
import time
import tracemalloc

import numpy as np
import pytest

from docket.llm import decontaminate as D


def edits(pattern, text, borders=None):
    """(fewest edits of `pattern` at any place of `text`), by the full table."""
    far = 10**6
    row = [0 if borders is None or borders[j] else far for j in range(len(text) + 1)]
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(r for j, r in enumerate(row) if borders is None or borders[j])


def borders_of(text):
    """Positions among the compared ASCII bytes at which no word goes on."""
    kept = [i for i, c in enumerate(text) if c.isascii() and c.isalnum() or c > "\x7f"]
    size = {i: len(D.compared(text[i])) for i in kept}
    out = [True]
    for n, i in enumerate(kept):
        out += [False] * (size[i] - 1) + [n + 1 == len(kept) or kept[n + 1] > i + 1]
    return out


def mutate(rng, text, n):
    chars = list(text)
    for _ in range(min(n, len(chars) - 1)):
        i = rng.randrange(len(chars))
        kind = rng.randrange(3)
        chars[i : i + 1] = [rng.choice("abcdefgh")] if kind == 0 else [] if kind == 1 and len(chars) > 1 else [chars[i], "z"]
    return "".join(chars)


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randrange(6, 30))) for i in range(25)] + [(90, "too short"), (91, None), (92, "")]
    items += [(93, items[0][1]), (93, items[0][1])] + [(100 + n, prose(9).replace(" ", "")[:n]) for n in (1, 5, 9, 10, 16, 20, 23, 30, 31, 39)]
    docs = [None, "", "x", prose(5000)]
    for i in range(140):
        text = mutate(rng, items[rng.randrange(25)][1], rng.randrange(0, 16)) if i % 3 else prose(15)
        if i >= 120:
            text = mutate(rng, items[-1 - rng.randrange(8)][1], rng.randrange(4))
        docs.append(prose(rng.randrange(20)) + ". " + text.upper() + "! é " + prose(rng.randrange(20)))
    docs.append("; ".join(t for _, t in items[1:5]) + " " + " ".join(t for _, t in items[-10:-4]))
    return items, docs


def test_against_full_alignment(spark):
    items, docs = corpus()
    documents = spark.createDataFrame([(i, t, 1, i) for i, t in enumerate(docs)], "doc_id long, text string, leaks int, before long")
    benchmark = spark.createDataFrame([(*x, "q") for x in items], "item_id long, text string, extra string")
    for block in (2.0, 0.0005):
        rows = D.find_leaks(documents, benchmark, block_mb=block).collect()
        got = {(r.doc_id, x.item_id): x for r in rows for x in r.leaks}
        hits = 0
        assert all(r.before == r.doc_id for r in rows) and max(len(r.leaks) for r in rows) > 2
        for d, t in enumerate(docs):
            text = D.compared(t).tobytes()
            for i, x in items:
                pattern = D.compared(x).tobytes()
                if not pattern:
                    assert (d, i) not in got
                    continue
                budget = int(0.1 * len(pattern))
                if len(text) >= 2000 and len(pattern) >= D.SHORT:
                    assert ((d, i) in got) or pattern not in text
                    continue
                least = edits(pattern, text, borders_of(t) if t and len(pattern) < D.SHORT else None)
                assert ((d, i) in got) == (least <= budget), (d, i, least, budget)
                if (d, i) in got:
                    x = got[d, i]
                    hits += 1
                    assert x.edits == least
                    assert edits(pattern, D.compared(t[x.start : x.end]).tobytes()) == least
        assert hits > 40


def test_short_items_at_word_borders():
    index = D.index_items([(1, "a"), (2, "cat"), (3, "日本")], 0.1)
    got = D.leaks_in(["banana concatenated", "Is it a cat?", "in 東日本では", "aa", ""], index)
    assert [[(x["item_id"], x["start"], x["end"]) for x in g] for g in got] == [[], [(1, 6, 7), (2, 8, 11)], [(3, 4, 6)], [], []]


def test_monotone_texts_in_bounded_memory():
    """Texts and items of one letter, of short periods, and of runs with a foreign end: fast, small, and as by brute force."""
    tracemalloc.start()
    began = time.time()
    for size, item in ((5_000, 1_000), (20_000, 2_000), (40_000, 2_000)):
        got = D.leaks_in(["a" * size], D.index_items([(7, "a" * item)], 0.1))
        assert got == [[{"item_id": 7, "start": 0, "end": item, "edits": 0}]]
    taken, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert taken < 3 and peak < 300e6, (taken, peak)
    long = "a" * 200_000
    assert D.leaks_in([long], D.index_items([(1, "a" * 900 + "b" * 900)], 0.1)) == [[]]
    rng = random.Random(3)
    patterns = ["ab" * 30, "a" * 70, "abc" * 25 + "d" * 9, "a" * 30 + "b" * 30]
    texts = [mutate(rng, p * rng.randrange(1, 5), rng.randrange(9)) for p in patterns for _ in range(15)]
    index = D.index_items(list(enumerate(patterns)), 0.1)
    for step in (1 << 20, 50):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(D, "STEP", step)
            for t, leaks in zip(texts, D.leaks_in(texts, index)):
                found = {x["item_id"]: x["edits"] for x in leaks}
                least = {i: edits(p, t) for i, p in enumerate(patterns)}
                assert found == {i: e for i, e in least.items() if e <= len(patterns[i]) // 10}


def test_code_points():
    text = "É a-b, ñ!"
    assert D.code_points(text).tolist() == [0, 0, 2, 4, 7, 7] and len(D.compared(text)) == 6
    assert D.code_points("A b.c").tolist() == [0, 2, 4]


def test_align_matches_table():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(5, 40)))
        at = rng.randrange(len(text))
        pattern = mutate(rng, text[at:], rng.randrange(4)) or "a"
        a, b = (np.frombuffer(x.encode(), np.uint8) for x in (pattern, text))
        found = D.align(a, b, -len(a), len(b), 40)
        assert found[0] == edits(pattern, text)
        assert edits(pattern, text[found[1] : found[2]]) == found[0]


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    documents = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert D.find_leaks(documents, none).first().leaks == []
    assert D.find_leaks(documents.limit(0), spark.createDataFrame([(1, "a b c " * 9)], none.schema)).count() == 0

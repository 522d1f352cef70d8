"""The join on string similarity: by blocks of strings and by keys, against all pairs, and over more strings than it could do before."""

import hashlib
import random
import time

import numpy as np

from docket.functions import indel, similarity


def digest(i):
    return hashlib.md5(str(i).encode()).hexdigest()


def frame(spark, texts, c="a"):
    return spark.createDataFrame([(x,) for x in texts], f"{c} string").repartition(4)


def test_cells_against_all_pairs():
    """Strings of one to four words of bits, many characters, both sides or one, within one slice or across two."""
    rng = random.Random(1)
    for percent, letters, top in ((60.0, "ab", 9), (80.0, "0123456789abcdef", 24), (85.0, "abcdé🙂", 90), (90.0, "ab", 200), (100.0, "ab", 5), (80.0, [chr(i) for i in range(400, 800)], 70)):
        texts = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, top))) for _ in range(120)}
        texts = sorted(texts | {x[:3] + x[4:] or "q" for x in texts} | {x[: len(x) // 2] + letters[0] + x[len(x) // 2 :] for x in texts})
        sides, second = ([rng.choice(x) for _ in texts] for x in ((1, 2, 3), (0, 1)))
        for crossed in (False, True):
            cell = indel.Cell(texts, np.array(sides), np.array(second) * crossed, percent)
            got = [x for i, j in cell.candidates() for x in zip(*(c.tolist() for c in cell.named(*cell.verified(i, j))))]
            ratio = lambda a, b: 200 * similarity.common_subsequence(a, b) / (len(a) + len(b))
            want = [
                (i, j, ratio(a, b)) for i, a in enumerate(texts) for j, b in enumerate(texts)
                if i != j and sides[i] & 1 and sides[j] & 2 and (not crossed or second[i] != second[j]) and ratio(a, b) >= percent
            ]
            assert sorted(got) == want


def test_many_names(spark):
    """30,000 names, which were not finished in 100 seconds: some with an equal end, near copies of some."""
    names = [f"{digest(i)[:14]} {('hot', 'cold', 'large')[i % 3]} {('bolt', 'ring')[i % 2]}" for i in range(29_000)]
    near = [f"{x[1:6]}_{x[6:]}" for x in names[:1000]]
    a = frame(spark, names + near)
    began = time.time()
    got = {(r.a, r.b): r.ratio for r in similarity.similar_strings(a, a.withColumnRenamed("a", "b"), 80.0).collect()}
    assert time.time() - began < 60
    for x, y in zip(names, near):
        assert got[x, y] == got[y, x] == 200 * (len(x) - 1) / (2 * len(x))
    assert all(got[x, x] == 100 for x in names + near)
    one = names[7]
    assert {b for a, b in got if a == one} == {x for x in names + near if 200 * similarity.common_subsequence(one, x) >= 80 * (len(one) + len(x))}


def test_cells_in_slices(spark, monkeypatch):
    """Each pair meets in one cell, however the strings are dealt out."""
    monkeypatch.setattr(similarity, "PAIRS_A_TASK", 5_000)
    words = [digest(i)[:6] + " " + "red anvil"[: i % 5 + 4] for i in range(400)]
    a, b = words[:300], words[150:]
    got = sorted((r.a, r.b) for r in similarity.similar_strings(frame(spark, a), frame(spark, b, "b"), 75.0).collect())
    want = sorted((x, y) for x in a for y in b if 200 * similarity.common_subsequence(x, y) >= 75 * (len(x) + len(y)))
    assert got == want and len(want) > 160


def test_plates_meet_by_keys(spark, monkeypatch):
    """Half a million pairs of plates are found through what is left by one deletion, as by all pairs."""
    monkeypatch.setattr(similarity, "PAIRS_A_KEY", 1)
    plates = [x for i in range(1500) for p in [digest(i)[:10].upper()] for x in (p, "B" + p, p[:4] + "X" + p[5:])[: i % 4]]
    a, b = plates[::2], plates[::3] + plates[1::3] + ["", None]
    assert similarity.Strings(frame(spark, a), frame(spark, b, "b"), 90.0).key_lengths() == {10: [9, 10], 11: [10]}
    got = sorted((r.a, r.b, r.ratio) for r in similarity.similar_strings(frame(spark, a), frame(spark, b, "b"), 90.0).collect())
    ratio = lambda x, y: 200 * similarity.common_subsequence(x, y) / (len(x) + len(y))
    assert got == sorted((x, y, ratio(x, y)) for x in a for y in set(b) - {"", None} if ratio(x, y) >= 90)


def test_many_plates(spark):
    """300,000 plates, each similar to the one without its first letter: work grows with the plates, not with their pairs."""
    made = spark.range(150_000).selectExpr("upper(substr(md5(string(id)), 1, 10)) as p")
    a = made.selectExpr("concat('B', p) as a").union(made)
    began = time.time()
    found = similarity.similar_strings(a, a.withColumnRenamed("a", "b"), 90.0)
    assert found.where("a = b").count() == 300_000 and found.where("a = concat('B', b)").count() == 150_000
    assert time.time() - began < 120

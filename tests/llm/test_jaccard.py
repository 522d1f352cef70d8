import random
import re

import pytest
from pyspark.sql import functions as F

from docket.llm import jaccard as J


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def brute(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if either and 100 * both >= percent * either and rows[i][0] is not None and rows[j][0] is not None:
                parent[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return sorted((str(d), len(s), str(None if d is None else low[top(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, groups=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5)))
    prose = lambda n: [word() for _ in range(n)]
    passage = prose(40)
    texts = [None, "", " \n ", "one", "One", "one two three", "a b c d", "A b\x0bc d", "x " * 3000]
    for _ in range(groups):
        base = prose(rng.choice([3, 4, 6, 20, 60, 120])) + (passage if rng.random() < 0.3 else [])
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ", "\n"]).join(copy))
    base = prose(100)
    for _ in range(80):  # a chain: neighbours link, ends don't
        base = list(base)
        base[rng.randrange(100)] = word()
        texts.append(" ".join(base))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(k, texts[i]) for k, i in enumerate(order)] + [(None, "one two three"), (5, texts[order[5]]), (5, texts[order[5]])]


@pytest.mark.parametrize(("words", "percent", "small"), [(4, 85, 8), (5, 80, 2), (2, 50, 3)])
def test_against_all_pairs(spark, monkeypatch, words, percent, small):
    monkeypatch.setattr(J, "SMALL_REGION", small)
    monkeypatch.setattr(J, "LISTED", 3 * small)
    rows = corpus(words * 100 + small)
    documents = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = J.near_duplicates(documents, words, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, words, percent)


def test_large_regions_fall_into_voronoi_regions(spark, monkeypatch):
    """Many copies with few or many changes make regions of more than LISTED classes."""
    monkeypatch.setattr(J, "LISTED", 16)
    inner, seen = J.regions_within, []

    def spy(stars, *more):
        seen.append(stars.where(F.col("size") > J.LISTED).count())
        return inner(stars, *more)

    monkeypatch.setattr(J, "regions_within", spy)
    rng, texts = random.Random(11), []
    for changes in (1, 2, 4, 6):
        base = [f"w{changes}x{k}" for k in range(120)]
        for copy in range(40):
            words = list(base)
            for k in rng.sample(range(120), changes):
                words[k] = f"c{copy}x{k}"
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 4, 85)
    assert max(seen) > 0


def test_chance_pairs_are_not_compared(spark, monkeypatch):
    """Texts of shared passages meet in many regions of two or three; their sketches tell that they aren't linked."""
    inner, seen = J.Verifier.close, []

    def spy(self, pairs):
        seen.append(pairs.count())
        return inner(self, pairs)

    monkeypatch.setattr(J.Verifier, "close", spy)
    rng = random.Random(3)
    passages = [[f"p{k}w{i}" for i in range(12)] for k in range(30)]
    texts = [" ".join(w for k in rng.sample(range(30), 8) for w in passages[k]) for _ in range(120)]
    texts += [f"{t} more" for t in texts[:5]]
    rows = list(enumerate(texts))
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    want = brute(rows, 4, 85)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert len({c for _, _, c in want}) == 120
    assert sum(seen) <= 10


def test_sets_are_not_shuffled_for_few_pairs(spark):
    """Whatever Spark's own threshold, few pairs go to the sets, not the sets to the pairs."""
    documents = spark.createDataFrame([(k, f"a b c d e f {k} g h i j k l") for k in range(40)], "doc_id long, text string")
    ranks = J.rank_buckets(J.bucket_counts(documents, 4))
    classes = J.distinct_classes(J.describe(documents, 4, 85, ranks))
    verifier = J.Verifier(documents, classes, 4, 85, ranks)
    ids = sorted(r.id for r in classes.select("id").collect())
    pairs = J.written(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long"), "pairs")
    verifier.load(classes.select("id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = verifier.joined(pairs, verifier.sets, ["elements"])
        assert joined.count() == 39
        assert "hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_appended_prepended_and_truncated_copies(spark, words, percent):
    rng = random.Random(words)
    fresh = (f"w{k}" for k in rng.sample(range(10**6), 10**5))
    new = lambda n: [next(fresh) for _ in range(n)]
    texts = []
    for n in [12, 14, 15, 20, 23, 24, 31, 40, 60, 90] * 3:
        base = new(n + words - 1)
        more = max(1, n * (100 - percent) // percent)
        texts += [base, rng.choice([base + new(more), new(more) + base, base[: -max(1, n * (100 - percent) // 100)]])]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    want = brute(rows, words, percent)
    assert len({c for _, _, c in want}) == len(rows) / 2
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


def test_no_candidates_and_empty(spark):
    documents = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, None)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in J.near_duplicates(documents).collect()} == {(1, 1), (2, 2), (3, 3)}
    assert J.near_duplicates(documents.limit(0)).count() == 0


def test_keep_one(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "z y x w v"), (9, ""), (8, None), (None, "q")]
    kept = J.keep_one(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, component_id string"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "8", "9", "None"]
    assert kept.columns == ["doc_id", "text", "component_id"]


def test_keep_one_judges_rows_of_one_id_by_their_texts(spark):
    rows = [(1, "a b c d e f g"), (4, "A b c d e f g"), (4, "h i j k l m"), (4, "n o p q r s"), (4, "n o p q r s"), (4, "")]
    rows += [(7, "N o p q r s"), (8, "t u v w x y"), (8, " t u v w x y"), (8, None), (9, "h i j k l m")]
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(1, "a b c d e f g"), (4, ""), (4, "h i j k l m"), (4, "n o p q r s"), (8, " t u v w x y"), (8, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)

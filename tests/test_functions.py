import difflib
import random
import re

from pyspark.sql import functions as F

from docket.functions import similarity, text


def python_clean(value, ocr):
    value = re.sub(r"[ \t]+", " ", value.replace("\r\n", "\n").replace("\r", "\n"))
    if ocr:
        value = re.sub(r"^[^a-zA-Z0-9ऀ-ॿ\n]{1,2}$", "", value, flags=re.M)
    value = re.sub(r"\n{3,}", "\n\n", value)
    return "".join(c for c in value if c.isprintable() or c in "\n\t").strip()


def test_cleaning_against_python(spark):
    rng = random.Random(1)
    pool = list("ab1 \t\n\r|.") + ["\xa0", "​", "\x85", "\x1c", "क", "😀", "\r\n", "\n\n\n", "é"]
    values = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(1500)] + ["", " ", "\n"]
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = frame.select(
        "i", text.clean_text(F.col("v")).alias("a"), text.clean_text(F.col("v"), True).alias("b"),
        text.strip(F.col("v")).alias("s"), text.collapse(F.col("v")).alias("c"),
    ).collect()
    for r in got:
        v = values[r.i]
        assert r.a == python_clean(v, False) and r.b == python_clean(v, True), repr(v)
        assert r.s == v.strip() and r.c == re.sub(r"\s+", " ", v), repr(v)


def test_cells(spark):
    values = ["N/A", " unknown ", "--", "a   b", "\xa0x\xa0", " nan", "nan", None, "Nil", "NOT  Available", "0"]
    want = [None, None, None, "a b", "x", "nan", None, None, None, None, "0"]
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    assert [r.c for r in frame.select(text.clean_cell(F.col("v")).alias("c"), "i").orderBy("i").collect()] == want


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_ratio(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice("abcé") for _ in range(rng.randrange(12))), "".join(rng.choice("abcé") for _ in range(rng.randrange(12)))) for _ in range(300)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = frame.select("i", similarity.indel_ratio("a", "b").alias("x")).collect()
    for r in got:
        a, b = pairs[r.i]
        want = 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0
        assert abs(r.x - want) < 1e-9
        assert want >= 100 * difflib.SequenceMatcher(None, a, b, False).ratio() - 1e-9


def test_similar_strings_lose_no_pair(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 14))) for _ in range(120)]
    a = spark.createDataFrame([(w,) for w in words], "a string")
    for percent in (60.0, 80.0, 90.0):
        got = {(r.a, r.b) for r in similarity.similar_strings(a, a.withColumnRenamed("a", "b"), percent).collect()}
        want = {(x, y) for x in words for y in words if 200 * lcs(x, y) / (len(x) + len(y)) >= percent}
        assert got == want


def test_bounds_of_the_string_join(spark):
    """Counts never exceed the distance, also beyond 255 of one character and for characters outside the basic plane."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcxyz é🙂𝒳日") for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["a" * 300, "a" * 600, "🙂" * 9]
    a = spark.createDataFrame([(w,) for w in texts], "a string").distinct()
    counts = similarity.letter_counts(F.col("a"))
    one = a.select("a", *(counts[c].alias(f"a{c}") for c in similarity.COUNTS))
    two = one.toDF(*(c.replace("a", "b", 1) for c in one.columns))
    for r in one.crossJoin(two).select("a", "b", similarity.count_distance("a", "b").alias("bound")).collect():
        assert r.bound <= len(r.a) + len(r.b) - 2 * lcs(r.a, r.b)


def test_candidates_of_the_string_join_are_few(spark):
    """Of names made of two words, the bounds leave few of the pairs of like length; none of the similar ones is lost."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(4, 9))) for _ in range(300)]
    names = sorted({f"{rng.choice(words)} {rng.choice(words)}" for _ in range(900)})
    names += [f"{n[:3]}{n[4:]}" for n in names[::30]]
    a = spark.createDataFrame([(n,) for n in set(names)], "a string")
    candidates = {(r.a, r.b) for r in similarity.candidate_pairs(a, a.withColumnRenamed("a", "b"), 80.0).collect()}
    alike = [(x, y) for x in set(names) for y in set(names) if abs(len(x) - len(y)) <= 0.2 * (len(x) + len(y))]
    want = {(x, y) for x, y in alike if similarity.common_subsequence(x, y) * 200 >= 80 * (len(x) + len(y))}
    assert want <= candidates and len(candidates) < 0.06 * len(alike)

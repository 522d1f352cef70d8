import random
from collections import Counter

from pyspark.sql import functions as F

from docket.llm import quality

BLANK = " \t\n\x0b\f\r"


def brute(text):
    text = text or ""
    words = "".join(" " if c in BLANK else c for c in text).split(" ")
    words = [w for w in words if w]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if any(c not in BLANK for c in x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_figures(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\x0b ", "a b c d e", "a b c d e a b c d e", " x y #\n#\n \n#", "w " * 30_000]
    for _ in range(120):
        texts.append("".join(rng.choice("ab") + rng.choice([" ", " ", "\n", "\t", "#"]) for _ in range(rng.randrange(60))))
    frame = spark.createDataFrame([(i, t, "s", 7) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int")
    got = {r.doc_id: tuple(r[x] for x in quality.FIGURES) for r in quality.figures(frame).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


def rates_of(hosts):
    """Shrunk rates and bounds by host and rule, of {host: (documents, failures by rule)}."""
    out = {}
    for k in range(len(quality.RULES)):
        counts = [(n, f[k]) for n, f in hosts.values()]
        bins = sorted(int(1000 * (f / n) ** 0.5) for n, f in counts)
        centre = ((bins[len(bins) // 2] + 1) / 1000) ** 2
        usual = centre + 3 * (centre - (bins[len(bins) // 4] / 1000) ** 2) / 0.6745
        p = sum(f for _, f in counts) / sum(n for n, _ in counts)
        kept = [(n, f) for n, f in counts if f <= n * usual + 3 * (n * p * (1 - p)) ** 0.5 + 3]
        m = sum(f for _, f in kept) / sum(n for n, _ in kept)
        plain = sum(f / n for n, f in kept) / len(kept)
        v = sum((f / n - plain) ** 2 for n, f in kept) / max(1, len(kept) - 1)
        between = v - m * (1 - m) * sum(1 / n for n, _ in kept) / len(kept)
        most = sum(n for n, _ in kept) / len(kept)
        s = min(max(m * (1 - m) / between - 1, 1), most) if between > 0 else most
        for h, (n, f) in hosts.items():
            out[h, k] = ((f[k] + m * s) / (n + s), m + 3 * (m * (1 - m) / (s + 1)) ** 0.5)
    return out


def counted(spark, hosts):
    """Documents as figures() leaves them, whose first rule fails as often as {host: (documents, failures)} says."""
    none = F.lit(0).cast("long")
    frame = spark.createDataFrame([(h, n, f) for h, (n, f) in hosts.items()], "source string, n long, f long")
    rows = frame.select("source", F.explode(F.sequence(F.lit(1), "n")).alias("i"), "f")
    words = F.when(F.col("i") <= F.col("f"), 5).otherwise(50).cast("long")
    figures = {"n_words": words, "word_chars": 5 * words, "n_symbols": none, "n_dup_lines": none, "n_repeat_words": none}
    return rows.select("source", *(c.alias(name) for name, c in figures.items()))


def test_many_bad_hosts_hide_each_other_no_more(spark):
    rng = random.Random(4)
    for bad in (1, 2, 5, 9, 12):
        hosts = {f"h{i}": (1000, sum(rng.random() < (0.9 if i < bad else 0.02) for _ in range(1000))) for i in range(30)}
        rows = quality.host_rates(counted(spark, hosts)).where("host_verdict = 'few_words'").collect()
        assert {r.host for r in rows} == {f"h{i}" for i in range(bad)}


def test_hosts_of_all_sizes_and_true_spread(spark):
    """Small hosts, a hot one and rates that truly differ: none falls but those far off."""
    rng = random.Random(6)
    hosts = {f"tiny{i}": (1 + i % 3, int(rng.random() < 0.1)) for i in range(300)}
    hosts |= {f"mid{i}": (400, sum(rng.random() < p for _ in range(400))) for i in range(60) for p in [rng.betavariate(10, 90)]}
    hosts |= {"hot": (20_000, 2_300), "bad1": (500, 400), "bad2": (9_000, 7_000)}
    rows = quality.host_rates(counted(spark, hosts)).where("host_verdict <> ''").collect()
    assert {r.host for r in rows} == {"bad1", "bad2"}
    two = quality.host_rates(counted(spark, {"a": (100, 2), "b": (100, 90)}))
    assert two.where("host_verdict <> ''").count() == 0


def test_hosts(spark):
    good = "one two three four five six seven eight nine ten eleven"
    rows, hosts = [], {}
    for h in range(30):
        bad, marked = (30 if h == 7 else 2 + h % 3), (h == 11) * 25
        hosts[None if h == 3 else f"h{h}"] = (40, (bad, 0, marked, 0, 0))
        for i in range(40):
            text = f"{good} {h} {i} long" + " and so on" * (i >= 40 - marked)
            text = "bad" if i < bad else text + (" ## ## ##" if bad <= i < bad + marked else "")
            rows.append((h * 100 + i, text.replace(" and so on", ""), None if h == 3 else f"h{h}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    frame = frame.withColumns({c: F.lit("own") for c in ("host", "_host", "counted", "_counted", "prior", "bound", "kept", "rate")})
    out = quality.judge(frame).collect()
    assert len(out) == len(rows) and {r.host for r in out} == {r._host for r in out} == {r.counted for r in out} == {"own"}
    want = rates_of(hosts)
    names = list(quality.RULES)
    for r in out:
        falls = [n for k, n in enumerate(names) if want[r.source, k][0] > want[r.source, k][1]]
        assert r.host_verdict == ",".join(falls)
        assert abs(r.host_rate - max(want[r.source, k][0] for k in range(len(names)))) < 1e-9
        assert r.kept == (not r.base_failed and not falls)
    assert {r.source: r.host_verdict for r in out if r.host_verdict} == {"h7": "few_words", "h11": "symbols"}
    assert any(r.source == "h7" and not r.base_failed and not r.kept for r in out)


def test_hosts_that_differ_by_chance_all_stay(spark):
    rng = random.Random(3)
    good = "one two three four five six seven eight nine ten eleven"
    rows = [(i, "bad" if rng.random() < 0.1 else good, f"h{i % 20}") for i in range(2000)]
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert out.where("host_verdict <> ''").count() == 0
    one = quality.judge(spark.createDataFrame([(1, "bad", "a"), (1, "bad", "a"), (2, good, "a")], "doc_id long, text string, source string"))
    assert sorted(r.kept for r in one.collect()) == [False, False, True]
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0

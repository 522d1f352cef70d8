"""The pipeline against brute-force versions of its stages."""

import pathlib
import random

import public_tokenizers
import sentencepiece

from tests.llm.test_decontaminate import edits
from tests.llm.test_jaccard import shingles
from tests.llm.test_quality import brute as figures
from tests.llm.test_secrets import brute as spans

import corpus_pipeline
from pyspark.sql import functions as F
from docket.llm import decontaminate as D
from docket.llm.shared import shared_folder


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    prose = lambda n: [word() for _ in range(n)]
    items = [" ".join(prose(14)) for _ in range(4)]
    docs = [None, "", "too few words here", "a b c d e f " * 20]
    for i in range(40):
        base = prose(rng.randrange(30, 90))
        if i % 7 == 0:
            base[5:5] = items[i % 4].upper().split()
        if i % 5 == 0:
            base[9:9] = [f"password: '{word()}{word()}9'", "AKIA" + "Z9" * 9]
        for _ in range(rng.choice([1, 1, 3])):
            copy = list(base)
            if rng.random() < 0.5:
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(docs)], list(enumerate(items))


def expected(documents, items):
    kept = []
    for d in documents:
        n, *_, repeated = figures(d[1])
        if n >= 10 and 100 * repeated <= 20 * n:
            kept.append(d)
    sets, group = [shingles(d[1], 5) for d in kept], list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    kept = [d for i, d in enumerate(kept) if group[i] == i]
    out = {}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for doc_id, text, *_ in kept:
        data = D.compared(text).tobytes()
        if any(edits(p, data) <= int(0.1 * len(p)) for p in (D.compared(x).tobytes() for _, x in items)):
            continue
        clean, at = "", 0
        for start, _, _, end in spans(text):
            if start >= at:
                clean += text[at:start] + "<secret>"
            at = max(at, end)
        clean += text[at:]
        out[doc_id] = (clean, len(clean), " ".join(map(str, library.encode(clean, add_eos=True))))
    return out


def test_pipeline(spark, tmp_path):
    documents, items = corpus()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(documents, columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = expected(documents, items)
    assert {k: (r.text, r.n_chars, r.ids) for k, r in got.items()} == want
    assert 20 < len(want) < 40 and any("<secret>" in x[0] for x in want.values())
    assert all(r.round_trip for r in got.values())


def test_tables_that_are_done_are_deleted(spark, tmp_path):
    """Texts stay on disk twice at most: as the quality rules write them, and as the last stage reads them; no sets or classes."""
    documents, items = corpus()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(documents, columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    shared = pathlib.Path(shared_folder(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 20
    left = {p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before}
    assert {"quality", "secret-scan"} <= left
    assert not left & {"quality-rules", "near-duplicates", "decontamination", "described", "classes", "several", "groups", "sets"}


CLASHES = (
    "kept n_words word_chars base_failed host_rate host_verdict host counted class root id row again component_id leaks before"
    " spans n_tokens ids decoded round_trip own_0 own_1 _doc prior key region"
).split()


def test_own_columns_stay_whatever_their_names(spark, tmp_path):
    documents, items = corpus()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(documents, columns)
    for k, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.col("doc_id") * 100 + k)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), stage(spark, docs, str(tmp_path)).schema)
        if name != "tokens":
            assert docs.columns == before
    rows = docs.collect()
    assert len(rows) > 20
    for r in rows:
        for k, c in enumerate(CLASHES):
            own = f"_{c}" if c in ("ids", "n_tokens", "round_trip") else c
            assert r[own] == r.doc_id * 100 + k
        assert isinstance(r.ids, str) and r.round_trip


def test_empty_null_repeated_and_long(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    good = "one two three four five six seven eight nine ten eleven twelve"
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, good, None, None, None), (1, good, None, None, None), (2, good, "en", "a", 3), (None, good, "en", "a", 1)]
    rows += [(3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, long, "en", "b", 1)]
    for given, want in (([], []), (rows, [("1", good), ("5", long), ("None", good)])):
        docs = spark.createDataFrame(given, columns)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert sorted((str(r.doc_id), r.text) for r in docs.collect()) == want

"""The operators' queries on the smallest tables: against DuckDB where SQL can express them, else by brute force."""

import hashlib
import zlib
from pathlib import Path

import duckdb
import pytest
import sentencepiece

from docket.llm import decontaminate, queries, wordpiece
from tests.llm.test_decontaminate import edits
from tests.llm.test_jaccard import brute as components
from tests.llm.test_secrets import brute as secret_spans
from tests.llm.test_tokens import MODEL, VOCABULARY, longest_match
from tools_oracle import plain

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), con.execute(queries.ORACLE_SQL[name]).fetchdf()
    assert sorted(got) == sorted(want) and plain(got) == plain(want)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_jaccard_query(spark, documents):
    got = queries.op3_jaccard_join(spark, SMALL).collect()
    rows = [(r.doc_id, r.text) for r in documents]
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components(rows, 4, 85)


def test_token_count_query(spark, documents):
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in queries.op5_token_counts(spark, SMALL).collect()}
    pieces, known = wordpiece.read_vocabulary(VOCABULARY), {}
    for r in documents:
        words = wordpiece.WORD.findall(r.text or "")
        for w in set(words) - known.keys():
            known[w] = longest_match(pieces, b" " + w.encode())
        assert got[r.doc_id] == (len(words), sum(known[w] for w in words))


def test_secret_query(spark):
    larger = SMALL.replace("0.001", "0.01")  # the smallest tables hold no secrets
    documents = spark.read.parquet(f"{larger}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op6_secret_scan(spark, larger).collect()}
    assert len(got) == len(documents) and any(r.spans for r in got.values())
    for d in documents:
        spans, r = secret_spans(d.text), got[d.doc_id]
        said = [f"{kind}:{start}:{end}" for start, _, kind, end in spans if kind != "entropy"]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == sha(",".join(said))
        assert r.spans == ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def test_decontamination_query(spark, documents):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id): r for r in queries.op7_decontamination(spark, SMALL).collect()}
    for d in (d for d in documents if len(d.text or "") < 1500):
        data = decontaminate.compared(d.text).tobytes()
        for x in items:
            pattern = decontaminate.compared(x.text).tobytes()
            found = got.get((d.doc_id, x.item_id))
            if found:
                assert found.edits == edits(pattern, decontaminate.compared(d.text[found.start : found.end]).tobytes()) <= int(0.1 * len(pattern))
            else:
                assert pattern not in data


def test_sentencepiece_query(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in queries.op9_sentencepiece(spark, SMALL).collect()}
    for d in documents:
        ids = library.encode(d.text or "", add_eos=True)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_language_query(spark, documents):
    got = {r.doc_id: r for r in queries.op10_language_id(spark, SMALL).collect()}
    right = total = 0
    for d in documents:
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in d.text or ""))
        if r.held_out and d.lang is not None and r.lang_pred != "und":
            right, total = right + (r.lang_pred == d.lang), total + 1
    assert total > 30 and right / total > 0.95

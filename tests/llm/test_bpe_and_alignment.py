"""Byte-level BPE against its library; alignment of two tokenizers by brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docket.llm import align, byte_bpe, queries

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENS = byte_bpe.read_ranks(MULTI)
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={}
)
REPLAY = byte_bpe.Replay(TOKENS, public_tokenizers.PATTERN)
A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


def ids_of(replay, texts):
    return [sum(words, []) for words in replay.block(texts)]


part = st.one_of(st.text(max_size=12), st.text("abtheinrso ", max_size=30), st.sampled_from([t.decode("utf-8", "ignore") for t in TOKENS[::97]]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(part, max_size=6).map("".join), max_size=8))
def test_same_ids_as_the_library(texts):
    assert ids_of(REPLAY, texts) == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [REPLAY.decode(ids).decode() for ids in ids_of(REPLAY, texts)] == texts


def test_many_places_together_and_in_turn():
    words = sorted({w for i in range(3000) for w in REPLAY.split.findall(f"ab{i * 7919 % 1000}aaab{'aab' * (i % 9)}the{i % 30 * 'an'}")})
    data = [w.encode() for w in words]
    assert REPLAY.words(data, 2) == REPLAY.words(data, 10**9) == [LIBRARY.encode_ordinary(w) for w in words]


def test_a_pair_of_lower_rank_comes_first():
    """Made so that joining `bc` makes `abc`, which has a lower rank, beside another `bc` of the same word."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bcb", b"bc", b"abcbc"]
    own = byte_bpe.Replay(tokens, ".+")
    library = tiktoken.Encoding("own", pat_str=".+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for text in ("abc", "abcbcb", "bcbcbc", "xabcbcabcb", "abcbcx"):
        for many in (1, 10**9):
            assert own.words([text.encode()], many) == [library._core_bpe.encode_single_piece(text.encode())]


def test_long_words_and_forgetting():
    replay = byte_bpe.Replay(TOKENS, public_tokenizers.PATTERN, keep=3)
    texts = ["a" * 50_000, "ab " * 1000, "x" * 65, None, ""]
    for _ in range(2):
        assert ids_of(replay, texts) == [LIBRARY.encode_ordinary(t or "") for t in texts]
    assert not any(len(w) > 64 for w in replay.known)


def test_encode_table(spark):
    rows = [(1, "one two", "x"), (2, None, "y"), (3, "", "z"), (1, "one two", "x"), (4, "<|endoftext|> é\n\n 日本", None)]
    df = spark.createDataFrame(rows, "n_tokens int, text string, extra string")
    got = byte_bpe.encode(df, MULTI, public_tokenizers.PATTERN).collect()
    assert [r.ids for r in got] == [",".join(map(str, LIBRARY.encode_ordinary(t or ""))) for _, t, _ in rows]
    assert [bytes(r.decoded).decode() for r in got] == [t or "" for _, t, _ in rows] and [r.extra for r in got] == list("xyzx") + [None]
    assert byte_bpe.encode(df.limit(0), MULTI, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_query(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op12_byte_bpe(spark, SMALL).collect()}
    for d in documents:
        ids, r = LIBRARY.encode_ordinary(d.text or ""), got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def brute_alignment(texts):
    """Columns of the alignment by loops over bytes, with both libraries."""
    a_side, b_side = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    a_side.encode_special_tokens = True
    names = {i: p for p, i in a_side.get_vocab().items()}
    table = align.printable_bytes()
    found, linked = [], []
    for text in texts:
        tokens = []
        if text:
            for ids, token in (
                (a_side.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(table[c] for c in names[i])),
                (b_side.encode(text), lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if re.fullmatch("<0x..>", b_side.id_to_piece(i)) else b_side.id_to_piece(i).replace("▁", " ").encode()),
            ):
                tokens.append([(i, token(i)) for i in ids])
        if not text or any(b"".join(t for _, t in side) != (" " + text).encode() for side in tokens):
            found.append((0, 0, 0, ""))
            linked.append([])
            continue
        owners = [[(n, i) for n, (i, t) in enumerate(side) for _ in t] for side in tokens]
        links = sorted(set(zip(*owners)))
        ends = [{sum(len(t) for _, t in side[: n + 1]) for n in range(len(side))} for side in tokens]
        groups, start = [], 0
        for end in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(i) for _, i in dict.fromkeys(side[start:end])) for side in owners))
            start = end
        found.append((len(tokens[0]), len(tokens[1]), len(groups), ";".join(groups)))
        linked.append([(a[1], b[1]) for a, b in links])
    counts = Counter(p for links in linked for p in set(links))
    highest = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    return [
        (*f[:3], len(links), sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links), f[3])
        for f, links in zip(found, linked)
    ]


TEXTS = [
    "The cat sat.", "The cat sat.", None, "", " ", "   two  spaces ", "<s> <|endoftext|> <unk>", "naïve 日本語 🙂 \n\t x", "a" * 300,
    "the the the the cat cat", "nul\0 and ▁ mark", "ﬁ ligature   nbsp", "word " * 70, "​zero", "end▁",
]


@pytest.mark.parametrize("links", [align.LINKS, 20])
def test_alignment(spark, monkeypatch, links):
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(TEXTS)], "doc_id long, text string, block string").repartition(3)
    monkeypatch.setattr(align, "LINKS", links)
    got = align.scored(df, A_FILE, B_FILE, public_tokenizers.PATTERN).collect()
    rows = {r.doc_id: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")) for r in got}
    assert [rows[i] for i in range(len(TEXTS))] == brute_alignment(TEXTS) and {r.block for r in got} == {"mine"}
    assert align.scored(df.limit(0), A_FILE, B_FILE, public_tokenizers.PATTERN).count() == 0


def test_bitmaps_both_kinds():
    random = np.random.default_rng(1)
    codes = np.unique(random.integers(0, 40, 3000) ** 2 << 16 | random.integers(0, 1000, 3000))
    pairs, counts, dense, docs = align.bitmaps(codes, 1000)
    assert dense.any() and not dense.all() and counts.sum() == len(codes)
    slots, rows = align.documents_of(docs, dense)
    assert sorted((pairs[rows] << 16 | slots).tolist()) == codes.tolist()
    some = docs.slice(3, 5)
    slots, rows = align.documents_of(some, dense[3:8])
    assert len(slots) == counts[3:8].sum()


def test_alignment_query(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_token_alignment(spark, SMALL).collect()}
    for d, want in zip(documents, brute_alignment([d.text for d in documents])):
        r = got[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == want[:6]
        assert r.groups_sha256 == (hashlib.sha256(want[6].encode()).hexdigest() if want[0] else "")

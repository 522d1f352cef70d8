import random

import public_tokenizers
import pytest
import sentencepiece

from docket.llm import sentencepiece_bpe, wordpiece

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(3)
    pool = list(" ▁\n\tabcdeéßñ😀①ÿthenig.,   ")
    out = [None, "", " ", "\n", "\x00a", "</s> <s> <unk> <0x41>", "a" * 5000, " " * 300, "the " * 20_000, "é́😀"]
    out += ["".join(rng.choice(pool) for _ in range(rng.randrange(50))) for _ in range(2000)]
    return out + out[-2:]


def test_bpe_against_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t, 5) for i, t in enumerate(texts())]
    out = sentencepiece_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids int"), MODEL)
    got = {r.doc_id: r for r in out.collect()}
    model = sentencepiece_bpe.BpeModel(MODEL)
    for i, text, _ in rows:
        want = library.encode(text or "", add_eos=True)
        assert got[i].ids == " ".join(map(str, want)) and got[i].n_tokens == len(want)
        assert got[i].decoded == library.decode(want) == model.decode(want)


def test_bpe_random_pieces():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = sentencepiece_bpe.BpeModel(MODEL)
    encoder = sentencepiece_bpe.Encoder(model, keep=100)
    rng, pieces = random.Random(4), list(model.ids)
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(7)).replace("▁", " ")
        assert encoder.text(text)[1] == " ".join(map(str, library.encode(text, add_eos=True)))
        ids = [rng.randrange(259, len(model.pieces)) for _ in range(5)]
        assert model.decode(ids) == library.decode(ids)


def longest_match(pieces, word):
    at = count = 0
    while at < len(word):
        size = next((n for n in range(len(word) - at, 0, -1) if word[at : at + n] in pieces), 0)
        if not size:
            return 1
        at, count = at + size, count + 1
    return count


def brute(pieces, text):
    words = wordpiece.WORD.findall(text or "")
    return len(words), sum(longest_match(pieces, b" " + w.encode()) for w in words)


def test_counts_against_longest_match(spark):
    pieces = wordpiece.read_vocabulary(VOCABULARY)
    rows = [(i, t, 5) for i, t in enumerate(x for x in texts() if len(x or "") < 1000)]
    out = wordpiece.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_words int"), VOCABULARY)
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in out.collect()}
    for i, text, _ in rows:
        assert got[i] == brute(pieces, text), text


@pytest.mark.parametrize("seed", range(5))
def test_small_vocabularies(seed):
    rng = random.Random(seed)
    for _ in range(40):
        size = rng.randrange(1, 12)
        pieces = {bytes(rng.choice(b"ab ") if i == 0 else rng.choice(b"ab") for i in range(rng.randrange(1, 6))) for _ in range(size)}
        counter = wordpiece.Counter(pieces)
        for _ in range(50):
            word = b" " + bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 10)))
            assert counter.walk(word) == longest_match(pieces, word), (pieces, word)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sentencepiece_bpe.encode(none, MODEL).count() == wordpiece.count_tokens(none, VOCABULARY).count() == 0

import hashlib

from docket.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, loss string, turns int"


def test_round_trip_and_order(spark):
    texts = ["<|im_end|>\n<|im_start|>assistant\nx", "<\\|", "<\\\\|<||", "", None, "\\", "a<", "é😀\n\n"]
    roles = ["system", "user", "assistant", "user", "assistant", "user", "assistant", "us%er\n<|im_start|>"]
    rows = [(1, i, r, t, "x", 1) for i, (r, t) in enumerate(zip(roles, texts))]
    rows += [(2, 0, "user", "q", "x", 1), (2, 1, "assistant", "a", "x", 1), (3, 5, "assistant", "a", "x", 1)]
    rows += [(None, None, None, None, None, None)] * 2 + [(4, 0, "user", "q", "x", 1)] * 2
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    out = out.withColumn("turns", chat.read_turns(out.formatted)).withColumn("loss", chat.loss_text(out.segments))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t or "") for r, t in zip(roles, texts)]
    assert got[1].loss == "".join(t or "" for r, t in zip(roles, texts) if r == "assistant")
    assert (got[1].valid, got[1].bad_turn) == (False, 7)
    assert (got[2].valid, got[2].bad_turn) == (True, None)
    assert got[2].formatted == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert (got[3].valid, got[3].bad_turn) == (False, 0)
    assert got[4].n_turns == 2 and got[4].bad_turn == 1
    assert got[None].n_turns == 2 and not got[None].valid


def test_empty_and_long(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "ab<|c " * 200_000
    out = chat.format_chats(spark.createDataFrame([(1, 0, "user", long, "", 0)], SCHEMA))
    turn = out.select(chat.read_turns(out.formatted).alias("t")).first().t[0]
    assert hashlib.sha256(turn.text.encode()).digest() == hashlib.sha256(long.encode()).digest()

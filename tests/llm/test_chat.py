import os
from hashlib import md5

from oracle import compare

from papyrion.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, n int, last string"


def plain(rows):
    """{conv_id: (turns, n_equal)} of the conversations that no other one continues."""
    by = {}
    for i, turn, role, text, *_ in rows:
        if i is not None:
            by.setdefault(i, []).append((chat.NO_TURN if turn is None else turn, role or "", text or ""))
    by = {i: tuple((r, t) for _, r, t in sorted(v, key=lambda x: (x[0], md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()))) for i, v in by.items()}
    kept = {}
    for i, turns in by.items():
        equal = [j for j in by if by[j] == turns]
        if i == min(equal) and not any(len(o) > len(turns) and o[: len(turns)] == turns for o in by.values()):
            kept[i] = (turns, len(equal))
    return kept


def rendered(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def test_snapshots(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", None), ("assistant", "x" * 100000), ("user", "bye")]
    rows = []
    for i, n in ((1, 2), (2, 4), (3, 5), (4, 5), (5, 1)):
        rows += [(i, t, *talk[t], 1, "q") for t in range(n)]
    rows += [(6, 0, "user", "hi", 1, None), (6, 1, "assistant", "hello!", 1, "q")]  # leaves the common start
    rows += [(7, 1, "assistant", "hello", None, "q"), (7, 0, "user", "hi", 1, "q"), (7, 2, "user", "more", 1, "q")]  # out of order
    rows += [(8, None, None, None, 1, "q"), (None, 0, "user", "lost", 1, "q"), (9, 0, "user", "<|im_end|> no", 1, "q")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = plain(rows)
    assert set(got) == set(want) == {3, 6, 7, 8, 9}
    assert {i: (r.n_turns, r.n_equal) for i, r in got.items()} == {i: (len(t), n) for i, (t, n) in want.items()}
    for i in (3, 6, 7, 8):
        assert got[i].chat == rendered(want[i][0])
    assert got[9].chat == "<|im_start|>user\n<| im_end|> no<|im_end|>\n"


def test_repeated_rows_and_ties_are_turns(spark):
    rows = [(1, 0, "user", "a", 1, ""), (1, 0, "user", "a", 1, ""), (2, 0, "user", "a", 1, ""), (3, 0, "user", "b", 1, ""), (3, 0, "user", "a", 1, ""), (4, 0, "user", "a", 1, ""), (4, 0, "user", "b", 1, "")]
    got = {r.conv_id: (r.n_turns, r.n_equal) for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (2, 1), 3: (2, 2)}


def test_sql_agrees_on_nulls_ties_and_copies(spark, tmp_path):
    from papyrion.llm.queries import OP8_SQL, op8_chat

    rows = [(i, t if t != 2 else None, "user" if t % 2 else None, None if t == 3 else f"said {t} {i % 3}") for i in range(12) for t in range(2 + i % 4)]
    rows += [*rows[:6], (None, 0, "user", "lost"), (20, -5, "user", "minus"), (20, None, "user", "none"), (20, 1, "user", "b"), (20, 1, "user", "a"), (21, None, None, None)]
    tables = "/root/testdata/sf0.001"
    for name in os.listdir(tables):
        if name != "conversations.parquet":
            os.symlink(f"{tables}/{name}", tmp_path / name)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert compare(spark, op8_chat, OP8_SQL, str(tmp_path)) == ""
    got = {r.conv_id: r.chat for r in op8_chat(spark, str(tmp_path)).collect()}
    assert got[20].startswith("<|im_start|>user\nnone") and set(got) == set(plain(rows))


def test_long_conversations_cross_blocks(spark):
    n = chat.BLOCK * 2 + 7
    rows = [(1, t, "user", str(t), 1, "") for t in range(n)] + [(2, t, "user", str(t), 1, "") for t in range(n - 3)] + [(3, t, "user", str(t if t != chat.BLOCK + 1 else -1), 1, "") for t in range(n - 3)]
    assert {r.conv_id for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()} == {1, 3}


def test_query_is_brute_force(spark):
    from papyrion.llm.queries import op8_chat

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op8_chat(spark, "/root/testdata/sf0.001").collect()
    assert {r.conv_id: (r.n_turns, r.n_equal, r.chat) for r in got} == {i: (len(t), n, rendered(t)) for i, (t, n) in plain(rows).items()}


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0

import random

from tests.llm.helpers import rows
from viewpoint.llm import chat

OUT = ("conv_id", "n_turns", "n_copies", "text")


def brute(turns):
    convs = {}
    for c, t, r, s in turns:
        if c is not None:
            convs.setdefault(c, []).append((-(10**9) if t is None else t, r or "unknown", s or ""))
    convs = {c: tuple(x[1:] for x in sorted(v)) for c, v in convs.items()}
    inner = {v[:k] for v in convs.values() for k in range(1, len(v))}
    out = []
    for v in set(convs.values()) - inner:
        ids = [c for c in convs if convs[c] == v]
        out.append((min(ids), len(v), len(ids), "".join(f"<|{r}|>\n{s}\n" for r, s in v)))
    return sorted(out, key=repr)


def run(spark, turns):
    return rows(chat.format_chats(spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string")), *OUT)


def test_equals_brute_force_on_random_snapshots(spark):
    rng = random.Random(1)
    turns = []
    for c in range(150):
        for t in range(rng.randrange(1, 6)):
            turns.append((c, t, ("user", "assistant")[t % 2], rng.choice("ab")))
    rng.shuffle(turns)
    assert run(spark, turns) == brute(turns)


def test_snapshots_go_and_the_longest_stays(spark):
    full = [(0, "user", "hi"), (1, "assistant", "yes?"), (2, "user", "bye")]
    turns = [(c, *x) for c, n in ((1, 1), (2, 2), (3, 3), (4, 3)) for x in full[:n]] + [(5, 0, "user", "hi there")]
    assert run(spark, turns) == [(3, 3, 2, "<|user|>\nhi\n<|assistant|>\nyes?\n<|user|>\nbye\n"), (5, 1, 1, "<|user|>\nhi there\n")]


def test_boundaries_between_role_and_text_count(spark):
    turns = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "a", "bc"), (3, 1, "a", ""), (4, 1, "a", "bc"), (4, 0, "a", "")]
    assert run(spark, turns) == brute(turns)


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    turns = [
        (1, 0, None, "x"), (1, 1, "user", None), (2, 0, "unknown", "x"), (2, 1, "user", ""), (3, None, "user", "x"), (3, 0, "user", "y"),
        (4, 0, "user", "b"), (4, 0, "user", "a"), (5, 0, "user", "r"), (5, 0, "user", "r"), (6, 0, "user", "r"), (7, 0, "user", "long " * 100_000),
        (None, 0, "user", "lost"),
    ]
    assert run(spark, turns) == brute(turns)


def test_many_turns_in_one_conversation(spark):
    turns = [(1, t, "user", str(t % 7)) for t in range(3000)] + [(2, t, "user", str(t % 7)) for t in range(2999)]
    assert run(spark, turns) == brute(turns)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, 0, "user", "x", 5, 5, 5)], "conv_id bigint, turn int, role string, text string, k int, p1 int, n_copies int")
    assert rows(chat.format_chats(df), *OUT) == [(1, 1, 1, "<|user|>\nx\n")]

"""Forms of operators for long texts and large tables: equal to the row-local ones."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from viewpoint.functions import rouge as RG
from viewpoint.functions import text as T
from viewpoint.operators import bins as B
from viewpoint.operators import external as E
from viewpoint.operators import passages as P


def test_contained_is_the_substring_test():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab é\U0001f600") for _ in range(rng.randrange(0, 60)))
        heads = ["".join(rng.choice("ab é\U0001f600") for _ in range(rng.randrange(0, 9))) for _ in range(12)] + [text[3:9], text, text + "a"]
        assert T.contained(heads, text).tolist() == [h in text for h in heads]
    assert T.contained(["", "a"], None).tolist() == [False, False] and T.contained([], "abc").tolist() == []
    # Windows whose polynomial hashes are equal modulo 2 ** 64 are told apart as strings.
    words = ["a", "b"]
    for _ in range(11):
        words = [words[0] + words[1], words[1] + words[0]]
    assert T._window_hash(words[0]) == T._window_hash(words[1]) and words[0] != words[1]
    assert T.contained(words, words[0]).tolist() == [True, False]


def test_sides_of_a_topic_are_those_of_its_passages(spark):
    rng = random.Random(2)
    lines = lambda: "\n".join(" ".join(rng.choice(["War,", "peace", "the", "U.S.", "x"]) for _ in range(rng.randrange(0, 7))) for _ in range(9))
    rows = [(i, lines(), lines(), lines()) for i in range(30)] + [(30, "a\n\nb", None, "b"), (31, None, "x", None), (32, "", "", "")]
    topics = spark.createDataFrame(rows, "row_id long, alt_op string, left_op string, right_op string")
    got = P.explode_passages(topics).join(topics.select("row_id", "left_op", "right_op"), "row_id")
    one = T.side_of("op", T.normalize("left_op"), T.normalize("right_op"))
    assert got.where(~F.col("side").eqNullSafe(one)).count() == 0 and got.count() == sum(len((r[1] or "").split("\n")) for r in rows)


def test_sides_take_linear_time():
    """50,000 passages; one search per passage would read the side 50,000 times."""
    rng = random.Random(3)
    heads = [f"passage number {rng.randrange(10**9)}"[:30] for _ in range(50_000)]
    side = " ".join(heads[::2])
    start = time.process_time()
    got = T.contained(heads, side)
    assert time.process_time() - start < 20
    assert got[::2].all() and got[1::2].sum() < 1000


@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_long_overlap_equals_the_fold(spark, chunk):
    rng = random.Random(chunk)
    toks = lambda: [rng.choice("abcde") for _ in range(rng.randrange(0, 12))]
    rows = [(i, toks(), toks()) for i in range(60)] + [(60, [], []), (61, None, ["a"]), (62, ["a"] * 50, ["a"] * 20)]
    df = spark.createDataFrame(rows, "id long, p array<string>, r array<string>")
    known = df.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in "pr"})
    want = {r["id"]: (r["rouge1"], r["rouge2"]) for r in RG.add_rouge(known, "p", "r", ("rouge1", "rouge2")).collect()}
    for n in (1, 2):
        got = {r["id"]: r["f"] for r in RG.long_overlap(df, ["id"], "p", "r", n, chunk).collect()}
        assert got == pytest.approx({i: w[n - 1] for i, w in want.items()})


def test_a_very_long_pair_across_tasks(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(999_999)), lambda i: F.concat(F.lit("w"), (i % 1000).cast("string")))
    df = spark.range(1).select("id", words.alias("p"), F.slice(words, 1, 500_000).alias("r"))
    got = RG.long_overlap(df, ["id"], "p", "r", 2).first()
    assert (got["hits"], got["n_pred"], got["n_ref"]) == (499_999, 999_999, 499_999)


def test_sketched_edges_are_within_the_rank_error(spark):
    rng = random.Random(4)
    values = [rng.gauss(0, 1) for _ in range(20_000)]
    df = spark.createDataFrame([("m", v) for v in values] + [("m", None), ("m", float("nan")), ("n", None)], "model string, x double").repartition(6)
    ranks = sorted(values)
    half = df.where("x < 0"), df.where("x >= 0 or x is null")
    merged = B.edges_of_states(B.merge_states(B.quantile_state(half[0], "x").union(B.quantile_state(half[1], "x"))), 10)
    for got in (B.percentile_edges(df, "x", 10, sketch=200), merged):
        edges = {r["model"]: r["edges"] for r in got.collect()}
        assert edges["n"] is None and len(edges["m"]) == 10
        for i, e in enumerate(edges["m"], 1):
            rank = sum(v <= e for v in ranks)
            assert abs(rank - i / 10 * len(ranks)) <= 0.03 * len(ranks)


def _fragile():
    def score(text, n):
        if (text == "bad").any():
            raise ValueError("no score for this")
        return text.fillna("").str.len() + n

    return score


def test_a_failing_input_is_one_reject_and_equal_inputs_are_scored_once(spark):
    rows = [(i, "bad" if i == 77 else None if i % 100 == 5 else f"t{i % 50}", float(i % 2)) for i in range(10_000)]
    df = spark.createDataFrame(rows, "id long, text string, n double").repartition(5)
    out, rejects = E.score_distinct(df, _fragile, ["text", "n"], "score")
    got = {r["id"]: r["score"] for r in out.collect()}
    assert got == {i: None if t == "bad" else len(t or "") + n for i, t, n in rows}
    assert [tuple(r) for r in rejects.collect()] == [("bad", 1.0, "ValueError: no score for this")]


def _counting(path):
    def factory():
        def score(text):
            with open(path, "a") as f:
                f.write("x" * len(text))
            return pd.Series([1.0] * len(text), index=text.index)

        return score

    return factory


def test_equal_inputs_reach_the_scorer_once(spark, tmp_path):
    df = spark.createDataFrame([(f"t{i % 7}",) for i in range(500)], "text string").repartition(4)
    out, rejects = E.score_distinct(df, _counting(str(tmp_path / "calls")), ["text"], "score")
    assert out.where("score = 1").count() == 500 and rejects.count() == 0
    assert len((tmp_path / "calls").read_text()) == 7

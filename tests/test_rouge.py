import random

import pytest
from pyspark.sql import functions as F

from tests import pyref
from viewpoint.functions import rouge as RG
from viewpoint.functions.rouge import _lcs_length


def _pairs(n=300, seed=7):
    rnd = random.Random(seed)
    vocab = ["a", "b", "c", "d", "e", "f", "g"]
    out = []
    for _ in range(n):
        p = [rnd.choice(vocab) for _ in range(rnd.randint(0, 25))]
        r = [rnd.choice(vocab) for _ in range(rnd.randint(0, 25))]
        out.append((p, r))
    return out + [([], []), (["a"], ["a"]), (["a", "b"], ["a", "b"])]


def test_bit_parallel_lcs_equals_dp():
    for p, r in _pairs(500, seed=3):
        assert _lcs_length(p, r) == pyref.lcs(p, r)


def test_rouge_matches_python(spark):
    pairs = _pairs()
    df = spark.createDataFrame(pairs, "p array<string>, r array<string>")
    got = RG.add_rouge(df, "p", "r").collect()
    for row, (p, r) in zip(got, pairs):
        assert abs(row["rouge1"] - pyref.rouge_n(p, r, 1)) < 1e-12
        assert abs(row["rouge2"] - pyref.rouge_n(p, r, 2)) < 1e-12
        assert abs(row["rougeL"] - pyref.rouge_l(p, r)) < 1e-12


def test_clipped_counts_by_hand(spark):
    df = spark.createDataFrame([(["a", "a", "a", "b", ""], ["a", "b", "b", "a", "", ""])], "p array<string>, r array<string>")
    hits = df.select(RG.clipped_hits(RG.tagged(F.col("p"), F.col("r")))).first()[0]
    assert hits == 4  # two a, one b, one empty
    assert RG.add_rouge(df, "p", "r").first()["rouge1"] == pytest.approx(2 * 4 / (5 + 6))


def test_long_texts_take_linear_time(spark):
    import time

    seconds = {}
    for n in (2_000, 2_000, 20_000):
        tokens = [f"t{i}" for i in range(n)]
        df = spark.createDataFrame([(tokens, tokens[::-1])], "p array<string>, r array<string>")
        start = time.perf_counter()
        assert RG.add_rouge(df, "p", "r", metrics=("rouge1", "rouge2")).first()["rouge1"] == 1.0
        seconds[n] = time.perf_counter() - start
    assert seconds[20_000] < 10 * seconds[2_000] + 5


def test_rouge_identity_and_range(spark):
    df = spark.createDataFrame([(["x", "y", "z"],), (["q"],)], "p array<string>")
    got = RG.add_rouge(df.withColumn("r", F.col("p")), "p", "r").collect()
    assert got[0]["rouge1"] == 1.0 and got[0]["rouge2"] == 1.0 and got[0]["rougeL"] == 1.0
    assert got[1]["rouge1"] == 1.0 and got[1]["rouge2"] == 0.0  # one token has no bigram

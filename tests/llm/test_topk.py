import math
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import rows
from viewpoint.llm import topk

OUT = ("query_id", "rank", "vec_id", "score")


def brute(vectors, k=5, step=50):
    of = {i: [math.floor(256 * x) for x in v] for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in of:
        if q % step == 0:
            scores = sorted((-sum(a * b for a, b in zip(of[q], of[c])), c) for c in of if c != q and len(of[c]) == len(of[q]))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def run(spark, vectors, **more):
    return rows(topk.exact_top_k(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>"), **more), *OUT)


def test_equals_brute_force_with_many_ties(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(6)]) for i in range(900)]
    assert run(spark, vectors) == brute(vectors)


def test_equals_brute_force_on_gaussian_vectors(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(32)]) for i in range(700)]
    vectors += [(10_000 + i, vectors[7][1]) for i in range(40)]  # a group of copies
    assert run(spark, vectors) == brute(vectors)


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(topk, "DATA_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 2) for _ in range(5)]) for i in range(400)]
    assert run(spark, vectors) == brute(vectors)


def test_unusable_vectors_other_lengths_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, -1.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [1.0, None]), (5, []), (6, [0.999, 0.5]), (7, [3.0]), (50, [0.0, 0.0]), (100, [2.0]), (150, None), (None, [1.0, 1.0])]
    assert run(spark, vectors) == brute(vectors)
    assert run(spark, []) == [] and run(spark, [(50, [1.0])]) == []


def test_own_queries_and_k_and_clashing_columns(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)], 1, 2, 3) for i in range(120)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>, rank int, score int, query_id int")
    got = rows(topk.exact_top_k(df, F.col("vec_id") % 7 == 0, k=2), *OUT)
    assert got == brute([v[:2] for v in vectors], k=2, step=7)


@pytest.mark.parametrize("large", [2.0**20, -(2.0**40)])
def test_components_beyond_the_limit_raise(spark, large):
    with pytest.raises(Exception, match="a vector component"):
        run(spark, [(0, [1.0, 2.0]), (50, [large, 1.0])])

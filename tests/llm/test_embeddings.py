import math
import random

from tests.llm.helpers import components, rows
from viewpoint.llm import embeddings

OUT = ("vec_id", "n_links", "component_id", "kept")


def cosine(x, y):
    return math.fsum(a * b for a, b in zip(x, y)) / math.sqrt(math.fsum(a * a for a in x)) / math.sqrt(math.fsum(b * b for b in y))


def good(v):
    return v is not None and all(a is not None and math.isfinite(a) for a in v) and any(v)


def brute(vectors):
    ids = sorted(i for i, _ in vectors)
    of = {i: v for i, v in vectors if good(v)}
    links = [(a, b) for a in of for b in of if a < b and len(of[a]) == len(of[b]) and cosine(of[a], of[b]) >= 0.9]
    comp = components(ids, links)
    return [(i, sum(i in x for x in links), comp[i], comp[i] == i) for i in ids], links


def run(spark, vectors):
    return rows(embeddings.near_duplicate_vectors(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")), *OUT)


def clouds(seed, n, spread):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(n)]


def test_all_links_of_tight_clouds(spark):
    vectors = clouds(1, 300, 0.1)
    vectors += [(1000 + i, vectors[i][1]) for i in range(0, 60, 2)]  # equal vectors
    assert run(spark, vectors) == sorted(brute(vectors)[0], key=repr)


def test_recall_where_clouds_run_into_one_another(spark):
    vectors = clouds(2, 500, 0.4)
    want, links = brute(vectors)
    got = run(spark, vectors)
    assert sum(r[1] for r in got) >= 0.9 * 2 * len(links)
    most = {r[0]: r[1] for r in want}
    assert all(r[1] <= most[r[0]] for r in got)  # no link below the threshold


def test_blocks_give_the_same_links(spark, monkeypatch):
    vectors = clouds(3, 200, 0.1)
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    assert run(spark, vectors) == sorted(brute(vectors)[0], key=repr)


def test_unusable_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
        (9, [-1.0, 0.0]), (10, [1e300, 0.0]), (11, [1e-300, 0.0]), (12, [1.0, 0.0, 0.0]), (13, [3.0, 0.0, 0.0]),
    ]
    got = {r[0]: r for r in run(spark, vectors)}
    assert all(got[i][1:] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9))
    assert got[7][1:] == (3, 7, True) and got[11][1:] == (3, 7, False) and got[13][1:] == (1, 12, False)


def test_empty_null_ids_repeated_rows_and_clashing_columns(spark):
    assert run(spark, []) == []
    data = [(1, [1.0, 0.1], 5, 5, 5), (1, [1.0, 0.1], 5, 5, 5), (2, [1.0, 0.1], 5, 5, 5), (None, [1.0, 0.1], 5, 5, 5)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, n_links int, component_id int, kept int")
    got = rows(embeddings.near_duplicate_vectors(df), "vec_id", "component_id", "kept")
    assert got == [(1, 1, True), (2, 1, False)]

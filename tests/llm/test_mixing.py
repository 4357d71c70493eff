import hashlib
import math
import random

import pytest

from tests.llm.helpers import rows
from viewpoint.llm import mixing

MANY = {f"s{i:03d}": 1 + (i * 37 % 11 if i % 5 == 0 else 0) for i in range(120)}
OUT = ("doc_id", "source", "block", "slot", "release", "deadline")


def edf(weights):
    """Slot order of one period, by simulation: the released block with the earliest deadline."""
    p, done, order = sum(weights.values()), dict.fromkeys(weights, 0), []
    for t in range(p):
        open_ = [(-(-(done[s] + 1) * p // a), s) for s, a in weights.items() if done[s] < a and done[s] * p // a <= t]
        s = min(open_)[1]
        done[s] += 1
        order.append(s)
    return order


def brute(docs, weights, block=100):
    p, order, out = sum(weights.values()), edf(weights), []
    slots = {s: [t for t, x in enumerate(order) if x == s] for s in weights}
    for s, a in weights.items():
        at = 0
        own = [(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest(), i, len((t or "").encode()), t, src) for i, src, t in docs if (src or "") == s]
        for _, i, n, _, src in sorted(own, key=lambda x: (x[0], x[2])):
            b = at // block
            out.append((i, src, b, b // a * p + slots[s][b % a], b * p // a, -(-(b + 1) * p // a)))
            at += n
    return sorted(out, key=repr)


def made(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice(["web"] * 8 + ["books", "code", None]), "x" * rng.randrange(0, 260)) for i in range(n)]


def run(spark, docs, **more):
    return rows(mixing.mix(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), block_bytes=100, **more), *OUT)


def test_given_weights_equal_brute_force(spark):
    docs = made(1, 400)
    weights = {"web": 7, "books": 3, "code": 2, "": 1}
    assert run(spark, docs, weights=weights) == brute(docs, weights)


def test_derived_weights_equal_brute_force(spark):
    docs = made(2, 300)
    size = {}
    for _, s, t in docs:
        size[s or ""] = size.get(s or "", 0) + len(t)
    root = {s: math.isqrt(n) for s, n in size.items()}
    weights = {s: max(1, r * 64 // max(1, sum(root.values()))) for s, r in root.items()}
    assert run(spark, docs, period=64) == brute(docs, weights)


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 3, "c": 3}, {"a": 100, "b": 1, "c": 17, "d": 40}, {s: 1 for s in "abcdefgh"}, {"a": 33, "b": 66}, {"m": 7, "z": 2, "c": 2} | {s: 1 for s in "abdexy"}, MANY])
def test_every_prefix_is_within_one_block_of_its_share(spark, weights):
    df = spark.createDataFrame(list(weights.items()), "src string, a bigint")
    got = mixing.schedule(df).collect()
    order = [r["src"] for r in sorted(got, key=lambda r: r["slot"])]
    assert order == edf(weights)
    p, count = sum(weights.values()), dict.fromkeys(weights, 0)
    for t, s in enumerate(order, 1):
        count[s] += 1
        assert all(abs(count[x] * p - a * t) < p for x, a in weights.items())
    for r in got:
        assert r["j"] * p // r["a"] <= r["slot"] < -(-(r["j"] + 1) * p // r["a"])


@pytest.mark.parametrize("seed", range(12))
def test_schedules_of_random_weights_equal_the_simulation(spark, seed):
    rng = random.Random(seed)
    names = rng.sample([a + b for a in "abcdef" for b in "uvwxyz"], rng.randrange(1, 30))
    weights = {s: rng.choice([1, 1, 1, 2, 3, rng.randrange(1, 40)]) for s in names}
    got = mixing.schedule(spark.createDataFrame(list(weights.items()), "src string, a bigint")).collect()
    assert [r["src"] for r in sorted(got, key=lambda r: r["slot"])] == edf(weights)


def test_nulls_empty_long_texts_repeated_rows_and_clashing_columns(spark):
    data = [(1, "a", None, 0), (2, "a", "", 0), (3, None, "x" * 100_000, 0), (3, None, "x" * 100_000, 0), (None, "a", "y" * 150, 0), (4, "", "z", 0)]
    df = spark.createDataFrame(data, "doc_id bigint, source string, text string, slot int")
    out = mixing.mix(df, weights={"a": 2}, block_bytes=100)
    assert out.columns == ["doc_id", "source", "text", "block", "slot", "release", "deadline", "slot_order"]
    assert rows(out, *OUT) == brute([d[:3] for d in data], {"a": 2, "": 1})


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [], weights={"a": 1}) == []


def test_more_sources_than_slots_raise(spark):
    docs = [(i, f"s{i}", "x") for i in range(40)]
    with pytest.raises(Exception, match="more sources"):
        run(spark, docs, period=8)


@pytest.mark.parametrize("named", [None, {"big0": 5, "big1": 3}])
def test_the_period_grows_with_the_sources(spark, named):
    docs = [(i, f"s{i}", "x") for i in range(2300)] + [(3000 + i, f"big{i % 2}", "y" * 40_000) for i in range(20)]
    size = {}
    for _, s, t in docs:
        size[s] = size.get(s, 0) + len(t)
    root = {s: math.isqrt(n) for s, n in size.items()}
    weights = {s: named.get(s, 1) if named else max(1, r * mixing.PERIOD // sum(root.values())) for s, r in root.items()}
    assert sum(weights.values()) > 2 * mixing.PERIOD and max(weights.values()) > 1
    assert run(spark, docs, weights=named) == brute(docs, weights)

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from viewpoint.functions import moments as M
from viewpoint.operators import bins as B
from viewpoint.operators import reports as RP


def _values(spark, values, parts=1):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_sums_are_exact_in_any_order(spark, parts):
    rng = random.Random(parts)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-1, 15) for _ in range(400)] + [0.1] * 50 + [1 / 3, None, 0.0, -0.0]
    values += [-v for v in values[:200] if v]
    rng.shuffle(values)
    exact = sum((Fraction(v) for v in values if v is not None), Fraction(0))
    got = _values(spark, values, parts).agg(M.exact_sum(F.col("x")).alias("s"), M.mean("x").alias("m")).first()
    assert got["s"] == pytest.approx(float(exact), rel=2e-16, abs=1e-15)
    assert got["m"] == pytest.approx(float(exact / sum(v is not None for v in values)), rel=4e-16, abs=1e-17)


def test_the_order_of_rows_changes_no_bit(spark):
    rng = random.Random(8)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 9) for _ in range(300)]
    seen = set()
    for parts in range(1, 9):
        rng.shuffle(values)
        seen.add(_values(spark, values, parts).agg(M.mean("x")).first()[0])
    assert len(seen) == 1


def test_values_without_parts_and_empty_columns(spark):
    one = lambda values: _values(spark, values).agg(M.exact_sum(F.col("x")), M.mean("x")).first()
    assert tuple(one([None, None])) == (None, None) and tuple(one([])) == (None, None)
    assert tuple(one([1e300, 1.0, None])) == (1e300, 5e299)
    assert tuple(one([float("inf"), 1.0])) == (math.inf, math.inf)
    assert all(math.isnan(v) for v in one([float("nan"), 1.0]))
    assert one([2.0**59, -(2.0**59), 0.25])[0] == 0.25 and one([2.0**59 - 64, 0.5])[0] == float(Fraction(2**59 - 64) + Fraction(1, 2))


def test_spread_of_large_values_close_together(spark):
    """Sums of squares would cancel here."""
    rows = [("m", 0, 1.0, 1e9 + i) for i in range(10)] + [("m", 0, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "model string, pos long, x double, y double")
    got = {r["b"]: r for r in B.binned_report(df, "x", 2, "b", ["y"]).collect()}
    assert got[0]["y"] == 1e9 + 4.5 and got[0]["y_std"] == pytest.approx(1.96 * 3.0276503540974917 / math.sqrt(10), abs=1e-9)


def test_states_of_many_values_merge_to_the_spread_of_the_rows(spark):
    rng = random.Random(2)
    rows = [("m", 0, float(rng.randrange(40)), 1e8 + rng.random()) for _ in range(500)]
    df = spark.createDataFrame(rows, "model string, pos long, x double, y double")
    seen = []
    for parts in (1, 5):
        got = B.binned_report(df.repartition(parts), "x", 1, "b", ["y"]).first()
        ys = [Fraction(r[3]) for r in rows]
        mean = sum(ys) / len(ys)
        var = sum((y - mean) ** 2 for y in ys) / (len(ys) - 1)
        assert got["y"] == float(mean) and got["y_std"] == pytest.approx(1.96 * math.sqrt(var / len(ys)), rel=1e-9)
        seen.append(got["y"])
    assert len(set(seen)) == 1


def test_reports_do_not_depend_on_the_partitioning(spark):
    rng = random.Random(3)
    cols = ["mpl_ext", "mpr_ext"]
    rows = [("m", rng.randrange(4), rng.choice(["left", "right"]), rng.random() / 3, rng.random() / 7) for _ in range(400)]
    seen = set()
    for parts in (1, 2, 5, 8):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "model string, pos long, side string, mpl_ext double, mpr_ext double").repartition(parts)
        seen.add(tuple(tuple(r) for r in RP.position_report(df, 4).select("model", "pos", *cols).orderBy("pos").collect()))
    assert len(seen) == 1

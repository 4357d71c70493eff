import random

import pytest

from tests import pyref
from viewpoint.operators import bins as B
from viewpoint.operators import reports as RP


def _values(spark, values, model="m"):
    return spark.createDataFrame([(model, i, v) for i, v in enumerate(values)], "model string, i long, x double")


@pytest.mark.parametrize("seed, signed", [(1, False), (2, True)])
def test_bins_and_edges_match_exact_fractions(spark, seed, signed):
    rnd = random.Random(seed)
    vals = [float(rnd.randint(-9 * signed, 40)) for _ in range(500)] + [rnd.random() * (-1) ** (signed * rnd.randint(0, 1)) for _ in range(200)]
    df = _values(spark, vals)
    got = {r["i"]: r["b"] for r in B.assign_bins(df, "x", 10, "b").collect()}
    assert [got[i] for i in range(len(vals))] == [pyref.bin_of(v, vals, 10) for v in vals]
    e = B.percentile_edges(df, "x", 10).first()["edges"]
    assert e == pytest.approx([float(x) for x in pyref.edges(vals, 10)], abs=1e-12)


def test_bins_by_hand(spark):
    # Quartile edges of seven values: 1, 2 (between 1 and 2 at rank 1.5: 1.0), 5, 9.
    vals = [1.0, 1.0, 1.0, 2.0, 5.0, 5.0, 9.0]
    df = _values(spark, vals)
    assert B.percentile_edges(df, "x", 4).first()["edges"] == [1.0, 2.0, 5.0, 9.0]
    rows = sorted((r["x"], r["b"]) for r in B.assign_bins(df, "x", 4, "b").collect())
    assert rows == [(1.0, 0)] * 3 + [(2.0, 1), (5.0, 2), (5.0, 2), (9.0, 3)]


def test_rows_and_models_without_a_value_stay(spark):
    df = _values(spark, [1.0, None, 3.0, float("nan"), 0.0, -0.0]).union(_values(spark, [None, None], "n")).union(_values(spark, [7.0], None))
    rows = B.assign_bins(df, "x", 2, "b").collect()
    assert len(rows) == 9
    assert {r["b"] for r in rows if r["model"] == "n"} == {None}
    assert [r["b"] for r in rows if r["model"] is None] == [0]
    assert sorted(((r["i"], r["b"]) for r in rows if r["model"] == "m"), key=repr) == [(0, 1), (1, None), (2, 1), (3, None), (4, 0), (5, 0)]
    assert {r["model"]: r["edges"] for r in B.percentile_edges(df, "x", 2).collect()} == {"m": [0.5, 3.0], "n": None, None: [7.0, 7.0]}


def test_binned_report_equals_statistics_of_the_rows(spark):
    import statistics

    rnd = random.Random(4)
    rows = [("m", rnd.randint(0, 6), rnd.choice([None, *map(float, range(20))]), rnd.choice([None, rnd.random(), rnd.random()])) for _ in range(400)]
    rows += [("n", 0, None, 0.5), ("n", 9, 3.0, 0.5)]
    df = spark.createDataFrame(rows, "model string, pos long, x double, y double")
    got = {(r["model"], r["b"]): (r["y"], r["y_std"]) for r in B.binned_report(df, "x", 5, "b", ["y"]).collect()}
    for model in "mn":
        vals = [r[2] for r in rows if r[0] == model and r[2] is not None]
        bins = {}
        for r in rows:
            if r[0] == model and r[1] < 4:
                bins.setdefault(None if r[2] is None else pyref.bin_of(r[2], vals, 5), []).append(r[3])
        for b, ys in bins.items():
            ys = [y for y in ys if y is not None]
            mean, std = got.pop((model, b))
            assert mean == pytest.approx(statistics.mean(ys))
            assert std is None if len(ys) < 2 else std == pytest.approx(1.96 * statistics.stdev(ys) / len(ys) ** 0.5)
    assert not got


def _facts(spark):
    rows = [
        ("m", 1, 0, "left", 0.5, 0.1), ("m", 2, 0, "left", 0.7, 0.2), ("m", 1, 1, "right", 0.3, 0.6),
        ("m", 2, 1, "right", 0.2, 0.4), ("m", 1, 4, "left", 0.9, 0.9), ("m", 1, 2, "neither", 0.1, 0.1),
    ]
    return spark.createDataFrame(rows, "model string, row_id long, pos long, side string, mpl_ext double, mpr_ext double")


def test_position_report_scaffold_and_counts(spark):
    rep = {r["pos"]: r for r in RP.position_report(_facts(spark)).collect()}
    assert sorted(rep) == list(range(10))
    assert rep[0]["mpl_count"] == 2 and rep[0]["mpl_ext"] == pytest.approx(0.6)
    assert rep[1]["mpr_count"] == 2 and rep[1]["mpr_ext"] == pytest.approx(0.5)
    assert rep[7]["mpl_count"] == 0 and rep[7]["mpl_ext"] is None and rep[7]["mpl_ext_std"] is None
    assert rep[4]["mpl_ext_std"] is None  # one row: sample std undefined


def test_side_report_uses_pos5_denominator(spark):
    r = RP.side_report(_facts(spark)).first()
    # left subset for the mean: pos < 4 -> 0.5, 0.7; n from pos < 5 -> 3 rows
    import statistics

    assert r["left_left"] == pytest.approx(0.6)
    assert r["left_left_std"] == pytest.approx(1.96 * statistics.stdev([0.5, 0.7]) / 3 ** 0.5)


def test_metric_summary_ci_counts_all_rows(spark):
    df = spark.createDataFrame([("m", "e", 0.2), ("m", "e", 0.4), ("m", "e", None)], "model string, exp string, s double")
    r = RP.metric_summary(df, ["s"]).first()
    import statistics

    assert r["s"] == pytest.approx(30.0)
    assert r["s_ci"] == pytest.approx(1.96 * statistics.stdev([0.2, 0.4]) / 3 ** 0.5 * 100)


def test_plot_points_and_display_names(spark):
    df = spark.createDataFrame([("b", 1, 0.2, 0.4, 0.1, 0.3), ("z", 0, 0.5, None, 0.1, 0.1)], "model string, length_bin long, mpl_ext double, mpr_ext double, mpl_ext_std double, mpr_ext_std double")
    p = RP.display_names(RP.plot_points(df, "length", RP.percentile_axis("length_bin")), {"a": "A", "b": "B"})
    got = {(r["model"], r["side"]): r for r in p.collect()}
    avg = got["b", "avg"]
    assert (avg["x"], avg["label"], avg["ord"]) == (20, "B", 1)
    assert (avg["ext"], avg["ext_std"], avg["lo"], avg["hi"]) == pytest.approx((0.3, 0.2, 0.1, 0.5))
    assert got["b", "right"]["hi"] == pytest.approx(0.7) and got["z", "avg"]["ext"] is None and got["z", "left"]["label"] is None

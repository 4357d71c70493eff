"""Decisions recorded in SURVEY §1.4, each pinned by a test."""

import pytest

from viewpoint.operators import experiments as X
from viewpoint.operators import external as E
from viewpoint.operators import passages as P


def test_unknown_metric_is_rejected():
    assert X.resolve_metrics(["rouge", "bleurt"]) == ["rouge1", "rouge2", "rougeL", "bleurt"]
    assert X.resolve_metrics(["rouge2", "rouge", "intens", "target"]) == ["rouge2", "rouge1", "rougeL", "intens", "target"]
    with pytest.raises(ValueError):
        X.resolve_metrics(["rouge", "menli"])


def test_missing_text_modes(spark):
    rows = spark.createDataFrame([("m", 1, "e", None, "the ref"), ("m", 2, "e", "the ref", "the ref")], "model string, row_id long, exp string, pred string, ref string")
    null = {r["row_id"]: r["rouge1"] for r in X.score_rouge(rows).collect()}
    sent = {r["row_id"]: r["rouge1"] for r in X.score_rouge(rows, missing="sentinel").collect()}
    nan = {r["row_id"]: r["rouge1"] for r in X.score_rouge(rows, missing="nan_text").collect()}
    assert null == {1: None, 2: 1.0}
    assert sent == {1: -1.0, 2: 1.0}
    assert nan == {1: 0.0, 2: 1.0}  # 'nan' shares no token with the reference


def test_first_sentence_flag(spark):
    rows = spark.createDataFrame([("m", 1, "e", "The left wins. Extra words here", "the left wins")], "model string, row_id long, exp string, pred string, ref string")
    first = X.score_rouge(rows).first()["rouge1"]
    full = X.score_rouge(rows, first_sentence=False).first()["rouge1"]
    assert first == 1.0 and full < 1.0


def test_invalid_unique_mode(spark):
    df = spark.createDataFrame([(1, "a")], "row_id long, alt_op string")
    with pytest.raises(ValueError):
        P.extraction_facts(df, df, unique_mode="intersection")


def test_greedy_match_one_sided_pair_is_null(spark):
    df = spark.createDataFrame([(7, 0, [1.0, 0.0])], "pair_id long, side int, vec array<double>")
    r = E.greedy_match(df).first()
    assert r["precision"] is None and r["f1"] is None


def test_experiment_selection_and_zip_shortest(spark):
    df = spark.createDataFrame([("m", 1, "a", "b", "c", "d", "L", "R", "l", "r")],
                               "model string, row_id long, sp_left_pred string, sp_right_pred string, mp_left_pred string, mp_right_pred string, left_sum string, right_sum string, left_op string, right_op string")
    assert [r["exp"] for r in X.unpivot(df, exps=["mp_left_pred"]).collect()] == ["mp_left_pred"]
    short = X.unpivot(df, pred_cols=["sp_left_pred", "sp_right_pred"], ref_cols=["left_sum"], src_cols=["left_op", "right_op"])
    assert [r["exp"] for r in short.collect()] == ["sp_left_pred"]

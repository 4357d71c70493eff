import tempfile

from viewpoint.plans import catalogue as C
from viewpoint.plans import evaluation as EV
from viewpoint.schemas import PRED_COLS
from viewpoint.sources import fixtures as FX
from viewpoint.sources import io


def test_runs_write_and_match_queries(spark, small_dir):
    out = tempfile.mkdtemp(prefix="viewpoint-eval-")
    topics = FX.topics(spark, small_dir)
    preds = FX.predictions(spark, small_dir).select("model", "row_id", *PRED_COLS)
    summary = EV.base_evaluation(topics, preds, out)
    assert summary.count() == 12
    got = {(r["model"], r["exp"]): round(r["rouge1"], 6) for r in summary.collect()}
    ref = {(r["model"], r["exp"]): r["rouge1"] for r in C.base_summary(spark, small_dir).collect()}
    assert got == ref
    lookup = C.lookup(spark, small_dir)
    stance = FX.stance_scores(C._stance(spark, small_dir))
    st = EV.perspective_evaluation(topics, preds, lookup, stance, summary, out, C._targets(spark, small_dir), metrics=("stance", "intens", "target"))
    want = {(r["model"], r["exp"]): (r["stance"], r["stance_ci"]) for r in C.stance_summary(spark, small_dir).collect()}
    got = {(r["model"], r["exp"]): (round(r["stance"], 6), round(r["stance_ci"], 6)) for r in st.collect()}
    assert got == {k: v for k, v in want.items() if k in got} and got
    assert {"intens", "intens_ci", "target", "target_ci"} <= set(st.columns)
    # A reverse run and a run of one model leave the plain rows of the others alone.
    EV.base_evaluation(topics, preds.where("model = 'm1'"), out, metrics=("rouge1",), reverse=True)
    again = EV.base_evaluation(topics, preds.where("model = 'm0'"), out)
    assert {r["model"] for r in again.select("model").collect()} == {"m0"}
    assert {r["model"] for r in io.read_row_metrics(spark, out + "/row_metrics").select("model").distinct().collect()} == {"m0", "m1", "m2"}
    reverse = io.read_row_metrics(spark, out + "/row_metrics", reverse=True)
    assert {r["model"] for r in reverse.select("model").distinct().collect()} == {"m1"}
    assert io.read_summary(spark, out + "/summary", ["rouge1"], reverse=True).count() == 4

    rep = EV.extraction_analysis(topics, preds, lookup, out)
    pos = {(r["model"], r["pos"]): r["mpl_count"] for r in rep["position"].collect()}
    pos_q = {(r["model"], r["pos"]): r["mpl_count"] for r in C.position_report(spark, small_dir).collect()}
    assert pos == pos_q
    assert rep["length"].count() == C.length_bins(spark, small_dir).count()

import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from viewpoint.sources import io
from viewpoint.streaming import responses as S


def _tmp():
    return tempfile.mkdtemp(prefix="viewpoint-test-")


def test_topics_csv_roundtrip_with_newlines_and_quotes(spark):
    d = _tmp()
    rows = pd.DataFrame(
        {
            "title": ["t1", 'say "hi"'],
            "alt_op": ["p1\np2\np3", 'quote "x", comma\nnext'],
            "left_op": ["p1\np3", ""],
            "right_op": ["p2", "next"],
            "left_sum": ["a.", "b."],
            "right_sum": ["c.", "d."],
        }
    )
    rows.to_csv(os.path.join(d, "topics.csv"), index=False)
    got = io.read_topics_csv(spark, os.path.join(d, "topics.csv")).orderBy("row_id").collect()
    assert [r["alt_op"] for r in got] == list(rows["alt_op"])
    assert got[1]["title"] == 'say "hi"'
    assert got[1]["left_op"] is None  # an empty string comes back NULL from CSV


def test_row_ids_follow_file_names_not_file_sizes(spark):
    d = _tmp()
    pd.DataFrame({"title": ["t0", "t1"], "alt_op": ["x", "y"]}).to_csv(os.path.join(d, "part1.csv"), index=False)
    pd.DataFrame({"alt_op": ["z" * 100_000] * 3, "title": ["t2", "t3", "t4"]}).to_csv(os.path.join(d, "part2.csv"), index=False)
    got = {r["row_id"]: r["title"] for r in io.read_topics_csv(spark, d).collect()}
    assert got == {i: f"t{i}" for i in range(5)}
    pd.DataFrame({"row_id": [70], "title": ["key"]}).to_csv(os.path.join(d, "part1.csv"), index=False)
    assert {r["row_id"]: r["title"] for r in io.read_topics_csv(spark, d).collect()}[70] == "key"


def test_model_files_of_different_column_orders_in_one_scan(spark):
    d = _tmp()
    for m, cols in (("m a", ["title", "mp_left_pred"]), ("m+b", ["mp_left_pred", "extra", "title"])):
        os.makedirs(os.path.join(d, m))
        rows = pd.DataFrame({c: [f"{m} {c} {i}" for i in range(3)] for c in cols})
        rows.to_csv(os.path.join(d, m, "preds.csv"), index=False)
        rows.assign(mp_left_pred_rouge1=[0.5, None, 0.25]).to_csv(os.path.join(d, m, "preds_rev_bmetrics.csv"), index=False)
    df = io.read_model_files(spark, d)
    got = sorted((r["model"], r["row_id"], r["title"], r["mp_left_pred"], r["alt_op"]) for r in df.collect())
    assert got == [(m, i, f"{m} title {i}", f"{m} mp_left_pred {i}", None) for m in ("m a", "m+b") for i in range(3)]
    plan = io.read_model_files(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "FileScan csv" not in plan  # the records were cut once, when the files were opened
    metrics = io.read_row_metrics_csv(spark, d, ["m a"], reverse=True).orderBy("row_id").collect()
    assert [(r["model"], r["mp_left_pred_rouge1"], r["mp_left_pred_bert"]) for r in metrics] == [("m a", 0.5, None), ("m a", None, None), ("m a", 0.25, None)]


def test_model_files_scan_and_key(spark):
    d = _tmp()
    for m in ("bart-large", "gpt4-o"):
        os.makedirs(os.path.join(d, m))
        pd.DataFrame({"title": ["t"], "alt_op": ["a"], "mp_left_pred": [f"{m} says"]}).to_csv(os.path.join(d, m, "preds.csv"), index=False)
    df = io.read_model_files(spark, d, ["bart-large", "gpt4-o/"])
    got = sorted((r["model"], r["mp_left_pred"]) for r in df.collect())
    assert got == [("bart-large", "bart-large says"), ("gpt4-o", "gpt4-o says")]
    keys = spark.createDataFrame([("org/model-x//",), ("plain",)], "p string").select(io.model_key(F.col("p"))).collect()
    assert [k[0] for k in keys] == ["model-x", "plain"]


def test_lexicon_tsv_rejects_and_last_wins(spark):
    d = _tmp()
    p = os.path.join(d, "lex.txt")
    with open(p, "w") as f:
        f.write("war\t0.2\t0.8\t0.5\npeace\t0.9\t0.3\t0.5\nbad line\t0.1\nwar\t0.1\t0.9\t0.4\n\n")
    lex, rejected = io.read_lexicon_tsv(spark, p)
    got = {r["term"]: (r["v"], r["a"], r["d"]) for r in lex.collect()}
    assert got == {"war": (100, 900, 400), "peace": (900, 300, 500)}
    assert rejected.count() == 2  # the 2-field line and the blank last line


def test_lexicon_of_several_files_keeps_the_last_line_of_the_last_file(spark):
    d = _tmp()
    for name, text in (("a.txt", "war\t0.1\t0.1\t0.1\n" * 3 + "x\t0.5\t0.5\t0.5\n" * 5000), ("b.txt", "war\t0.2\t0.9\t0.4\nwar\t0.9\t0.8\t0.7\n")):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    lex, rejected = io.read_lexicon_tsv(spark, d)
    assert {r["term"]: r["v"] for r in lex.collect()} == {"war": 900, "x": 500} and rejected.count() == 0


def test_experiment_sink_replaces_only_its_partition(spark):
    d = _tmp()
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    a = spark.createDataFrame([("m0", 1, "mp_left_pred", "x"), ("m0", 1, "sp_left_pred", "y")], "model string, row_id long, exp string, pred string")
    io.write_experiment(a, d)
    b = spark.createDataFrame([("m0", 1, "mp_left_pred", "z")], "model string, row_id long, exp string, pred string")
    io.write_experiment(b, d)
    got = sorted((r["exp"], r["pred"]) for r in spark.read.parquet(d).collect())
    assert got == [("mp_left_pred", "z"), ("sp_left_pred", "y")]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before  # the sink leaves the session as it was


def test_runs_of_a_model_lie_side_by_side(spark):
    d = _tmp()
    row = lambda m, x: spark.createDataFrame([(m, 1, "e", x)], "model string, row_id long, exp string, rouge1 double")
    for m, x, flags in (("m0", 0.1, {}), ("m1", 0.2, {}), ("m0", 0.3, {"reverse": True}), ("m0", 0.4, {"reverse": True, "full": True}), ("m1", 0.5, {})):
        io.write_row_metrics(row(m, x), d, **flags)
    got = lambda **f: sorted((r["model"], r["rouge1"]) for r in io.read_row_metrics(spark, d, **f).collect())
    assert got() == [("m0", 0.1), ("m1", 0.5)] and got(reverse=True) == [("m0", 0.3)] and got(reverse=True, full=True) == [("m0", 0.4)] and got(full=True) == []


def test_stream_ingest_keeps_the_last_response(spark):
    src, out = _tmp(), _tmp()
    good = '{"choices":[{"message":{"content":"%s"}}]}'
    rows = [("m0", 1, "e", good % "late", 9), ("m0", 1, "e", good % "early", 3), ("m0", 2, "e", "oops", 1), ("m0", 3, "e", (good % "x") + " tail", 1)]
    spark.createDataFrame(rows, S.RESPONSE_SCHEMA).write.mode("append").parquet(src)
    name = os.path.basename(out)
    S.start_ingest(spark, src, out, name=name).awaitTermination(120)
    got = lambda: sorted((r["row_id"], r["pred"], r["is_error"]) for r in S.latest(spark, out).collect())
    assert got() == [(1, "late", False), (2, "Error", True), (3, "Error", True)]
    # A restarted stream takes only new files; a response that comes late but was received early does not win.
    more = [("m0", 1, "e", good % "old", 5), ("m0", 2, "e", good % "second", 2)]
    spark.createDataFrame(more, S.RESPONSE_SCHEMA).write.mode("append").parquet(src)
    S.start_ingest(spark, src, out, name=name).awaitTermination(120)
    assert got() == [(1, "late", False), (2, "second", False), (3, "Error", True)]


def test_row_metrics_summary_and_raw_response_sinks(spark):
    d = _tmp()
    rows = spark.createDataFrame([("m0", 1, "mp_left_pred", 0.5), ("m1", 1, "mp_left_pred", 0.25)], "model string, row_id long, exp string, rouge1 double")
    io.write_row_metrics(rows, os.path.join(d, "rm"), full=True)
    back = spark.read.parquet(os.path.join(d, "rm"))
    assert sorted(r["model"] for r in back.collect()) == ["m0", "m1"] and back.first()["full_pred"] is True
    summ = spark.createDataFrame([("m0", "mp_left_pred", 50.0, 1.5)], "model string, exp string, rouge1 double, rouge1_ci double")
    io.write_summary(summ, os.path.join(d, "summary"))
    got = io.read_summary(spark, os.path.join(d, "summary"), ["rouge1"]).first()
    assert (got["model"], got["rouge1"], got["rouge1_ci"]) == ("m0", 50.0, 1.5)
    raw = spark.createDataFrame([('{"choices":[{"message":{"content":"x"}}]}',), ("oops",)], "raw string")
    out = [(r["pred"], r["raw_response"]) for r in io.with_raw_response(raw).collect()]
    assert out == [("x", '{"choices":[{"message":{"content":"x"}}]}'), ("Error", "oops")]

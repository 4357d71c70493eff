"""Catalogue queries against the DuckDB oracle on the smallest tables, plus
properties of the extraction facts."""

import duckdb
import pytest
from pyspark.sql import functions as F

from viewpoint.plans import catalogue, oracle

@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small_dir}/{t}.parquet')")
    return con


def _norm(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_matches_oracle(spark, duck, small_dir, name):
    df = catalogue.queries()[name](spark, small_dir)
    cur = duck.execute(oracle.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    s = _norm(df.select(*cols).collect())
    d = _norm(cur.fetchall())
    assert s == d


def test_unique_coverage_as_coded_zero_after_first(spark, small_dir):
    f = catalogue.facts(spark, small_dir)
    bad = f.filter((F.col("pos") >= 1) & ((F.col("mpl_ext_unq") != 0) | (F.col("spr_ext_unq") != 0))).count()
    assert bad == 0


def test_coverage_in_unit_interval(spark, small_dir):
    f = catalogue.facts(spark, small_dir, unique_mode="shared")
    cols = [c for c in f.columns if c.endswith("_ext") or c.endswith("_unq")]
    cond = None
    for c in cols:
        e = (F.col(c) < 0) | (F.col(c) > 1)
        cond = e if cond is None else cond | e
    assert f.filter(cond).count() == 0


def test_every_query_registered_with_oracle():
    q, o = catalogue.queries(), oracle.oracle_sql()
    assert set(q) == set(o)


ROW_LOCAL = ["first_sentence", "first_sentence_tables", "experiment_scores", "prompt_table", "response_parse", "output_cleanup", "pad_segments", "scorer_hook", "passage_explode", "passage_side"]


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.mark.parametrize("name", ROW_LOCAL)
def test_row_local_queries_shuffle_nothing(spark, small_dir, name):
    assert _exchanges(catalogue.queries()[name](spark, small_dir)) == 0


def test_coverage_shuffles_each_side_of_its_join_once(spark, small_dir):
    from viewpoint.operators import passages as P
    from viewpoint.sources import fixtures as FX

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        f = P.extraction_facts(FX.topics(spark, small_dir), P.summary_sets(FX.predictions(spark, small_dir)))
        assert "lead_side" in f.columns and _exchanges(f) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_token_sums_of_passages_and_topics_share_one_exchange(spark, small_dir):
    from viewpoint.operators import passages as P
    from viewpoint.sources import fixtures as FX

    a = P.topic_arousal(FX.topics(spark, small_dir), catalogue.lookup(spark, small_dir))
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and plan.count("Exchange hashpartitioning(") == 1
    f = P.extraction_facts(FX.topics(spark, small_dir), P.summary_sets(FX.predictions(spark, small_dir)), catalogue.lookup(spark, small_dir))
    assert f._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") <= 3


def test_arousal_of_the_facts_equals_that_by_passage(spark, small_dir):
    from viewpoint.operators import passages as P
    from viewpoint.sources import fixtures as FX

    topics, lookup = FX.topics(spark, small_dir), catalogue.lookup(spark, small_dir)
    cols = ["row_id", "pos", "num_arous", "perc_arous", "arous_score"]
    f = P.extraction_facts(topics, P.summary_sets(FX.predictions(spark, small_dir)), lookup).select(*cols).distinct()
    want = P.arousal_by_passage(P.explode_passages(topics), lookup).select(*cols)
    assert sorted(map(tuple, f.collect())) == sorted(map(tuple, want.collect()))


def test_the_score_fixture_has_every_fault(spark, small_dir):
    assert all(r["n"] > 0 for r in catalogue.score_checks(spark, small_dir).collect())


def _own_documents(spark, tmp_path):
    rows = [(1, "One two three. Four\nfive six!\n\nseven"), (1, "Again the same id."), (2, None), (3, ""), (None, "No id\nhere at all")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_the_reference_is_read_with_the_predictions(spark, tmp_path, small_dir):
    from viewpoint.sources import fixtures as FX

    d = _own_documents(spark, tmp_path)
    got = FX.predictions_and_reference(spark, d)
    ref = FX.topics(spark, d).selectExpr(
        "'ref' as model", "*", "left_sum as sp_left_pred", "right_sum as sp_right_pred", "left_sum as mp_left_pred", "right_sum as mp_right_pred"
    )
    want = FX.predictions(spark, d).unionByName(ref)
    assert got.columns == want.columns and got.count() == 20
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    plan = catalogue.facts(spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2  # topics once, summaries of all models once


def test_scores_take_the_keys_of_predictions_without_their_texts(spark, tmp_path):
    from viewpoint.sources import fixtures as FX

    d = _own_documents(spark, tmp_path)
    got, want = FX.prediction_keys(spark, d), catalogue.long_predictions(spark, d).select("model", "row_id", "exp")
    assert got.count() == 60 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert "text" not in got._jdf.queryExecution().executedPlan().toString()

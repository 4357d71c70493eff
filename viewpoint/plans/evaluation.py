"""End-to-end evaluation runs: the three programs of the reference as Spark
plans with sinks.

* :func:`base_evaluation` - experiments x metrics per prediction, then the
  per (model, exp) mean/CI summary (row metrics and summary written).
* :func:`perspective_evaluation` - stance, intensity gap (source intensity once
  per topic) and key-phrase score per prediction, written; their mean/CI attached
  to the base summary.
* :func:`extraction_analysis` - the extraction fact table written once to the
  output folder, and every report computed from that written table.

Inputs are DataFrames: topics (row_id, title, alt_op, left_op, right_op,
left_sum, right_sum) and predictions (model, row_id, four prediction
columns); model outputs (scores, stance, key-phrase scores) are tables as well.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewpoint.operators import bins as B
from viewpoint.operators import experiments as X
from viewpoint.operators import external as E
from viewpoint.operators import lexicon as LX
from viewpoint.operators import passages as P
from viewpoint.operators import reports as RP
from viewpoint.schemas import PERSPECTIVE_METRICS, ROUGE_METRICS
from viewpoint.sources import io


def _with_topics(preds: DataFrame, topics: DataFrame) -> DataFrame:
    need = [c for c in ("left_sum", "right_sum", "left_op", "right_op") if c not in preds.columns]
    return preds if not need else preds.join(topics.select("row_id", *need), "row_id")


def base_evaluation(
    topics: DataFrame,
    preds: DataFrame,
    out_dir: str,
    scores: DataFrame | None = None,
    metrics: tuple[str, ...] = ("rouge",),
    first_sentence: bool = True,
    reverse: bool = False,
    z: float = RP.Z_DEFAULT,
) -> DataFrame:
    """Row metrics (written by model and run) and the summary table of the run.
    ``reverse`` says that the predictions were made from reversed passages; plain
    and reverse runs, of first sentences or full predictions, lie side by side."""
    names = X.resolve_metrics(list(metrics))
    rows = X.unpivot(_with_topics(preds, topics))
    rouge = [m for m in names if m in ROUGE_METRICS]
    if rouge:
        rows = X.score_rouge(rows, first_sentence=first_sentence, metrics=rouge)
    rows = rows.select(*E.KEYS, *rouge)
    external = [m for m in names if m not in ROUGE_METRICS]
    if external:
        if scores is None:
            raise ValueError(f"metrics {external} need a score table")
        rows = E.attach_scores(rows, scores, external)
    path, full = os.path.join(out_dir, "row_metrics"), not first_sentence
    io.write_row_metrics(rows, path, reverse=reverse, full=full)
    models = preds.select("model").distinct()
    written = io.read_row_metrics(rows.sparkSession, path, reverse=reverse, full=full).join(models, "model", "left_semi")
    summary = RP.metric_summary(written, names, z=z)
    path = os.path.join(out_dir, "summary")
    io.write_summary(summary, path, reverse=reverse, full=full)
    return io.read_summary(rows.sparkSession, path, names, reverse=reverse, full=full)


def perspective_rows(
    topics: DataFrame, preds: DataFrame, lookup: DataFrame, stance: DataFrame | None = None, target: DataFrame | None = None, first_sentence: bool = True
) -> DataFrame:
    """(model, row_id, exp, pred_int, src_int, intens, stance, target) of every
    prediction. The intensity is compared with that of ``alt_op``; ``stance`` and
    ``target`` are tables (model, row_id, exp, score), NULL where they have no row."""
    sources = topics.select("row_id", F.col("alt_op").alias("text"))
    rows = LX.intensity_gap(X.unpivot(_with_topics(preds, topics)), sources, lookup, first_sentence)
    for name, table in (("stance", stance), ("target", target)):
        if table is None:
            rows = rows.withColumn(name, F.lit(None).cast("double"))
        else:
            rows = rows.join(table.select(*E.KEYS, name), E.KEYS, "left")
    return rows


def perspective_evaluation(
    topics: DataFrame,
    preds: DataFrame,
    lookup: DataFrame,
    stance_scores: DataFrame,
    base_summary: DataFrame,
    out_dir: str,
    target_scores: DataFrame | None = None,
    metrics: tuple[str, ...] = ("stance",),
    z: float = RP.Z_DEFAULT,
) -> DataFrame:
    """Perspective rows (written by model) and the base summary with the mean and
    CI of ``metrics``, any of stance, intens and target, over all predictions."""
    names = X.resolve_metrics(list(metrics))
    if unknown := [m for m in names if m not in PERSPECTIVE_METRICS]:
        raise ValueError(f"not computed here: {unknown}")
    path = os.path.join(out_dir, "perspective_rows")
    io.write_row_metrics(perspective_rows(topics, preds, lookup, stance_scores, target_scores), path)
    rows = io.read_row_metrics(topics.sparkSession, path)
    out = base_summary.join(RP.metric_summary(rows, names, z=z), ["model", "exp"], "left")
    path = os.path.join(out_dir, "summary_stance")
    io.write_summary(out, path)
    return io.read_summary(topics.sparkSession, path, [c for c in out.columns[2:] if not c.endswith("_ci")])


def extraction_analysis(
    topics: DataFrame,
    preds: DataFrame,
    lookup: DataFrame,
    out_dir: str,
    with_reference: bool = True,
    unique_mode: str = "as_coded",
) -> dict[str, DataFrame]:
    """Write the extraction facts once, then every report from the written
    table: position, side, arousal (20 bins), density (10), length (10)."""
    summ = P.summary_sets(preds)
    if with_reference:
        summ = summ.unionByName(P.summary_sets(topics.withColumn("model", F.lit("ref")), reference=True))
    facts_path = os.path.join(out_dir, "facts")
    P.extraction_facts(topics, summ, lookup, unique_mode).write.mode("overwrite").partitionBy("model").parquet(facts_path)
    facts = topics.sparkSession.read.parquet(facts_path)
    reports = {
        "position": RP.position_report(facts),
        "side": RP.side_report(facts),
        "arousal": B.binned_report(facts, "arous_score", 20, "arous_bin", RP.FACT_NUMERIC, with_ci=False),
        "density": B.binned_report(facts, "perc_arous", 10, "parous_bin", RP.FACT_NUMERIC),
        "length": B.binned_report(facts, "length", 10, "length_bin", RP.FACT_NUMERIC),
    }
    for name, df in reports.items():
        df.write.mode("overwrite").parquet(os.path.join(out_dir, name))
    return {k: topics.sparkSession.read.parquet(os.path.join(out_dir, k)) for k in reports}

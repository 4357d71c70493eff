"""Explicit schemas of the evaluation tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

# Columns of the topic and prediction tables, and the metrics of a row.
TOPIC_COLS = ["title", "alt_op", "left_op", "right_op", "left_sum", "right_sum"]
PRED_COLS = ["sp_left_pred", "sp_right_pred", "mp_left_pred", "mp_right_pred"]
REF_COLS = ["left_sum", "right_sum", "left_sum", "right_sum"]
SRC_COLS = ["left_op", "right_op", "left_op", "right_op"]
ROUGE_METRICS = ["rouge1", "rouge2", "rougeL"]
EXTERNAL_METRICS = ["bleurt", "summac", "align", "bert"]
PERSPECTIVE_METRICS = ["stance", "intens", "target"]


def _of(columns: list[str], kind) -> list[StructField]:
    return [StructField(c, kind) for c in columns]


TOPICS = StructType(_of(TOPIC_COLS, StringType()))
PREDICTIONS = StructType(_of(TOPIC_COLS + PRED_COLS + [p + "_full" for p in PRED_COLS], StringType()))
ROW_METRICS = StructType(
    _of(TOPIC_COLS + PRED_COLS, StringType()) + _of([f"{p}_{m}" for p in PRED_COLS for m in ROUGE_METRICS + EXTERNAL_METRICS], DoubleType())
)
PERSPECTIVE_ROWS = StructType(
    [
        *ROW_METRICS.fields,
        *_of([f"{s}_kp" for s in dict.fromkeys(SRC_COLS)] + [f"{p}_kp" for p in PRED_COLS], StringType()),
        *_of([f"{p}_{m}" for p in PRED_COLS for m in PERSPECTIVE_METRICS], DoubleType()),
    ]
)
RESPONSES = StructType(
    [*_of(["model"], StringType()), *_of(["row_id"], LongType()), *_of(["exp", "raw"], StringType()), *_of(["received"], LongType())]
)


def summary(metrics: list[str]) -> StructType:
    """Mean and confidence interval of each metric per model and experiment."""
    return StructType(_of(["model", "exp"], StringType()) + _of([c for m in metrics for c in (m, m + "_ci")], DoubleType()))

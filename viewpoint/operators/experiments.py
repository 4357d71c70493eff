"""Experiments in long format and per-prediction scoring.

The reference zips three column lists (prediction, reference, source) and
loops over them; here one ``explode`` of an array of structs turns a wide
prediction row into one row per experiment in a single scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewpoint.functions import rouge as RG
from viewpoint.functions import text as T
from viewpoint.schemas import EXTERNAL_METRICS, PERSPECTIVE_METRICS, PRED_COLS, REF_COLS, ROUGE_METRICS, SRC_COLS

#: Names a caller may ask for, and the score columns that each stands for.
METRICS = {"rouge": ROUGE_METRICS} | {m: [m] for m in ROUGE_METRICS + EXTERNAL_METRICS + PERSPECTIVE_METRICS}


def unpivot(
    preds: DataFrame,
    pred_cols: list[str] = PRED_COLS,
    ref_cols: list[str] = REF_COLS,
    src_cols: list[str] = SRC_COLS,
    keys: tuple[str, ...] = ("model", "row_id"),
    exps: list[str] | None = None,
) -> DataFrame:
    """(keys..., exp, pred, ref, src); lists are paired by position and the
    shortest one wins, as ``zip`` does. ``exps`` keeps only those experiments."""
    triples = list(zip(pred_cols, ref_cols, src_cols))
    if exps is not None:
        triples = [t for t in triples if t[0] in exps]
    arr = F.array(
        *[F.struct(F.lit(p).alias("exp"), F.col(p).alias("pred"), F.col(r).alias("ref"), F.col(s).alias("src")) for p, r, s in triples]
    )
    return preds.select(*keys, F.explode(arr).alias("e")).select(*keys, "e.exp", "e.pred", "e.ref", "e.src")


def resolve_metrics(metrics: list[str]) -> list[str]:
    """The score columns of the named metrics; unknown names raise (the
    reference silently lists a metric it never implements)."""
    for m in metrics:
        if m not in METRICS:
            raise ValueError(f"unknown metric {m!r}")
    return list(dict.fromkeys(c for m in metrics for c in METRICS[m]))


def as_text(c: Column) -> Column:
    """Missing text as the word that pandas' ``astype(str)`` makes of it."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def score_rouge(long: DataFrame, first_sentence: bool = True, missing: str = "null", metrics: list[str] = ("rouge",)) -> DataFrame:
    """Add the ROUGE columns named in ``metrics``, of (first sentence of)
    ``pred`` against ``ref``.

    ``missing``: 'null' - a NULL text gives NULL scores; 'sentinel' - -1 as
    the reference's unreachable branch; 'nan_text' - NULL is scored as the
    text 'nan' (what the reference's ``astype(str)`` actually does).
    """
    names = [m for m in resolve_metrics(list(metrics)) if m in ROUGE_METRICS]
    pred, ref = F.col("pred"), F.col("ref")
    if missing == "nan_text":
        pred, ref = as_text(pred), as_text(ref)
    p = T.first_sentence(pred) if first_sentence else pred
    base = long.select("*", T.rouge_tokens(p).alias("_pt"), T.rouge_tokens(ref).alias("_rt"), (pred.isNotNull() & ref.isNotNull()).alias("_ok"))
    scored = RG.add_rouge(base, "_pt", "_rt", metrics=tuple(names))
    fallback = F.lit(-1.0) if missing == "sentinel" else F.lit(None).cast("double")
    return scored.select(*long.columns, *[F.when(F.col("_ok"), F.col(n)).otherwise(fallback).alias(n) for n in names])

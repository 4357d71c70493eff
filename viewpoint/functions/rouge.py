"""ROUGE-1/2/L F-measures (rouge-score semantics, no stemming).

N-gram overlap is clipped (min of the two counts per n-gram). It is computed
row-locally with built-ins: the grams of both sides are sorted together, the
prediction's before equal ones of the reference, and one fold over the sorted
array counts the reference grams that still find a partner. That is a sort and
a pass, whatever the texts; no explode, no shuffle. The LCS length is the one
dynamic programme Spark cannot express without quadratic array copies; it runs
as an Arrow-batched pandas UDF with a bit-parallel LCS (O(n * m / 64) per pair).

:func:`add_rouge` stages intermediates in separate projections: every array
referenced twice is a materialised column, so no expression is re-evaluated.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def bigrams(toks: Column) -> Column:
    n = F.size(toks)
    shifted = F.slice(toks, 2, F.greatest(n - 1, F.lit(0)))
    grams = F.zip_with(F.slice(toks, 1, F.greatest(n - 1, F.lit(0))), shifted, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n >= 2, grams).otherwise(F.array().cast("array<string>"))


def tagged(pred: Column, ref: Column) -> Column:
    """The grams of both sides, sorted, each with its side (0 before 1)."""
    side = lambda c, s: F.transform(c, lambda g: F.struct(g.alias("g"), F.lit(s).alias("s")))
    return F.sort_array(F.concat(side(pred, 0), side(ref, 1)))


def clipped_hits(grams: Column) -> Column:
    """Sum over distinct grams of the smaller count, from a :func:`tagged` array."""
    start = F.struct(F.lit("").alias("g"), F.lit(0).alias("left"), F.lit(0).alias("hits"))

    def step(acc: Column, x: Column) -> Column:
        left = F.when(x["g"] == acc["g"], acc["left"]).otherwise(F.lit(0))
        hit = ((x["s"] == 1) & (left > 0)).cast("int")
        return F.struct(x["g"].alias("g"), F.when(x["s"] == 0, left + 1).otherwise(left - hit).alias("left"), (acc["hits"] + hit).alias("hits"))

    return F.aggregate(grams, start, step, lambda acc: acc["hits"])


def f_measure(hits: Column, n_pred: Column, n_ref: Column) -> Column:
    """P = hits / max(n_pred, 1), R = hits / max(n_ref, 1), F = 2PR / (P + R),
    0 when P + R = 0. Inputs should be materialised columns."""
    p = hits / F.greatest(n_pred, F.lit(1))
    r = hits / F.greatest(n_ref, F.lit(1))
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def lcs_f_measure(lcs: Column, n_pred: Column, n_ref: Column) -> Column:
    """ROUGE-L F from an LCS length; 0 when either side has no token."""
    return F.when((n_pred == 0) | (n_ref == 0), F.lit(0.0)).otherwise(f_measure(lcs, n_pred, n_ref))


def _lcs_length(a, b) -> int:
    """Word-level LCS length, bit-parallel over the tokens of ``b``."""
    m = len(b)
    if m == 0 or len(a) == 0:
        return 0
    masks: dict[str, int] = {}
    for i, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    full = (1 << m) - 1
    v = full
    for tok in a:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_lcs_length(x, y) for x, y in zip(a, b)], dtype="int32")


def add_rouge(df: DataFrame, pred_toks: str, ref_toks: str, metrics=("rouge1", "rouge2", "rougeL")) -> DataFrame:
    """Add ROUGE F-measure columns for token-array columns ``pred_toks`` and
    ``ref_toks`` (prediction, reference)."""
    keep = df.columns
    pt, rt = F.col(pred_toks), F.col(ref_toks)
    grams = {}
    if "rouge1" in metrics:
        grams["1"] = (pt, rt)
    stage = df
    if "rouge2" in metrics:
        stage = stage.select("*", bigrams(pt).alias("_p2"), bigrams(rt).alias("_r2"))
        grams["2"] = (F.col("_p2"), F.col("_r2"))
    staged = [c for k, (p, r) in grams.items() for c in (tagged(p, r).alias(f"_g{k}"), F.size(p).alias(f"_np{k}"), F.size(r).alias(f"_nr{k}"))]
    extra = [F.size(pt).alias("_npt"), F.size(rt).alias("_nrt")]
    if "rougeL" in metrics:
        extra.append(lcs_length(pt, rt).alias("_lcs"))
    stage = stage.select(*keep, *staged, *extra)
    stage = stage.select("*", *[clipped_hits(F.col(f"_g{k}")).alias(f"_h{k}") for k in grams])
    out = [f_measure(F.col(f"_h{k}"), F.col(f"_np{k}"), F.col(f"_nr{k}")).alias(f"rouge{k}") for k in grams]
    if "rougeL" in metrics:
        out.append(lcs_f_measure(F.col("_lcs"), F.col("_npt"), F.col("_nrt")).alias("rougeL"))
    return stage.select(*keep, *out)


def long_overlap(pairs: DataFrame, keys: list[str], pred: str, ref: str, n: int = 1, chunk: int = 1 << 16) -> DataFrame:
    """(keys..., hits, n_pred, n_ref, f): clipped n-gram overlap of token-array columns ``pred`` and
    ``ref`` across tasks, for texts whose grams should not be sorted in one row; ``n`` is 1 or 2.

    The arrays are cut into chunks of ``chunk`` tokens, which overlap by n - 1, and every gram becomes a
    row. Tasks count their own grams first, so a frequent gram costs a row a task; counts meet by
    (keys, gram), and the smaller of the two counts is summed by keys. ``keys`` must name each row. Same
    values as :func:`add_rouge`; a pair without any token has 0 everywhere."""
    if n not in (1, 2):
        raise ValueError("n must be 1 or 2")
    both = F.array(*[F.struct(F.lit(s).alias("side"), F.coalesce(F.col(c), F.array().cast("array<string>")).alias("t")) for s, c in ((0, pred), (1, ref))])
    toks = pairs.select(*keys, F.explode(both).alias("x")).select(*keys, "x.side", "x.t")
    starts = F.sequence(F.lit(0), F.greatest(F.size("t") - 1, F.lit(0)), F.lit(chunk))
    # The struct keeps a row for a text without tokens.
    part = toks.select(*keys, "side", F.explode(F.transform(starts, lambda i: F.struct(F.slice("t", i + 1, chunk + n - 1).alias("t")))).alias("x"))
    grams = F.col("x.t") if n == 1 else bigrams(F.col("x.t"))
    rows = part.select(*keys, "side", F.explode_outer(grams).alias("gram"))
    count = lambda s: F.count(F.when((F.col("side") == s) & F.col("gram").isNotNull(), 1))
    per = rows.groupBy(*keys, "gram").agg(count(0).alias("p"), count(1).alias("r"))
    out = per.groupBy(*keys).agg(F.sum(F.least("p", "r")).alias("hits"), F.sum("p").alias("n_pred"), F.sum("r").alias("n_ref"))
    return out.select(*keys, "hits", "n_pred", "n_ref", f_measure(F.col("hits"), F.col("n_pred"), F.col("n_ref")).alias("f"))

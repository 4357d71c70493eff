"""Operators around model outputs that arrive as tables.

The reference runs pretrained scorers per row; here their outputs (scores,
token vectors, sentence score matrices, class logits) are inputs, and Spark
does the validation, joins and reductions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from viewpoint.functions import moments as M
from viewpoint.functions import vectors as V
from viewpoint.schemas import EXTERNAL_METRICS
from viewpoint.session import materialize

KEYS = ["model", "row_id", "exp"]
#: Token vectors of a tile; texts of any length are compared tile by tile.
TILE = 256


def score_checks(
    scores: DataFrame, rows: DataFrame, keys: list[str] = KEYS, metrics: list[str] = EXTERNAL_METRICS, lo: float = -1.0, hi: float = 1.0
) -> DataFrame:
    """Quality report of a long score table (keys..., metric, score) against the
    predictions ``rows`` (keys...), as (check, n) rows: duplicate (key, metric)
    rows, rows whose key has no prediction, rows of unknown metrics, scores
    outside [lo, hi], NULL scores, all rows, and predictions without any score.

    Both tables go through one aggregate by (key, metric), whose few rows per
    key are summed by key: no join."""
    s = scores.select(
        *keys,
        "metric",
        F.lit(0).alias("_pred"),
        F.lit(1).alias("rows"),
        F.coalesce(((F.col("score") < lo) | (F.col("score") > hi)).cast("int"), F.lit(0)).alias("out_of_range"),
        F.col("score").isNull().cast("int").alias("null_scores"),
        (~F.coalesce(F.col("metric").isin(metrics), F.lit(False))).cast("int").alias("unknown_metrics"),
    )
    zero = [F.lit(0).alias(c) for c in s.columns[len(keys) + 2 :]]
    both = s.unionByName(rows.select(*keys, F.lit(None).cast("string").alias("metric"), F.lit(1).alias("_pred"), *zero))
    sums = ["rows", "out_of_range", "null_scores", "unknown_metrics"]
    per = both.groupBy(*keys, "metric").agg(F.max("_pred").alias("_pred"), *[F.sum(c).alias(c) for c in sums])
    per = per.withColumn("duplicates", F.greatest(F.col("rows") - 1, F.lit(0)))
    per = per.groupBy(*keys).agg(F.max("_pred").alias("_pred"), *[F.sum(c).alias(c) for c in [*sums, "duplicates"]])
    per = per.withColumn("unknown_keys", F.when(F.col("_pred") == 0, F.col("rows")).otherwise(0))
    per = per.withColumn("without_score", (F.col("rows") == 0).cast("int"))
    checks = ["duplicates", "unknown_keys", "unknown_metrics", "out_of_range", "null_scores", "rows", "without_score"]
    total = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in checks])
    return total.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in checks])).alias("x")).select("x.*")


def attach_scores(rows: DataFrame, scores: DataFrame, metrics: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Left-join a long score table as one column per metric. Of several scores
    of one (key, metric) the last by the column ``ingest_order`` counts; without
    that column they are an error (NULL scores aside)."""
    cols = []
    for m in metrics:
        mine = F.col("metric") == m
        x = F.when(mine, F.col("score"))
        if "ingest_order" in scores.columns:
            cols.append(F.max_by(x, F.when(mine, F.col("ingest_order"))).alias(m))
        else:
            twice = F.raise_error(F.lit(f"several {m} scores of one prediction and no column ingest_order")).cast("double")
            cols.append(F.when(F.count(x) > 1, twice).otherwise(F.max(x)).alias(m))
    wide = scores.filter(F.col("metric").isin(metrics)).groupBy(*keys).agg(*cols)
    return rows.join(wide, keys, "left")


def _tiles(vectors: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """(keys..., tile, vecs): the vectors of each key in tiles of at most ``tile``.
    Windows and gathering share the partitioning of ``vectors`` if it is by some of ``keys``."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.monotonically_increasing_id())) - 1
    v = vectors.withColumn("tile", F.floor(n / tile).cast("int"))
    return v.groupBy(*keys, "tile").agg(F.collect_list("vec").alias("vecs"))


def _reduced(both: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., precision, recall, f1) from pairs of tiles (keys..., tile, vecs, other, other_vecs).

    Each pair gives the best cosine of every token of either tile to the other one; the maxima
    of a token over all tiles of the other text are its match, and the means over tokens follow."""
    m = both.withColumn("_m", _tile_maxima("vecs", "other_vecs"))
    per_side = F.array(*[F.struct(F.lit(s).alias("side"), F.col(t).alias("tile"), F.col(f"_m.{c}").alias("best")) for s, t, c in ((0, "tile", "cand"), (1, "other", "ref"))])
    m = m.select(*keys, F.explode(per_side).alias("x")).select(*keys, "x.side", "x.tile", F.posexplode("x.best").alias("i", "best"))
    best = m.groupBy(*keys, "side", "tile", "i").agg(F.max("best").alias("best"))
    side = lambda s: M.mean(F.when(F.col("side") == s, F.col("best")))
    pr = best.groupBy(*keys).agg(side(0).alias("precision"), side(1).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return pr.select(*keys, "precision", "recall", F.when(p + r != 0, 2 * p * r / (p + r)).when(p.isNotNull() & r.isNotNull(), 0.0).alias("f1"))


def greedy_match(vectors: DataFrame, key: str = "pair_id", tile: int = TILE) -> DataFrame:
    """Greedy-matching similarity (BERTScore form, no idf weighting): for
    token vectors (key, side, vec) with side 0 = candidate, 1 = reference,
    P = mean over candidate tokens of the best cosine to any reference token,
    R = the converse, F1 = 2PR / (P + R). A zero vector has cosine 0; a pair
    with one side only has NULLs.

    A text may have any number of vectors: tiles of ``tile`` vectors meet pair by pair (an
    Arrow-batched numpy product), and maxima and means are reduced by key.
    """
    v = vectors.select(key, "side", "vec")
    cand = _tiles(v.where("side = 0"), [key], tile)
    ref = _tiles(v.where("side = 1"), [key], tile).select(key, F.col("tile").alias("other"), F.col("vecs").alias("other_vecs"))
    both = cand.join(ref.hint("merge"), key, "full")
    return _reduced(both, [key])


def keyphrase_target(pred_vectors: DataFrame, src_vectors: DataFrame, src_of: dict[str, str], tile: int = TILE) -> DataFrame:
    """(model, row_id, exp, target): greedy-matching F1 of the key phrase of each
    prediction, as token vectors (model, row_id, exp, vec), and that of its source,
    (row_id, src, vec). ``src_of`` names the source column of each experiment. The
    phrase of a source is gathered once, whatever the number of predictions; a
    prediction without a phrase has no row, one whose source has none a NULL target.
    Phrases may have any length, see :func:`greedy_match`."""
    pred = _tiles(pred_vectors.select(*KEYS, "vec"), KEYS, tile)
    src = _tiles(src_vectors.select("row_id", "src", "vec"), ["row_id", "src"], tile)
    src = src.select("row_id", "src", F.col("tile").alias("other"), F.col("vecs").alias("other_vecs"))
    of = F.create_map(*[F.lit(x) for kv in src_of.items() for x in kv])
    both = pred.withColumn("src", F.try_element_at(of, F.col("exp"))).join(src, ["row_id", "src"], "left")
    return _reduced(both, KEYS).select(*KEYS, F.col("f1").alias("target"))


def _maxima(cand, ref):
    """Best cosine of each vector of either side to the other one; NULLs without that side."""
    if cand is None or ref is None:
        return tuple(None if x is None else [None] * len(x) for x in (cand, ref))
    a, b = (np.vstack(x).astype(np.float64) for x in (cand, ref))
    a, b = (np.divide(x, n, out=np.zeros_like(x), where=n > 0) for x, n in ((y, np.linalg.norm(y, axis=1, keepdims=True)) for y in (a, b)))
    sim = a @ b.T
    return sim.max(axis=1), sim.max(axis=0)


@F.pandas_udf(StructType([StructField(n, ArrayType(DoubleType())) for n in ("cand", "ref")]))
def _tile_maxima(cand: pd.Series, ref: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_maxima(c, r) for c, r in zip(cand, ref)], columns=["cand", "ref"])


def matrix_reduce(matrix: DataFrame, key: str = "pair_id") -> DataFrame:
    """Sentence-level consistency from a (key, src_sent, claim_sent, score)
    matrix: max over source sentences per claim, mean over claims."""
    per_claim = matrix.groupBy(key, "claim_sent").agg(F.max("score").alias("best"))
    return per_claim.groupBy(key).agg(M.mean("best").alias("score"), F.count(F.lit(1)).alias("claims"))


def stance_pairs(logits: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, p_pred, p_ref, label, stance, rmse) from class logits (key, is_ref,
    logits): softmax both, take the reference's arg-max class, score the gap;
    ``rmse`` is that of the two whole distributions."""
    g = logits.groupBy(key).agg(
        F.first(F.when(~F.col("is_ref"), F.col("logits")), ignorenulls=True).alias("lp"),
        F.first(F.when(F.col("is_ref"), F.col("logits")), ignorenulls=True).alias("lr"),
    )
    probs = g.select(key, V.softmax(F.col("lp")).alias("p_pred"), V.softmax(F.col("lr")).alias("p_ref"))
    labels = F.array(*[F.lit(x) for x in V.STANCE_LABELS])
    return probs.select(
        key,
        "p_pred",
        "p_ref",
        F.element_at(labels, V.argmax1(F.col("p_ref")).cast("int")).alias("label"),
        V.stance_gap(F.col("p_pred"), F.col("p_ref")).alias("stance"),
        V.rmse(F.col("p_pred"), F.col("p_ref")).alias("rmse"),
    )


def apply_scorer(
    df: DataFrame,
    factory: Callable[[], Callable[..., pd.Series]],
    cols: list[str],
    name: str,
    return_type: str = "double",
) -> DataFrame:
    """User hook for a load-once scorer: ``factory`` runs once per task (e.g.
    loads a model), the returned function scores Arrow batches of ``cols``."""

    @F.pandas_udf(return_type)
    def _score(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        fn = factory()
        for batch in it:
            yield fn(*batch)

    return df.withColumn(name, _score(*[F.col(c) for c in cols]))


def score_distinct(df: DataFrame, factory: Callable[[], Callable[..., pd.Series]], cols: list[str], name: str, return_type: str = "double") -> tuple[DataFrame, DataFrame]:
    """As :func:`apply_scorer`, but equal inputs are scored once and a failing input does not end the job.

    Returns (``df`` plus ``name``, rejects). Rows are brought together by a digest of their ``cols`` (NULLs included),
    each distinct input goes to the scorer once, and the scores, written to the shared folder, are joined back. If the
    scorer raises on a batch, the batch is scored row by row; inputs on which it still raises get NULL and a
    row in ``rejects`` (cols..., error). A scorer must not depend on the other rows of its batch."""
    schema = StructType([StructField("_digest", StringType()), *[df.schema[c] for c in cols]])
    digest = F.sha2(F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])), 256)
    inputs = df.select(digest.alias("_digest"), *cols).groupBy("_digest").agg(*[F.first(c).alias(c) for c in cols])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = factory()
        for batch in batches:
            error = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            try:
                score = pd.Series(fn(*[batch[c] for c in cols]), index=batch.index)
            except Exception:  # noqa: BLE001 - any failure of the user's scorer goes to the rejects
                found = []
                for i in batch.index:
                    try:
                        found.append(pd.Series(fn(*[batch.loc[[i], c] for c in cols])).iloc[0])
                    except Exception as e:  # noqa: BLE001
                        found.append(None)
                        error[i] = f"{type(e).__name__}: {e}"
                score = pd.Series(found, index=batch.index)
            yield batch.assign(**{"_score": score, "_error": error})

    out = StructType([*schema.fields]).add("_score", return_type).add("_error", "string")
    scored = materialize(inputs.select(*schema.names).mapInPandas(run, out), "scores")
    both = df.withColumn("_digest", digest).join(scored.select("_digest", F.col("_score").alias(name)), "_digest", "left").drop("_digest")
    return both, scored.where("_error is not null").select(*cols, F.col("_error").alias("error"))

"""Report aggregations over extraction facts and metric tables.

Every report is one ``groupBy`` with conditional aggregates (partial
aggregation map-side, one small shuffle); the reference's repeated boolean
masks become ``avg(when(...))`` / ``count(when(...))`` columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewpoint.functions import coverage as C
from viewpoint.functions import moments as M
from viewpoint.functions import text as T

Z_DEFAULT = 1.96  # fixed value: default confidence multiplier
EXT_COLS = ["spl_ext", "spr_ext", "mpl_ext", "mpr_ext", "spl_ext_unq", "spr_ext_unq", "mpl_ext_unq", "mpr_ext_unq"]
FACT_NUMERIC = ["pos", "length", *EXT_COLS, "num_arous", "perc_arous", "arous_score"]


def ci(x: Column, n: Column, z: float = Z_DEFAULT) -> Column:
    """z * sample std / sqrt(n); NULL for an empty cell instead of an error."""
    return F.try_divide(F.lit(z) * F.stddev_samp(x), F.sqrt(n.cast("double")))


def position_report(facts: DataFrame, positions: int = 10, z: float = Z_DEFAULT) -> DataFrame:
    """Per model and position 0..positions-1: mean ``mpl_ext`` over left
    passages, mean ``mpr_ext`` over right passages, their CIs (n = subset size)
    and counts. Every position appears, with count 0 when it has no rows."""
    left, right = F.col("side") == "left", F.col("side") == "right"
    agg = (
        facts.filter(F.col("pos") < positions)
        .groupBy("model", "pos")
        .agg(
            M.mean(F.when(left, F.col("mpl_ext"))).alias("mpl_ext"),
            M.mean(F.when(right, F.col("mpr_ext"))).alias("mpr_ext"),
            ci(F.when(left, F.col("mpl_ext")), F.count(F.when(left, 1)), z).alias("mpl_ext_std"),
            ci(F.when(right, F.col("mpr_ext")), F.count(F.when(right, 1)), z).alias("mpr_ext_std"),
            F.count(F.when(left, 1)).alias("mpl_count"),
            F.count(F.when(right, 1)).alias("mpr_count"),
        )
    )
    # Every position 0..positions-1 for every model: the (at most `positions`)
    # cells of a model are gathered into a map and the positions generated
    # from it - no self-join, so the facts are computed once.
    cells = agg.groupBy("model").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", F.struct(*STAT_COLS)))).alias("_m")
    )
    grid = cells.select("model", "_m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(positions - 1).cast("bigint"))).alias("pos"))
    cell = F.element_at(F.col("_m"), F.col("pos"))
    return grid.select(
        "model",
        "pos",
        *[cell[c].alias(c) for c in ("mpl_ext", "mpr_ext", "mpl_ext_std", "mpr_ext_std")],
        F.coalesce(cell["mpl_count"], F.lit(0)).cast("bigint").alias("mpl_count"),
        F.coalesce(cell["mpr_count"], F.lit(0)).cast("bigint").alias("mpr_count"),
    )


STAT_COLS = ["mpl_ext", "mpr_ext", "mpl_ext_std", "mpr_ext_std", "mpl_count", "mpr_count"]


def side_report(facts: DataFrame, head: int = 4, n_head: int = 5, z: float = Z_DEFAULT) -> DataFrame:
    """Per model: summary side x passage side means over ``pos < head``; the CI
    uses the std of that subset but n from ``pos < n_head`` (as the reference)."""
    aggs = []
    for summ, col in (("left", "mpl_ext"), ("right", "mpr_ext")):
        for side in ("left", "right"):
            sub = (F.col("side") == side) & (F.col("pos") < head)
            n = F.count(F.when((F.col("side") == side) & (F.col("pos") < n_head), 1))
            aggs.append(M.mean(F.when(sub, F.col(col))).alias(f"{summ}_{side}"))
            aggs.append(ci(F.when(sub, F.col(col)), n, z).alias(f"{summ}_{side}_std"))
    return facts.groupBy("model").agg(*aggs)


def metric_summary(
    scores: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("model", "exp"), z: float = Z_DEFAULT
) -> DataFrame:
    """Per key: ``avg(m) * 100`` and ``z * std(m) / sqrt(count(*)) * 100``.

    The mean skips NULLs but the CI denominator counts all rows, as the
    reference does (``len(df)``)."""
    aggs = []
    for m in metrics:
        aggs.append((M.mean(m) * 100).alias(m))
        aggs.append((ci(F.col(m), F.count(F.lit(1)), z) * 100).alias(f"{m}_ci"))
    return scores.groupBy(*keys).agg(*aggs)


def doc_coverage(
    preds: DataFrame, topics: DataFrame, left_col: str = "mp_left_pred", right_col: str = "mp_right_pred"
) -> DataFrame:
    """Per model: mean coverage of the whole left / right summaries by the
    whole ``alt_op`` and their average.

    The document's token set is built once per topic and joined on
    ``row_id``, not once per model row.
    """
    doc = topics.select("row_id", F.array_distinct(T.word_tokens("alt_op")).alias("_doc"))
    summ = preds.select(
        "model",
        "row_id",
        F.array_distinct(T.word_tokens(left_col)).alias("_l"),
        F.array_distinct(T.word_tokens(right_col)).alias("_r"),
    )
    cov = summ.join(doc, "row_id").select(
        "model", C.coverage(F.col("_l"), F.col("_doc")).alias("l"), C.coverage(F.col("_r"), F.col("_doc")).alias("r")
    )
    return cov.groupBy("model").agg(M.mean("l").alias("left_cov"), M.mean("r").alias("right_cov")).select(
        "model", "left_cov", "right_cov", (F.col("left_cov") / 2 + F.col("right_cov") / 2).alias("avg_cov")
    )


def summary_length(preds: DataFrame, left: Column | None = None, right: Column | None = None) -> DataFrame:
    """Per model: mean length of left / right summaries and their average (labels
    follow the column they come from). ``left`` and ``right`` are the lengths,
    for example columns of subword counts; by default word tokens are counted."""
    left = T.word_count("mp_left_pred") if left is None else left
    right = T.word_count("mp_right_pred") if right is None else right
    ln = preds.select("model", left.alias("l"), right.alias("r"))
    return ln.groupBy("model").agg(M.mean("l").alias("left_len"), M.mean("r").alias("right_len")).select(
        "model", "left_len", "right_len", (F.col("left_len") / 2 + F.col("right_len") / 2).alias("avg_len")
    )


def plot_points(report: DataFrame, series: str, x: Column, suffix: str = "", sides: tuple[str, ...] = ("avg", "left", "right")) -> DataFrame:
    """(model, series, side, x, ext, ext_std, lo, hi): the points and bands of a
    figure from a report with mpl_ext, mpr_ext and their _std columns (with
    ``suffix`` after _ext); side 'avg' is the mean of left and right."""
    left, right = F.col(f"mpl_ext{suffix}"), F.col(f"mpr_ext{suffix}")
    left_std, right_std = F.col(f"mpl_ext{suffix}_std"), F.col(f"mpr_ext{suffix}_std")
    of = {"avg": ((left + right) / 2, (left_std + right_std) / 2), "left": (left, left_std), "right": (right, right_std)}
    points = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), of[s][0].alias("ext"), of[s][1].alias("ext_std")) for s in sides])).alias("p")
    p = report.select("model", F.lit(series).alias("series"), x.cast("bigint").alias("x"), points).select("model", "series", "x", "p.*")
    return p.withColumn("lo", F.col("ext") - F.col("ext_std")).withColumn("hi", F.col("ext") + F.col("ext_std"))


def percentile_axis(bin_col: str, num_bins: int = 10) -> Column:
    """Upper percentile of a bin."""
    return (F.col(bin_col) + 1) * (100 // num_bins)


def display_names(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """``df`` plus the label of each model and its place in the given order; NULL
    for models without one. The names are constants of the plan."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    places = F.create_map(*[F.lit(x) for i, m in enumerate(labels) for x in (m, i)])
    return df.withColumn("label", F.try_element_at(names, F.col("model"))).withColumn("ord", F.try_element_at(places, F.col("model")))

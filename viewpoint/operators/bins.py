"""Percentile bins and binned reports.

Edges are per model over all passages (before any position filter), at
100*i/n for i = 1..n with linear interpolation; a value's bin is the first edge
it is <= to (ties go to the lowest bin, bins may be empty). This is
value-based, not ``ntile``. Rows without a value have no bin (NULL) and stay.

Everything is worked out on the distinct values of a model with their counts.
Their ranks come from two windows: one over the counts of value buckets (runs of
neighbouring doubles, so their number is set by the range of the values and not
by the rows), one inside each bucket. A model may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from viewpoint.functions import moments as M
from viewpoint.operators.reports import Z_DEFAULT
from viewpoint.session import materialize

#: Buckets per factor of two; a bucket holds doubles within 1 part in 90,000.
BUCKETS_PER_OCTAVE = 1 << 16
_OFFSET = 1 << 40
_LARGEST = 1.7976931348623157e308


def _number(value: str) -> Column:
    v = F.col(value).cast("double")
    return F.when(~F.isnan(v), v)


def _bucket(v: Column) -> Column:
    """A whole number that never falls as ``v`` rises."""
    size = _OFFSET + F.floor(F.log2(F.least(F.abs(v), F.lit(_LARGEST))) * BUCKETS_PER_OCTAVE)
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("bigint")


def value_counts(df: DataFrame, value: str, key: str = "model") -> DataFrame:
    """(key, _v, _n): the distinct values of each key, as doubles, and their rows."""
    return df.select(key, _number(value).alias("_v")).groupBy(key, "_v").agg(F.count(F.lit(1)).alias("_n"))


def ranked(counts: DataFrame, key: str = "model") -> DataFrame:
    """``counts`` (key, _v, _n, ...) without NULL values plus the ranks that each
    value takes, [_start, _end), the rows of its key, _total, and the value before
    it, _prev."""
    c = counts.where("_v is not null").withColumn("_bucket", _bucket(F.col("_v")))
    sums = c.groupBy(key, "_bucket").agg(F.sum("_n").alias("_rows"), F.max("_v").alias("_top"))
    order = Window.partitionBy(key).orderBy("_bucket")
    before = F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(
        F.col(key).alias("_k"),
        F.col("_bucket").alias("_b"),
        F.coalesce(before, F.lit(0)).alias("_before"),
        F.lag("_top").over(order).alias("_below"),
        F.sum("_rows").over(Window.partitionBy(key)).alias("_total"),
    )
    inside = Window.partitionBy(key, "_bucket").orderBy("_v")
    c = c.join(starts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bucket") == F.col("_b"))).drop("_k", "_b")
    c = c.withColumn("_end", F.col("_before") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    c = c.withColumn("_prev", F.coalesce(F.lag("_v").over(inside), F.col("_below"))).withColumn("_start", F.col("_end") - F.col("_n"))
    return c.drop("_bucket", "_before", "_below")


def _targets(num_bins: int) -> Column:
    """Per edge: its number and the ranks lo and hi between which it lies, t of the way."""
    at = F.array(*[F.lit(i / num_bins) for i in range(1, num_bins + 1)])
    at = F.transform(at, lambda q, i: F.struct(i.alias("i"), ((F.col("_total") - 1) * q).alias("r")))
    at = F.transform(at, lambda x: F.struct(x["i"].alias("i"), F.floor(x["r"]).alias("lo"), (x["r"] - F.floor(x["r"])).alias("t")))
    return F.transform(at, lambda x: F.struct(x["i"].alias("i"), x["lo"].alias("lo"), x["t"].alias("t"), (x["lo"] + (x["t"] > 0).cast("int")).alias("hi")))


def _between(a: Column, b: Column, t: Column) -> Column:
    """a + (b - a) t, measured from the nearer end."""
    return F.when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t)


def percentile_edges(df: DataFrame, value: str, num_bins: int, key: str = "model", sketch: int | None = None) -> DataFrame:
    """(key, edges): exact percentiles at i/num_bins, i = 1..num_bins, with
    linear interpolation; NULL edges for a key without any value. With ``sketch``
    they are approximate, out of a KLL sketch of that size, see :func:`edges_of_states`."""
    if sketch is not None:
        return edges_of_states(quantile_state(df, value, key, sketch), num_bins, key)
    r = ranked(value_counts(df, value, key), key)
    holds = lambda rank: (F.col("_start") <= rank) & (rank < F.col("_end"))
    hit = r.select(key, "_v", "_start", "_end", F.explode(F.filter(_targets(num_bins), lambda x: holds(x["lo"]) | holds(x["hi"]))).alias("x"))
    ab = hit.groupBy(key, "x.i", "x.t").agg(
        F.max(F.when(holds(F.col("x.lo")), F.col("_v"))).alias("_a"), F.max(F.when(holds(F.col("x.hi")), F.col("_v"))).alias("_b")
    )
    ab = ab.select(key, F.struct("i", _between(F.col("_a"), F.col("_b"), F.col("t")).alias("e")).alias("x"))
    # Keys without a value come with a NULL, which the gathering skips.
    ab = ab.unionByName(df.select(key).distinct().select(key, F.lit(None).cast(ab.schema["x"].dataType).alias("x")))
    edges = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"])
    return ab.groupBy(key).agg(edges.alias("edges")).select(key, F.when(F.size("edges") > 0, F.col("edges")).alias("edges"))


def quantile_state(df: DataFrame, value: str, key: str = "model", k: int = 200) -> DataFrame:
    """(key, state): a KLL sketch of the values of each key, a few kilobytes whatever the
    rows. States of batches can be kept with the facts and merged, see :func:`merge_states`."""
    return df.groupBy(key).agg(F.kll_sketch_agg_double(_number(value), F.lit(k)).alias("state"))


def merge_states(states: DataFrame, key: str = "model", k: int = 200) -> DataFrame:
    """One state per key out of those of several batches (key, state)."""
    return states.groupBy(key).agg(F.kll_merge_agg_double("state", F.lit(k)).alias("state"))


def edges_of_states(states: DataFrame, num_bins: int, key: str = "model") -> DataFrame:
    """(key, edges): approximate percentiles at i/num_bins, i = 1..num_bins, from :func:`quantile_state`;
    NULL edges for a key without any value. An edge is a value of the data whose rank is within
    about 1.7 % of the rows for k = 200, and 0.4 % for k = 1,000 (the sketch's bound at 99 % confidence)."""
    at = F.array(*[F.lit(i / num_bins) for i in range(1, num_bins + 1)])
    edges = F.kll_sketch_get_quantile_double("state", at)
    return states.select(key, F.when(F.kll_sketch_get_n_double("state") > 0, edges).alias("edges"))


def _bin(num_bins: int) -> Column:
    """Number of edges below the value of a :func:`ranked` row. An edge between
    ranks lo and hi is below if both lie before the value; if only lo does, it is
    interpolated between the value before and this one."""
    v, start = F.col("_v"), F.col("_start")
    below = lambda x: (x["lo"] < start) & ((x["hi"] < start) | (_between(F.col("_prev"), v, x["t"]) < v))
    return F.size(F.filter(_targets(num_bins), below)).cast("bigint")


def assign_bins(df: DataFrame, value: str, num_bins: int, out: str, key: str = "model") -> DataFrame:
    """``df`` plus ``out`` = index of the first edge >= value, NULL where there is
    no value. Rows meet their bin by (key, value), never by the key alone."""
    bins = ranked(value_counts(df, value, key), key).select(F.col(key).alias("_k"), "_v", _bin(num_bins).alias(out))
    rows = df.withColumn("_x", _number(value))
    return rows.join(bins, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_x") == F.col("_v")), "left").drop("_x", "_k", "_v")


def binned_report(
    facts: DataFrame,
    value: str,
    num_bins: int,
    bin_col: str,
    columns: list[str],
    max_pos: int = 4,
    with_ci: bool = True,
    z: float = Z_DEFAULT,
    key: str = "model",
) -> DataFrame:
    """Per (key, bin) over passages with ``pos < max_pos``: mean of each
    declared column and, with ``with_ci``, ``z * std / sqrt(count(col))``.

    The facts are read once: exact sums and spreads per (key, distinct value) are
    written to the shared folder with their bins, and the report follows from that
    table. Means do not depend on the order of the rows, and spreads are merged as
    states of (n, mean, M2), see :mod:`viewpoint.functions.moments`."""
    head = F.col("pos") < max_pos
    aggs = [F.count(F.lit(1)).alias("_n"), F.count(F.when(head, 1)).alias("_head")]
    for c in columns:
        x = F.when(head, F.col(c)).cast("double")
        aggs += [F.count(x).alias(f"{c}_n"), *M.sum_columns(x, c)]
        aggs += [M.spread_column(x).alias(f"{c}_m2")] if with_ci else []
    stats = facts.withColumn("_v", _number(value)).groupBy(F.col(key).alias("_key"), "_v").agg(*aggs)
    stats = materialize(stats, "value_stats")
    kept = [c for c in stats.columns if c not in ("_v", "_n")]
    binned = ranked(stats, "_key").select(*kept, _bin(num_bins).alias("_bin"))
    binned = binned.unionByName(stats.where("_v is null").select(*kept, F.lit(None).cast("bigint").alias("_bin")))
    counts = [F.sum(c).alias(c) for c in ["_head", *[f"{c}_n" for c in columns]]]
    sums = binned.groupBy("_key", "_bin").agg(*counts, *[a for c in columns for a in M.merge_columns(c)]).where("_head > 0")
    means = [F.try_divide(M.total(c), F.col(f"{c}_n")).alias(c) for c in columns]
    if not with_ci:
        return sums.select(F.col("_key").alias(key), F.col("_bin").alias(bin_col), *means)
    report = sums.select(F.col("_key").alias("_k"), F.col("_bin").alias("_b"), *means, *[f"{c}_n" for c in columns])
    # A bin's values meet the bin's means: few rows a key, so this is a small join.
    own = binned.select("_key", "_bin", *[x for c in columns for x in (F.col(f"{c}_n").alias(f"{c}_i"), F.try_divide(M.total(c), F.col(f"{c}_n")).alias(f"{c}_m"), f"{c}_m2")])
    both = own.join(report, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_bin").eqNullSafe(F.col("_b")))
    spread = [M.merged_spread(F.col(f"{c}_i"), F.col(f"{c}_m"), F.col(f"{c}_m2"), F.col(c)).alias(f"{c}_m2") for c in columns]
    both = both.groupBy("_key", "_bin").agg(*[F.first(c).alias(c) for c in columns], *[F.first(f"{c}_n").alias(f"{c}_n") for c in columns], *spread)
    out = []
    for c in columns:
        n = F.col(f"{c}_n")
        # One value has no spread: 0 / 0 is NULL.
        std = F.sqrt(F.try_divide(F.col(f"{c}_m2"), n - 1))
        out += [F.col(c), (z * std / F.sqrt(F.when(n > 0, n))).alias(c + "_std")]
    return both.select(F.col("_key").alias(key), F.col("_bin").alias(bin_col), *out)

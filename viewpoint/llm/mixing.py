"""Mixing sources to target weights by Pfair scheduling (native DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewpoint.operators.passages import pinned
from viewpoint.session import materialize

BLOCK_BYTES = 16384
PERIOD = 1024
#: Leading hex digits of the shuffle hash that make a hash range: a source's
#: prefix sums run over its 16 ** 3 ranges, so no source is one window.
RANGE_DIGITS = 3


def source_weights(docs: DataFrame, weights: Mapping[str, int] | None = None, period: int = PERIOD) -> DataFrame:
    """(src, a): whole-number target weights. By default in proportion to the
    square root of a source's bytes, scaled to about ``period`` in total and at
    least 1. With ``weights`` given, sources it does not name get weight 1."""
    size = docs.groupBy("src").agg(F.sum("n_bytes").alias("b"))
    if weights is not None:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
        a = F.coalesce(F.try_element_at(named, "src"), F.lit(1)) if weights else F.lit(1)
        return size.select("src", a.cast("bigint").alias("a"))
    root = size.select("src", F.floor(F.sqrt(F.col("b").cast("double"))).cast("bigint").alias("r"))
    # The sum comes from the aggregate, once for all sources.
    every = root.agg(F.array_agg(F.struct("src", "r")).alias("x"), F.sum("r").alias("total")).select(F.explode("x").alias("y"), "total")
    a = F.expr(f"greatest(1L, (y.r * {int(period)}) div greatest(1L, total))")
    return every.select("y.src", a.alias("a"))


def schedule(weights: DataFrame) -> DataFrame:
    """(src, a, j, period, slot, release, deadline): the slot of every source's
    j-th block (from 0) within one period of sum(a) slots.

    Block j of a source with weight a out of P is released at floor(j * P / a)
    and due by ceil((j + 1) * P / a). Each slot goes to the released block with
    the earliest deadline, ties to the alphabetically first source. As the
    weights add up to P, every block meets its deadline, so that at any slot a
    source is less than one block off its share; later periods repeat the first.

    Blocks due before P come first whatever the others do, so they are folded
    alone: a step is a block, of which sources of weight over 1 have sum(a - 1),
    no more than P. What is due at P (the last block of those sources, and the
    one of each source of weight 1) shares the slots left by name: a second fold
    steps over the releases and places of the last blocks only, and the sources
    of weight 1 fill the rest in order. So the folds don't grow with the number
    of sources of weight 1, and the rest is linear in it."""
    row = weights.agg(F.array_sort(F.array_agg(F.struct("src", "a"))).alias("s")).where("size(s) > 0")
    row = row.select("s", F.expr("aggregate(s, 0L, (acc, y) -> acc + y.a)").alias("p"))
    # Sources of weight over 1, in the order of names; below: the sources of weight 1 that come before.
    row = pinned(
        row,
        ["p"],
        m=F.expr("transform(filter(transform(s, (y, x) -> named_struct('src', y.src, 'a', y.a, 'x', x)), y -> y.a > 1), (y, i) -> named_struct('src', y.src, 'a', y.a, 'below', y.x - i))"),
        u=F.expr("filter(s, y -> y.a <= 1)"),
    )
    # Blocks due before P: the state is a count a source, the next slot and the places so far.
    waiting = (
        "filter(transform(m, (y, i) -> if(acc.c[i] < y.a - 1, named_struct('d', ((acc.c[i] + 1) * p + y.a - 1) div y.a, 'i', i, 'r', (acc.c[i] * p) div y.a), null)), z -> z is not null)"
    )
    at = "greatest(acc.t, array_min(transform(w, z -> z.r)))"
    pick = f"transform(array({waiting}), w -> transform(array({at}), t -> named_struct('i', array_min(filter(w, z -> z.r <= t)).i, 't', t))[0])"
    early = (
        "aggregate(if(n > 0, sequence(1L, n), cast(array() as array<bigint>)),"
        " named_struct('c', transform(m, y -> 0L), 't', 0L, 'o', cast(array() as array<struct<i: int, t: bigint>>)),"
        f" (acc, k) -> transform({pick}, b -> named_struct('c', transform(acc.c, (x, i) -> if(i = b.i, x + 1, x)), 't', b.t + 1, 'o', concat(acc.o, array(b))))[0], acc -> acc.o)"
    )
    row = row.withColumn("n", F.expr("aggregate(m, 0L, (acc, y) -> acc + y.a - 1)"))
    row = pinned(row, ["p", "m", "u"], o=F.expr(early))
    # Last blocks: r is the number of free slots before the release.
    last = "transform(m, y -> named_struct('below', y.below, 'r', cast(((y.a - 1) * p) div y.a - size(filter(o, z -> z.t < ((y.a - 1) * p) div y.a)) as int)))"
    row = pinned(row, ["p", "m", "u", "o"], free=F.expr("array_except(sequence(0L, p - 1), transform(o, z -> z.t))"), last=F.expr(last))
    due = "array_min(filter(transform(acc.at, (q, i) -> if(q < 0 and last[i].r <= acc.f, i, null)), i -> i is not null))"
    released = "coalesce(array_min(filter(transform(acc.at, (q, i) -> if(q < 0 and last[i].r > acc.f, last[i].r, null)), r -> r is not null)), size(free))"
    place = "named_struct('f', acc.f + 1, 'g', acc.g, 'at', transform(acc.at, (q, i) -> if(i = h, acc.f, q)))"
    # Sources of weight 1 run on until a block is released, or until the name of the waiting one.
    ahead = f"if(acc.g < size(u), least({released} - acc.f, coalesce(last[h].below, size(u)) - acc.g, size(u) - acc.g), 0)"
    skip = f"transform(array({ahead}), x -> named_struct('f', if(x > 0, acc.f + x, {released}), 'g', acc.g + x, 'at', acc.at))[0]"
    places = (
        "aggregate(if(size(m) > 0, sequence(0, 3 * size(m)), cast(array() as array<int>)), named_struct('f', 0, 'g', 0, 'at', transform(m, y -> -1)),"
        f" (acc, k) -> transform(array({due}), h -> if(last[h].below <= acc.g, {place}, {skip}))[0], acc -> acc.at)"
    )
    row = pinned(row, ["m", "u", "o", "p", "free"], at=F.expr(f"transform({places}, q -> free[q])"))
    row = pinned(row, ["m", "u", "o", "p", "at"], rest=F.expr("array_except(free, at)"))
    jobs = (
        "concat(transform(o, z -> named_struct('src', m[z.i].src, 'a', m[z.i].a, 'slot', z.t)),"
        " transform(m, (y, i) -> named_struct('src', y.src, 'a', y.a, 'slot', at[i])), transform(u, (y, i) -> named_struct('src', y.src, 'a', y.a, 'slot', rest[i])))"
    )
    slots = row.select(F.col("p").alias("period"), F.explode(F.expr(jobs)).alias("x")).select("period", "x.slot", "x.src", "x.a")
    j = F.row_number().over(Window.partitionBy("src").orderBy("slot")).cast("bigint") - 1
    return slots.withColumn("j", j)


def mix(docs: DataFrame, weights: Mapping[str, int] | None = None, block_bytes: int = BLOCK_BYTES, period: int | None = None, seed: str = "mix") -> DataFrame:
    """``docs`` (doc_id, text, source, ...) plus the interleaving: block, slot,
    release, deadline (bigint) and slot_order, the row's place in its slot's
    order (its shuffle hash). Sort by (slot, slot_order, doc_id) to read the mix.

    Each source's documents are put in a fixed random order (MD5 of seed and
    doc_id; ties by doc_id, then text) and laid end to end; a document belongs
    to the block of ``block_bytes`` bytes in which it starts, so a document
    longer than a block leaves the blocks it spans unfilled. Blocks get slots
    by earliest deadline first, see :func:`schedule`. A source that has run out
    leaves its slots empty; the others keep their ratio. No row is dropped or
    repeated.

    A null source counts as the source ''. Null and empty texts take 0 bytes
    and share the block in which they fall. A null doc_id counts as ''. Equal
    rows get neighbouring places in any order. An empty table gives an empty
    result. Input columns with the names of the added ones are replaced.

    A source of any size is handled in hash ranges: sums per (source, range),
    running totals of those, and a window inside each range. The sums and the
    schedule are written once. The schedule has one row a slot: PERIOD rows and
    one a source at most when weights are derived, so the period grows with the
    sources. The planner broadcasts it if its bytes are few; else it is joined
    by (source, place), and adaptive execution splits the hot ones. With a
    ``period`` given, a schedule of more than twice as many slots raises an error.
    """
    added = ["block", "slot", "release", "deadline", "slot_order"]
    d = docs.drop(*[c for c in docs.columns if c in added])
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = d.select(
        F.struct(*d.columns).alias("row"),
        F.coalesce(F.col("source"), F.lit("")).alias("src"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        h.alias("h"),
    )
    d = d.withColumn("range", F.substring("h", 1, RANGE_DIGITS))
    sums = materialize(d.groupBy("src", "range").agg(F.sum("n_bytes").alias("n_bytes")), "sums")
    before = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("src", "range", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("src", "range").orderBy("h", "row.doc_id", F.col("n_bytes"), F.md5("row.text")).rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(starts.hint("merge"), ["src", "range"])
    d = d.withColumn("at_byte", F.col("start") + F.coalesce(F.sum("n_bytes").over(inside), F.lit(0)))
    d = d.withColumn("block", F.expr(f"at_byte div {int(block_bytes)}"))
    plan = schedule(source_weights(sums, weights, period or PERIOD))
    if period is not None:
        most = max(2 * period, sum(weights.values()) if weights else 0)
        plan = plan.withColumn("period", F.when(F.col("period") <= most, F.col("period")).otherwise(F.raise_error(F.lit("more sources than the period has slots"))))
    plan = materialize(plan, "schedule")
    d = d.join(plan.where("j = 0").select("src", "a", F.col("period").alias("p")), "src")
    d = d.withColumn("j", F.expr("block % a"))
    d = d.join(plan.select("src", "j", F.col("slot").alias("at")), ["src", "j"])
    return d.select(
        *[F.col(f"row.{c}").alias(c) for c in docs.columns if c not in added],
        F.col("block").cast("bigint").alias("block"),
        F.expr("(block div a) * p + at").alias("slot"),
        F.expr("(block * p) div a").alias("release"),
        F.expr("((block + 1) * p + a - 1) div a").alias("deadline"),
        F.col("h").alias("slot_order"),
    )


ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, '') AS src, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, md5(text) AS m
  FROM documents
),
b AS (
  SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY src ORDER BY h, doc_id, n, m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
    // {BLOCK_BYTES} AS block
  FROM d
),
r AS (SELECT src, CAST(floor(sqrt(CAST(sum(n) AS DOUBLE))) AS BIGINT) AS r FROM d GROUP BY src),
wt AS (
  SELECT src, greatest(1, (r * {PERIOD}) // greatest(1, (SELECT CAST(sum(r) AS BIGINT) FROM r))) AS a,
    CAST(row_number() OVER (ORDER BY src) AS BIGINT) AS i FROM r
),
p AS (SELECT CAST(sum(a) AS BIGINT) AS p, list(a ORDER BY i) AS a FROM wt),
run(t, c, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(a, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM p
  UNION ALL
  SELECT t, list_transform(c, lambda n, i: CASE WHEN i = best THEN n + 1 ELSE n END), best FROM (
    SELECT t + 1 AS t, c, list_min(list_filter(list_transform(p.a, lambda y, i: CASE WHEN c[i] < y AND (c[i] * p.p) // y <= t + 1
        THEN (((c[i] + 1) * p.p + y - 1) // y) * 1000000 + i END), lambda z: z IS NOT NULL)) % 1000000 AS best
    FROM run, p WHERE t + 1 < p.p
  )
),
s AS (SELECT t, pick, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM run WHERE t >= 0)
SELECT b.doc_id, b.source, b.block, (b.block // wt.a) * p.p + s.t AS slot, (b.block * p.p) // wt.a AS release,
  ((b.block + 1) * p.p + wt.a - 1) // wt.a AS deadline, b.h AS slot_order
FROM b JOIN wt USING (src) JOIN s ON s.pick = wt.i AND s.j = b.block % wt.a, p
"""

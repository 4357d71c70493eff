"""Chat formatting after cumulative-snapshot collapse (native DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, p1, p2, role, text, turn): a rolling hash of each
    conversation's first k turns. Every turn adds two 64-bit hashes of
    (place, role, text) to the running exact sums, so equal prefixes have equal
    sums and a prefix costs one addition."""
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    t = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("k", F.row_number().over(order).cast("bigint"))
    for i in (1, 2):
        h = F.xxhash64(F.lit(i), "k", "role", "text").cast("decimal(38,0)")
        t = t.withColumn(f"p{i}", F.sum(h).over(upto))
    return t


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations to keep: not a prefix
    of a longer one, and the smallest conv_id among equal ones."""
    conv = prefixes.groupBy("conv_id").agg(F.max(F.struct("k", "p1", "p2")).alias("x")).select("conv_id", "x.*")
    whole = conv.groupBy("k", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    n = prefixes.groupBy("conv_id").agg(F.max("k").alias("n"))
    # Proper prefixes only; aggregated to one row a prefix, so a common first turn is one row.
    inner = prefixes.select("conv_id", "k", "p1", "p2").join(n.hint("merge"), "conv_id").where("k < n").select("k", "p1", "p2").distinct()
    return whole.join(inner.hint("merge"), ["k", "p1", "p2"], "left_anti").select("conv_id", F.col("k").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation of ``turns`` (conv_id, turn, role,
    text): conv_id, n_turns, n_copies (conversations with just these turns) and
    ``text``, the turns rendered as ``<|role|>\\ncontent\\n`` each.

    Logs hold a snapshot of a conversation after every turn; a conversation
    whose turns are the first turns of a longer one is such a snapshot and
    goes. Of equal conversations the smallest conv_id stays.

    Turns are ordered by (turn, role, text); a null turn comes first. A null
    role renders as ``unknown``, a null text as empty. Repeated rows are turns
    like any other. Rows without conv_id take no part. Other columns are
    ignored. A conversation is one row of output, so its turns meet in one
    task; the window streams them.
    """
    p = turn_prefixes(turns)
    keep = maximal_conversations(p)
    one = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    shown = p.join(keep.hint("merge"), "conv_id", "left_semi").select("conv_id", "k", one.alias("s"))
    text = shown.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]), "").alias("text")
    )
    return keep.join(text.hint("merge"), "conv_id")


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
),
c AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS ts FROM t GROUP BY conv_id
),
p AS (
  SELECT DISTINCT CAST(ts[1:k] AS VARCHAR) AS key FROM (SELECT ts, n, unnest(range(1, n)) AS k FROM c)
),
w AS (SELECT min(conv_id) AS conv_id, n, ts, count(*) AS m FROM c GROUP BY n, ts)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, CAST(m AS BIGINT) AS n_copies,
  list_aggregate(list_transform(ts, lambda x: '<|' || x.r || '|>' || chr(10) || x.t || chr(10)), 'string_agg', '') AS text
FROM w WHERE CAST(ts AS VARCHAR) NOT IN (SELECT key FROM p)
"""

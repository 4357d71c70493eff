"""Line dedup over overlapping three-line windows (native DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewpoint.llm.common import split_join

WINDOW = 3


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, __text, pos) of every window of three consecutive lines that also occurs
    earlier: at a smaller doc_id, or higher up in the same document. ``__text``, a hash of the
    whole text, tells documents of one doc_id apart."""
    h = F.transform(F.split("text", "\n", -1), lambda x: F.xxhash64(x))
    w = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("__text"), h.alias("h")).where(F.size("h") >= WINDOW)
    # Two 64-bit hashes of the three line hashes make the key.
    w = w.select(
        "doc_id",
        "__text",
        F.explode(
            F.expr(
                f"transform(sequence(0, size(h) - {WINDOW}), i -> named_struct('pos', i,"
                " 'w1', xxhash64(h[i], h[i + 1], h[i + 2]), 'w2', xxhash64(h[i + 2], 1L, h[i], 2L, h[i + 1])))"
            )
        ).alias("x"),
    ).select("doc_id", "__text", "x.pos", "x.w1", "x.w2")
    first = (
        w.groupBy("w1", "w2")
        .agg(F.min(F.struct("doc_id", "__text", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    return split_join(w, first, "w1", "w2").where("struct(doc_id, __text, pos) <> first").select("doc_id", "__text", "pos")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated lines taken out of ``text``,
    plus n_lines and n_removed (bigint).

    Lines end at ``\\n``. Every three consecutive lines form a window; windows
    with equal lines are repeats of the first one by (doc_id, position), and
    all lines that a later occurrence covers go. Windows are judged on the
    input, overlaps merge, and texts under three lines stay as they are.

    Null texts stay null with 0 lines; an empty text is one empty line; a text
    whose lines all go becomes empty, and its row stays. Rows that repeat a
    doc_id with the same text count as one document, so neither loses lines to
    the other; with different texts they are documents of their own, in the
    order of a hash of the text. A null doc_id sorts before all others and loses no line itself.
    Extra columns pass through; input columns named n_lines or n_removed are
    replaced. Names that start with two underscores are reserved.
    """
    covered = repeated_windows(docs).groupBy("doc_id", "__text").agg(F.collect_set("pos").alias("__dup"))
    lines = F.split("text", "\n", -1)
    kept = F.expr(
        "transform(array_except(sequence(0, size(__lines) - 1), flatten(transform(__dup, p -> array(p, p + 1, p + 2)))), i -> __lines[i])"
    )
    keyed = docs.withColumn("__text", F.xxhash64("text"))
    out = keyed.join(covered.hint("merge"), ["doc_id", "__text"], "left").withColumn("__lines", lines)
    out = out.withColumn("__kept", F.when(F.col("__dup").isNull(), F.col("__lines")).otherwise(kept))
    n, m = F.coalesce(F.size("__lines"), F.lit(0)), F.coalesce(F.size("__kept"), F.lit(0))
    n, m = F.greatest(n, F.lit(0)), F.greatest(m, F.lit(0))
    text = F.when(F.col("__dup").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n"))
    return out.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        n.cast("bigint").alias("n_lines"),
        (n - m).cast("bigint").alias("n_removed"),
    )


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, i AS pos, {'a': ls[i + 1], 'b': ls[i + 2], 'c': ls[i + 3]} AS k
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS i FROM l WHERE len(ls) >= 3)
),
later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r FROM w) WHERE r > 1
),
gone AS (SELECT DISTINCT doc_id, pos + d AS pos FROM later, (VALUES (0), (1), (2)) v(d)),
pieces AS (SELECT doc_id, i AS pos, ls[i + 1] AS line FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM l)),
kept AS (
  SELECT p.doc_id, string_agg(line, chr(10) ORDER BY p.pos) AS text, count(*) AS n
  FROM pieces p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id
)
SELECT l.doc_id, CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(ls), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed
FROM l LEFT JOIN kept k USING (doc_id)
"""

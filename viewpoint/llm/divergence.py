"""Source divergence audit: how the term frequencies of a language's sources differ, in exact arithmetic."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewpoint.llm.common import materialize

#: Documents of its language that a term is in at least, and terms reported per source.
LEAST, TOP = 10, 10
#: Bytes of different texts that a task gathers before it sends them on, and entries
#: (term and source) that it counts before it sends those on.
TEXT_BYTES, ENTRIES = 1 << 24, 1 << 20

#: Bytes that end a term become spaces, A-Z become a-z, all others stay.
TERM_BYTES = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

GROUPED = "lang string, h1 bigint, h2 bigint, text binary, sources array<string>, copies array<bigint>"
COUNTED = "lang string, term string, source string, n bigint"


def same_texts(docs: DataFrame) -> DataFrame:
    """Rows of equal (lang, text) meet as one row with the copies of each source, as
    far as one task holds them at a time; h1 and h2 are a digest of the text."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], Counter] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            h = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for _, t in held), dtype=np.int64).reshape(-1, 2)
            cols = [pa.array([lang for lang, _ in held], pa.string()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([t for _, t in held], pa.binary())]
            cols += [pa.array([list(c) for c in held.values()], pa.list_(pa.string())), pa.array([list(c.values()) for c in held.values()], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, names=["lang", "h1", "h2", "text", "sources", "copies"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                sources = held.get((lang, text))
                if sources is None:
                    sources = held[lang, text] = Counter()
                    size += len(text)
                sources[source] += 1
                if size >= TEXT_BYTES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(gather, GROUPED)


def counted_terms(docs: DataFrame) -> DataFrame:
    """(lang, term, source, n): occurrences of every term in each source and, with a NULL
    source, the documents of the language that have it; several rows per key.

    Equal texts of a language meet, their copies are added up, and the text is split into terms once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple[str, str | None], dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
        here, copies, n = None, Counter(), 0

        def add() -> int:
            """Adds the text that is complete now; entries that are new."""
            lang, text = here
            terms = Counter(text.translate(TERM_BYTES).split())
            new = 0
            every = sum(copies.values())
            into = tables[lang, None]
            new -= len(into)
            for t in terms:
                into[t] += every
            new += len(into)
            for source, m in copies.items():
                into = tables[lang, source]
                new -= len(into)
                for t, c in terms.items():
                    into[t] += c * m
                new += len(into)
            return new

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), into in tables.items():
                k = len(into)
                cols = [pa.array([lang] * k, pa.string()), pa.array(list(into), pa.binary()).cast(pa.string()), pa.array([source] * k, pa.string()), pa.array(list(into.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "term", "source", "n"])

        for batch in batches:
            for lang, text, sources, m in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "sources", "copies")), strict=True):
                if here != (lang, text):
                    if here is not None:
                        n += add()
                    here, copies = (lang, text), Counter()
                    if n >= ENTRIES:
                        yield from flush()
                        tables.clear()
                        n = 0
                copies.update(dict(zip(sources, m, strict=True)))
        if here is not None:
            add()
        yield from flush()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return same_texts(docs).repartition(parts, "lang", "h1", "h2").sortWithinPartitions("lang", "h1", "h2", "text").mapInArrow(count, COUNTED)


def _share(count: str, total: str) -> Column:
    """1 + floor(10**9 (count + 2) / (total + 2 kept)); NULL without kept terms."""
    return F.expr(f"CASE WHEN kept > 0 THEN 1 + (cast({count} + 2 AS decimal(38,0)) * 1000000000) div ({total} + 2 * kept) END")


def _gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def source_divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The audit of ``docs`` (text, lang, source; null counts as ''): lang, source, part,
    item (strings), value (bigint), rank (int from 1 per source and part, by falling value, then item by its bytes).

    Terms are runs of ASCII letters and non-ASCII characters, A-Z in lower case. A language keeps the
    V terms that at least ``least`` of its documents hold. With ``count`` occurrences of a kept term among a
    source's N kept ones, p = 1 + floor(10**9 (count + 2) / (N + 2 V)); q likewise, and f = floor((p - q)**2 / (p + q)).
    Part ``pair``: every other source of the language, f summed over all kept terms (0 without any). Part ``term``: the ``top``
    terms that occur in the source and are more frequent there than in the whole language, q the language's.

    All sums are of whole numbers. The sum over a pair's terms is sparse: terms that neither source
    has all give the same f; a source's own terms are taken by their count against the other's
    p of absent terms; only terms that both have are evaluated one by one.

    Rows that repeat an id or a text are documents of their own; equal texts are split once. Empty and null texts
    have no term, but their source takes part. Ids and other columns are ignored; an empty table gives no row.
    """
    names = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Keyed by (lang, term), so one exchange serves the sums and both windows.
    cells = counted_terms(docs).repartition(parts, "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    term = Window.partitionBy("lang", "term")
    cells = cells.withColumn("df", F.max(F.when(F.col("source").isNull(), F.col("n"))).over(term))
    cells = cells.where((F.col("df") >= least) & F.col("source").isNotNull()).withColumn("whole", F.sum("n").over(term))
    cells = cells.withColumn("first", (F.row_number().over(term.orderBy("source")) == 1).cast("bigint"))
    cells = materialize(cells.drop("df"), "divergence_cells")

    by_lang = cells.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("n").alias("lang_total"))
    by_source = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = docs.select(*names).distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    totals = materialize(totals.withColumn("p0", _share("0", "total")), "divergence_totals")

    # The planner knows the bytes of the totals and broadcasts them while they are few.
    shares = cells.join(totals, ["lang", "source"]).withColumn("p", _share("n", "total"))
    terms = shares.withColumn("q", _share("whole", "lang_total")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    other = totals.select("lang", F.col("source").alias("other"), F.col("p0").alias("o0"))
    base = totals.join(other, "lang").where("source <> other").select("lang", "source", "other", F.expr(f"coalesce(kept * ({_gap('p0', 'o0')}), 0)").alias("value"))
    counts = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("terms"))
    alone = counts.join(other, "lang").where("source <> other").groupBy("lang", "source", "other").agg(F.expr(f"sum(terms * ({_gap('p', 'o0')} - {_gap('p0', 'o0')}))").alias("value"))
    one = shares.select("lang", "term", "source", "p", "p0")
    two = shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("o"), F.col("p0").alias("o0"))
    both = one.join(two.hint("merge"), ["lang", "term"]).where("source < other")
    # In both sources: the sums of `alone` counted f(p, o0) + f(p0, o) - 2 f(p0, o0) on top of f(p0, o0).
    both = both.groupBy("lang", "source", "other").agg(F.expr(f"sum({_gap('p', 'o')} - {_gap('p', 'o0')} - {_gap('p0', 'o')} + {_gap('p0', 'o0')})").alias("value"))
    sums = alone.union(both)
    sums = sums.union(sums.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    pairs = base.union(sums).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value").withColumn("rank", F.row_number().over(order))
    return pairs.union(terms)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
),
w AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
keep AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
cnt AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN keep USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(whole)::HUGEINT AS nl FROM keep GROUP BY lang),
g AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN cnt USING (lang, source) GROUP BY ALL
),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.whole + 2)) // (l.nl + 2 * l.v) AS q
  FROM g JOIN l USING (lang) JOIN keep k USING (lang) LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

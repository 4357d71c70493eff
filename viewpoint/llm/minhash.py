"""MinHash near-dedup: a signature-coordinate inverted join with prefix and skip merging."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewpoint.llm.common import Powers, chunks, components, materialize, shingle_sets, split_join, text_bytes

#: Signature coordinates. Shingle hashes are dealt to as many bins by value; a
#: coordinate is the smallest hash of its bin.
BINS = 96
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Standard deviations by which the match threshold lies below the expected
#: number of equal coordinates at the link threshold: a miss has odds under 1e-6.
SIGMAS = 5.0
#: Bins of the finer sketch that is merged after the signature, a byte a bin; a
#: multiple of BINS, so that the signature's coordinates can be read off it.
FINE = 6 * BINS
#: Members of a posting list that one task compares with as many others.
BLOCK = 1024
_U = np.uint64


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A byte for each of FINE bins: 0 where ``hashes`` (sorted) has none, else from the smallest."""
    b = ((hashes >> _U(32)) * _U(FINE)) >> _U(32)
    first = np.ones(len(b), dtype=bool)
    first[1:] = b[1:] != b[:-1]
    out = np.zeros(FINE, dtype=np.uint8)
    out[b[first].astype(np.int64)] = hashes[first] % _U(255) + _U(1)
    return out


def coarse(fine: np.ndarray) -> np.ndarray:
    """The sketches of BINS bins: the first byte in each run of fine bins."""
    runs = fine.reshape(len(fine), BINS, -1)
    return np.take_along_axis(runs, (runs != 0).argmax(axis=2)[:, :, None], axis=2)[:, :, 0]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, d1, d2, sig, sketch): number of distinct shingles, a 128-bit
    digest of the shingle set, the MinHash signature, as the sorted hashes that
    are the smallest of their bin (which names the coordinate and its value),
    and the byte sketch of FINE bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Powers()
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for part in chunks([len(t or b"") for t in texts], 1 << 21):
                sets = shingle_sets(texts[part], table)
                digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64) for s in sets]
                sigs = []
                for s in sets:
                    b = ((s >> _U(32)) * _U(BINS)) >> _U(32)
                    sigs.append(s[np.concatenate([[True], b[1:] != b[:-1]])].view(np.int64) if len(s) else s.view(np.int64))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(part.start, part.stop - part.start),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "d1": pa.array([int(d[0]) for d in digests], pa.int64()),
                        "d2": pa.array([int(d[1]) for d in digests], pa.int64()),
                        "sig": pa.array(sigs, pa.list_(pa.int64())),
                        "sketch": pa.array([sketch(s).tobytes() for s in sets], pa.binary()),
                    }
                )

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, sig array<bigint>, sketch binary")


def match_threshold(size: Column, n: Column) -> Column:
    """Equal coordinates that a pair must have, given how many one side has and
    its number of shingles. Coordinates are drawn from the union, of n / j
    shingles at most, without replacement."""
    j = PERCENT / 100
    spread = SIGMAS * math.sqrt(j * (1 - j)) * F.sqrt(size * (1 - j * size / n))
    return F.greatest(F.lit(1), F.floor(size * j - spread).cast("int"))


def candidates(reps: DataFrame) -> DataFrame:
    """(id, n, t, sig, prefix) of the documents that can have a partner at all.

    Coordinates are ordered by how many documents have them, rarest first. A
    pair shares at least t coordinates, so it shares one of the first
    len - t + 1 of either side; those that no other document has come first
    and need no posting, the frequent ones at the end are skipped."""
    post = reps.select("id", "n", F.size("sig").alias("size"), F.explode("sig").alias("h"))
    often = post.groupBy("h").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = split_join(post, often, "h")
    doc = shared.groupBy("id", "n", "size").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("c"))
    doc = doc.withColumn("t", match_threshold(F.col("size"), F.col("n"))).where(F.size("c") >= F.col("t"))
    return doc.select(
        "id", "n", "t",
        F.transform("c", lambda x: x["h"]).alias("sig"),
        F.transform(F.slice("c", F.lit(1), F.size("c") - F.col("t") + 1), lambda x: x["h"]).alias("prefix"),
    )


def size_ok(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def pivot_pairs(cand: DataFrame) -> DataFrame:
    """(a, b): every posting with its list's smallest member, where the merged
    signatures reach the threshold. One pair a posting, however long the list."""
    post = cand.select("id", F.explode("prefix").alias("h"))
    pivot = post.groupBy("h").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    pairs = split_join(post, pivot, "h").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    left = cand.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("t").alias("ta"), F.col("sig").alias("sa"))
    right = cand.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("t").alias("tb"), F.col("sig").alias("sb"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(size_ok("na", "nb"))
    return both.where(F.size(F.array_intersect("sa", "sb")) >= F.greatest("ta", "tb")).select("a", "b")


def similar_rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): ids of the pairs of different components in one pair of blocks of
    a posting list whose sketches match often enough. Pairs that share a posting
    before this list's in their order belong to that one and are left to it.

    The bins that either has are a sample without replacement of the union, which
    at the link threshold has (n + n') / (1 + j) shingles; of them a share of j is
    equal, give or take SIGMAS deviations."""
    ids, n, match, comp, own = (t.column(k).to_numpy() for k in ("id", "n", "t", "comp", "own"))
    fine = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(ids), FINE)
    first, j = coarse(fine), PERCENT / 100
    before = t.column("early").combine_chunks()
    row, value = np.repeat(np.arange(len(ids)), before.value_lengths().to_numpy()), before.flatten().to_numpy().view(_U)
    early = np.zeros((len(ids), BINS), dtype=_U)
    early[row, (((value >> _U(32)) * _U(BINS)) >> _U(32)).astype(np.int64)] = value
    diagonal = t.column("i")[0] == t.column("j")[0]
    out_a, out_b = [], []
    for at in range(0, len(ids), 64):
        part = slice(at, at + 64)
        ok = (comp[part, None] != comp[None]) & (ids[part, None] < ids[None])
        ok &= 100 * np.minimum(n[part, None], n[None]) >= PERCENT * np.maximum(n[part, None], n[None])
        if not diagonal:
            ok &= own[part, None] != own[None]
        x, y = np.nonzero(ok)
        for k in range(0, len(x), 1 << 14):
            p, q = x[k : k + (1 << 14)] + at, y[k : k + (1 << 14)]
            near = ((first[p] == first[q]) & (first[p] != 0)).sum(axis=1) >= np.maximum(match[p], match[q])
            p, q = p[near], q[near]
            u, v = fine[p], fine[q]
            bins = ((u != 0) | (v != 0)).sum(axis=1)
            spread = np.sqrt(np.maximum(0, bins * (1 - bins * (1 + j) / (n[p] + n[q]))) * j * (1 - j))
            good = ((u == v) & (u != 0)).sum(axis=1) >= j * bins - SIGMAS * spread - 1
            p, q = p[good], q[good]
            mine = ~((early[p] == early[q]) & (early[p] != 0)).any(axis=1)
            out_a.append(ids[p[mine]])
            out_b.append(ids[q[mine]])
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (ids[:0], ids[:0])


def rest_pairs(cand: DataFrame, comp: DataFrame) -> DataFrame:
    """(a, b): the pairs of a posting list that the pivots left in different
    components and whose sketches match. Lists that lie in one component are
    done. The others are compared in blocks of BLOCK members: a long list becomes
    many tasks, none of which holds more than two blocks."""
    c = cand.join(comp.withColumnRenamed("node", "id").hint("merge"), "id", "left")
    c = c.select("id", "n", "t", "sketch", "prefix", F.coalesce("component_id", "id").alias("comp"))
    post = c.select("id", "comp", F.explode("prefix").alias("h"))
    lists = post.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    lists = lists.where("lo <> hi").select("h", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    full = split_join(c.select("id", "n", "t", "sketch", "comp", "prefix", F.posexplode("prefix").alias("k", "h")), lists, "h")
    full = full.withColumn("early", F.slice("prefix", F.lit(1), F.col("k"))).drop("prefix", "k")
    full = full.withColumn("own", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    full = full.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "t", "comp", "sketch", "early")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            a, b = similar_rows(pa.Table.from_batches(held))
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            names = np.stack([batch.column(x).to_numpy() for x in ("h", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if end > start:
                    if (name := names[start].tolist()) != key and held:
                        yield done()
                        held = []
                    key = name
                    held.append(batch.slice(start, end - start))
        if held:
            yield done()

    parts = int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return full.repartition(parts, "h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(src, dst): the pairs whose full shingle sets are similar enough. The
    texts are joined to the pairs by key; a pivot's many pairs are split by the
    adaptive skew join."""
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    both = pairs.join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    both = both.join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = Powers(), {}  # of the last left text: a pivot's pairs come in a row
        for batch in batches:
            keep = []
            for ta, tb in zip(text_bytes(batch.column("ta")), text_bytes(batch.column("tb")), strict=True):
                if ta not in known:
                    known = {ta: shingle_sets([ta], table)[0]}
                x, y = known[ta], shingle_sets([tb], table)[0]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common) and common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per distinct doc_id of ``docs`` (doc_id, text): doc_id,
    n_shingles (bigint), component_id (bigint) and kept (doc_id = component_id).

    Two documents are linked when their sets of 5-word shingles have a Jaccard
    similarity of at least PERCENT / 100; components are what links reach. Words
    are runs without ASCII white space, A-Z lower-cased; a text of under five
    words is one shingle. Documents without words or text have no shingle and
    no link. Rows that repeat a doc_id are one document, which has the links of
    all its texts and the largest n_shingles; rows with a null doc_id are left
    out. Other columns are ignored; an empty table gives no row.

    Documents with equal sets form a class with one representative. Their
    signatures are posted under each coordinate they share with others (see
    :func:`candidates`), each posting is first merged with its list's pivot, and
    what pivots leave apart is compared in blocks. Every link is confirmed on
    the full sets.
    """
    docs = docs.where(F.col("doc_id").isNotNull())
    signed = materialize(signatures(docs), "signatures")
    found = signed.where("n > 0")
    classes = found.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    reps = found.select(F.col("doc_id").alias("id"), "n", "d1", "d2", "sig").join(classes.withColumnRenamed("rep", "id").hint("merge"), ["id", "d1", "d2"])
    reps = reps.dropDuplicates(["id", "d1", "d2"]).select("id", "n", "sig")
    cand = candidates(reps).join(found.select(F.col("doc_id").alias("id"), "sketch").hint("merge"), "id")
    cand = materialize(cand.dropDuplicates(["id", "n", "sketch"]), "candidates")
    pairs = materialize(pivot_pairs(cand), "pivot_pairs")
    links = materialize(verified(pairs, docs), "pivot_links")
    rest = rest_pairs(cand, components(links)).join(pairs.hint("merge"), ["a", "b"], "left_anti")
    links = links.union(verified(materialize(rest, "rest_pairs"), docs))
    of_class = split_join(found.select("doc_id", "d1", "d2"), classes, "d1", "d2")
    twice = of_class.groupBy("doc_id").agg(F.min("rep").alias("src"), F.max("rep").alias("dst")).where("src < dst").select("src", "dst")
    comp = components(links.union(twice))
    named = classes.join(comp.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("d1", "d2", F.coalesce("component_id", "rep").alias("component_id"))
    out = signed.select("doc_id", "n", "d1", "d2").join(named.hint("merge"), ["d1", "d2"], "left")
    out = out.groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id"))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, md5(CASE WHEN len(ws) < 5 THEN list_aggregate(ws, 'string_agg', ' ')
    ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] END) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, to_id) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.to_id
),
m AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, m.doc_id = component_id AS kept
FROM m LEFT JOIN n USING (doc_id)
"""

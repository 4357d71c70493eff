"""Embedding near-dedup: spherical k-means cells and blocked cosine products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewpoint.llm.common import components, materialize, split_join

#: Vectors with a cosine of at least this are linked.
COSINE = 0.9
#: Vectors that the centroids are fitted on, at most: those with the smallest MD5 of vec_id.
MAX_FIT = 8192
ROUNDS = 12
#: Vectors of a cell that one task compares with as many others.
BLOCK = 1024


def usable(column: str) -> Column:
    """Whether a vector is there, without null or non-finite components and not zero."""
    x = F.col(column)
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaling by the largest component first keeps squares in range."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def cell_count(n: int) -> int:
    """Cells for n vectors: they grow with the square root, as do the vectors in one."""
    return max(4, math.ceil(math.sqrt(n) / 2))


def probe_count(cells: int) -> int:
    """Cells in which a vector is compared, its own included."""
    return min(cells, 4 + math.ceil(2 * math.sqrt(cells)))


def fit_cells(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Spherical k-means: unit centroids of the unit rows of ``sample``."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(sample))
    centroids = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        best = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, best, sample)
        norm = np.linalg.norm(sums, axis=1)
        centroids[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centroids


def assigned(reps: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """(id, w, unit, cells): the nearest ``probes`` cells of every vector, its own first."""
    shared = reps.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                u = unit(np.array(part.column("v").to_pylist(), dtype=np.float64))
                near = np.argsort(-(u @ c.T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_pydict(
                    {"id": part.column("id"), "w": part.column("w"), "unit": pa.array(list(u), pa.list_(pa.float64())), "cells": pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))}
                )

    return reps.mapInArrow(run, "id bigint, w bigint, unit array<double>, cells array<int>")


def block_pairs(vectors: DataFrame) -> DataFrame:
    """(cell, i, j, ...): what a task compares: members of a cell in block i with
    members in block j or guests in guest block j. Guests are vectors that have
    the cell among their nearest ones. The blocks of a large cell are spread
    over tasks, two blocks each, so no task holds a whole cell."""
    at = vectors.select("id", "w", "unit", "cells", F.posexplode("cells").alias("rank", "cell")).withColumn("guest", F.col("rank") > 0)
    sizes = at.groupBy("cell").agg(F.sum((~F.col("guest")).cast("long")).alias("m"), F.count(F.lit(1)).alias("n"))
    sizes = sizes.where("m > 0").select("cell", F.ceil(F.col("m") / BLOCK).alias("mb"), F.ceil((F.col("n") - F.col("m") + 1) / BLOCK).alias("gb"))
    at = at.join(F.broadcast(sizes), "cell")  # a row a cell: bounded by the number of centroids
    h = F.xxhash64("id")
    own = F.when(F.col("guest"), F.pmod(h, "gb")).otherwise(F.pmod(h, "mb"))
    at = at.withColumn("own", own)
    # Keys: kind 'm' for member blocks i <= j, kind 'g' for member block i and guest block j.
    key = F.when(
        F.col("guest"), F.expr("transform(sequence(0L, mb - 1), x -> named_struct('k', 'g', 'i', x, 'j', own))")
    ).otherwise(
        F.expr(
            "concat(transform(sequence(0L, mb - 1), x -> named_struct('k', 'm', 'i', least(own, x), 'j', greatest(own, x))),"
            " transform(sequence(0L, gb - 1), x -> named_struct('k', 'g', 'i', own, 'j', x)))"
        )
    )
    return at.withColumn("key", F.explode(key)).select("cell", "key.k", "key.i", "key.j", "own", "guest", "id", "w", "unit", "cells")


def found_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(src, dst, n): for dst = -1 the number of vectors linked to src in one
    task, else an edge. Per task the edges are a spanning forest of the links
    found there, at most one fewer than its vectors, never all pairs."""

    def compare(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        col = lambda name: t.column(name).to_numpy()
        ids, w, guest, own = col("id"), col("w"), col("guest"), col("own")
        cell, kind, i, j = (t.column(x)[0].as_py() for x in ("cell", "k", "i", "j"))
        u = np.stack(t.column("unit").to_numpy())
        cells = np.stack(t.column("cells").to_numpy())
        home, count, parent = cells[:, 0], np.zeros(len(ids), np.int64), np.arange(len(ids))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        edges_a, edges_b = [], []
        left = np.flatnonzero(~guest & ((own == i) | (kind == "g")))
        right = np.flatnonzero(guest) if kind == "g" else np.flatnonzero(own == j)
        for at in range(0, len(left), 256):
            p = left[at : at + 256]
            ok = u[p] @ u[right].T >= cosine
            if kind == "m":
                ok &= (ids[p, None] < ids[right][None]) if i == j else True
            x, y = np.nonzero(ok)
            a, b = p[x], right[y]
            if kind == "g":
                # Both find the pair if the member's list names the guest's home, too: the smaller cell counts it.
                both = (cells[a] == home[b][:, None]).any(axis=1)
                a, b = a[~both | (cell < home[b])], b[~both | (cell < home[b])]
            np.add.at(count, a, w[b])
            np.add.at(count, b, w[a])
            # Only pairs of different groups can add an edge.
            new = parent[a] != parent[b]
            for s, d in zip(a[new].tolist(), b[new].tolist(), strict=True):
                rs, rd = root(s), root(d)
                if rs != rd:
                    parent[max(rs, rd)] = min(rs, rd)
                    edges_a.append(ids[s])
                    edges_b.append(ids[d])
            for s in range(len(parent)):
                parent[s] = parent[parent[s]]
        some = np.flatnonzero(count)
        src = np.concatenate([ids[some], np.array(edges_a, dtype=np.int64)])
        dst = np.concatenate([np.full(len(some), -1), np.array(edges_b, dtype=np.int64)])
        n = np.concatenate([count[some], np.zeros(len(edges_a), np.int64)])
        return pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "n": pa.array(n, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            names = list(zip(*(batch.column(x).to_pylist() for x in ("cell", "k", "i", "j")), strict=True))
            cuts = [0, *[x for x in range(1, len(names)) if names[x] != names[x - 1]], len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if names[a] != key and rows:
                    yield compare(rows)
                    rows = []
                key = names[a]
                rows.append(batch.slice(a, b - a))
        if rows:
            yield compare(rows)

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = block_pairs(vectors).repartition(parts, "cell", "k", "i", "j").sortWithinPartitions("cell", "k", "i", "j")
    return keyed.mapInArrow(run, "src bigint, dst bigint, n bigint")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, max_fit: int = MAX_FIT) -> DataFrame:
    """One row per distinct vec_id of ``vectors`` (vec_id, embedding): vec_id,
    n_links (other vectors linked directly), component_id and kept (all bigint
    but the last). Links are the pairs found with a cosine of ``cosine`` or more
    in double precision, never others.

    Equal vectors are one class with a weight. Centroids are fitted on at most
    ``max_fit`` class representatives (smallest MD5 of the id); every class gets
    a home cell and is a guest in its next nearest cells, and a cell's members
    are compared with its members and guests. A pair is missed if neither's home
    is among the other's cells; the tests hold the recall against brute force.

    Null, zero and empty vectors and those with null or non-finite components
    have no link. Vectors of different lengths are never compared. Rows that
    repeat a vec_id count as one: a link of either is its link, its n_links adds
    up. Rows with null vec_id are left out, other columns are ignored.
    """
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    good = materialize(rows.where(usable("v")).select("id", "v", F.size("v").alias("dim")), "vectors")
    classes = good.groupBy("v", "dim").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w"))
    classes = materialize(classes, "vector_classes")
    parts = []
    for dim in sorted(r["dim"] for r in good.select("dim").distinct().collect()):
        reps = classes.where(F.col("dim") == dim).select(F.col("rep").alias("id"), "w", "v")
        fitted = [r["v"] for r in reps.orderBy(F.md5(F.col("id").cast("string")), "id").limit(max_fit).select("v").collect()]
        cells = cell_count(reps.count())
        centroids = fit_cells(unit(np.array(fitted, dtype=np.float64)), cells)
        near = materialize(assigned(reps, centroids, probe_count(len(centroids))), "cells")
        parts.append(found_links(near, cosine))
    spark = vectors.sparkSession
    links = spark.createDataFrame([], "src bigint, dst bigint, n bigint")
    for p in parts:
        links = links.union(p)
    links = materialize(links, "links")
    counts = links.where("dst = -1").groupBy(F.col("src").alias("rep")).agg(F.sum("n").alias("n"))
    member = good.join(classes.hint("merge"), ["v", "dim"]).select("id", "rep", "w")
    twice = member.groupBy("id").agg(F.min("rep").alias("src"), F.max("rep").alias("dst")).where("src < dst").select("src", "dst")
    comp = components(links.where("dst <> -1").select("src", "dst").union(twice)).withColumnRenamed("node", "rep")
    member = split_join(split_join(member, counts, "rep", how="left"), comp, "rep", how="left")
    member = member.groupBy("id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.min(F.coalesce("component_id", "rep")).alias("component_id"))
    out = rows.select("id").distinct().join(member.hint("merge"), "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= {COSINE}),
r(vec_id, to_id) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.to_id),
c AS (SELECT vec_id, min(to_id) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id
"""

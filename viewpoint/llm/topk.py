"""Exact top-k by inner product over a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewpoint.llm.common import materialize

#: Components are whole numbers: floor(SCALE * x).
SCALE = 256
K = 5
#: Components are smaller than this.
LIMIT = 2.0**20
#: Bits of the approximation of each component.
BITS = 6
#: Vectors, and queries, of one block.
DATA_BLOCK, QUERY_BLOCK = 2048, 256


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(id, v): floor(256 * x) of every component; vectors that are null or hold
    null or non-finite components are left out. A finite component of LIMIT or
    more raises an error, as 64 bits may not hold its products."""

    def whole(c: Column) -> Column:
        too_large = F.raise_error(F.lit("a vector component of 2 ** 20 or more")).cast("bigint")
        return F.when(F.abs(c) < F.lit(LIMIT), F.floor(c * F.lit(float(SCALE))).cast("bigint")).otherwise(too_large)

    x = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    x = x.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    return x.select("id", F.transform("v", whole).alias("v"))


def vector_classes(whole: DataFrame, k: int) -> DataFrame:
    """(rep, v, ids): one row per distinct vector with the k + 1 smallest ids
    that have it, which is all that k results without the query itself can use.
    A hot vector's ids are narrowed in 64 parts before they meet."""
    near = whole.withColumn("r", F.row_number().over(Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id"))).where(F.col("r") <= k + 1)
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    return near.groupBy("v").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids"))


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


def approximation_file(classes: DataFrame) -> DataFrame:
    """(block, reps, sizes, low, width, approx): the quantised cells of up to
    DATA_BLOCK vectors a row. Each component's range in the block is cut into
    2 ** BITS equal cells; ``approx`` has one byte a component, the cell."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DATA_BLOCK):
                part = batch.slice(at, DATA_BLOCK)
                v = matrix(part.column("v"), part.num_rows)
                low = v.min(axis=0)
                width = np.maximum(1, -(-(v.max(axis=0) - low + 1) // (1 << BITS)))
                yield pa.RecordBatch.from_pydict(
                    {
                        "reps": pa.array([part.column("rep").to_numpy()], pa.list_(pa.int64())),
                        "sizes": pa.array([part.column("size").to_numpy()], pa.list_(pa.int64())),
                        "low": pa.array([low], pa.list_(pa.int64())),
                        "width": pa.array([width], pa.list_(pa.int64())),
                        "approx": pa.array([((v - low) // width).astype(np.uint8).tobytes()], pa.binary()),
                    }
                )

    schema = "reps array<bigint>, sizes array<bigint>, low array<bigint>, width array<bigint>, approx binary"
    rows = classes.select("rep", "v", F.size("ids").cast("bigint").alias("size")).mapInArrow(pack, schema)
    return rows.withColumn("block", F.monotonically_increasing_id())


def query_blocks(queries: DataFrame) -> DataFrame:
    """(queries, q_reps, q, least): up to QUERY_BLOCK query vectors a row;
    ``least`` is the score that a result must reach, as far as is known."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                yield pa.RecordBatch.from_pydict(
                    {
                        "queries": pa.array([part.column("id").to_numpy()], pa.list_(pa.int64())),
                        "q_reps": pa.array([part.column("rep").to_numpy()], pa.list_(pa.int64())),
                        "q": pa.array([matrix(part.column("v"), part.num_rows).astype("<i8").tobytes()], pa.binary()),
                        "least": pa.array([part.column("least").to_numpy()], pa.list_(pa.int64())),
                    }
                )

    return queries.mapInArrow(pack, "queries array<bigint>, q_reps array<bigint>, q binary, least array<bigint>").withColumn("q_block", F.monotonically_increasing_id())


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of ``q`` with any vector of each cell."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    most = int(np.abs(q).max(initial=1)) * max(int(np.abs(low).max(initial=1)), int(np.abs(high).max(initial=1))) * q.shape[1]
    if most < 1 << 53:  # doubles hold these integers exactly, and multiply faster
        up, down, low, high = (x.astype(np.float64) for x in (up, down, low, high))
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    return least.astype(np.int64), most.astype(np.int64)


def scan(file: DataFrame, queries: DataFrame, k: int, candidates: bool) -> DataFrame:
    """One scan of the approximations with every query: (query_id, rep, bound).
    Without ``candidates`` the bounds are each block's k largest lower bounds;
    with it they are all upper bounds that reach the query's ``least``. The grid
    of query blocks and file blocks is dealt out by rows and columns, as many
    as there are blocks, so a task gets a few pairs of blocks."""
    n_q, n_b = max(1, queries.count()), max(1, file.count())
    spark = file.sparkSession
    row, column = F.pmod(F.xxhash64("q_block"), F.lit(n_q)), F.pmod(F.xxhash64("block"), F.lit(n_b))
    left = file.withColumn("d", column).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    right = queries.withColumn("r", row).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(n_b - 1))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_q * n_b // 16)
    pairs = left.repartition(parts, "r", "d").join(right.repartition(parts, "r", "d").hint("shuffle_hash"), ["r", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                reps, sizes, low, width = (np.array(r[x], dtype=np.int64) for x in ("reps", "sizes", "low", "width"))
                ids, q_reps, floor = (np.array(r[x], dtype=np.int64) for x in ("queries", "q_reps", "least"))
                q = np.frombuffer(r["q"], dtype="<i8").reshape(len(ids), -1)
                if q.shape[1] != len(low):
                    continue
                at = low + np.frombuffer(r["approx"], dtype=np.uint8).reshape(len(reps), -1).astype(np.int64) * width
                least, most = bounds(q, at, at + width - 1)
                # How many results a class can give to a query: its ids without the query's own.
                give = sizes[None] - (reps[None] == q_reps[:, None])
                if candidates:
                    x, y = np.nonzero((most >= floor[:, None]) & (give > 0))
                    out = ids[x], reps[y], most[x, y]
                else:
                    order = np.argsort(-least, axis=1, kind="stable")[:, : k + 1]
                    x = np.repeat(np.arange(len(ids)), order.shape[1])
                    y = order.ravel()
                    n = np.minimum(give[x, y], k)
                    out = np.repeat(ids[x], n), np.repeat(reps[y], n), np.repeat(least[x, y], n)
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "rep", "bound"), out, strict=True)})

    return pairs.mapInArrow(run, "query_id bigint, rep bigint, bound bigint")


def kth(rows: DataFrame, value: str, k: int) -> DataFrame:
    """(query_id, least): the k-th largest value of each query that has k."""
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(value)))).where(F.col("r") == k)
    return top.select("query_id", F.col(value).alias("least"))


def exact_top_k(vectors: DataFrame, is_query: Column | None = None, k: int = K) -> DataFrame:
    """query_id, rank (int, from 1), vec_id and score of the k highest integer
    inner products of every query with all other rows of ``vectors`` (vec_id,
    embedding), ties to the smaller vec_id; fewer rows if there are fewer others.

    Components x become floor(256 * x). Equal vectors are one class. A first
    scan of the approximation file gives each query the k-th largest lower
    bound; a second lists the classes whose upper bound reaches it. The 2k with
    the largest upper bounds are read and scored exactly, and of the rest only
    those whose upper bound reaches the k-th exact score: no other can be a result.

    Queries are the rows for which ``is_query`` (default: vec_id divisible by 50)
    holds. Vectors that are null, or hold null or non-finite components,
    take no part; nor do rows with null vec_id. Finite components of 2 ** 20 and
    more, whose products 64 bits may not hold, raise an error. An empty vector has no product with
    others of length 0 but 0. Vectors of other lengths than the query's are no
    candidates. Of rows that repeat a vec_id the one with the smallest components
    counts. Other columns are ignored.
    """
    whole = whole_vectors(vectors).groupBy("id").agg(F.min("v").alias("v")).where(F.size("v") > 0)
    dims = [r[0] for r in whole.select(F.size("v").alias("n")).distinct().collect()]
    whole = materialize(whole, "whole_vectors")
    out = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    for n in sorted(dims):
        out = out.union(_top_k(whole.where(F.size("v") == n), is_query, k))
    return out


def _top_k(whole: DataFrame, is_query: Column | None, k: int) -> DataFrame:
    classes = materialize(vector_classes(whole, k), "vector_classes")
    file = materialize(approximation_file(classes), "approximations")
    asked = whole.withColumn("vec_id", F.col("id")).where(F.col("vec_id") % 50 == 0 if is_query is None else is_query)
    asked = asked.join(classes.select("v", "rep").hint("merge"), "v").select("id", "rep", "v")
    asked = materialize(asked, "queries")
    none = F.lit(-(1 << 62)).alias("least")
    first = scan(file, materialize(query_blocks(asked.select("*", none)), "query_blocks"), k, candidates=False)
    least = kth(first, "bound", k)
    asked2 = asked.join(least.withColumnRenamed("query_id", "id").hint("merge"), "id", "left").select("id", "rep", "v", F.coalesce("least", F.lit(-(1 << 62))).alias("least"))
    listed = materialize(scan(file, materialize(query_blocks(asked2), "query_blocks"), k, candidates=True), "candidates")

    def read(rows: DataFrame) -> DataFrame:
        """Exact scores, one row per result that a class gives."""
        q = asked.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
        x = rows.join(classes.hint("merge"), "rep").join(q.hint("merge"), "query_id")
        s = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda a, b: a + b)
        return x.select("query_id", s.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")

    listed = listed.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "rep")))
    begun = materialize(read(listed.where(F.col("place") <= 2 * k)), "first_read")
    rest = listed.where(F.col("place") > 2 * k).join(kth(begun, "score", k).hint("merge"), "query_id", "left")
    rest = read(rest.where("least is null or bound >= least").drop("least"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return begun.union(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""

"""CSV files read in parallel although their quoted fields hold line breaks.

Spark hands out byte ranges (blocks) of a file, line by line. Whether a line starts inside
quotes depends on all the quotes before it, so a block is first summarised as an automaton of two states: for a
start outside and for one inside quotes, whether it ends inside, and how many records
start in it. A prefix pass over the blocks of each file, a row each, gives every block's true state and its
first record's place; then all blocks are cut into records side by side, and the few
records that cross blocks are put together.

Fields may hold anything when quoted, with quotes doubled (RFC 4180, as pandas writes them); an unquoted field has no quote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewpoint.session import materialize

#: Blocks whose states go to every task, at about 200 bytes each; with more, lines and states meet in a sorted join.
BROADCAST_BLOCKS = 1 << 18

SUMMARY = "file string, block bigint, odd int, starts0 bigint, starts1 bigint"
PIECE = "file string, block bigint, record bigint, whole boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, id, value): the lines of each block in their order, ids rising."""
    text = spark.read.option("lineSep", "\n").text(path)
    block = F.col("_metadata.file_block_start").cast("bigint").alias("block")
    return text.select(F.col("_metadata.file_path").alias("file"), block, F.monotonically_increasing_id().alias("id"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The stretches of a batch that lie in one block."""
    if not batch.num_rows:
        return
    name, block = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
    place = name.indices.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero((np.diff(place) != 0) | (np.diff(block) != 0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield (name.dictionary[int(place[a])].as_py(), int(block[a])), batch.slice(a, b - a)


def _quotes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Quotes of each line, modulo 2, and whether it is blank."""
    odd = pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64) % 2
    blank = pc.or_(pc.equal(values, ""), pc.equal(values, "\r")).to_numpy(zero_copy_only=False)
    return odd, blank


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, odd, starts = None, 0, [0, 0]

    def row() -> pa.RecordBatch:
        cols = [pa.array([here[0]], pa.string()), pa.array([here[1]], pa.int64()), pa.array([odd], pa.int32()), *[pa.array([s], pa.int64()) for s in starts]]
        return pa.RecordBatch.from_arrays(cols, names=["file", "block", "odd", "starts0", "starts1"])

    for batch in batches:
        for key, run in _runs(batch):
            if key != here:
                if here is not None:
                    yield row()
                here, odd, starts = key, 0, [0, 0]
            flips, blank = _quotes(run.column("value"))
            before = (odd + np.cumsum(flips) - flips) % 2
            starts = [starts[s] + int(np.count_nonzero((before == s) & ~blank)) for s in (0, 1)]
            odd = (odd + int(flips.sum())) % 2
    if here is not None:
        yield row()


class _Cutter:
    """Cuts the lines of one block into records, given the block's true start."""

    def __init__(self, state: int, first: int) -> None:
        self.inside, self.record = state, first - 1
        self.lines: list[str] = []  # of the record that is open or may go on
        self.begun = False  # whether it starts in this block

    def cut(self, run: pa.RecordBatch) -> list[tuple[int, bool, str]]:
        """(record, whole, text) of the records that are known to end."""
        flips, blank = _quotes(run.column("value"))
        before = (self.inside + np.cumsum(flips) - flips) % 2
        out = []
        keep = np.flatnonzero((before == 1) | ~blank)
        lines = run.column("value").take(pa.array(keep)).to_pylist()
        starts = np.flatnonzero(before[keep] == 0).tolist()
        self.lines += lines[: starts[0]] if starts else lines
        for a, b in zip(starts, [*starts[1:], len(lines)][: len(starts)], strict=True):
            # Before the next one starts, a record that has started here is complete.
            out += self.rest(True)
            self.record, self.begun, self.lines = self.record + 1, True, lines[a:b]
        self.inside = (self.inside + int(flips.sum())) % 2
        return out

    def rest(self, closed: bool) -> list[tuple[int, bool, str]]:
        return [(self.record, self.begun and closed, "\n".join(self.lines))] if self.lines else []


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, cutter = None, None

    def rows(found: list[tuple[int, bool, str]]) -> pa.RecordBatch:
        n = len(found)
        record, whole, text = zip(*found, strict=True) if n else ((), (), ())
        cols = [pa.array([here[0]] * n, pa.string()), pa.array([here[1]] * n, pa.int64()), pa.array(record, pa.int64()), pa.array(whole, pa.bool_()), pa.array(text, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=["file", "block", "record", "whole", "text"])

    for batch in batches:
        for key, run in _runs(batch):
            if key != here:
                if here is not None:
                    yield rows(cutter.rest(cutter.inside == 0))
                here, cutter = key, _Cutter(run.column("state")[0].as_py(), run.column("first")[0].as_py())
            yield rows(cutter.cut(run))
    if here is not None:
        yield rows(cutter.rest(cutter.inside == 0))


def csv_records(spark: SparkSession, path: str, broadcast_blocks: int = BROADCAST_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(records, files) of the CSV files at ``path``.

    records: (file, record, text), the text of every record and its place in its
    file from 0, the header's; blank lines between records are skipped, line ends inside
    fields are ``\\n``. files: (file, n), the records of each file with its header.
    The pieces of records are written to the shared folder once, so they are not cut again for every use.
    A quote that never closes makes all that follows in its file one record."""
    blocks = _lines(spark, path).select("file", "block", "value").mapInArrow(_summaries, SUMMARY)
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("state", (F.coalesce(F.sum("odd").over(order), F.lit(0)) % 2).cast("int"))
    blocks = blocks.withColumn("starts", F.when(F.col("state") == 0, F.col("starts0")).otherwise(F.col("starts1")))
    blocks = blocks.select("file", "block", "state", "starts", F.coalesce(F.sum("starts").over(order), F.lit(0)).cast("bigint").alias("first"))
    blocks = materialize(blocks, "csv_blocks")
    files = blocks.groupBy("file").agg(F.sum("starts").alias("n"))

    states = blocks.select("file", "block", "state", "first")
    if blocks.count() <= broadcast_blocks:
        # The join keeps the order in which a task reads its lines.
        lines = _lines(spark, path).join(F.broadcast(states), ["file", "block"])
    else:
        lines = _lines(spark, path).join(states.hint("merge"), ["file", "block"]).sortWithinPartitions("file", "block", "id")
    pieces = materialize(lines.select("file", "block", "value", "state", "first").mapInArrow(_pieces, PIECE), "csv_pieces")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n")
    crossing = pieces.where("not whole").groupBy("file", "record").agg(joined.alias("text"))
    records = pieces.where("whole").select("file", "record", "text").unionByName(crossing)
    text = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    return records.select("file", "record", F.regexp_replace(text, "\r\\z", "").alias("text")), files


def csv_cells(records: DataFrame) -> tuple[DataFrame, int]:
    """(file, at, names, cells) of :func:`csv_records`, and the columns of the widest header. ``at`` is the place after
    the header, ``names`` the file's header; files may order their columns differently.
    Cells beyond a file's header have no name and are left out; empty cells are NULL."""

    def cells(rows: DataFrame, width: int) -> DataFrame:
        schema = ", ".join(f"c{i} string" for i in range(width))
        options = {"quote": '"', "escape": '"', "maxColumns": str(width + 1), "maxCharsPerColumn": "-1"}
        x = F.from_csv("text", schema, options)
        return rows.select("file", "record", F.explode(F.array(x)).alias("x")).select("file", "record", F.array(*[F.col(f"x.c{i}") for i in range(width)]).alias("cells"))

    headers = records.where("record = 0")
    # A header has one column more than commas at most.
    most = headers.agg(F.max(F.length("text") - F.length(F.replace("text", F.lit(","), F.lit(""))))).first()[0]
    if most is None:
        return records.select("file", F.col("record").alias("at"), F.array().cast("array<string>").alias("names"), F.array().cast("array<string>").alias("cells")).where("false"), 0
    width = most + 1
    names = materialize(cells(headers, width).select("file", F.col("cells").alias("names")), "csv_headers")
    rows = cells(records.where("record > 0"), width).join(names, "file")
    return rows.select("file", (F.col("record") - 1).alias("at"), "names", "cells"), width

"""Readers and writers for the evaluation tables (explicit schemas, no inference).

Layout on disk: one directory per model (``{root}/{model}/preds.csv``) as the
reference writes it, or Parquet partitioned by ``model`` (and ``exp``) - the
preferred format, which gives partition pruning on model and experiment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from viewpoint import schemas
from viewpoint.operators import lexicon as LX
from viewpoint.sources.csvparts import csv_cells, csv_records


def _csv_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows (file, at, names, cells) and files (file, n) of CSV files, whatever their
    size and width: see :mod:`viewpoint.sources.csvparts`."""
    records, files = csv_records(spark, path)
    return csv_cells(records)[0], files.select("file", (F.col("n") - 1).alias("n"))


def _cell(name: str) -> Column:
    """The record's value in the named column, NULL if the file has none."""
    return F.get("cells", F.array_position("names", F.lit(name)).cast("int") - 1)


def _numbered(rows: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` plus ``row_id``: the row's place among all rows of its ``keys``
    (columns of ``files``), files in the order of their names, records in the order of
    the file. It does not depend on file sizes or on how Spark splits the work."""
    order = [F.substring_index("file", "/", -1), F.col("file")]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", *keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return rows.join(files, "file").withColumn("row_id", F.col("_before") + F.col("at")).drop("_before")


def read_topics_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1: topic table from one CSV file written by pandas or a folder of them.
    A ``row_id`` column of the files is the key; without one, rows are numbered
    in file order (see :func:`_numbered`)."""
    rows = _numbered(*_csv_rows(spark, path), [])
    key = F.coalesce(_cell("row_id").try_cast("bigint"), F.col("row_id"))
    return rows.select(key.alias("row_id"), *[_cell(c).alias(c) for c in schemas.TOPIC_COLS])


def model_key(path_or_name: Column) -> Column:
    """A9: result key of a model path: strip trailing '/', keep the basename."""
    return F.substring_index(F.regexp_replace(path_or_name, "/+$", ""), "/", -1)


def read_model_files(
    spark: SparkSession, root: str, models: list[str] | None = None, file_name: str = "preds.csv", schema: StructType = schemas.PREDICTIONS
) -> DataFrame:
    """A2/A3: ``{root}/{model}/{file_name}`` of all models, or of those named, in
    one scan: (model, the schema's columns, row_id). ``model`` is the folder's
    name, ``row_id`` the file's row_id column or the record's place in it, as of
    :func:`read_topics_csv`; columns that a file lacks are NULL."""
    names = [m.rstrip("/").rsplit("/", 1)[-1] for m in models] if models is not None else ["*"]
    paths = f"{root}/{{{','.join(names)}}}/{file_name}" if len(names) > 1 else f"{root}/{names[0]}/{file_name}"
    rows, files = _csv_rows(spark, paths)
    rows = _numbered(rows, files.withColumn("model", F.url_decode(F.replace(F.element_at(F.split("file", "/"), -2), F.lit("+"), F.lit("%2B")))), ["model"])
    key = F.coalesce(_cell("row_id").try_cast("bigint"), F.col("row_id"))
    return rows.select("model", *[_cell(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields], key.alias("row_id"))


def read_row_metrics_csv(spark: SparkSession, root: str, models: list[str] | None = None, reverse: bool = False, full: bool = False) -> DataFrame:
    """A3: the row metrics of all models, as the reference names their files."""
    return read_model_files(spark, root, models, f"preds{'_rev' * reverse}{'_full' * full}_bmetrics.csv", schemas.ROW_METRICS)


def read_predictions_parquet(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    """A2 (preferred layout): Parquet partitioned by ``model``; selecting
    models is a partition filter."""
    df = spark.read.parquet(path)
    return df.filter(F.col("model").isin(models)) if models else df


def run_name(reverse: bool = False, full: bool = False) -> str:
    """Partition value of a run: reversed passages, full predictions, both or neither."""
    return "_".join(["rev"] * reverse + ["full"] * full) or "plain"


def read_row_metrics(spark: SparkSession, path: str, reverse: bool = False, full: bool = False) -> DataFrame:
    """The row metrics that :func:`write_row_metrics` has written for one run."""
    return spark.read.parquet(path).where(F.col("run") == run_name(reverse, full)).drop("run")


def read_summary(spark: SparkSession, path: str, metrics: list[str], reverse: bool = False, full: bool = False) -> DataFrame:
    """A4: summary table (model, exp, metric, metric_ci ...) of one run."""
    schema = StructType([*schemas.summary(metrics).fields, StructField("run", StringType())])
    return spark.read.schema(schema).option("header", True).csv(path).where(F.col("run") == run_name(reverse, full)).drop("run")


def read_lexicon_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A5: ``term \\t v \\t a \\t d`` without header, one file or several.

    Returns (lexicon, rejected): the lexicon has one row per term with scores as
    integer thousandths; a repeated term keeps its last line, files in the order
    of their names. Lines that do not have exactly four fields with numeric scores
    are returned in ``rejected`` instead of failing the load.
    """
    # Within a split, ids rise with the lines.
    line = F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("id"))
    lines = spark.read.text(path).select(line.alias("line_no"), F.split("value", "\t").alias("f"))
    parsed = lines.select(
        "line_no",
        F.size("f").alias("n"),
        F.get("f", 0).alias("term"),
        *[F.get("f", i).try_cast("double").alias(c) for i, c in ((1, "v"), (2, "a"), (3, "d"))],
    )
    ok = (F.col("n") == 4) & F.col("v").isNotNull() & F.col("a").isNotNull() & F.col("d").isNotNull()
    good = parsed.filter(ok).select(
        "term", "line_no", *[F.round(F.col(c) * 1000).cast("int").alias(c) for c in ("v", "a", "d")]
    )
    return LX.dedupe_last(good), parsed.filter(~ok).select("line_no", "n", "term")


def _replace_partitions(df: DataFrame, path: str, by: list[str], fmt: str) -> None:
    """Write ``df``, replacing the partitions it has rows of and no others; the
    session's settings stay as they are."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header as pandas writes them: quotes doubled, white space kept, a
    field with a line break in quotes. The readers of this module give them back; '' comes back as NULL."""
    same = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(header=True, **same).csv(path)


def write_experiment(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A6: checkpointed prediction sink. Rows are (model, row_id, exp, ...); a
    rerun of one experiment replaces only its own ``model=/exp=`` partition."""
    _replace_partitions(df, path, ["model", "exp"], fmt)


def write_row_metrics(df: DataFrame, path: str, reverse: bool = False, full: bool = False, fmt: str = "parquet") -> None:
    """A7: row metrics, partitioned by model and run; the reference's file-name
    flags become columns. Runs of a model lie side by side, a rerun replaces its own."""
    out = df.withColumn("reverse", F.lit(reverse)).withColumn("full_pred", F.lit(full)).withColumn("run", F.lit(run_name(reverse, full)))
    _replace_partitions(out, path, ["model", "run"], fmt)


def write_summary(df: DataFrame, path: str, reverse: bool = False, full: bool = False, fmt: str = "csv") -> None:
    """A8: the per (model, exp) summary (a small table), partitioned by run."""
    _replace_partitions(df.withColumn("run", F.lit(run_name(reverse, full))), path, ["run"], fmt)


def with_raw_response(df: DataFrame, raw_col: str = "raw", pred_col: str = "pred") -> DataFrame:
    """A10: keep the decoded raw response next to the parsed text."""
    from viewpoint.operators.prompts import response_text

    return df.withColumn("raw_response", F.col(raw_col).cast("string")).withColumn(pred_col, response_text(F.col(raw_col)))

"""Tables that are written run by run, each run visible as a whole or not at all.

A run writes its rows to a folder of its own, ``{path}/data/run=<id>``, and then publishes a
manifest, ``{path}/_runs/<id>.json``, by a rename: a small file that names the partitions
(for example model and experiment) the run has written. Readers take every partition from its latest published
run, so a writer that dies leaves the old rows readable, writers of different partitions do not
meet, and what is published need not be computed again.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MANIFEST = "run string, at bigint, schema string, parts array<map<string,string>>"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _publish(spark: SparkSession, path: str, run: str, manifest: dict) -> None:
    """The manifest appears under its name complete or not at all."""
    fs, jpath = _fs(spark, path)
    draft, final = jpath(f"{path}/_runs/_{run}.draft"), jpath(f"{path}/_runs/{run}.json")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    if not fs.rename(draft, final):
        raise OSError(f"could not publish run {run} of {path}")


def write_run(df: DataFrame, path: str, by: list[str]) -> str:
    """Writes ``df`` as one run, partitioned by the columns ``by``, and returns its id. The partitions
    that ``df`` has rows of are replaced by this run's as soon as it returns, all others stay.
    NULL is a partition of its own. Partitions are listed on the driver, as Spark does itself on reading."""
    spark = df.sparkSession
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    data = f"{path}/data/run={run}"
    df.write.partitionBy(*by).parquet(data)
    schema = StructType([*[f for f in df.schema.fields if f.name not in by], *[df.schema[c] for c in by]])
    parts = spark.read.schema(schema).parquet(data).select(*[F.col(c).cast("string") for c in by]).distinct()
    parts = [{c: r[c] for c in by} for r in parts.collect()]
    _publish(spark, path, run, {"run": run, "at": time.time_ns(), "schema": schema.json(), "parts": parts})
    return run


def committed(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """(by..., run): the partitions of published runs as strings, each with its latest run; none before the first run."""
    fs, jpath = _fs(spark, path)
    if not fs.globStatus(jpath(f"{path}/_runs/[0-9]*.json")):
        return spark.createDataFrame([], ", ".join([*[f"`{c}` string" for c in by], "run string"]))
    manifests = spark.read.schema(MANIFEST).json(f"{path}/_runs")
    parts = manifests.select("run", F.explode("parts").alias("p")).select("run", *[F.element_at("p", F.lit(c)).alias(c) for c in by])
    return parts.groupBy(*by).agg(F.max("run").alias("run"))


def read_runs(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """The table as of the runs published by now. Its columns are those of the latest run; a partition written
    before a column existed has NULL there. Before the first run there is no table and this raises."""
    last = spark.read.schema(MANIFEST).json(f"{path}/_runs").orderBy(F.desc("run")).select("schema").first()
    schema = StructType.fromJson(json.loads(last[0]))
    stored = spark.read.schema(StructType([*schema.fields, StructField("run", StringType())])).option("basePath", f"{path}/data").parquet(f"{path}/data")
    # A row per partition, as many as the folders that Spark lists on the driver anyway.
    now = committed(spark, path, by).select("run", *[F.col(c).alias(f"_{c}") for c in by])
    same = stored["run"] == now["run"]
    for c in by:
        same = same & stored[c].cast("string").eqNullSafe(now[f"_{c}"])
    return stored.join(F.broadcast(now), same, "left_semi").select(*schema.names)


def pending(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """The rows of ``df`` whose partition no published run has: what a resumed job still has to do."""
    done = committed(df.sparkSession, path, by).select(*[F.col(c).alias(f"_{c}") for c in by])
    same = None
    for c in by:
        one = df[c].cast("string").eqNullSafe(done[f"_{c}"])
        same = one if same is None else same & one
    return df.join(F.broadcast(done), same, "left_anti")

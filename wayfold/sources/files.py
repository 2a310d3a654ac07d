"""Scans and sinks: per-agent Parquet folders, partitioned tables, CSV, panels wide and long, file counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_agents(spark: SparkSession, path: str, subpop: int | None = None) -> DataFrame:
    """All agents' Parquet files below path; subpop and agent_id come from names like subpop_3_agent_17.parquet.

    A subpopulation is picked by file pattern, so other files are never listed as input.
    """
    pattern = f"*subpop_{subpop}_agent_*" if subpop is not None else "*subpop_*_agent_*"
    name = F.col("_metadata.file_path")
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(path)
    return rows.select("*", F.regexp_extract(name, r"subpop_(\d+)_agent_", 1).cast("int").alias("subpop"), F.regexp_extract(name, r"_agent_(\d+)", 1).cast("int").alias("agent_id"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """A Parquet table; all models, states and results are kept as such tables."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_results(results: DataFrame, path: str, key: str = "agent", buckets: int = 64, mode: str = "errorifexists") -> None:
    """Results (a row for each agent and run) as a table partitioned by a hash of the key, in place of a file for each task's agent."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    results.withColumn("bucket", bucket).repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def read_results(spark: SparkSession, path: str, keys: list[int] | None = None, key: str = "agent", buckets: int = 64) -> DataFrame:
    """What write_results() wrote; for given keys only their buckets are read."""
    rows = spark.read.parquet(path)
    if keys is not None:
        wanted = spark.createDataFrame([(k,) for k in keys], f"{key} long").select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("b"))
        rows = rows.filter(F.col("bucket").isin(sorted({r["b"] for r in wanted.collect()})) & F.col(key).isin(list(keys)))
    return rows.drop("bucket")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a given schema; types are never inferred by an extra pass."""
    return spark.read.option("header", True).schema(schema).csv(path)


def count_files(spark: SparkSession, path: str, pattern: str = "*") -> int:
    """Files in a folder of any store."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path").count()


def to_wide(panel: DataFrame, slots: list[int]) -> DataFrame:
    """Panel with a column for each given slot, for export; agents without a position have null."""
    return panel.groupBy("agent").pivot("slot", slots).agg(F.first("zone"))


def to_long(wide: DataFrame) -> DataFrame:
    """The panel of a wide table."""
    slots = [c for c in wide.columns if c != "agent"]
    return wide.unpivot("agent", slots, "slot", "zone").filter("zone is not null").select("agent", F.col("slot").cast("long").alias("slot"), "zone")


def stratified_sample(df: DataFrame, group: list[str], order: list[str], most: int = 20, seed: int = 42) -> DataFrame:
    """At most `most` rows of each group, in an order that the seed fixes: that of the MD5 of seed and order, joined by '|'."""
    from pyspark.sql import Window

    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order])
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.md5(text), *order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")

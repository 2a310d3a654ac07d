"""Session defaults and the one place that tells executors where the package is."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

REPO_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Pin UTC and let Python workers import the package.

    On a cluster without a common checkout, submit with ``--py-files``; the path set
    here is then simply not used.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO_ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([REPO_ROOT, *known])
    return spark


def measured_broadcasts(spark: SparkSession) -> SparkSession:
    """Let sizes measured at run time alone decide on broadcasts that no plan asks for.

    Estimates before it take no account of exploded ranges: a panel of millions of rows counts as
    the few columns of its positions, and the driver would collect it.
    """
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if most != "-1":
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", most)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return spark


def ensure_checkpoint(spark: SparkSession) -> None:
    """Use the checkpoint folder that the session names; make one only for a session in one process, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="wayfold-"))


def kept(df: DataFrame, dealt: bool = False) -> DataFrame:
    """df, written below the checkpoint folder as Parquet and read back: steps that feed several others run once.

    Columns are compressed there, which rows of a checkpoint are not. dealt: sides of a join that
    both lie by some of its keys (each agent's rows in one place, say) are joined where they are, not
    dealt anew by all keys; for steps whose keys are many. What is such a table already is not written again.
    """
    if getattr(df, "_kept", False):
        return df
    spark, name = df.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition"
    ensure_checkpoint(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/wayfold/kept-{uuid.uuid4().hex}"
    before = spark.conf.get(name)
    try:
        if dealt:
            spark.conf.set(name, "false")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(name, before)
    made = spark.read.schema(df.schema).parquet(path)
    made._kept = True
    return made


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session as the tests and the benchmark use it."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wayfold")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("WAYFOLD_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)

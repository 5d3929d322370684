"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "codestrata", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs assume; cluster-provided values win over ours."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # call-site capture costs several driver round trips per column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Single-JVM session for tests and the benchmark."""
    return build_session(
        "codestrata-local",
        f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": str(partitions),
            "spark.driver.memory": memory,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's ``spark.checkpoint.dir``, a scratch one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    context.setCheckpointDir(named)
    return named


def lanes(spark: SparkSession) -> int:
    """Tasks for work that the size of its rows does not tell: some for every core, and no fewer than a shuffle has."""
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to :func:`lanes` tasks, which adaptive execution leaves apart.

    For small rows that cost much each: a narrow table is read by as few tasks as it has megabytes, and so is a shuffle of it.
    """
    return df.repartition(lanes(df.sparkSession), *keys)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and go on from there.

    The result survives the loss of executors and keeps loop plans short.  Unlike an RDD checkpoint it comes back with
    its true size, so the planner itself decides which later joins are small enough to broadcast.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_dealt(df: DataFrame) -> DataFrame:
    """:func:`cut` for tables that loops join again and again: their joins deal both sides to the executors.

    The files are far smaller than the rows in them, so the planner would take tables of millions of rows for small ones
    and send them through the driver, once per join and round.
    """
    return cut(df).hint("merge")

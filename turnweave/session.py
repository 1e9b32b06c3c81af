"""Session helpers: local sessions, size checks, materialisation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: copies of a lookup where adaptive execution cannot split hot keys
DEFAULT_SALTS = 64


def local_session(app: str = "turnweave", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        # no call-site capture per Column call: plans here have many expressions
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # text work is heavy per byte: keep small shuffles on all cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` that the driver and all executors see.

    Only a local session without that setting gets a temporary folder instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="turnweave-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder of the cluster.

    The folder is the one named in ``spark.checkpoint.dir``.  Only a local session
    without that setting (tests, a laptop) gets a temporary one; on a cluster
    executors would write to disks that nobody else can read.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="turnweave-ckpt-"))
    return df.checkpoint(eager=True)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Column,
    how: str = "left",
    salts: int = 0,
) -> DataFrame:
    """Many-to-one join that survives hot keys on the many side.

    Adaptive execution decides by measured bytes: a small ``right`` is sent to
    every executor, and of a large join the partitions with hot keys are split.
    No job runs while the query is built.  Where adaptive execution is off, or
    ``salts`` are asked for, ``right`` is copied once per salt and ``spread``
    (any expression that varies inside a key) deals the rows of a key over the
    copies.  ``right`` must be unique on ``on``.  All ways give the same rows.
    """
    adaptive = left.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    if adaptive and not salts:
        return left.join(right, list(on), how)
    salts = salts or DEFAULT_SALTS
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return dealt.join(salted, [*on, "_salt"], how).drop("_salt")

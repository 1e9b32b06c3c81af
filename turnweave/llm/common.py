"""What the corpus operators share: working tables, shipped code, salted lookups, words."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: words of the corpus contracts are runs of anything else.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: byte table that lower-cases A-Z and nothing else
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one named in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, a laptop) gets a
    temporary folder; on a cluster a missing setting is an error, as executors
    would write to disks that nobody else can read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="turnweave-llm-")
    return f"{root.rstrip('/')}/turnweave-{uuid.uuid4().hex}"


class Workspace:
    """Working tables of one call: Parquet below the shared folder.

    A written table cuts the lineage and survives lost executors.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = shared_folder(spark)

    def save(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    target = os.path.join(tempfile.mkdtemp(prefix="turnweave-code-"), "turnweave_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, root))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Column,
    how: str = "left",
    salts: int = 16,
) -> DataFrame:
    """Many-to-one join whose hot keys are dealt over ``salts`` tasks.

    ``right`` (unique on ``on``) is first joined to the distinct (key, salt)
    pairs that occur on the left, at most ``salts`` per key, so only hot keys
    are copied.  Rows whose key is null match nothing.
    """
    keys = list(on)
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    slots = dealt.select(*keys, "_salt").distinct()
    return dealt.join(slots.join(right, keys), [*keys, "_salt"], how).drop("_salt")


def utf8(text: str = "text") -> Column:
    """The bytes of a text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")

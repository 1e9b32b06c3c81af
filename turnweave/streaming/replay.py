"""A table as a stream: waves of rows are appended, and after each a run goes on from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..session import shared_folder

#: start(stream, output folder, checkpoint folder)
Start = Callable[[DataFrame, str, str], StreamingQuery]


class Replay:
    """Folders of one replay; ``feed`` appends a wave and runs until it is worked off."""

    def __init__(self, spark, schema, start: Start):
        self.spark = spark
        self.schema = schema
        self.start = start
        self.folder = shared_folder(spark, "replay")
        self.dropped = 0

    def feed(self, wave: DataFrame) -> None:
        wave.select(*self.schema.names).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in")
        query = self.start(stream, f"{self.folder}/out", f"{self.folder}/checkpoint")
        query.awaitTermination()
        for progress in query.recentProgress:
            self.dropped += sum(s["numRowsDroppedByWatermark"] for s in progress["stateOperators"])

    def result(self, schema: str) -> DataFrame:
        """What has come out so far; the schema holds for a run without output too."""
        return self.spark.read.schema(schema).parquet(f"{self.folder}/out")


def replay(rows: DataFrame, wave: str, waves: int, last: DataFrame, start: Start) -> Replay:
    """Feed ``rows`` by the number in ``wave`` (0 to ``waves`` - 1), then ``last``, which moves the watermark past all."""
    out = Replay(rows.sparkSession, rows.drop(wave).schema, start)
    for number in range(waves):
        out.feed(rows.where(F.col(wave) == number))
    out.feed(last)
    return out

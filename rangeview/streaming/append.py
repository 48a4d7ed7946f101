"""Progressive discovery: a table that grows by micro-batches, each row once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rangeview.model import Extent, PreviewError


class Growing:
    """An append-only table fed by a folder of Parquet files; extent is at-least until the source is done."""

    def __init__(self, spark: SparkSession, source: str, target: str, checkpoint: str):
        self.spark, self.source, self.target, self.checkpoint, self.done = spark, source, target, checkpoint, False

    def advance(self, files: int | None = None) -> None:
        """Take in what the source has now, ``files`` a micro-batch."""
        schema = self.spark.read.parquet(self.source).schema
        stream = self.spark.readStream.schema(schema)
        if files:
            stream = stream.option("maxFilesPerTrigger", files)
        q = stream.parquet(self.source).writeStream.format("parquet").option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start(self.target)
        q.awaitTermination()

    def finish(self) -> None:
        self.done = True

    def extent(self) -> Extent:
        return Extent("exact" if self.done else "at-least", self.df().count())

    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.target)

    def require(self, row_start: int) -> None:
        """Refuse rows that are not indexed yet; the caller can try again."""
        if not self.done and self.extent().value <= row_start:
            raise PreviewError("RANGE_NOT_INDEXED", "the source has not been read so far yet", retryable=True)

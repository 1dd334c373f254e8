"""Resumable scoring: candidate files are scored as a stream whose checkpoint remembers what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def score_new_files(spark: SparkSession, candidates: str, out: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], threshold: float, files_at_once: int = 100) -> None:
    """Scores candidate files that no earlier call has seen, keeps rows of ``probability`` >= ``threshold``, and ends.

    A call that breaks off is taken up by the next: a batch's output counts only once its commit is in the
    checkpoint, and the Parquet sink ignores files of a batch without one.
    """
    schema = spark.read.parquet(candidates).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(candidates)
    kept = score(stream).filter(F.col("probability") >= threshold)
    kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

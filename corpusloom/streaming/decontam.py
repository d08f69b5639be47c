"""Incremental decontamination: a stream of records against a static index of held-out n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ngrams, skeleton, words


def hits_stream(records: DataFrame, grams: DataFrame, n: int = 8) -> DataFrame:
    """(doc_id, g) of each held-out n-gram in a streamed record; stateless, so no watermark."""
    return records.select("doc_id", F.explode(F.array_distinct(ngrams(words(skeleton(F.col("text"))), n))).alias("g")).join(grams, "g", "left_semi")


def run_stream(spark: SparkSession, source: str, schema, grams: DataFrame, out: str, checkpoint: str) -> None:
    """Process what a folder holds now, and stop. The sink is files with a log, so a
    batch that is run again writes nothing twice."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).option("pathGlobFilter", "*.parquet").parquet(source)
    hits_stream(stream, grams).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

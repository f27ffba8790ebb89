"""Letters that arrive in files: cleaned and deduplicated as a stream, resumable from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions.sequential import clean_text
from letterloom.functions.text import content_ratio, content_tokens, dedup_key


def cleaned_stream(spark: SparkSession, folder: str, schema: str, arrival: str = "loaded_at", lateness: str = "90 days") -> DataFrame:
    """Cleaned rows with enough content; of rows with one label and text that arrive within `lateness` one is kept.

    State is one key for each text of that span, not the texts.
    """
    rows = spark.readStream.schema(schema).parquet(folder).withColumn("text", F.coalesce("text", F.lit("")))
    done = clean_text(rows, out="cleaned")
    c = F.col("cleaned")
    kept = done.filter((c != "") & (content_ratio(c) >= 0.15) & (content_tokens(c) >= 5))
    key = F.sha2(F.coalesce(dedup_key(F.col("label"), c), F.lit("\u0000")), 256)
    return kept.withColumn("record_key", key).withWatermark(arrival, lateness).dropDuplicatesWithinWatermark(["record_key"])


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write everything that has arrived since the last run and stop."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

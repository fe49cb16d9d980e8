"""Cards on a stream: row functions as their files arrive, and roll-ups with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import consistency


def check_stream(spark: SparkSession, path: str, schema: StructType, as_of: str) -> DataFrame:
    """Cards of arriving Parquet files with all checks; stateless, so any trigger and output mode will do."""
    return consistency.check_all(spark.readStream.schema(schema).parquet(path), as_of)


def _rank() -> Column:
    return F.struct((-F.col("ocr_confidence")).alias("c"), "idx")


def best_texts(texts: DataFrame, time: str, window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """window, card_id, field_name, raw_value, ocr_confidence: the most confident text of each field of a card in a window of
    its time of reading, for a stream or a table.

    On a stream a row that comes again (same card, field and idx) within delay counts once; rows later than delay are left
    out, and a window is given out once and forgotten when the watermark has passed it, so state holds the open windows
    only."""
    key = ["card_id", "field_name", "idx"]
    once = texts.withWatermark(time, delay).dropDuplicatesWithinWatermark(key) if texts.isStreaming else texts.dropDuplicates([*key, time])
    best = once.groupBy(F.window(time, window).alias("window"), "card_id", "field_name").agg(F.min_by(F.struct("text", "ocr_confidence"), _rank()).alias("b"))
    return best.select("window", "card_id", "field_name", F.col("b.text").alias("raw_value"), "b.ocr_confidence")


def card_rollup(localized: DataFrame, time: str, window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """window, card_id, n_localized, n_fields and success (half of the fields or more) of the fields that were localized in a
    window; on a stream with the same bounds as best_texts()."""
    key = ["card_id", "field_name"]
    once = localized.withWatermark(time, delay).dropDuplicatesWithinWatermark(key) if localized.isStreaming else localized.dropDuplicates([*key, time])
    per = once.groupBy(F.window(time, window).alias("window"), "card_id").agg(F.count_if(F.col("loc_status") == "localized").alias("n_localized"), F.count("*").alias("n_fields"))
    return per.withColumn("success", F.col("n_localized") >= 0.5 * F.col("n_fields"))

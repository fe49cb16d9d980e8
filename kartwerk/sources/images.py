"""Image sources: files by Spark's image reader, and rows of bytes that are already there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def acceptable_type(content_type: Column) -> Column:
    return F.coalesce(content_type, F.lit("")).startswith("image/")


def type_error(content_type: Column) -> Column:
    return F.when(~acceptable_type(content_type), F.concat(F.lit("Invalid file type. Expected image, got "), F.coalesce(content_type, F.lit("None"))))


def read_images(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """origin, height, width, channels, data (blue first) and failure for files that can't be decoded."""
    df = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", pattern).load(path)
    bad = F.col("image.height") < 0
    return df.select("image.origin", F.when(~bad, F.col("image.height")).alias("height"), F.when(~bad, F.col("image.width")).alias("width"), F.when(~bad, F.col("image.nChannels")).alias("channels"), F.when(~bad, F.col("image.data")).alias("data"), F.when(bad, "Failed to decode image").alias("failure"))


def from_rows(df: DataFrame) -> DataFrame:
    """Rows of height, width, channels and data with failure for those without pixels."""
    empty = F.col("data").isNull() | (F.octet_length("data") == 0) | (F.coalesce("height", F.lit(0)) <= 0)
    return df.withColumn("failure", F.when(empty, "Empty or invalid image provided"))

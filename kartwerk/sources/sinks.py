"""Result documents: JSON of cards, the service's status codes and static answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config

FIELDS = ["nid", "name", "dob", "gender", "governorate", "address"]


def http_status(success: Column) -> Column:
    return F.when(success, 200).otherwise(206).cast("long")


def truthy(c: Column, kind: str) -> Column:
    """The value, or null where a document leaves it out: empty text, list or map, and false."""
    if kind == "string":
        return F.nullif(c, F.lit(""))
    if kind in ("array", "map"):
        return F.when(F.size(c) > 0, c)
    return c


def to_document(df: DataFrame, columns: dict[str, str], name: str = "json") -> DataFrame:
    """Adds a JSON document of columns; columns gives each one's kind, and empty values are left out."""
    return df.withColumn(name, F.to_json(F.struct(*[truthy(F.col(c), k).alias(c) for c, k in columns.items()])))


def fields_map() -> Column:
    """Aggregate of a card's rows of the long table of extracted fields: a map of field results, six entries at most."""
    item = F.struct("field_name", F.struct(F.col("value").alias("normalized_value"), "raw_value", F.col("ocr_confidence").alias("confidence"), F.col("validation_status").alias("status"), "failure_reason").alias("v"))
    return F.map_from_entries(F.array_sort(F.collect_list(item)))


def value_maps() -> dict[str, Column]:
    """normalized_fields and raw_fields from the map of field results, fields."""
    pick = lambda n: F.map_filter(F.transform_values("fields", lambda _, v: v[n]), lambda _, v: F.coalesce(v, F.lit("")) != "")
    return {"normalized_fields": pick("normalized_value"), "raw_fields": pick("raw_value")}


def export_fields(fields: DataFrame) -> DataFrame:
    """card_id with maps of normalised and raw values and of field results, from the long table of extracted fields."""
    return fields.groupBy("card_id").agg(fields_map().alias("fields")).withColumns(value_maps())


METRICS = ["card_detection_time_ms", "rectification_time_ms", "total_time_ms"]


def card_documents(fields: DataFrame, cards: DataFrame, name: str = "json") -> DataFrame:
    """card_id and the whole result document of each card as JSON: status, normalized_fields, raw_fields,
    validation_results, consistency_result, metrics and fields. Empty texts, lists and maps are left out, as are parts that
    a card doesn't have.

    fields: the long table of extracted fields; cards: one row a card with the number's verdict and the checks, and with
    the metrics' columns where there are any. One join by card, both sides grouped by it already; where both come from the
    same texts, plans.cards.documents_from_texts() does without it."""
    return documents(cards.join(export_fields(fields), "card_id"), name)


def documents(cards: DataFrame, name: str = "json") -> DataFrame:
    """card_documents() of cards that have their maps of fields (fields, normalized_fields and raw_fields)."""
    had = [c for c in METRICS if c in cards.columns]
    kind = lambda c: "array" if c.endswith(("errors", "warnings", "recommendations", "fields")) else "string" if c.endswith(("status", "details", "summary")) else "value"
    part = lambda names, cut="": F.struct(*[truthy(F.col(c), kind(c)).alias(c.removeprefix(cut)) for c in names])
    verdict = [f"nid_{c}" for c in ("is_valid", "format_valid", "date_valid", "governorate_valid", "errors", "warnings")]
    checks = F.struct(*[F.struct(truthy(F.col(f"{c}_status"), "string").alias("status"), truthy(F.col(f"{c}_details"), "string").alias("details")).alias(c) for c in ("dob", "gender", "governorate")])
    figures = ["overall_status", "consistent_count", "conflict_count", "unknown_count", "has_conflicts", "confidence", "conflicting_fields", "recommendations", "summary"]
    figures_of = part(figures)
    document = F.struct(
        truthy(F.col("nid_status"), "string").alias("status"), *[truthy(F.col(c), "map").alias(c) for c in ("normalized_fields", "raw_fields")],
        F.struct(part(verdict, "nid_").alias("nid")).alias("validation_results"), F.struct(*[figures_of[c].alias(c) for c in figures], checks.alias("checks")).alias("consistency_result"),
        *([part(had).alias("metrics")] if had else []), truthy(F.col("fields"), "map").alias("fields"),
    )
    return cards.select("card_id", F.to_json(document).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def png_base64(data: Column) -> Column:
    """Text form of encoded image bytes."""
    return F.base64(data)


def health(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("healthy").alias("status"))


def system_status(spark: SparkSession, config: Config = Config()) -> DataFrame:
    return spark.range(1).select(F.lit(f"{config.width}x{config.height}").alias("canonical_size"), F.lit(config.aspect).alias("expected_aspect_ratio"), F.array(*[F.lit(f) for f in FIELDS]).alias("fields"))

"""Recognised texts: engines, choice among candidates, full text, tiers and card results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

RESULT = "text string, confidence double, bbox array<int>, language string"


class Engine(Protocol):
    """A recogniser; an instance lives in each worker and is made once for it."""

    def initialize(self) -> bool: ...

    def is_initialized(self) -> bool: ...

    def recognize(self, image: bytes) -> list[tuple]: ...


class FallbackEngine:
    """Recognises nothing."""

    def initialize(self) -> bool:
        return True

    def is_initialized(self) -> bool:
        return True

    def recognize(self, image: bytes) -> list[tuple]:
        return []


_engines: dict[str, Engine] = {}


def get_engine(name: str, make: Callable[[], Engine] = FallbackEngine) -> Engine:
    """The worker's engine of a name; the first call makes it and later arguments are not looked at."""
    if name not in _engines:
        _engines[name] = make()
        _engines[name].initialize()
    return _engines[name]


def reset_engines() -> None:
    _engines.clear()


def recognize(crops: DataFrame, name: str = "fallback", make: Callable[[], Engine] = FallbackEngine) -> DataFrame:
    """card_id, field_name, idx, text, ocr_confidence, bbox for the crops (card_id, field_name, image binary).

    An engine that fails on an image yields nothing for it.
    """

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        engine = get_engine(name, make)
        for f in frames:
            rows = []
            for card, field, image in zip(f["card_id"], f["field_name"], f["image"]):
                try:
                    found = engine.recognize(image) if engine.is_initialized() else []
                except Exception:  # noqa: BLE001  an unreadable crop is no text
                    found = []
                rows += [(card, field, i + 1, *r) for i, r in enumerate(found)]
            yield pd.DataFrame(rows, columns=["card_id", "field_name", "idx", "text", "ocr_confidence", "bbox"])

    return crops.select("card_id", "field_name", "image").mapInPandas(run, "card_id long, field_name string, idx long, text string, ocr_confidence double, bbox array<int>")


def reader(name: str = "fallback", make: Callable[[], Engine] = FallbackEngine):
    """The engine as a table function of an image: a row (idx, text, ocr_confidence, bbox) for each recognised text. The
    engine is made once for a worker; an image that it fails on, and a null one, yields no row."""

    class Reader:
        def eval(self, image):
            engine = get_engine(name, make)
            try:
                found = engine.recognize(bytes(image)) if image is not None and engine.is_initialized() else []
            except Exception:  # noqa: BLE001  an unreadable crop is no text
                found = []
            for i, (text, confidence, bbox) in enumerate(found):
                yield i + 1, text, float(confidence), list(bbox)

    return F.udtf(Reader, returnType="idx int, text string, ocr_confidence double, bbox array<int>", useArrow=True)


def read(crops: DataFrame, name: str = "fallback", make: Callable[[], Engine] = FallbackEngine, image: str = "image") -> DataFrame:
    """crops, all columns kept, beside each text that is recognised in them: a lateral join with reader()."""
    return crops.lateralJoin(reader(name, make)(F.col(image).outer()))


def best(candidates: DataFrame) -> DataFrame:
    """The most confident text of each field of a card; the first one wins ties. Combined before the shuffle."""
    rank = F.struct((-F.col("ocr_confidence")).alias("c"), "idx")
    return candidates.groupBy("card_id", "field_name").agg(F.min_by(F.struct("text", "ocr_confidence"), rank).alias("b")).select("card_id", "field_name", F.col("b.text").alias("raw_value"), "b.ocr_confidence")


def full_text(candidates: DataFrame) -> DataFrame:
    """The texts of each field that aren't blank, one a line, in order."""
    solid = F.when(text.strip(F.col("text")) != "", F.struct("idx", "text"))
    return candidates.groupBy("card_id", "field_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(solid)), lambda x: x["text"]), "\n").alias("full_text"))


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "High").when(confidence >= 0.5, "Medium").otherwise("Low")


def colour(confidence: Column) -> Column:
    """Colour of a box in a debug drawing."""
    return F.when(confidence >= 0.8, "green").when(confidence >= 0.6, "cyan").otherwise("red")


def extract(candidates: DataFrame, compose: bool = True) -> DataFrame:
    """Best text of each field with its normalised value, status and failure."""
    df = best(candidates)
    df = df.withColumn("value", text.field_value(F.col("field_name"), F.col("raw_value"), compose))
    have = F.coalesce("value", F.lit("")) != ""
    return df.withColumns({"validation_status": F.when(have, "extracted").otherwise("ocr_failed"), "failure_reason": F.when(~have, "OCR extraction failed or normalization produced empty result"), "label": F.concat(F.col("field_name"), F.lit(": "), F.substring(F.coalesce("value", F.lit("")), 1, 20))})

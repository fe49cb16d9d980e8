"""Dimension tables: governorates with their variant spellings, and field regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config

# The 27 governorates (code, Arabic name, English name, region).
GOVERNORATES = [
    ("01", "القاهرة", "Cairo", "Greater Cairo"),
    ("02", "الإسكندرية", "Alexandria", "Alexandria"),
    ("03", "بورسعيد", "Port Said", "Canal"),
    ("04", "السويس", "Suez", "Canal"),
    ("05", "دمياط", "Damietta", "Lower Egypt"),
    ("06", "الدقهلية", "Dakahlia", "Lower Egypt"),
    ("07", "الشرقية", "Sharqia", "Lower Egypt"),
    ("08", "القليوبية", "Qalyubia", "Lower Egypt"),
    ("09", "كفر الشيخ", "Kafr El Sheikh", "Lower Egypt"),
    ("10", "الغربية", "Gharbia", "Lower Egypt"),
    ("11", "المنوفية", "Menoufia", "Lower Egypt"),
    ("12", "البحيرة", "Beheira", "Lower Egypt"),
    ("13", "الإسماعيلية", "Ismailia", "Canal"),
    ("14", "الجيزة", "Giza", "Greater Cairo"),
    ("15", "بني سويف", "Beni Suef", "Upper Egypt"),
    ("16", "الفيوم", "Fayoum", "Upper Egypt"),
    ("17", "المنيا", "Minya", "Upper Egypt"),
    ("18", "أسيوط", "Assiut", "Upper Egypt"),
    ("19", "سوهاج", "Sohag", "Upper Egypt"),
    ("20", "قنا", "Qena", "Upper Egypt"),
    ("21", "الأقصر", "Luxor", "Upper Egypt"),
    ("22", "أسوان", "Aswan", "Upper Egypt"),
    ("23", "الوادي الجديد", "New Valley", "Frontier"),
    ("24", "البحر الأحمر", "Red Sea", "Frontier"),
    ("25", "مطروح", "Matrouh", "Frontier"),
    ("26", "شمال سيناء", "North Sinai", "Frontier"),
    ("27", "جنوب سيناء", "South Sinai", "Frontier"),
]

# Variant spellings and their codes.
VARIATIONS = [
    ("القاهره", "01"),
    ("القاهرة الكبري", "01"),
    ("cairo", "01"),
    ("الاسكندرية", "02"),
    ("الاسكندريه", "02"),
    ("alexandria", "02"),
    ("alex", "02"),
    ("بور سعيد", "03"),
    ("port said", "03"),
    ("portsaid", "03"),
    ("السويس", "04"),
    ("suez", "04"),
    ("الجيزه", "14"),
    ("giza", "14"),
    ("gizeh", "14"),
    ("الاقصر", "21"),
    ("luxor", "21"),
    ("اسوان", "22"),
    ("aswan", "22"),
]


def governorates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GOVERNORATES, "code string, name_arabic string, name_english string, region string")


def variations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VARIATIONS, "name string, code string")


def regions(spark: SparkSession, config: Config = Config()) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(config.regions)]
    return spark.createDataFrame(rows, "field_no int, field_name string, rx1 double, ry1 double, rx2 double, ry2 double, refinement string, expected_ar double")


def constant_map(pairs: list[tuple[str, str]]) -> Column:
    """A literal map; lookups in so few entries stay inside the projection and need no join."""
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def governorates_by_region(spark: SparkSession, region: str) -> DataFrame:
    return governorates(spark).where(F.lower("region") == region.lower())


def all_names(spark: SparkSession, language: str = "arabic") -> DataFrame:
    name = "name_english" if language.lower() == "english" else "name_arabic"
    return governorates(spark).select("code", F.col(name).alias("name"))


def all_codes(spark: SparkSession) -> DataFrame:
    return governorates(spark).select("code").orderBy("code")

"""Arabic text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits of both Arabic scripts, marks, and look-alike letters.
ARABIC_DIGITS, PERSIAN_DIGITS, DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"
DIACRITICS = "ًٌٍَُِّْ"
FOLD_FROM, FOLD_TO = "آأإىـ", "اااي"
NAME_FROM, NAME_TO = "أإآىء", "اااي"

# White space as Python's \s and str.strip see it.
_WHITE = r"\s\x{1C}-\x{1F}"


def strip(c: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(c, rf"(?U)^[{_WHITE}]+|[{_WHITE}]+$", "")


def normalize_digits(c: Column) -> Column:
    return F.translate(c, ARABIC_DIGITS + PERSIAN_DIGITS, DIGITS * 2)


def remove_diacritics(c: Column) -> Column:
    return F.translate(c, DIACRITICS, "")


def fold_letters(c: Column) -> Column:
    """Alef and yeh forms to one letter each; the elongation sign goes."""
    return F.translate(c, FOLD_FROM, FOLD_TO)


def normalize_whitespace(c: Column) -> Column:
    """Runs of white and zero-width space to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"(?U)[{_WHITE}\x{{A0}}\x{{200B}}-\x{{200D}}]+", " "))


def nfkc(c: Column) -> Column:
    """Compatibility composition, in Arrow batches; Spark has no such function."""
    import pandas as pd

    def apply(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    apply.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(apply, "string")(c)


def normalize_arabic(c: Column, digits: bool = True, diacritics: bool = True, whitespace: bool = True, compose: bool = True) -> Column:
    """Compose, drop marks, fold letters, map digits, tidy space, in this order. Null becomes empty.

    compose=False leaves composition out where the input is known to be composed, which keeps Python out of the plan.
    """
    out = F.coalesce(c, F.lit(""))
    out = nfkc(out) if compose else out
    out = remove_diacritics(out) if diacritics else out
    out = fold_letters(out)
    out = normalize_digits(out) if digits else out
    return normalize_whitespace(out) if whitespace else out


def numeric_candidate(c: Column) -> Column:
    """Digits only, both Arabic scripts mapped."""
    return F.regexp_replace(normalize_digits(F.coalesce(c, F.lit(""))), r"[^\p{Nd}]", "")


def gender_text(c: Column, compose: bool = True) -> Column:
    """male, female or null by the words that occur in normalised text; "female" holds "male" and reads as male."""
    t = F.lower(normalize_arabic(c, compose=compose))
    male = t.contains("ذكر") | t.contains("دكر") | t.contains("male")
    female = t.contains("انثى") | t.contains("أنثى") | t.contains("انثي") | t.contains("female")
    return F.when(male, "male").when(female, "female")


def is_mostly_arabic(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    return F.length(F.regexp_replace(c, r"[^\x{0600}-\x{06FF}]", "")) > 0.5 * F.length(c)


def is_mostly_numeric(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    solid = F.regexp_replace(c, rf"(?U)[{_WHITE}]", "")
    return (F.length(solid) > 0) & (F.length(F.regexp_replace(solid, r"[^\p{Nd}]", "")) > 0.7 * F.length(solid))


def fold_name(c: Column) -> Column:
    """What governorate names are compared by: trimmed, alef and yeh folded, lone hamza dropped."""
    return F.translate(strip(c), NAME_FROM, NAME_TO)


def field_value(field: Column, c: Column, compose: bool = True) -> Column:
    """The value of a field read as its type asks; blank is null, other fields stay as they are."""
    plain = normalize_arabic(c, digits=False, compose=compose)
    full = normalize_arabic(c, compose=compose)
    out = (
        F.when(field == "nid", numeric_candidate(c))
        .when(field == "dob", F.regexp_replace(full, r"[^\p{Nd}/\-.]", ""))
        .when(field == "gender", gender_text(c, compose))
        .when(field.isin("governorate", "name"), plain)
        .when(field == "address", full)
    )
    known = field.isin("nid", "dob", "gender", "governorate", "name", "address")
    return F.when(known, F.nullif(out, F.lit(""))).otherwise(c)

"""Identity numbers: 14 digits that encode century, birth date, governorate and gender."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from . import text

NO_CHECK_DIGIT = "Check digit validation not available (algorithm not public)"
# Hints for codes that misreading produces.
CODE_HINTS = [
    ("00", "Possible OCR error: detected as 00"),
    ("99", "Possible OCR error: detected as 99"),
    ("28", "Code 28 is not assigned (max is 27)"),
    ("29", "Code 29 is not assigned (max is 27)"),
]


def _compact(*items: Column) -> Column:
    """The items that aren't null, in order."""
    return F.array_compact(F.array(*items))


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def normalize_nid(c: Column) -> Column:
    """Digits of a number as read: Arabic ones mapped, Persian ones kept as they are, anything else dropped."""
    return F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), text.ARABIC_DIGITS, text.DIGITS), r"[^\p{Nd}]", "")


def governorate_name(code: Column, name: str = "name_arabic") -> Column:
    """Name of a code; null for any other text. The code must have two characters before it is trimmed."""
    k = {"name_arabic": 1, "name_english": 2, "region": 3}[name]
    return F.when(F.length(code) == 2, F.element_at(dims.constant_map([(g[0], g[k]) for g in dims.GOVERNORATES]), text.strip(code)))


def code_check(code: Column) -> Column:
    """The complaint about a governorate code, or null."""
    return (
        F.when(F.coalesce(code, F.lit("")) == "", "Empty governorate code")
        .when(F.length(code) != 2, F.concat(F.lit("Invalid code length: expected 2, got "), F.length(code).cast("string")))
        .when(~code.rlike(r"^\p{Nd}+$"), F.concat(F.lit("Code must be numeric: got '"), code, F.lit("'")))
        .when(governorate_name(code).isNull(), F.concat(F.lit("Unknown governorate code: "), code))
    )


def code_by_arabic_name(c: Column) -> Column:
    """Names are folded, the list isn't: five names with hamza never match."""
    probe = text.fold_name(F.nullif(c, F.lit("")))
    names = dims.constant_map([(g[1], g[0]) for g in dims.GOVERNORATES])
    return F.coalesce(F.element_at(names, probe), F.element_at(dims.constant_map(dims.VARIATIONS), probe))


def code_by_english_name(c: Column) -> Column:
    """Names are lower-cased, the list isn't: only variant spellings match."""
    probe = F.lower(text.strip(F.nullif(c, F.lit(""))))
    names = dims.constant_map([(g[2], g[0]) for g in dims.GOVERNORATES])
    return F.coalesce(F.element_at(names, probe), F.element_at(dims.constant_map(dims.VARIATIONS), probe))


def code_by_name(c: Column) -> Column:
    return F.coalesce(code_by_arabic_name(c), code_by_english_name(c))


def validate(df: DataFrame, column: str, as_of: str) -> DataFrame:
    """df with the parts and the verdict of an identity number added, all prefixed nid_.

    as_of: the day (yyyy-MM-dd) that ages and future dates are judged by. Index 7 of the number is not used: the code is
    at 8-9 and gender at 10. A number with an unknown century can still be valid.
    """
    today = F.lit(as_of).cast("date")
    df = df.withColumn("nid_normalized", normalize_nid(F.col(column)))
    n = F.col("nid_normalized")
    plain = text.normalize_digits(n)
    formed = F.length(n) == 14
    part = lambda a, k, src=n: F.when(formed, F.substring(src, a, k))
    number = lambda a, k: part(a, k, plain).try_cast("int")
    df = df.withColumns({"nid_format_valid": formed, "nid_century_digit": part(1, 1), "nid_birth_year": number(2, 2), "nid_birth_month": number(4, 2), "nid_birth_day": number(6, 2), "nid_governorate_code_raw": part(9, 2), "nid_gender_digit": number(11, 1)})
    digit = F.col("nid_century_digit")
    df = df.withColumn("nid_century", F.when(digit == "2", 1900).when(digit == "3", 2000))
    yy, mm, dd = F.col("nid_birth_year"), F.col("nid_birth_month"), F.col("nid_birth_day")
    in_range = mm.between(1, 12) & dd.between(1, 31)
    iso = F.concat((F.coalesce("nid_century", F.lit(2000)) + yy).cast("string"), F.lit("-"), _two(mm), F.lit("-"), _two(dd))
    df = df.withColumn("nid_birth", F.when(in_range, iso.try_cast("date")))
    code = F.col("nid_governorate_code_raw")
    df = df.withColumns({
        "nid_date_of_birth": F.date_format("nid_birth", "yyyy-MM-dd"),
        "nid_date_valid": F.coalesce(F.col("nid_birth") <= today, F.lit(False)),
        "nid_governorate_code": code,
        "nid_governorate_arabic": governorate_name(code),
        "nid_governorate_english": governorate_name(code, "name_english"),
        "nid_gender": F.when(F.col("nid_gender_digit") % 2 == 1, "male").when(F.col("nid_gender_digit") % 2 == 0, "female"),
    })
    df = df.withColumn("nid_governorate_valid", F.coalesce(F.col("nid_governorate_arabic").isNotNull(), F.lit(False)))
    good_date, good_code = F.col("nid_date_valid"), F.col("nid_governorate_valid")
    status = (
        F.when(~formed, "malformed")
        .when(good_date & good_code, "valid")
        .when(~good_date & ~good_code, "invalid")
        .when(~good_date, "invalid_date")
        .otherwise("invalid_governorate")
    )
    born = F.col("nid_birth")
    future = formed & born.isNotNull() & (born > today)
    age = F.datediff(today, born) / F.lit(365.25)
    say = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    bad_century = formed & ~digit.isin("2", "3")
    errors = _compact(
        F.when(n == "", "Empty or invalid NID"),
        F.when((n != "") & ~formed, say("Invalid NID length: expected 14 digits, got ", F.length(n))),
        F.when(bad_century, say("Invalid century code: '", digit, "' (expected '2' or '3')")),
        F.when(bad_century, say("Unknown century code: ", digit)),
        F.when(formed & ~mm.between(1, 12), say("Invalid month: ", mm, " (must be 01-12)")),
        F.when(formed & mm.between(1, 12) & ~dd.between(1, 31), say("Invalid day: ", dd, " (must be 01-31)")),
        F.when(formed & in_range & born.isNull(), say("Invalid date: ", yy, "-", _two(mm), "-", _two(dd), " (day is out of range for month)")),
        F.when(future, say("Birth date ", F.col("nid_date_of_birth"), " is in the future")),
        F.when(formed & ~good_code, say("Invalid governorate code: ", code, " (", code_check(code), ")")),
    )
    warnings = _compact(
        F.when(bad_century, "First digit should be '2' (1900s) or '3' (2000s)"),
        F.when(future, "Date appears invalid (future date)"),
        F.when(formed & (age > 120), say("Unusual age: ", F.round(age).cast("int"), " years (possible OCR error)")),
        F.when(formed & (age < 0), "Calculated age is negative (date validation failed)"),
        F.when(formed, F.element_at(dims.constant_map(CODE_HINTS), code)),
        F.when(formed, NO_CHECK_DIGIT),
    )
    df = df.withColumns({"nid_status": status, "nid_errors": errors, "nid_warnings": warnings, "nid_check_digit_valid": F.lit(None).cast("boolean")})
    return df.withColumn("nid_is_valid", F.col("nid_status") == "valid").drop("nid_birth", "nid_governorate_code_raw", "nid_century_digit", "nid_gender_digit")


def normalize_date(c: Column) -> Column:
    """yyyy-MM-dd from a date as read. The start of the text must fit year-month-day, then day-month-year, then a
    two-digit year; separators are - and /, there is no calendar check and what follows is ignored."""
    t = text.strip(F.translate(c, text.ARABIC_DIGITS, text.DIGITS))
    a, b, d = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})", r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})", r"^(\d{2})[-/](\d{1,2})[-/](\d{1,2})"
    get = lambda p, i: F.regexp_extract(t, p, i)
    year = F.when(get(d, 1).try_cast("int") <= 25, F.concat(F.lit("20"), get(d, 1))).otherwise(F.concat(F.lit("19"), get(d, 1)))
    join = lambda y, m, x: F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(x, 2, "0"))
    return F.when(t.rlike(a), join(get(a, 1), get(a, 2), get(a, 3))).when(t.rlike(b), join(get(b, 3), get(b, 2), get(b, 1))).when(t.rlike(d), join(year, get(d, 2), get(d, 3)))


def normalize_gender(c: Column) -> Column:
    """male, female or null; words are looked for anywhere in the text, male ones first."""
    t = F.lower(text.strip(c))
    has = lambda *words: reduce(lambda x, y: x | y, [t.contains(w) for w in words])
    return (
        F.when(has("ذكر", "رجل", "م", "male"), "male")
        .when(has("أنثى", "امرأة", "ف", "female"), "female")
        .when(t.isin("m", "man", "boy"), "male")
        .when(t.isin("f", "woman", "girl"), "female")
    )

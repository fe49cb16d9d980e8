"""Checks of an identity number against the fields read beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nid as N

# Recommendation texts.
CONFLICT_DOB = "DOB conflict: Verify birth date against NID-encoded date. OCR may have misread digits."
CONFLICT_GENDER = "Gender conflict: Verify gender field. NID digit 11 determines gender (odd=male, even=female). OCR may have misread Arabic text."
CONFLICT_GOVERNORATE = "Governorate conflict: Verify governorate name. NID digits 9-10 encode governorate code. OCR may have misread Arabic place name."
INCONCLUSIVE = "Some consistency checks could not be completed due to missing or invalid data."


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _differ(a: Column, b: Column) -> Column:
    return F.concat(F.lit("NID: "), F.coalesce(a, F.lit("None")), F.lit(" vs OCR: "), b)


def compare(df: DataFrame, as_of: str, nid: str = "nid_raw", dob: str = "dob_raw", gender: str = "gender_raw", governorate: str = "governorate_raw") -> DataFrame:
    """df with the parts of the number and, for each of dob, gender and governorate, {x}_status and {x}_details.

    Dates and genders compare as normalised, governorates by code. Status is consistent, conflict, unknown or missing.
    """
    df = N.validate(df, nid, as_of)
    df = df.withColumns({"dob_normalized": N.normalize_date(F.nullif(F.col(dob), F.lit(""))), "gender_normalized": N.normalize_gender(F.nullif(F.col(gender), F.lit(""))), "governorate_code": N.code_by_name(F.col(governorate))})
    sides = {
        "dob": (dob, "nid_date_of_birth", "dob_normalized", "Could not derive DOB from NID", "Could not normalize OCR DOB", "Dates match", "DOB"),
        "gender": (gender, "nid_gender", "gender_normalized", "Could not derive gender from NID", "Could not normalize OCR gender", "Genders match", "Gender"),
        "governorate": (governorate, "nid_governorate_code", "governorate_code", "Could not derive governorate from NID", "Could not match OCR text to governorate", "Governorates match", "Governorate"),
    }
    out = {}
    for name, (raw, own, read, no_own, no_read, match, title) in sides.items():
        a, b = F.col(own), F.col(read)
        text = _differ(F.col("nid_governorate_arabic"), F.col(raw)) if name == "governorate" else _differ(a, b)
        out[f"{name}_status"] = F.when(_empty(nid) | _empty(raw), "missing").when(a.isNull() | b.isNull(), "unknown").when(a == b, "consistent").otherwise("conflict")
        out[f"{name}_details"] = (
            F.when(_empty(nid), "NID value not provided").when(_empty(raw), f"{title} value not provided")
            .when(a.isNull(), no_own).when(b.isNull(), no_read).when(a == b, match).otherwise(text)
        )
    return df.withColumns(out)


def summarize(df: DataFrame) -> DataFrame:
    """Adds counts, overall status, confidence, summary and recommendations from the three statuses of compare()."""
    statuses = F.array("dob_status", "gender_status", "governorate_status")
    count = lambda *s: F.size(F.filter(statuses, lambda x: x.isin(*s)))
    df = df.withColumns({"consistent_count": count("consistent"), "conflict_count": count("conflict"), "unknown_count": count("unknown", "missing")})
    yes, no, open_ = F.col("consistent_count"), F.col("conflict_count"), F.col("unknown_count")
    # A check weighs 1 if it is consistent or missing, else 1/2; it is worth 1, 0 (conflict) or 1/2.
    weight = lambda x: F.when(x.isin("consistent", "missing"), 1.0).otherwise(0.5)
    worth = lambda x: F.when(x == "consistent", 1.0).when(x == "conflict", 0.0).otherwise(0.5)
    total = lambda f: F.aggregate(F.transform(statuses, f), F.lit(0.0), lambda a, x: a + x)
    summary = F.concat_ws("; ", F.when(yes > 0, F.concat(yes.cast("string"), F.lit(" checks consistent"))), F.when(no > 0, F.concat(no.cast("string"), F.lit(" conflicts detected"))), F.when(open_ > 0, F.concat(open_.cast("string"), F.lit(" checks inconclusive"))))
    return df.withColumns({
        "has_conflicts": no > 0,
        "is_fully_consistent": no == 0,
        "overall_status": F.when(no > 0, "conflict").when(yes > 0, "consistent").otherwise("unknown"),
        "confidence": F.try_divide(total(lambda x: weight(x) * worth(x)), total(weight)),
        "conflicting_fields": F.when(no > 0, F.array(F.lit("nid"), F.lit("ocr"))).otherwise(F.array().cast("array<string>")),
        "summary": F.when(summary == "", "No consistency checks completed").otherwise(summary),
        "recommendations": F.array_compact(F.array(
            F.when(F.col("dob_status") == "conflict", CONFLICT_DOB), F.when(F.col("gender_status") == "conflict", CONFLICT_GENDER),
            F.when(F.col("governorate_status") == "conflict", CONFLICT_GOVERNORATE), F.when(open_ > 0, INCONCLUSIVE),
        )),
    })


def check_all(df: DataFrame, as_of: str, **columns: str) -> DataFrame:
    """compare() and summarize(): one projection over the cards, no shuffle and no join."""
    return summarize(compare(df, as_of, **columns))

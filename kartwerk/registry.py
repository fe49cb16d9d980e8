"""Registered queries over the star-schema tables, each with its own SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims, fixtures
from .config import Config
from .functions import geometry as G
from .functions import nid as N
from .functions import text as T
from .operators import consistency, detection, localization, ocr, pixels, rectification
from .plans import cards as plans

AS_OF = "2026-01-01"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def rnd(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# -- SQL of the oracles -----------------------------------------------------------------------------------------------

AR, FA, EN = T.ARABIC_DIGITS, T.PERSIAN_DIGITS, T.DIGITS
_values = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)
DIMS = f"gov(code, ar, en, region) AS (VALUES {_values(dims.GOVERNORATES)}), var(name, code) AS (VALUES {_values(dims.VARIATIONS)})"
SP = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def d_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g')"


def d_white(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SP[:-1]}\\x{{200B}}-\\x{{200D}}]+', ' ', 'g'))"


def d_arabic(c: str, digits: bool = True) -> str:
    x = f"translate(translate(coalesce({c}, ''), '{T.DIACRITICS}', ''), '{T.FOLD_FROM}', '{T.FOLD_TO}')"
    return d_white(f"translate({x}, '{AR}{FA}', '{EN}{EN}')" if digits else x)


def d_numeric(c: str) -> str:
    return f"regexp_replace(translate(coalesce({c}, ''), '{AR}{FA}', '{EN}{EN}'), '[^\\p{{Nd}}]', '', 'g')"


def d_gender_text(c: str) -> str:
    t = f"lower({d_arabic(c)})"
    return f"CASE WHEN contains({t}, 'ذكر') OR contains({t}, 'دكر') OR contains({t}, 'male') THEN 'male' WHEN contains({t}, 'انثى') OR contains({t}, 'أنثى') OR contains({t}, 'انثي') OR contains({t}, 'female') THEN 'female' END"


def d_gender(c: str) -> str:
    t = f"lower({d_strip(c)})"
    any_of = lambda ws: " OR ".join(f"contains({t}, '{w}')" for w in ws)
    return f"CASE WHEN {any_of(['ذكر', 'رجل', 'م', 'male'])} THEN 'male' WHEN {any_of(['أنثى', 'امرأة', 'ف', 'female'])} THEN 'female' WHEN {t} IN ('m', 'man', 'boy') THEN 'male' WHEN {t} IN ('f', 'woman', 'girl') THEN 'female' END"


def d_date(c: str) -> str:
    t = d_strip(f"translate({c}, '{AR}', '{EN}')")
    a, b, d = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})", r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})", r"^(\d{2})[-/](\d{1,2})[-/](\d{1,2})"
    g = lambda p, i: f"regexp_extract({t}, '{p}', {i})"
    two = lambda x: f"lpad({x}, 2, '0')"
    return (
        f"CASE WHEN regexp_matches({t}, '{a}') THEN {g(a, 1)} || '-' || {two(g(a, 2))} || '-' || {two(g(a, 3))} WHEN regexp_matches({t}, '{b}') THEN {g(b, 3)} || '-' || {two(g(b, 2))} || '-' || {two(g(b, 1))} "
        f"WHEN regexp_matches({t}, '{d}') THEN (CASE WHEN CAST({g(d, 1)} AS INT) <= 25 THEN '20' ELSE '19' END) || {g(d, 1)} || '-' || {two(g(d, 2))} || '-' || {two(g(d, 3))} END"
    )


def nid_sql(source: str = fixtures.ORACLE_CARD_READS, nid: str = "nid_raw", dob: str = "dob_raw", gender: str = "gender_raw", governorate: str = "governorate_raw") -> str:
    """CTEs up to `checked`: cards with parts, verdict and statuses."""
    probe = f"translate({d_strip(f'nullif({governorate}, {chr(39) * 2})')}, '{T.NAME_FROM}', '{T.NAME_TO}')"
    english = f"lower({d_strip(f'nullif({governorate}, {chr(39) * 2})')})"
    status = lambda raw, a, b: f"CASE WHEN coalesce({nid}, '') = '' OR coalesce({raw}, '') = '' THEN 'missing' WHEN {a} IS NULL OR {b} IS NULL THEN 'unknown' WHEN {a} = {b} THEN 'consistent' ELSE 'conflict' END"
    detail = lambda raw, a, b, t, no_a, no_b, match, text: f"CASE WHEN coalesce({nid}, '') = '' THEN 'NID value not provided' WHEN coalesce({raw}, '') = '' THEN '{t} value not provided' WHEN {a} IS NULL THEN '{no_a}' WHEN {b} IS NULL THEN '{no_b}' WHEN {a} = {b} THEN '{match}' ELSE {text} END"
    return f"""WITH {DIMS}, cards AS ({source}),
n0 AS (SELECT *, regexp_replace(translate(coalesce({nid}, ''), '{AR}', '{EN}'), '[^\\p{{Nd}}]', '', 'g') AS n FROM cards),
n1 AS (SELECT *, length(n) = 14 AS f, translate(n, '{FA}', '{EN}') AS p FROM n0),
n2 AS (SELECT *, CASE WHEN f THEN substr(n, 1, 1) END AS c, CASE WHEN f THEN try_cast(substr(p, 2, 2) AS INT) END AS yy, CASE WHEN f THEN try_cast(substr(p, 4, 2) AS INT) END AS mm,
  CASE WHEN f THEN try_cast(substr(p, 6, 2) AS INT) END AS dd, CASE WHEN f THEN substr(n, 9, 2) END AS gc, CASE WHEN f THEN try_cast(substr(p, 11, 1) AS INT) END AS gd FROM n1),
n3 AS (SELECT *, CASE c WHEN '2' THEN 1900 WHEN '3' THEN 2000 END AS century, CASE WHEN mm BETWEEN 1 AND 12 AND dd BETWEEN 1 AND 31
  THEN try_cast(CAST(CASE c WHEN '2' THEN 1900 ELSE 2000 END + yy AS VARCHAR) || '-' || lpad(CAST(mm AS VARCHAR), 2, '0') || '-' || lpad(CAST(dd AS VARCHAR), 2, '0') AS DATE) END AS born FROM n2),
n4 AS (SELECT n3.*, gov.ar, gov.en, coalesce(born <= DATE '{AS_OF}', FALSE) AS ok_date, gov.code IS NOT NULL AS ok_gov, CAST(born AS VARCHAR) AS dob_nid,
  CASE gd % 2 WHEN 1 THEN 'male' WHEN 0 THEN 'female' END AS gender_nid, {d_date(f"nullif({dob}, '')")} AS dob_read, {d_gender(f"nullif({gender}, '')")} AS gender_read,
  {probe} AS pa, {english} AS pe FROM n3 LEFT JOIN gov ON gov.code = n3.gc),
n5 AS (SELECT n4.*, coalesce(g1.code, v1.code, g2.code, v2.code) AS gov_read FROM n4 LEFT JOIN gov g1 ON g1.ar = pa LEFT JOIN var v1 ON v1.name = pa LEFT JOIN gov g2 ON g2.en = pe LEFT JOIN var v2 ON v2.name = pe),
checked AS (SELECT *, CASE WHEN NOT f THEN 'malformed' WHEN ok_date AND ok_gov THEN 'valid' WHEN NOT ok_date AND NOT ok_gov THEN 'invalid' WHEN NOT ok_date THEN 'invalid_date' ELSE 'invalid_governorate' END AS status,
  {status(dob, "dob_nid", "dob_read")} AS s_dob, {status(gender, "gender_nid", "gender_read")} AS s_gender, {status(governorate, "gc", "gov_read")} AS s_gov,
  {detail(dob, "dob_nid", "dob_read", "DOB", "Could not derive DOB from NID", "Could not normalize OCR DOB", "Dates match", "'NID: ' || dob_nid || ' vs OCR: ' || dob_read")} AS t_dob,
  {detail(gender, "gender_nid", "gender_read", "Gender", "Could not derive gender from NID", "Could not normalize OCR gender", "Genders match", "'NID: ' || gender_nid || ' vs OCR: ' || gender_read")} AS t_gender,
  {detail(governorate, "gc", "gov_read", "Governorate", "Could not derive governorate from NID", "Could not match OCR text to governorate", "Governorates match", f"'NID: ' || coalesce(ar, 'None') || ' vs OCR: ' || {governorate}")} AS t_gov
  FROM n5),
counted AS (SELECT *, CAST(s_dob = 'consistent' AS INT) + CAST(s_gender = 'consistent' AS INT) + CAST(s_gov = 'consistent' AS INT) AS k_yes,
  CAST(s_dob = 'conflict' AS INT) + CAST(s_gender = 'conflict' AS INT) + CAST(s_gov = 'conflict' AS INT) AS k_no FROM checked),
summed AS (SELECT *, 3 - k_yes - k_no AS k_open, CASE WHEN k_no > 0 THEN 'conflict' WHEN k_yes > 0 THEN 'consistent' ELSE 'unknown' END AS overall,
  {" + ".join(f"CASE {s} WHEN 'consistent' THEN 1.0 WHEN 'missing' THEN 1.0 ELSE 0.5 END" for s in ("s_dob", "s_gender", "s_gov"))} AS w,
  {" + ".join(f"CASE {s} WHEN 'consistent' THEN 1.0 WHEN 'missing' THEN 0.5 WHEN 'unknown' THEN 0.25 ELSE 0.0 END" for s in ("s_dob", "s_gender", "s_gov"))} AS ws FROM counted)
"""


NID = nid_sql()
ERRORS = """concat_ws(' | ', CASE WHEN n = '' THEN 'Empty or invalid NID' END, CASE WHEN n <> '' AND NOT f THEN 'Invalid NID length: expected 14 digits, got ' || CAST(length(n) AS VARCHAR) END,
  CASE WHEN f AND c NOT IN ('2', '3') THEN 'Invalid century code: ''' || c || ''' (expected ''2'' or ''3'')' END, CASE WHEN f AND c NOT IN ('2', '3') THEN 'Unknown century code: ' || c END,
  CASE WHEN f AND mm NOT BETWEEN 1 AND 12 THEN 'Invalid month: ' || CAST(mm AS VARCHAR) || ' (must be 01-12)' END, CASE WHEN f AND mm BETWEEN 1 AND 12 AND dd NOT BETWEEN 1 AND 31 THEN 'Invalid day: ' || CAST(dd AS VARCHAR) || ' (must be 01-31)' END,
  CASE WHEN mm BETWEEN 1 AND 12 AND dd BETWEEN 1 AND 31 AND born IS NULL THEN 'Invalid date: ' || CAST(yy AS VARCHAR) || '-' || lpad(CAST(mm AS VARCHAR), 2, '0') || '-' || lpad(CAST(dd AS VARCHAR), 2, '0') || ' (day is out of range for month)' END,
  CASE WHEN f AND born > DATE '2026-01-01' THEN 'Birth date ' || dob_nid || ' is in the future' END, CASE WHEN f AND NOT ok_gov THEN 'Invalid governorate code: ' || gc || ' (Unknown governorate code: ' || gc || ')' END)"""
WARNINGS = """concat_ws(' | ', CASE WHEN f AND c NOT IN ('2', '3') THEN 'First digit should be ''2'' (1900s) or ''3'' (2000s)' END, CASE WHEN f AND born > DATE '2026-01-01' THEN 'Date appears invalid (future date)' END,
  CASE WHEN f AND (DATE '2026-01-01' - born) / 365.25 > 120 THEN 'Unusual age: ' || CAST(CAST(round((DATE '2026-01-01' - born) / 365.25) AS INT) AS VARCHAR) || ' years (possible OCR error)' END,
  CASE WHEN f AND born > DATE '2026-01-01' THEN 'Calculated age is negative (date validation failed)' END,
  CASE gc WHEN '00' THEN 'Possible OCR error: detected as 00' WHEN '99' THEN 'Possible OCR error: detected as 99' WHEN '28' THEN 'Code 28 is not assigned (max is 27)' WHEN '29' THEN 'Code 29 is not assigned (max is 27)' END,
  CASE WHEN f THEN 'Check digit validation not available (algorithm not public)' END)"""


# -- numbers ----------------------------------------------------------------------------------------------------------


def _cards(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.card_reads(spark, d)


@query("nid_status_rollup", NID + "SELECT status, count(*) AS n FROM checked GROUP BY status")
def nid_status_rollup(spark, d):
    return N.validate(_cards(spark, d), "nid_raw", AS_OF).groupBy(F.col("nid_status").alias("status")).agg(F.count("*").alias("n"))


@query("v1_normalize_nid", NID + "SELECT card_id, n AS nid FROM n0")
def v1_normalize_nid(spark, d):
    return _cards(spark, d).select("card_id", N.normalize_nid(F.col("nid_raw")).alias("nid"))


@query("v10_validate", NID + f"SELECT card_id, status, status = 'valid' AS is_valid, f AS format_valid, ok_date AS date_valid, ok_gov AS governorate_valid, CAST(century AS BIGINT) AS century, CAST(yy AS BIGINT) AS birth_year, CAST(mm AS BIGINT) AS birth_month, CAST(dd AS BIGINT) AS birth_day, {ERRORS} AS errors, {WARNINGS} AS warnings FROM checked")
def v10_validate(spark, d):
    df = N.validate(_cards(spark, d), "nid_raw", AS_OF)
    long = [F.col(f"nid_{c}").cast("long").alias(c) for c in ("century", "birth_year", "birth_month", "birth_day")]
    flags = [F.col(f"nid_{c}").alias(c) for c in ("status", "is_valid", "format_valid", "date_valid", "governorate_valid")]
    return df.select("card_id", *flags, *long, F.array_join("nid_errors", " | ").alias("errors"), F.array_join("nid_warnings", " | ").alias("warnings"))


@query("v11_v13_derive", NID + "SELECT card_id, dob_nid AS dob, gender_nid AS gender, gc AS governorate_code, ar AS governorate_arabic, en AS governorate_english FROM checked")
def v11_v13_derive(spark, d):
    df = N.validate(_cards(spark, d), "nid_raw", AS_OF)
    return df.select("card_id", F.col("nid_date_of_birth").alias("dob"), F.col("nid_gender").alias("gender"), *[F.col(f"nid_governorate_{x}").alias(f"governorate_{x}") for x in ("code", "arabic", "english")])


@query("v14_normalize_date", NID + "SELECT card_id, dob_read AS dob FROM checked")
def v14_normalize_date(spark, d):
    return _cards(spark, d).select("card_id", N.normalize_date(F.col("dob_raw")).alias("dob"))


@query("v16_normalize_gender", NID + "SELECT card_id, gender_read AS gender FROM checked")
def v16_normalize_gender(spark, d):
    return _cards(spark, d).select("card_id", N.normalize_gender(F.col("gender_raw")).alias("gender"))


for _k, _name, _t in (("v17", "dob", "dob"), ("v18", "gender", "gender"), ("v19", "governorate", "gov")):

    @query(f"{_k}_compare_{_name}", NID + f"SELECT card_id, s_{_t} AS status, t_{_t} AS details FROM checked")
    def _compare(spark, d, name=_name):
        return consistency.compare(_cards(spark, d), AS_OF).select("card_id", F.col(f"{name}_status").alias("status"), F.col(f"{name}_details").alias("details"))


# -- governorates -----------------------------------------------------------------------------------------------------


@query("a11_codes", f"WITH {DIMS} SELECT code FROM gov")
def a11_codes(spark, d):
    return dims.all_codes(spark)


@query("v20_names", f"WITH {DIMS} SELECT code, ar AS name, 'arabic' AS language FROM gov UNION ALL SELECT code, en, 'english' FROM gov")
def v20_names(spark, d):
    return dims.all_names(spark).withColumn("language", F.lit("arabic")).unionByName(dims.all_names(spark, "English").withColumn("language", F.lit("english")))


@query("v21_by_region", f"WITH {DIMS} SELECT code, ar AS name_arabic, en AS name_english, region FROM gov WHERE lower(region) = 'upper egypt'")
def v21_by_region(spark, d):
    return dims.governorates_by_region(spark, "UPPER Egypt")


@query("v6_code_check", NID + "SELECT card_id, gc AS code, ar AS name, CASE WHEN gc IS NULL THEN 'Empty governorate code' WHEN ar IS NULL THEN 'Unknown governorate code: ' || gc END AS error FROM checked")
def v6_code_check(spark, d):
    df = N.validate(_cards(spark, d), "nid_raw", AS_OF)
    c = F.col("nid_governorate_code")
    return df.select("card_id", c.alias("code"), N.governorate_name(c).alias("name"), N.code_check(c).alias("error"))


@query("j4_lookup", NID + "SELECT card_id, governorate_raw AS name, gov_read AS code FROM checked")
def j4_lookup(spark, d):
    return _cards(spark, d).select("card_id", F.col("governorate_raw").alias("name"), N.code_by_name(F.col("governorate_raw")).alias("code"))


# every canonical name against the lookups: the ones that folding and case keep from matching are part of the contract
@query("j2_j3_canonical", f"WITH {DIMS}, p AS (SELECT *, translate(ar, '{T.NAME_FROM}', '{T.NAME_TO}') AS pa, lower(en) AS pe FROM gov) SELECT p.code, coalesce(g1.code, v1.code) AS by_arabic, coalesce(g2.code, v2.code) AS by_english FROM p LEFT JOIN gov g1 ON g1.ar = pa LEFT JOIN var v1 ON v1.name = pa LEFT JOIN gov g2 ON g2.en = pe LEFT JOIN var v2 ON v2.name = pe")
def j2_j3_canonical(spark, d):
    return dims.governorates(spark).select("code", N.code_by_arabic_name(F.col("name_arabic")).alias("by_arabic"), N.code_by_english_name(F.col("name_english")).alias("by_english"))


# -- text -------------------------------------------------------------------------------------------------------------

TEXT = f"WITH t AS ({fixtures.ORACLE_TEXT}) "


@query("n1_n5_text", TEXT + f"SELECT CAST(id AS BIGINT) AS id, translate(text, '{AR}{FA}', '{EN}{EN}') AS digits, translate(text, '{T.DIACRITICS}', '') AS plain, translate(text, '{T.FOLD_FROM}', '{T.FOLD_TO}') AS folded, {d_white('text')} AS tidy FROM t")
def n1_n5_text(spark, d):
    c = F.col("text")
    return fixtures.arabic_text(spark).select(F.col("id").cast("long").alias("id"), T.normalize_digits(c).alias("digits"), T.remove_diacritics(c).alias("plain"), T.fold_letters(c).alias("folded"), T.normalize_whitespace(c).alias("tidy"))


@query("n6_normalize", TEXT + f"SELECT CAST(id AS BIGINT) AS id, {d_arabic('text')} AS text FROM t")
def n6_normalize(spark, d):
    return fixtures.arabic_text(spark).select(F.col("id").cast("long").alias("id"), T.normalize_arabic(F.col("text")).alias("text"))


@query("n2_nfkc")
def n2_nfkc(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.nfkc(F.col("text")).alias("text"))


@query("n7_n10_text", TEXT + f"SELECT CAST(id AS BIGINT) AS id, {d_numeric('text')} AS numeric_text, {d_gender_text('text')} AS gender, length(regexp_replace(coalesce(text, ''), '[^\\x{{0600}}-\\x{{06FF}}]', '', 'g')) > 0.5 * length(coalesce(text, '')) AS arabic, CASE WHEN length(regexp_replace(coalesce(text, ''), '{SP}', '', 'g')) = 0 THEN FALSE ELSE length(regexp_replace(coalesce(text, ''), '[^\\p{{Nd}}]', '', 'g')) > 0.7 * length(regexp_replace(coalesce(text, ''), '{SP}', '', 'g')) END AS mostly_numeric, translate({d_strip('text')}, '{T.NAME_FROM}', '{T.NAME_TO}') AS name FROM t")
def n7_n10_text(spark, d):
    c = F.col("text")
    return fixtures.arabic_text(spark).select(F.col("id").cast("long").alias("id"), T.numeric_candidate(c).alias("numeric_text"), T.gender_text(c).alias("gender"), T.is_mostly_arabic(c).alias("arabic"), T.is_mostly_numeric(c).alias("mostly_numeric"), T.fold_name(c).alias("name"))


@query("n9_documents", f"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\\x{{0600}}-\\x{{06FF}}]', '', 'g')) > 0.5 * length(coalesce(text, '')) AS arabic, {d_numeric('text')} AS digits FROM documents")
def n9_documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.is_mostly_arabic(F.col("text")).alias("arabic"), T.numeric_candidate(F.col("text")).alias("digits"))


LONG = fixtures.ORACLE_CARD_READS
FIELD = f"""CASE field_name WHEN 'nid' THEN nullif({d_numeric('raw')}, '') WHEN 'dob' THEN nullif(regexp_replace({d_arabic('raw')}, '[^\\p{{Nd}}/\\-.]', '', 'g'), '') WHEN 'gender' THEN {d_gender_text('raw')}
  WHEN 'governorate' THEN nullif({d_arabic('raw', False)}, '') WHEN 'name' THEN nullif({d_arabic('raw', False)}, '') WHEN 'address' THEN nullif({d_arabic('raw')}, '') ELSE raw END"""


@query("n11_field_value", "WITH c AS (" + LONG + "), f AS (" + " UNION ALL ".join(f"SELECT card_id, '{n}' AS field_name, {n}_raw AS raw FROM c" for n in ("nid", "dob", "gender", "governorate")) + f") SELECT card_id, field_name, {FIELD} AS value FROM f")
def n11_field_value(spark, d):
    names = ("nid", "dob", "gender", "governorate")
    long = _cards(spark, d).select("card_id", F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(f"{n}_raw").alias("raw")) for n in names])).alias("f")).select("card_id", "f.*")
    return long.select("card_id", "field_name", T.field_value(F.col("field_name"), F.col("raw"), compose=False).alias("value"))


# -- consistency ------------------------------------------------------------------------------------------------------


@query("c4_check_all", NID + "SELECT card_id, s_dob AS dob_status, s_gender AS gender_status, s_gov AS governorate_status, CAST(k_yes AS BIGINT) AS consistent_count, CAST(k_no AS BIGINT) AS conflict_count, CAST(k_open AS BIGINT) AS unknown_count, k_no > 0 AS has_conflicts, overall AS overall_status, round(CAST(ws AS DOUBLE) / CAST(w AS DOUBLE), 6) AS confidence FROM summed")
def c4_check_all(spark, d):
    df = consistency.check_all(_cards(spark, d), AS_OF)
    return df.select("card_id", "dob_status", "gender_status", "governorate_status", *[F.col(c).cast("long").alias(c) for c in ("consistent_count", "conflict_count", "unknown_count")], "has_conflicts", "overall_status", rnd("confidence").alias("confidence"))


_RECS = f"concat_ws(' | ', CASE WHEN s_dob = 'conflict' THEN '{consistency.CONFLICT_DOB}' END, CASE WHEN s_gender = 'conflict' THEN '{consistency.CONFLICT_GENDER}' END, CASE WHEN s_gov = 'conflict' THEN '{consistency.CONFLICT_GOVERNORATE}' END, CASE WHEN k_open > 0 THEN '{consistency.INCONCLUSIVE}' END)"


@query("c5_recommendations", NID + f"SELECT card_id, concat_ws('; ', CASE WHEN k_yes > 0 THEN k_yes || ' checks consistent' END, CASE WHEN k_no > 0 THEN k_no || ' conflicts detected' END, CASE WHEN k_open > 0 THEN k_open || ' checks inconclusive' END) AS summary, {_RECS} AS recommendations, CASE WHEN k_no > 0 THEN 'nid,ocr' ELSE '' END AS conflicting_fields, k_no = 0 AS fully_consistent FROM summed")
def c5_recommendations(spark, d):
    df = consistency.check_all(_cards(spark, d), AS_OF)
    return df.select("card_id", "summary", F.array_join("recommendations", " | ").alias("recommendations"), F.array_join("conflicting_fields", ",").alias("conflicting_fields"), F.col("is_fully_consistent").alias("fully_consistent"))


@query("consistency_rollup", NID + "SELECT overall AS overall_status, status AS nid_status, count(*) AS n, round(avg(CAST(ws AS DOUBLE) / CAST(w AS DOUBLE)), 6) AS mean_confidence FROM summed GROUP BY overall, status")
def consistency_rollup(spark, d):
    df = consistency.check_all(_cards(spark, d), AS_OF)
    return df.groupBy("overall_status", "nid_status").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


# -- geometry ---------------------------------------------------------------------------------------------------------

Q = f"WITH q AS ({fixtures.ORACLE_QUADS})"
_P = [("x1", "y1"), ("x2", "y2"), ("x3", "y3"), ("x4", "y4")]
_dist = lambda a, b: f"sqrt(({a[0]} - {b[0]}) * ({a[0]} - {b[0]}) + ({a[1]} - {b[1]}) * ({a[1]} - {b[1]}))"
D_AREA = "abs(" + " + ".join(f"({_P[i][0]} * {_P[(i + 1) % 4][1]} - {_P[(i + 1) % 4][0]} * {_P[i][1]})" for i in range(4)) + ") / 2.0"
_turn = lambda i: f"(({_P[(i + 1) % 4][0]} - {_P[i][0]}) * ({_P[(i + 2) % 4][1]} - {_P[(i + 1) % 4][1]}) - ({_P[(i + 1) % 4][1]} - {_P[i][1]}) * ({_P[(i + 2) % 4][0]} - {_P[(i + 1) % 4][0]}))"
D_CONVEX = "((" + " AND ".join(f"{_turn(i)} > 0" for i in range(4)) + ") OR (" + " AND ".join(f"{_turn(i)} < 0" for i in range(4)) + "))"
D_BOX = "((greatest(x1, x2, x3, x4) - least(x1, x2, x3, x4)) * (greatest(y1, y2, y3, y4) - least(y1, y2, y3, y4)))"
D_RECT = f"(CASE WHEN {D_BOX} > 0 THEN ({D_AREA}) / {D_BOX} ELSE 0.0 END)"
_TB, _LR = f"({_dist(_P[0], _P[1])} + {_dist(_P[3], _P[2])}) / 2.0", f"({_dist(_P[0], _P[3])} + {_dist(_P[1], _P[2])}) / 2.0"
D_AR = f"(CASE WHEN ({_LR}) > 0 THEN ({_TB}) / ({_LR}) ELSE 0.0 END)"


def _d_angle(i: int) -> str:
    p, a, b = _P[i], _P[(i - 1) % 4], _P[(i + 1) % 4]
    n = f"(sqrt(({a[0]} - {p[0]}) * ({a[0]} - {p[0]}) + ({a[1]} - {p[1]}) * ({a[1]} - {p[1]})) * sqrt(({b[0]} - {p[0]}) * ({b[0]} - {p[0]}) + ({b[1]} - {p[1]}) * ({b[1]} - {p[1]})))"
    dot = f"(({a[0]} - {p[0]}) * ({b[0]} - {p[0]}) + ({a[1]} - {p[1]}) * ({b[1]} - {p[1]}))"
    return f"(CASE WHEN {n} > 0 THEN degrees(acos(greatest(-1.0, least(1.0, {dot} / {n})))) ELSE 0.0 END)"


D_ANGLES = [_d_angle(i) for i in range(4)]
D_ISSUES = (
    f"CASE WHEN {D_CONVEX} THEN 0 ELSE 2 END + " + " + ".join(f"CAST({x} < 0 OR {x} > image_w AS INT) + CAST({y} < 0 OR {y} > image_h AS INT)" for x, y in _P)
    + " + " + " + ".join(f"CAST({_dist(_P[i], _P[j])} < 50 AS INT)" for i in range(4) for j in range(i + 1, 4)) + " + " + " + ".join(f"CAST(abs({a} - 90.0) > 45.0 AS INT)" for a in D_ANGLES)
)


@query("p1_bbox", Q + "SELECT image_id, cand_id, x2 - x1 AS w, y3 - y1 AS h, (x2 - x1) * (y3 - y1) AS area, CASE WHEN y3 - y1 = 0 THEN 0.0 ELSE round((x2 - x1) / (y3 - y1), 6) END AS aspect, (x1 + x2) / 2 AS cx, (y1 + y3) / 2 AS cy, x1 < x2 AND y1 < y3 AND x1 >= 0 AND y1 >= 0 AND x2 <= image_w AND y3 <= image_h AS valid, CAST(trunc(x1 * 1.5) AS BIGINT) AS sx1, CAST(trunc(y1 * 0.5) AS BIGINT) AS sy1 FROM q")
def p1_bbox(spark, d):
    q = fixtures.quads(spark, d)
    box = [F.col(c) for c in ("x1", "y1", "x2", "y3")]
    p = G.bbox_properties(*box)
    s = G.scale_bbox(box, F.lit(1.5), F.lit(0.5))
    return q.select("image_id", "cand_id", p["width"].alias("w"), p["height"].alias("h"), p["area"].alias("area"), rnd(p["aspect"]).alias("aspect"), p["center_x"].alias("cx"), p["center_y"].alias("cy"), G.bbox_valid(*box, F.col("image_w"), F.col("image_h")).alias("valid"), s[0].alias("sx1"), s[1].alias("sy1"))


@query("g2_g13_quads", Q + f"SELECT image_id, cand_id, {D_CONVEX} AS convex, round({D_AREA}, 6) AS area, round({D_RECT}, 6) AS rectangularity, round({D_AR}, 6) AS aspect, CAST(floor(least(x1, x2, x3, x4)) AS BIGINT) AS bx1, CAST(floor(least(y1, y2, y3, y4)) AS BIGINT) AS by1, CAST(ceil(greatest(x1, x2, x3, x4)) AS BIGINT) AS bx2, CAST(ceil(greatest(y1, y2, y3, y4)) AS BIGINT) AS by2 FROM q")
def g2_g13_quads(spark, d):
    q = G.corners()
    return fixtures.quads(spark, d).select("image_id", "cand_id", G.is_convex(q).alias("convex"), rnd(G.area(q)).alias("area"), rnd(G.rectangularity(q)).alias("rectangularity"), rnd(G.aspect_ratio(q)).alias("aspect"), *[v.cast("long").alias(k) for k, v in G.bounds(q).items()])


@query("g5_angles", Q + "SELECT image_id, cand_id, " + ", ".join(f"round({a}, 4) AS a{i + 1}" for i, a in enumerate(D_ANGLES)) + " FROM q")
def g5_angles(spark, d):
    return fixtures.quads(spark, d).select("image_id", G.apart(F.col("cand_id")).alias("cand_id"), *[rnd(a, 4).alias(f"a{i + 1}") for i, a in enumerate(G.angles(G.corners()))])


@query("g4_issues", Q + f"SELECT image_id, cand_id, CAST({D_ISSUES} AS BIGINT) AS n_issues FROM q")
def g4_issues(spark, d):
    return fixtures.quads(spark, d).select("image_id", G.apart(F.col("cand_id")).alias("cand_id"), G.number(G.flaws(G.corners(), F.col("image_w"), F.col("image_h"))).cast("long").alias("n_issues"))


# corners dealt in another order come back ordered
@query("w5_order", Q + """, p AS (SELECT image_id, cand_id, unnest([{'i': 0, 'x': x3, 'y': y3}, {'i': 1, 'x': x1, 'y': y1}, {'i': 2, 'x': x4, 'y': y4}, {'i': 3, 'x': x2, 'y': y2}], recursive := true) FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, cand_id ORDER BY y, i) <= 2 AS up FROM p), s AS (SELECT *, row_number() OVER (PARTITION BY image_id, cand_id, up ORDER BY x, i) AS k FROM r)
SELECT image_id, cand_id, max(CASE WHEN up AND k = 1 THEN x END) AS x1, max(CASE WHEN up AND k = 1 THEN y END) AS y1, max(CASE WHEN up AND k = 2 THEN x END) AS x2, max(CASE WHEN up AND k = 2 THEN y END) AS y2,
max(CASE WHEN NOT up AND k = 2 THEN x END) AS x3, max(CASE WHEN NOT up AND k = 2 THEN y END) AS y3, max(CASE WHEN NOT up AND k = 1 THEN x END) AS x4, max(CASE WHEN NOT up AND k = 1 THEN y END) AS y4 FROM s GROUP BY image_id, cand_id""")
def w5_order(spark, d):
    c = G.corners()
    o = G.ordered([c[2], c[0], c[3], c[1]])
    return fixtures.quads(spark, d).select("image_id", "cand_id", *[v.alias(n) for v, n in zip(o, detection.CORNERS)])


@query("g14_detection_scale", Q + "SELECT DISTINCT image_id, round(CASE WHEN greatest(image_w, image_h) <= 1280 THEN 1.0 ELSE 1280.0 / greatest(image_w, image_h) END, 6) AS scale, CAST(trunc(image_w * CASE WHEN greatest(image_w, image_h) <= 1280 THEN 1.0E0 ELSE 1280.0E0 / greatest(image_w, image_h) END) AS BIGINT) AS scaled_w FROM q")
def g14_detection_scale(spark, d):
    s = G.detection_scale(F.col("image_w"), F.col("image_h"), 1280)
    return fixtures.quads(spark, d).select("image_id", rnd(s["scale"]).alias("scale"), s["scaled_w"].alias("scaled_w")).distinct()


# Three corners, each weighted so that together they give the fourth, as in Spark: another construction differs in last bits,
# and some elements are exactly in the middle of two roundings. tests/test_rasters.py solves for the matrix instead.
_det3 = lambda a, b, c: f"({a}x * ({b}y - {c}y) - {a}y * ({b}x - {c}x) + ({b}x * {c}y - {c}x * {b}y))"
_cross = lambda a, b: (f"({a}y - {b}y)", f"({b}x - {a}x)", f"({a}x * {b}y - {a}y * {b}x)")
_map = lambda m, x, y: [f"(({m}{3 * i} * ({x}) + {m}{3 * i + 1} * ({y}) + {m}{3 * i + 2}) / ({m}6 * ({x}) + {m}7 * ({y}) + {m}8))" for i in (0, 1)]


def _d_box(m: str, box: tuple[str, str, str, str], w: str, h: str) -> list[str]:
    x1, y1, x2, y2 = box
    pts = [_map(m, x, y) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]
    xs, ys = ", ".join(p[0] for p in pts), ", ".join(p[1] for p in pts)
    inside = lambda v, most: f"CAST(greatest(0, least({most}, {v})) AS BIGINT)"
    return [inside(f"floor(least({xs}))", w), inside(f"floor(least({ys}))", h), inside(f"ceil(greatest({xs}))", w), inside(f"ceil(greatest({ys}))", h)]


_INSET = ("x1 + 10.2501E0", "y1 + 7.5003E0", "x3 - 11.2507E0", "y3 - 6.5009E0")
G9 = f"""{Q}, k0 AS (SELECT *, {", ".join(f"CAST(CAST({v}{i} AS FLOAT) AS DOUBLE) AS {n}{v}" for n, i in zip("efgt", (1, 2, 3, 4)) for v in "xy")} FROM q WHERE {D_CONVEX}),
k1 AS (SELECT *, {", ".join(f"{v} / {_det3(*w)} AS {n}{i}" for n, pair, w in (("p", "fg", "tfg"), ("s", "ge", "etg"), ("r", "ef", "eft")) for i, v in enumerate(_cross(*pair)))} FROM k0),
k2 AS (SELECT *, {", ".join(f"999.0E0 * (r{i} - s{i}) AS h{i}, 629.0E0 * r{i} AS h{3 + i}, p{i} - s{i} + r{i} AS h{6 + i}" for i in range(3))} FROM k1),
k3 AS (SELECT image_id, cand_id, image_w, image_h, x1, y1, x3, y3, {", ".join(f"h{i} / h8 AS m{i}" for i in range(9))} FROM k2),
k4 AS (SELECT *, {", ".join(f"{v} AS c{i}" for i, v in enumerate(_d_box("m", _INSET, "1000", "630")))}, m4 * m8 - m5 * m7 AS n0, m2 * m7 - m1 * m8 AS n1, m1 * m5 - m2 * m4 AS n2, m5 * m6 - m3 * m8 AS n3, m0 * m8 - m2 * m6 AS n4, m2 * m3 - m0 * m5 AS n5, m3 * m7 - m4 * m6 AS n6, m1 * m6 - m0 * m7 AS n7, m0 * m4 - m1 * m3 AS n8 FROM k3)
SELECT image_id, cand_id, {", ".join(f"CASE WHEN abs(m{i}) < 1 THEN round(m{i}, 9) WHEN abs(m{i}) < 1000 THEN round(m{i}, 6) WHEN abs(m{i}) < 100000 THEN round(m{i}, 3) ELSE round(m{i}, 0) END + 0.0E0 AS m{i}" for i in range(9))}, c0, c1, c2, c3, {", ".join(f"{v} AS s{i}" for i, v in enumerate(_d_box("n", tuple(f"c{i} + 0.3701E0" for i in range(4)), "image_w", "image_h")))} FROM k4"""


@query("g9_g12_homography", G9)
def g9_g12_homography(spark, d):
    """Matrix of each convex outline (fewer digits of large elements), a box inside it on the card, and that box back in the image."""
    q = fixtures.quads(spark, d).where(G.is_convex(G.corners()))
    # Where the matrix's last element is 0 the SQL divides by it.
    none = F.array(*[x * float("inf") for x in G.projection(G.corners())])
    number = G.apart(F.col("cand_id")).alias("cand_id")
    q = q.select("image_id", number, "image_w", "image_h", *[f"{c}{i}" for i in (1, 3) for c in "xy"], G.homography(G.corners()).alias("m"), none.alias("none"))
    m = [F.get("m", i) for i in range(9)]
    there = G.map_bbox(m, [F.col("x1") + 10.2501, F.col("y1") + 7.5003, F.col("x3") - 11.2507, F.col("y3") - 6.5009], F.lit(1000), F.lit(630))
    q = q.select("image_id", number, "image_w", "image_h", "m", "none", *[c.alias(f"c{i}") for i, c in enumerate(there)])
    back = G.map_bbox(G.adjugate(m), [F.col(f"c{i}") + 0.3701 for i in range(4)], F.col("image_w"), F.col("image_h"))
    # Scaled in binary, as DuckDB rounds; F.round(x, 9) takes the shortest decimal and parts from it beside ties.
    cut = lambda x, digits: F.round(x * 10.0**digits) / 10.0**digits
    short = lambda x: F.when(F.abs(x) < 1, cut(x, 9)).when(F.abs(x) < 1000, cut(x, 6)).when(F.abs(x) < 100000, cut(x, 3)).otherwise(cut(x, 0)) + 0.0
    shown = [F.when(F.col("m").isNull(), F.get("none", i)).otherwise(short(x)).alias(f"m{i}") for i, x in enumerate(m)]
    return q.select("image_id", number, *shown, *[f"c{i}" for i in range(4)], *[c.alias(f"s{i}") for i, c in enumerate(back)])


# The hull's edges are the pairs with no point to their right and none in line beyond them; the fold in Spark sorts instead.
@query("g8_convexity", """WITH e AS (SELECT vec_id, i, CAST(floor(1000 * CAST(embedding[2 * i + 1] AS DOUBLE)) AS BIGINT) AS x, CAST(floor(1000 * CAST(embedding[2 * i + 2] AS DOUBLE)) AS BIGINT) AS y FROM embeddings, (SELECT unnest(range(0, 16)) AS i) k),
s AS (SELECT a.vec_id, abs(sum(a.x * b.y - b.x * a.y)) / 2.0E0 AS area FROM e a JOIN e b ON a.vec_id = b.vec_id AND b.i = (a.i + 1) % 16 GROUP BY a.vec_id), p AS (SELECT DISTINCT vec_id, x, y FROM e),
t AS (SELECT a.vec_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0 OR ((b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) <= 0)) AS edge
  FROM p a JOIN p b ON a.vec_id = b.vec_id AND (a.x <> b.x OR a.y <> b.y) JOIN p c ON c.vec_id = a.vec_id GROUP BY ALL),
h AS (SELECT vec_id, count(*) FILTER (WHERE edge) AS n, coalesce(sum(x1 * y2 - x2 * y1) FILTER (WHERE edge), 0) / 2.0E0 AS hull FROM t GROUP BY vec_id)
SELECT vec_id, n AS n_corners, round(hull, 1) AS hull_area, round(CASE WHEN hull > 0 THEN area / hull ELSE 0.0E0 END, 9) AS convexity FROM h JOIN s USING (vec_id)""")
def g8_convexity(spark, d):
    """The first sixteen pairs of numbers of each vector as a polygon: its hull and its convexity."""
    at = lambda i: F.floor(F.get("embedding", i.cast("int")).cast("double") * 1000).cast("double")
    points = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y")))
    df = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", points.alias("points")).withColumn("hull", G.hull(F.col("points")))
    hull = G.polygon_area(F.col("hull"))
    return df.select("vec_id", F.size("hull").cast("long").alias("n_corners"), F.round(hull, 1).alias("hull_area"), F.round(G.convexity(G.polygon_area(F.col("points")), hull), 9).alias("convexity"))


# -- detection --------------------------------------------------------------------------------------------------------

D_SCORE = f"0.25E0 * least(10.0E0 * ({D_AREA}) / (image_w * image_h), 1.0E0) + 0.20E0 * (1.0E0 - least(abs({D_AR} - 1.587E0) / 0.3E0, 1.0E0)) + 0.25E0 * {D_RECT} + 0.15E0 * convexity + 0.15E0 * edge_strength"
DET = f"""{Q}, s AS (SELECT *, {D_AREA} AS area, {D_AR} AS ar, {D_RECT} AS rect, {D_SCORE} AS score, {D_ISSUES} AS corner_issues FROM q),
v AS (SELECT *, area / (image_w * image_h) * (image_w * image_h) < image_w * image_h * 0.05E0 AS bad_area, ar < 1.587E0 - 0.3E0 OR ar > 1.587E0 + 0.3E0 AS bad_ar, rect < 0.6E0 AS bad_rect, convexity < 0.75E0 AS bad_convex FROM s),
w AS (SELECT *, NOT (bad_area OR bad_ar OR bad_rect OR bad_convex) AND corner_issues = 0 AS ok FROM v),
b AS (SELECT image_id, count(*) AS candidate_count, max(score) AS best_score, arg_max(bad_area, [score, -cand_id]) FILTER (WHERE TRUE) AS dummy,
  arg_min(bad_area, [score, -cand_id]) AS last_bad_area, arg_max(struct_pack(cand_id := cand_id, score := score, rect := rect), [score, -cand_id]) FILTER (WHERE ok) AS good FROM w GROUP BY image_id)
"""


@query("d3_score", DET + "SELECT image_id, cand_id, round(score, 6) AS score FROM s")
def d3_score(spark, d):
    return detection.score(fixtures.quads(spark, d)).select("image_id", "cand_id", rnd("score").alias("score"))


@query("d5_validate", DET + "SELECT image_id, cand_id, bad_area, bad_ar, bad_rect, bad_convex, CAST(corner_issues AS BIGINT) AS corner_issues, ok FROM w")
def d5_validate(spark, d):
    df = detection.validate(detection.score(fixtures.quads(spark, d)))
    bad = detection.checks()
    n = sum((b.cast("int") for b in bad.values()), F.lit(0))
    return df.select("image_id", "cand_id", bad["bad_area"].alias("bad_area"), bad["bad_aspect"].alias("bad_ar"), bad["bad_rectangularity"].alias("bad_rect"), bad["bad_convexity"].alias("bad_convex"), (F.col("n_issues") - n).cast("long").alias("corner_issues"), F.col("is_valid").alias("ok"))


@query("d6_choose", DET + "SELECT image_id, CASE WHEN good IS NOT NULL THEN 'detected' WHEN last_bad_area THEN 'card_too_small' ELSE 'card_geometry_invalid' END AS status, candidate_count, round(best_score, 6) AS best_score, good.cand_id AS cand_id, round(CASE WHEN good IS NULL THEN best_score ELSE greatest(0.0, least(1.0, good.score * (1.0 - greatest(0.0, 0.3 * (1.0 - good.rect))))) END, 6) AS confidence FROM b")
def d6_choose(spark, d):
    df = detection.detect(fixtures.quads(spark, d))
    return df.select("image_id", "status", "candidate_count", rnd("best_candidate_score").alias("best_score"), "cand_id", rnd("confidence").alias("confidence"))


@query("d7_full_frame", Q + ", im AS (SELECT DISTINCT image_id, image_w, image_h FROM q), c AS (SELECT DISTINCT image_id FROM q WHERE cand_id > 1 AND convexity > 0.9) SELECT im.image_id, CASE WHEN abs(image_w / image_h - 1.587E0) <= 0.6E0 THEN 'full_frame_card_fallback' ELSE 'card_not_detected' END AS status, CASE WHEN abs(image_w / image_h - 1.587E0) <= 0.6E0 THEN 0.3E0 ELSE 0.0E0 END AS confidence FROM im LEFT JOIN c USING (image_id) WHERE c.image_id IS NULL")
def d7_full_frame(spark, d):
    q = fixtures.quads(spark, d)
    return detection.full_frame(q.select("image_id", "image_w", "image_h").distinct(), q.where("cand_id > 1 and convexity > 0.9")).select("image_id", "status", "confidence")


@query("p4_p5_contours", Q + f"SELECT image_id, cand_id, CASE WHEN 3 + (cand_id + image_id) % 3 = 4 THEN 'polygon' ELSE 'box' END AS outline FROM q WHERE {D_AREA} >= 10000 AND 3 + (cand_id + image_id) % 3 >= 4 AND (3 + (cand_id + image_id) % 3 = 4 OR {D_BOX} >= 10000)")
def p4_p5_contours(spark, d):
    xs, ys = [F.col(f"x{i}") for i in range(1, 5)], [F.col(f"y{i}") for i in range(1, 5)]
    box = (F.greatest(*xs) - F.least(*xs)) * (F.greatest(*ys) - F.least(*ys))
    c = fixtures.quads(spark, d).withColumns({"area": G.area(G.corners()), "n_vertices": 3 + (F.col("cand_id") + F.col("image_id")) % 3, "box_area": box})
    return detection.contour_filter(c).select("image_id", "cand_id", "outline")


# -- rectification ----------------------------------------------------------------------------------------------------

_pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
D_R1 = "greatest(0.0E0, 1.0E0 - (" + " + ".join([f"CASE WHEN abs({a} - 90.0) > 45.0 THEN 0.25E0 WHEN abs({a} - 90.0) > 30.0 THEN 0.1E0 ELSE 0.0E0 END" for a in D_ANGLES] + [f"CASE WHEN {_dist(_P[i], _P[j])} < 50 THEN 0.2E0 ELSE 0.0E0 END" for i, j in _pairs]) + "))"
D_R2 = f"greatest(0.0E0, 1.0E0 - CASE WHEN {D_CONVEX} THEN 0.0E0 ELSE 1.0E0 END - CASE WHEN {D_RECT} < 0.7E0 THEN 0.2E0 ELSE 0.0E0 END)"
D_R3 = f"least(({D_AREA}) / (image_w * image_h), 1.0E0)"


@query("r1_r6_rectify", Q + f", r AS (SELECT *, {D_R1} AS cq, {D_R2} AS gv, {D_R3} AS ac FROM q), c AS (SELECT *, greatest(0.0E0, least(1.0E0, convexity * (0.7E0 + 0.3E0 * cq) * (0.7E0 + 0.3E0 * gv) * (CASE WHEN ac < 0.8E0 THEN 0.8E0 ELSE 1.0E0 END) * (0.8E0 + 0.2E0 * edge_strength))) AS rc FROM r) SELECT image_id, cand_id, round(cq, 6) AS corner_quality, round(gv, 6) AS geometry_validity, round(ac, 12) AS area_coverage, round(rc, 6) AS rect_confidence, CASE WHEN rc < 0.3 THEN 'rectification_failed' WHEN rc < 0.5 THEN 'rectification_low_confidence' ELSE 'success' END AS rect_status FROM c")
def r1_r6_rectify(spark, d):
    q = fixtures.quads(spark, d).withColumns({"status": F.lit("detected"), "confidence": F.col("convexity"), "border_quality": F.col("edge_strength")})
    return rectification.rectify(q).select("image_id", "cand_id", *[rnd(c).alias(c) for c in ("corner_quality", "geometry_validity", "rect_confidence")], rnd("area_coverage", 12).alias("area_coverage"), "rect_status")


# -- localization -----------------------------------------------------------------------------------------------------
# Pixels are stood in for by a density that depends on the card and the box.

_REG = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}E0" for v in r) + ")" for r in Config().regions)
D_DENS = lambda p: f"((card_id * 7 + {p}x1 * 3 + {p}y1 * 11 + {p}x2 * 5 + {p}y2 * 13) % 97) / 97.0E0"
D_KIND = "CASE refinement WHEN 'digits' THEN d * greatest(0.0E0, 1.0E0 - abs((x2 - x1) / (y2 - y1) - 4.0E0) / 4.0E0) WHEN 'text_lines' THEN d * (1.0E0 + 0.2E0 * least((x2 - x1) / (y2 - y1), 5.0E0)) WHEN 'short_digits' THEN d * least(1.0E0, 100.0E0 / ((x2 - x1) * (y2 - y1))) WHEN 'compact' THEN d * least(1.0E0, 5000.0E0 / ((x2 - x1) * (y2 - y1))) WHEN 'large_block' THEN d * (0.5E0 + 0.5E0 * least(1.0E0, ((x2 - x1) * (y2 - y1)) / 20000.0E0)) ELSE d END"
D_CONF = """CASE field_name WHEN 'nid' THEN least(1.0E0, 1.5E0 * density) * (1.0E0 - least(abs(ar - 4.0E0) / 4.0E0, 0.3E0)) * CASE WHEN (by1 + by2) / 2.0E0 < 0.4E0 * 630 THEN 1.0E0 ELSE 0.8E0 END
  WHEN 'name' THEN least(1.0E0, 1.3E0 * density) * (1.0E0 - least(abs(ar - 3.0E0) / 3.0E0, 0.3E0)) WHEN 'dob' THEN least(1.0E0, 1.4E0 * density) * least(1.0E0, 8000.0E0 / area) WHEN 'gender' THEN least(1.0E0, 1.2E0 * density) * least(1.0E0, 5000.0E0 / area)
  WHEN 'governorate' THEN least(1.0E0, 1.3E0 * density) ELSE least(1.0E0, 1.2E0 * density) * (0.5E0 + 0.5E0 * least(1.0E0, area / 15000.0E0)) END"""
LOC = f"""WITH reg(field_name, rx1, ry1, rx2, ry2, refinement, ear) AS (VALUES {_REG}), cards AS (SELECT o_orderkey AS card_id FROM orders),
p AS (SELECT card_id, field_name, refinement, ear, CAST(trunc(rx1 * 1000) AS BIGINT) AS ix1, CAST(trunc(ry1 * 630) AS BIGINT) AS iy1, CAST(trunc(rx2 * 1000) AS BIGINT) AS ix2, CAST(trunc(ry2 * 630) AS BIGINT) AS iy2 FROM cards, reg),
st AS (SELECT *, CASE WHEN k <= 4 THEN greatest(0, ix1 - 5 * k) ELSE ix1 + 3 * (k - 4) END AS x1, CASE WHEN k <= 4 THEN greatest(0, iy1 - 5 * k) ELSE iy1 + 3 * (k - 4) END AS y1,
  CASE WHEN k <= 4 THEN least(1000, ix2 + 5 * k) ELSE ix2 - 3 * (k - 4) END AS x2, CASE WHEN k <= 4 THEN least(630, iy2 + 5 * k) ELSE iy2 - 3 * (k - 4) END AS y2 FROM p, (SELECT unnest(range(0, 8)) AS k) kk),
sd AS (SELECT *, {D_DENS('')} AS d FROM st), sc AS (SELECT *, {D_KIND} AS score FROM sd),
rk AS (SELECT *, row_number() OVER (PARTITION BY card_id, field_name ORDER BY score DESC, k) AS rn, max(CASE WHEN k = 0 THEN d END) OVER (PARTITION BY card_id, field_name) AS density FROM sc),
rf AS (SELECT card_id, field_name, ear, density, CASE WHEN score > 0 THEN x1 ELSE ix1 END AS bx1, CASE WHEN score > 0 THEN y1 ELSE iy1 END AS by1, CASE WHEN score > 0 THEN x2 ELSE ix2 END AS bx2, CASE WHEN score > 0 THEN y2 ELSE iy2 END AS by2, greatest(score, 0.0E0) AS best_score FROM rk WHERE rn = 1),
ra AS (SELECT *, (bx2 - bx1) / (by2 - by1) AS ar, CAST((bx2 - bx1) * (by2 - by1) AS DOUBLE) AS area FROM rf), cf AS (SELECT *, {D_CONF} AS conf FROM ra)
"""


def _density(box: list[Column]) -> Column:
    x1, y1, x2, y2 = box
    return ((F.col("card_id") * 7 + x1 * 3 + y1 * 11 + x2 * 5 + y2 * 13) % 97) / F.lit(97.0)


def _located(spark, d):
    cards = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("card_id"), F.lit(1000).alias("width"), F.lit(630).alias("height"))
    return localization.localize(cards, _density)


@query("w3_refine", LOC + "SELECT card_id, field_name, round(density, 6) AS density, bx1, by1, bx2, by2, round(best_score, 6) AS best_score FROM rf")
def w3_refine(spark, d):
    return _located(spark, d).select("card_id", "field_name", rnd("density").alias("density"), "bx1", "by1", "bx2", "by2", rnd("best_score").alias("best_score"))


@query("l10_confidence", LOC + "SELECT card_id, field_name, round(conf, 6) AS confidence, round(greatest(0.0E0, 1.0E0 - abs(ar - ear) / ear), 6) AS aspect_match, CASE WHEN conf >= 0.5 THEN 'localized' ELSE 'field_localization_uncertain' END AS status, CASE WHEN bx1 <= 2 OR by1 <= 2 OR bx2 >= 998 OR by2 >= 628 THEN 0.7E0 WHEN density * 255 > 240 OR density * 255 < 15 THEN 0.5E0 ELSE 0.2E0 END AS clipping FROM cf")
def l10_confidence(spark, d):
    df = _located(spark, d)
    clip = localization.clipping_score([F.col(c) for c in ("bx1", "by1", "bx2", "by2")], F.lit(1000), F.lit(630), F.col("density") * 255)
    return df.select("card_id", "field_name", rnd("loc_confidence").alias("confidence"), rnd("aspect_match").alias("aspect_match"), F.col("loc_status").alias("status"), clip.alias("clipping"))


@query("w4_alternatives", LOC + f""", sh(alt, dx, dy) AS (VALUES (0, 0, -5), (1, 0, 5), (2, -5, 0), (3, 5, 0)), al AS (SELECT card_id, field_name, alt, greatest(0, bx1 + dx) AS x1, greatest(0, by1 + dy) AS y1, least(1000, bx2 + dx) AS x2, least(630, by2 + dy) AS y2 FROM cf, sh WHERE conf < 0.6),
an AS (SELECT *, row_number() OVER (PARTITION BY card_id, field_name ORDER BY alt) AS rn FROM al WHERE x1 < x2 AND y1 < y2) SELECT card_id, field_name, rn - 1 AS alt_no, x1, y1, x2, y2, round(0.8E0 * ({D_DENS('')}), 6) AS confidence FROM an WHERE rn <= 3""")
def w4_alternatives(spark, d):
    df = localization.alternatives(_located(spark, d), _density)
    return df.select("card_id", "field_name", F.col("alt_no").cast("long").alias("alt_no"), F.col("ax1").alias("x1"), F.col("ay1").alias("y1"), F.col("ax2").alias("x2"), F.col("ay2").alias("y2"), rnd("alt_confidence").alias("confidence"))


@query("a5_card_success", LOC + ", t AS (SELECT card_id, count(*) AS n_fields, count(*) FILTER (WHERE conf >= 0.5) AS n_localized FROM cf GROUP BY card_id) SELECT card_id, n_localized, n_fields, n_localized >= 0.5 * n_fields AS success, CASE WHEN n_localized >= 0.5 * n_fields THEN 'localized' ELSE 'partial_localization' END AS status, CASE WHEN n_localized >= 0.5 * n_fields THEN 'Successfully localized ' || n_localized || '/' || n_fields || ' fields' ELSE 'Only ' || n_localized || '/' || n_fields || ' fields localized with confidence' END AS message, CAST(CASE WHEN n_localized >= 0.5 * n_fields THEN 200 ELSE 206 END AS BIGINT) AS http_status FROM t")
def a5_card_success(spark, d):
    from .sources.sinks import http_status

    return localization.card_success(_located(spark, d)).withColumn("http_status", http_status(F.col("success")))


# -- pixels -----------------------------------------------------------------------------------------------------------


# Variances over 64 pixels often end in a five at the last digit kept; the small addend makes both engines round alike.
@query("i1_i5_tile_quality", f"""WITH t AS ({fixtures.ORACLE_TILES}), g AS (SELECT vec_id, px // 8 AS r, px % 8 AS c, gray FROM t),
l AS (SELECT a.vec_id, a.gray, n.gray + s.gray + w.gray + e.gray - 4 * a.gray AS lap FROM g a
  JOIN g n ON n.vec_id = a.vec_id AND n.c = a.c AND n.r = CASE WHEN a.r = 0 THEN 1 ELSE a.r - 1 END JOIN g s ON s.vec_id = a.vec_id AND s.c = a.c AND s.r = CASE WHEN a.r = 7 THEN 6 ELSE a.r + 1 END
  JOIN g w ON w.vec_id = a.vec_id AND w.r = a.r AND w.c = CASE WHEN a.c = 0 THEN 1 ELSE a.c - 1 END JOIN g e ON e.vec_id = a.vec_id AND e.r = a.r AND e.c = CASE WHEN a.c = 7 THEN 6 ELSE a.c + 1 END),
m AS (SELECT vec_id, var_pop(lap) AS sh, avg(gray) AS br, stddev_pop(gray) AS co FROM l GROUP BY vec_id)
SELECT vec_id, round(sh + 1E-7, 4) AS sharpness, round(br + 1E-7, 4) AS brightness, round(co + 1E-7, 4) AS contrast, sh >= 25 AND br >= 24 AND br <= 264 AND co >= 14 AS is_acceptable FROM m""")
def i1_i5_tile_quality(spark, d):
    return pixels.image_quality(_tile_images(spark, d)).select("vec_id", *[rnd(F.col(c) + 1e-7, 4).alias(c) for c in ("sharpness", "brightness", "contrast")], "is_acceptable")


def _tile_images(spark, d) -> DataFrame:
    """Embeddings as grey images of 8 x 8."""
    hexes = F.transform("embedding", lambda v: F.lpad(F.hex(F.floor(F.least(F.greatest((v.cast("double") + 0.5) * 255, F.lit(0.0)), F.lit(255.0))).cast("long")), 2, "0"))
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    return df.select("vec_id", F.unhex(F.array_join(hexes, "")).alias("data"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"))


@query("l5_tile_density", f"""WITH t AS ({fixtures.ORACLE_TILES}), h AS (SELECT vec_id, gray, count(*) AS n FROM t GROUP BY vec_id, gray), c AS (SELECT vec_id, gray, CAST(sum(n) OVER w AS DOUBLE) AS below, CAST(sum(n * gray) OVER w AS DOUBLE) AS mass FROM h WINDOW w AS (PARTITION BY vec_id ORDER BY gray)),
k AS (SELECT c.*, max(mass) OVER (PARTITION BY vec_id) AS total FROM c), o AS (SELECT vec_id, gray AS thr, CASE WHEN below < 64 THEN (total * below - mass * 64) * (total * below - mass * 64) / (below * (64 - below)) ELSE -1 END AS v FROM k),
b AS (SELECT vec_id, thr, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, thr) AS rn FROM o) SELECT t.vec_id, round(avg(CASE WHEN t.gray > b.thr THEN 1.0E0 ELSE 0.0E0 END), 6) AS density FROM t JOIN b ON b.vec_id = t.vec_id AND b.rn = 1 GROUP BY t.vec_id""")
def l5_tile_density(spark, d):
    box = [F.lit(0), F.lit(0), F.lit(8), F.lit(8)]
    return _tile_images(spark, d).select("vec_id", rnd(pixels.density(F.col("data"), F.col("height"), F.col("width"), F.col("channels"), box)).alias("density"))


# -- recognised texts and cards ---------------------------------------------------------------------------------------

OCR = f"WITH o AS ({fixtures.ORACLE_OCR}), best AS (SELECT card_id, field_name, text AS raw, ocr_confidence FROM (SELECT *, row_number() OVER (PARTITION BY card_id, field_name ORDER BY ocr_confidence DESC, idx) AS rn FROM o) z WHERE rn = 1)"


@query("w2_best_text", OCR + f" SELECT card_id, field_name, raw AS raw_value, ocr_confidence, {FIELD} AS value, CASE WHEN coalesce({FIELD}, '') <> '' THEN 'extracted' ELSE 'ocr_failed' END AS status, CASE WHEN ocr_confidence >= 0.8 THEN 'High' WHEN ocr_confidence >= 0.5 THEN 'Medium' ELSE 'Low' END AS tier FROM best")
def w2_best_text(spark, d):
    df = ocr.extract(fixtures.ocr_candidates(spark, d), compose=False)
    return df.select("card_id", "field_name", "raw_value", "ocr_confidence", "value", F.col("validation_status").alias("status"), ocr.tier(F.col("ocr_confidence")).alias("tier"))


@query("a9_full_text", OCR + f" SELECT card_id, field_name, coalesce(string_agg(text, chr(10) ORDER BY idx) FILTER (WHERE {d_strip('text')} <> ''), '') AS full_text FROM o GROUP BY card_id, field_name")
def a9_full_text(spark, d):
    return ocr.full_text(fixtures.ocr_candidates(spark, d))


WIDE = fixtures.ORACLE_OCR
F3 = nid_sql(source=f"SELECT card_id, {', '.join(f'max(CASE WHEN field_name = {chr(39)}{n}{chr(39)} THEN value END) AS {n}' for n in ('nid', 'dob', 'gender', 'governorate'))} FROM (SELECT card_id, field_name, {FIELD} AS value FROM (SELECT card_id, field_name, text AS raw, row_number() OVER (PARTITION BY card_id, field_name ORDER BY ocr_confidence DESC, idx) AS rn FROM ({WIDE}) o) z WHERE rn = 1) y GROUP BY card_id", nid="nid", dob="dob", gender="gender", governorate="governorate")


@query("f3_cards", F3 + "SELECT card_id, n AS nid, status AS nid_status, s_dob AS dob_status, s_gender AS gender_status, s_gov AS governorate_status, overall AS overall_status, round(CAST(ws AS DOUBLE) / CAST(w AS DOUBLE), 6) AS confidence FROM summed")
def f3_cards(spark, d):
    df = plans.cards_from_texts(fixtures.ocr_candidates(spark, d), AS_OF, compose=False)
    return df.select("card_id", F.col("nid_normalized").alias("nid"), "nid_status", "dob_status", "gender_status", "governorate_status", "overall_status", rnd("confidence").alias("confidence"))


@query("s5_export")
def s5_export(spark, d):
    from .sources import sinks

    df = sinks.export_fields(ocr.extract(fixtures.ocr_candidates(spark, d), compose=False))
    return sinks.to_document(df, {"normalized_fields": "map", "raw_fields": "map", "fields": "map"}).select("card_id", "json")


# the document, read back from its text
@query("s5_document", F3 + f"""SELECT s.card_id, status, nullif(nid, '') AS nid, nullif(raw_gender, '') AS raw_gender, status = 'valid' AS is_valid, nullif({ERRORS}, '') AS errors, overall AS overall_status, CAST(k_no AS BIGINT) AS conflict_count, round(CAST(ws AS DOUBLE) / CAST(w AS DOUBLE), 6) AS confidence, s_dob AS dob_check, nullif(t_gov, '') AS governorate_details, dob_status, CAST(NULL AS VARCHAR) AS total_time_ms
FROM summed s JOIN (SELECT card_id, max(CASE WHEN field_name = 'gender' THEN raw END) AS raw_gender, max(CASE WHEN field_name = 'dob' THEN CASE WHEN coalesce({FIELD}, '') <> '' THEN 'extracted' ELSE 'ocr_failed' END END) AS dob_status
  FROM (SELECT card_id, field_name, text AS raw, row_number() OVER (PARTITION BY card_id, field_name ORDER BY ocr_confidence DESC, idx) AS rn FROM ({WIDE}) o) z WHERE rn = 1 GROUP BY card_id) r ON r.card_id = s.card_id""")
def s5_document(spark, d):
    df = plans.documents_from_texts(fixtures.ocr_candidates(spark, d), AS_OF, compose=False)
    parts = (
        "status string, normalized_fields struct<nid: string>, raw_fields struct<gender: string>, validation_results struct<nid: struct<is_valid: boolean, errors: array<string>>>, "
        "consistency_result struct<overall_status: string, conflict_count: bigint, confidence: double, checks: struct<dob: struct<status: string>, governorate: struct<details: string>>>, "
        "fields struct<dob: struct<status: string>>, metrics struct<total_time_ms: string>"
    )
    df = df.select("card_id", F.from_json("json", parts).alias("x"))  # the text is parsed once for all that is read
    at = lambda path: F.col(f"x.{path}")
    return df.select(
        "card_id", at("status").alias("status"), at("normalized_fields.nid").alias("nid"), at("raw_fields.gender").alias("raw_gender"), at("validation_results.nid.is_valid").alias("is_valid"), F.array_join(at("validation_results.nid.errors"), " | ").alias("errors"),
        at("consistency_result.overall_status").alias("overall_status"), at("consistency_result.conflict_count").alias("conflict_count"), rnd(at("consistency_result.confidence")).alias("confidence"),
        at("consistency_result.checks.dob.status").alias("dob_check"), at("consistency_result.checks.governorate.details").alias("governorate_details"), at("fields.dob.status").alias("dob_status"), at("metrics.total_time_ms").alias("total_time_ms"),
    )


from . import registry_rasters  # noqa: E402, F401  its queries join the ones above

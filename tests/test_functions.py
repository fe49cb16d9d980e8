"""Golden values of the card functions, odd behaviour included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kartwerk.functions import geometry as G
from kartwerk.functions import nid as N
from kartwerk.functions import sql
from kartwerk.functions import text as T
from kartwerk.operators import consistency, pixels


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_dates(spark):
    given = ["15/01/95", "1995-13-45", "15.01.1995", "5/1/95", "1995-01-155", "15/01/19955", "١٩٩٥-٠١-١٥", None, ""]
    want = ["2015-01-95", "1995-13-45", None, None, "1995-01-15", "1995-01-15", "1995-01-15", None, None]
    assert column(spark, N.normalize_date, given) == want


def test_genders(spark):
    assert column(spark, N.normalize_gender, ["female", "امرأة", "أنثى", " M ", "f", "ذكر", "x"]) == ["male", "male", "female", "male", "female", "male", None]
    assert column(spark, T.gender_text, ["female", "أنثى", "ذكر", "?"]) == ["male", "female", "male", None]


def test_whitespace_and_forms(spark):
    assert column(spark, T.normalize_whitespace, [" a​ \u001cb\t", "", None]) == ["a b", "", None]
    assert column(spark, T.nfkc, ["ﻻ", "abc", None]) == ["لا", "abc", None]
    assert column(spark, T.numeric_candidate, ["٢-۹ x3", None]) == ["293", ""]


def test_governorate_lookups(spark):
    assert column(spark, N.code_by_english_name, ["Cairo", "Sharqia", " GIZA "]) == ["01", None, "14"]
    assert column(spark, N.code_by_arabic_name, ["القاهرة", "أسيوط", "أسوان"]) == ["01", None, "22"]


@pytest.mark.parametrize(
    "number, status, errors",
    [
        ("29501010012345", "valid", 0),
        ("", "malformed", 1),
        ("123", "malformed", 1),
        ("41001010012345", "valid", 2),  # an unknown century alone doesn't make a number invalid
        ("29513010012345", "invalid_date", 1),
        ("29502300012345", "invalid_date", 1),
        ("29501010992345", "invalid_governorate", 1),
        ("29513010992345", "invalid", 2),
    ],
)
def test_numbers(spark, number, status, errors):
    r = N.validate(spark.createDataFrame([(number,)], "n string"), "n", "2026-01-01").first()
    assert (r.nid_status, len(r.nid_errors)) == (status, errors)


def test_future_birth(spark):
    r = N.validate(spark.createDataFrame([("39501010012345",)], "n string"), "n", "2026-01-01").first()
    assert r.nid_date_of_birth == "2095-01-01" and not r.nid_date_valid


TRUTH = {"CCC": 1.0, "CCU": 0.9, "CCM": 0.833333, "CCX": 0.8, "CUU": 0.75, "CUM": 0.7, "CMM": 0.666667, "CUX": 0.625, "CMX": 0.6, "CXX": 0.5, "UUU": 0.5, "MMX": 0.4, "UMX": 0.375, "UUX": 0.333333, "MXX": 0.25, "UXX": 0.166667, "XXX": 0.0}


def test_confidence_table(spark):
    full = {"C": "consistent", "U": "unknown", "M": "missing", "X": "conflict"}
    df = spark.createDataFrame([(k, *[full[x] for x in k]) for k in TRUTH], "k string, dob_status string, gender_status string, governorate_status string")
    assert {r.k: round(r.confidence, 6) for r in consistency.summarize(df).collect()} == TRUTH


def test_boxes_and_quads(spark):
    box = [F.lit(v) for v in (10, 10, 100, 100)]
    p = one(spark, **G.bbox_properties(*box))
    assert (p.width, p.height, p.area, p.aspect) == (90, 90, 8100, 1.0)
    assert one(spark, a=G.bbox_valid(*box, F.lit(200), F.lit(200)), b=G.bbox_valid(*[F.lit(v) for v in (100, 100, 10, 10)], F.lit(200), F.lit(200)))[:] == (True, False)
    quad = lambda *v: [(F.lit(float(x)), F.lit(float(y))) for x, y in v]
    rect, tie = quad((0, 0), (100, 0), (100, 50), (0, 50)), quad((0, 0), (100, 50), (0, 50), (100, 0))
    r = one(spark, area=G.area(rect), rect=G.rectangularity(rect), convex=G.is_convex(rect), crossed=G.is_convex(tie))
    assert (r.area, r.rect, r.convex, r.crossed) == (5000.0, 1.0, True, False)


def test_homography_round_trip(spark):
    q = [(F.lit(50.0), F.lit(50.0)), (F.lit(750.0), F.lit(30.0)), (F.lit(780.0), F.lit(480.0)), (F.lit(20.0), F.lit(500.0))]
    df = spark.range(1).select(G.homography(q).alias("m"))
    m = [F.get("m", i) for i in range(9)]
    x, y = G.transform_point(m, F.lit(780.0), F.lit(480.0))
    bx, by = G.transform_point(G.inverse(m), x, y)
    r = df.select(x.alias("x"), y.alias("y"), bx.alias("bx"), by.alias("by")).first()
    assert np.allclose(r, (999, 629, 780, 480), atol=1e-6)


def test_pixels():
    flat = np.full((20, 20), 200, np.uint8)
    assert pixels.laplacian_variance(flat) == 0 and pixels.noise(flat) == 0 and pixels.content_density(flat) in (0.0, 1.0)
    half = np.concatenate([np.zeros((10, 20), np.uint8), np.full((10, 20), 255, np.uint8)])
    assert pixels.otsu(half) == 0 and pixels.content_density(half) == 0.5
    assert pixels.border_quality(np.zeros((20, 20, 3), np.uint8)) == 0
    assert (pixels.warp(half, np.eye(3).ravel(), 20, 20) == half).all()
    for f in ("nid", "dob", "gender", "name", "other"):
        assert pixels.preprocess(half, f).shape == half.shape


def test_sql_functions(spark):
    assert "nid_digits" in sql.register(spark)
    assert spark.sql("SELECT nid_gender(nid_digits('٢٩٥-0101 0 01 2 345')), arabic_digits('۱٢3')").first()[:] == ("female", "123")

"""Physical plans: what must not shuffle doesn't, what must shuffles once, and scans read only what they need."""

import contextlib
import io

from kartwerk import registry
from kartwerk.config import Config
from kartwerk.operators import consistency, detection, localization, ocr

CARDS = "card_id long, nid_raw string, dob_raw string, gender_raw string, governorate_raw string"
QUADS = "image_id long, cand_id long, image_w long, image_h long, " + ", ".join(f"{c}{i} double" for i in range(1, 5) for c in "xy") + ", convexity double, edge_strength double"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue().split("== Physical Plan ==")[-1].split("\n\n")[0]


def parquet(spark, tmp_path, schema, name):
    path = str(tmp_path / name)
    spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.parquet(path)


def test_checks_are_one_projection(spark, tmp_path):
    p = plan(consistency.check_all(parquet(spark, tmp_path, CARDS, "cards"), "2026-01-01"))
    assert "Exchange" not in p and "Join" not in p and "Python" not in p


def test_detection_shuffles_once(spark, tmp_path):
    p = plan(detection.detect(parquet(spark, tmp_path, QUADS, "quads")))
    assert p.count("Exchange") == 1 and "Window" not in p


def test_localization_is_narrow(spark, tmp_path):
    cards = parquet(spark, tmp_path, "card_id long, width int, height int", "canon")
    p = plan(localization.localize(cards, lambda box: (box[0] + box[3]) / 5000.0, Config()))
    assert "Exchange" not in p and "Join" not in p


def test_best_text_shuffles_once(spark, tmp_path):
    p = plan(ocr.extract(parquet(spark, tmp_path, "card_id long, field_name string, idx long, text string, ocr_confidence double", "ocr"), compose=False))
    assert p.count("Exchange") == 1 and "Window" not in p and "Python" not in p


def test_scans_are_pruned(spark):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        registry.queries()["w3_refine"](spark, "/root/testdata/sf0.001").explain("formatted")
    assert "ReadSchema: struct<o_orderkey:bigint>" in out.getvalue()


def test_pixels_are_not_shuffled(spark):
    """Between an image's row and its fields there is no exchange at all."""
    from kartwerk.plans import cards

    corners = ", ".join(f"{c}{i}: double" for i in range(1, 5) for c in "xy")
    images = spark.createDataFrame([], f"image_id long, height int, width int, channels int, data binary, candidates array<struct<cand_id: long, {corners}, convexity: double, edge_strength: double>>")
    plan = cards.process_rows(images)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan

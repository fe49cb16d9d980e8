"""Flows end to end: images, streams, documents."""

import json

import numpy as np

from kartwerk import fixtures
from kartwerk.config import Config, get_config, reset_config
from kartwerk.operators import ocr
from kartwerk.plans import cards
from kartwerk.sources import images, sinks
from kartwerk.streaming.cards import check_stream


def test_images_to_fields(spark):
    rng = np.random.default_rng(1)
    a = np.full((500, 800, 3), 240, np.uint8)
    a[60:440, 100:700] = rng.integers(0, 255, (380, 600, 3))
    rows = [(1, 500, 800, 3, a.tobytes()), (2, 500, 800, 3, a.tobytes()), (3, 900, 300, 3, np.zeros((900, 300, 3), np.uint8).tobytes())]
    im = spark.createDataFrame([(i, h, w, c, bytearray(d)) for i, h, w, c, d in rows], "image_id long, height int, width int, channels int, data binary")
    cand = spark.createDataFrame([(1, 1, 800, 500, 100.0, 60.0, 700.0, 60.0, 700.0, 440.0, 100.0, 440.0, 1.0, 0.5)], "image_id long, cand_id long, image_w long, image_h long, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double, x4 double, y4 double, convexity double, edge_strength double")
    out = cards.process_images(im, cand).collect()
    assert sorted(r.field_name for r in out if r.card_id == 1) == ["address", "dob", "gender", "governorate", "name", "nid"]
    assert [r.rect_status for r in out if r.card_id == 3] == ["rectification_failed"]


def test_rows_equal_joined_images(spark):
    """Images that carry their outlines give the same fields as a table of outlines beside them."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    rows = []
    for i in range(6):
        a = np.full((500, 800), 240, np.uint8)
        a[60:440, 100:700] = rng.integers(0, 255, (380, 600))
        rows.append((i, 500, 800, 1, bytearray(a.tobytes())))
    rows += [(6, 1200, 2000, 1, bytearray(np.full((1200, 2000), 90, np.uint8).tobytes())), (7, None, None, None, None)]
    im = spark.createDataFrame(rows, "image_id long, height int, width int, channels int, data binary")
    good, small, bent = [100.0, 60.0, 700.0, 60.0, 700.0, 440.0, 100.0, 440.0], [10.0, 10.0, 90.0, 10.0, 90.0, 60.0, 10.0, 60.0], [100.0, 60.0, 700.0, 60.0, 300.0, 100.0, 100.0, 440.0]
    made = {0: [good], 1: [small, good], 2: [small], 3: [bent], 4: [good, good], 6: [[200.0, 100.0, 1100.0, 100.0, 1100.0, 660.0, 200.0, 660.0]]}
    names = [f"{c}{i}" for i in range(1, 5) for c in "xy"]
    cand = spark.createDataFrame([(i, k + 1, 1280 if i == 6 else 800, 768 if i == 6 else 500, *q, 0.9, 0.4) for i, qs in made.items() for k, q in enumerate(qs)], "image_id long, cand_id long, image_w long, image_h long, " + ", ".join(f"{n} double" for n in names) + ", convexity double, edge_strength double")
    nested = cand.groupBy("image_id").agg(F.collect_list(F.struct("cand_id", *names, "convexity", "edge_strength")).alias("candidates"))
    cols = ["card_id", "field_name", "rect_status", "rect_failure", "rect_confidence", "density", "bx1", "by1", "bx2", "by2", "loc_confidence"]
    one = sorted(map(str, cards.process_rows(im.join(nested, "image_id", "left")).select(*cols).collect()))
    assert one == sorted(map(str, cards.process_images(im, cand).select(*cols).collect()))
    assert len(one) == 6 * 4 + 4


def test_sources(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(b"no image")
    r = images.read_images(spark, str(tmp_path)).first()
    assert r.failure == "Failed to decode image" and r.height is None
    df = spark.createDataFrame([(None, None), (bytearray(b"x"), 1)], "data binary, height int")
    assert [r.failure for r in images.from_rows(df).collect()] == ["Empty or invalid image provided", None]


def test_engines(spark):
    crops = spark.createDataFrame([(1, "nid", bytearray(b"12"))], "card_id long, field_name string, image binary")

    class Reader(ocr.FallbackEngine):
        def recognize(self, image):
            return [(image.decode(), 0.9, [0, 0, 1, 1])]

    assert ocr.recognize(crops).count() == 0
    assert ocr.recognize(crops, "reader", Reader).first().text == "12"


def test_reader_beside_its_crops(spark):
    """A lateral join keeps the crops' columns; failures and null images give no rows."""

    class Words(ocr.FallbackEngine):
        made = 0

        def initialize(self):
            Words.made += 1
            return True

        def recognize(self, image):
            text = image.decode()
            if text == "bad":
                raise ValueError(text)
            return [(w, 1 / (i + 1 + Words.made), [i, 0, i + 1, 1]) for i, w in enumerate(text.split())]

    rows = [(1, "nid", "x", bytearray(b"12 34")), (2, "dob", "y", bytearray(b"bad")), (3, "dob", "z", None), (4, "name", None, bytearray(b"")), (5, "name", "v", bytearray(b"ab"))]
    crops = spark.createDataFrame(rows, "card_id long, field_name string, note string, image binary").repartition(1)
    out = sorted((r.card_id, r.note, r.idx, r.text, r.ocr_confidence, r.bbox) for r in ocr.read(crops, "words", Words).collect())
    assert out == [(1, "x", 1, "12", 0.5, [0, 0, 1, 1]), (1, "x", 2, "34", 1 / 3, [1, 0, 2, 1]), (5, "v", 1, "ab", 0.5, [0, 0, 1, 1])]
    assert ocr.read(crops).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    fixtures.card_reads(spark, d).limit(50).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    q = check_stream(spark, str(tmp_path / "in"), batch.schema, "2026-01-01").writeStream.format("memory").queryName("cards").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("cards").count() == 50


def test_documents(spark):
    df = spark.createDataFrame([("", [], "a")], "a string, b array<string>, c string")
    assert json.loads(sinks.to_document(df, {"a": "string", "b": "array", "c": "string"}).first().json) == {"c": "a"}
    assert sinks.health(spark).first().status == "healthy" and sinks.system_status(spark).first().canonical_size == "1000x630"


def test_card_documents(spark):
    """The whole document of a card: nested parts, metrics where there are any, and nothing empty."""
    from pyspark.sql import functions as F

    texts = [(1, "nid", 1, "29001010112345", 0.9), (1, "gender", 1, "", 0.4), (1, "dob", 1, "1990-01-01", 0.8), (2, "name", 1, " ", 0.2)]
    c = spark.createDataFrame(texts, "card_id long, field_name string, idx long, text string, ocr_confidence double")
    made = cards.cards_from_texts(c, "2026-01-01", compose=False).withColumn("total_time_ms", F.lit(12.5))
    docs = {r.card_id: json.loads(r.json) for r in sinks.card_documents(ocr.extract(c, compose=False), made).collect()}
    one, two = docs[1], docs[2]
    assert one["status"] == "valid" and one["normalized_fields"] == {"nid": "29001010112345", "dob": "1990-01-01"}
    assert one["validation_results"]["nid"]["is_valid"] is True and "errors" not in one["validation_results"]["nid"]
    assert one["consistency_result"]["checks"]["dob"] == {"status": "consistent", "details": "Dates match"}
    assert one["metrics"] == {"total_time_ms": 12.5}
    assert one["fields"]["gender"]["status"] == "ocr_failed" and one["raw_fields"] == {"nid": "29001010112345", "dob": "1990-01-01"}
    assert "normalized_fields" not in two and set(two["fields"]) == {"name"}


def test_config(monkeypatch):
    monkeypatch.setenv("KARTWERK_DEBUG", "yes")
    reset_config()
    assert get_config().debug and get_config() is get_config()
    reset_config()
    assert (Config().width, Config().height) == (1000, 630)

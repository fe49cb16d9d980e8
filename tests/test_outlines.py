"""Outlines from synthetic cards, through to localized fields."""

import numpy as np

from pyspark.sql import functions as F

from kartwerk.operators import detection, localization, outlines, pixels
from kartwerk.plans import cards


def card(h=500, w=800, x=100, y=60, cw=600, ch=378):
    a = np.full((h, w, 3), 240, np.uint8)
    a[y : y + ch, x : x + cw] = 50
    a[y + 3 : y + ch - 3, x + 3 : x + cw - 3] = 255
    for i in range(6):
        a[y + 40 + i * 50 : y + 60 + i * 50, x + 40 : x + cw - 40] = 200
    return a


def test_labels():
    m = np.array([[1, 0, 1, 1], [1, 1, 1, 0], [0, 0, 0, 0], [0, 1, 0, 1], [1, 0, 0, 1]], bool)
    assert outlines.label(m)[1] == 3 and outlines.label(m, diagonal=False)[1] == 4


def test_shapes():
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10], [5, 5]])
    h = outlines.hull(square)
    assert len(h) == 4 and outlines.polygon_area(h) == 100
    assert abs(outlines.polygon_area(outlines.smallest_rectangle(np.array([[0, 5], [5, 0], [10, 5], [5, 10]], float))) - 50) < 1e-9
    assert outlines.shrink(np.zeros((200, 400), np.uint8), 100)[0].shape == (50, 100)


def test_card_is_found(spark):
    images = spark.createDataFrame([(1, 500, 800, 3, bytearray(card().tobytes())), (2, 300, 300, 3, bytearray(np.full((300, 300, 3), 9, np.uint8).tobytes())), (3, None, None, None, None)], "image_id long, height int, width int, channels int, data binary")
    found = outlines.outlines(images)
    r = detection.detect(found).collect()
    assert [x.image_id for x in r] == [1] and r[0].status == "detected"
    assert max(abs(a - b) for a, b in zip((r[0].bx1, r[0].by1, r[0].bx2, r[0].by2), (100, 60, 700, 438))) <= 6
    fields = cards.process_images(images.where("image_id = 1"), found).collect()
    assert len({f.field_name for f in fields}) == 6


def test_shrunk_image(spark):
    """Corners of an image of over 1280 px are multiplied by the scale (as defined), sizes are those of the original."""
    a = card(1250, 2000, 250, 150, 1500, 945)
    images = spark.createDataFrame([(1, 1250, 2000, 3, bytearray(a.tobytes()))], "image_id long, height int, width int, channels int, data binary")
    found = outlines.outlines(images).cache()
    assert found.first().image_w == 1280
    sized = images.selectExpr("image_id", "cast(width as long) image_w", "cast(height as long) image_h")
    r = detection.detect(found, sized=sized).first()
    assert (r.status, r.image_w, r.image_h) == ("detected", 2000, 1250)
    assert max(abs(p - q * 0.64 * 0.64) for p, q in zip((r.bx1, r.by1, r.bx2, r.by2), (250, 150, 1750, 1095))) <= 6
    fields = cards.process_images(images, found).collect()
    assert len({f.field_name for f in fields}) == 6 and all(0 <= f.density <= 1 for f in fields)


def test_shares_of_boxes(spark):
    """All boxes of an image at once, empty ones too, equal box by box; every box that is tried has its share."""
    a = np.random.default_rng(3).integers(0, 255, (40, 60), np.uint8)
    boxes = [[0, 0, 60, 40], [5, 5, 20, 9], [7, 7, 7, 9]]
    df = spark.createDataFrame([(bytearray(a.tobytes()), 40, 60, 1, boxes), (None, None, None, None, boxes)], "data binary, h int, w int, c int, boxes array<array<long>>")
    got = [r[0] for r in df.select(pixels.densities(*[df[c] for c in ("data", "h", "w", "c", "boxes")])).collect()]
    assert got == [[pixels.content_density(a[y1:y2, x1:x2]) for x1, y1, x2, y2 in boxes], None]
    one = spark.createDataFrame([(1, 1000, 630)], "card_id long, width int, height int")
    known = {tuple(b) for b in one.select(localization.all_steps(one["width"], one["height"])).first()[0]}
    tried = localization.proposals(one).select(F.explode(localization.steps([F.col(c) for c in localization.BOX], F.col("width"), F.col("height"))).alias("s")).collect()
    assert known == {tuple(r.s[c] for c in localization.BOX) for r in tried}

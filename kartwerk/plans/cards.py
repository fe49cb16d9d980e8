"""Whole flows over cards: from recognised texts to checked cards, and from images to localized fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import geometry as G
from ..operators import consistency, detection, localization, ocr, pixels, rectification
from ..sources import sinks


def cards_from_texts(candidates: DataFrame, as_of: str, compose: bool = True) -> DataFrame:
    """One row a card with its normalised fields, the number's verdict and all consistency checks.

    candidates: card_id, field_name, idx, text, ocr_confidence. One shuffle chooses texts, the second gathers the at most
    six fields of a card; the checks are a projection.
    """
    return _checked(ocr.extract(candidates, compose), as_of)


def documents_from_texts(candidates: DataFrame, as_of: str, compose: bool = True) -> DataFrame:
    """card_id and json, the card's whole result document, from recognised texts. Texts are chosen once, and one shuffle
    gathers both the values to check and the maps of the document."""
    return sinks.documents(_checked(ocr.extract(candidates, compose), as_of, sinks.fields_map().alias("fields")).withColumns(sinks.value_maps()))


def _checked(fields: DataFrame, as_of: str, *more: Column) -> DataFrame:
    """One row a card with its values, further aggregates of its fields, the number's verdict and all checks."""
    names = ("nid", "name", "dob", "gender", "governorate", "address")
    per = fields.groupBy("card_id").agg(*[F.max(F.when(F.col("field_name") == n, F.col("value"))).alias(n) for n in names], *[F.max(F.when(F.col("field_name") == n, F.col("ocr_confidence"))).alias(f"{n}_confidence") for n in names], *more)
    return consistency.check_all(per, as_of, nid="nid", dob="dob", gender="gender", governorate="governorate")


def process_images(images: DataFrame, candidates: DataFrame, config: Config = Config()) -> DataFrame:
    """Localized fields of cards in images: quality, detection, rectification and localization.

    images: image_id, height, width, channels, data; candidates: outlines with their figures (see detection). Outlines
    come from any generator; images without one fall back on the whole frame. Returns a row for each field of a
    rectified card, and one row with a null field_name for each image that got no further.
    """
    sized = images.select("image_id", F.col("width").cast("long").alias("image_w"), F.col("height").cast("long").alias("image_h"))
    found = detection.detect(candidates, config, sized)
    whole = detection.full_frame(sized, candidates, config).join(sized, "image_id")
    frame = whole.select("image_id", "status", "confidence", "image_w", "image_h", *[F.when(F.col("status") == "full_frame_card_fallback", v).cast("double").alias(n) for n, v in zip(detection.CORNERS, [F.lit(0), F.lit(0), F.col("image_w"), F.lit(0), F.col("image_w"), F.col("image_h"), F.lit(0), F.col("image_h")])])
    cards = found.select("image_id", "status", "confidence", "image_w", "image_h", *detection.CORNERS).unionByName(frame)
    return _fields(cards.join(images.select("image_id", "height", "width", "channels", "data"), "image_id"), config)


def process_rows(images: DataFrame, config: Config = Config()) -> DataFrame:
    """process_images() for images that carry their outlines: image_id, height, width, channels, data and candidates, an
    array of structs of cand_id, corners (in the shrunk image), convexity and edge_strength, null or empty for none.

    Every step is a projection of the image's row, so pixels are never shuffled; only figures leave it."""
    w, h = F.col("width").cast("long"), F.col("height").cast("long")
    shrunk = G.detection_scale(w, h, config.detection_max_dim)
    # Generators keep the planner from copying what they make into every later filter and column.
    df = images.withColumn("found", F.explode(F.array(detection.choose_in_row(F.col("candidates"), shrunk["scaled_w"], shrunk["scaled_h"], config))))
    none = F.col("found").isNull()
    near = F.abs(F.when(h > 0, w / h).otherwise(0.0) - config.aspect) <= 2 * config.aspect_tolerance
    frame = dict(zip(detection.CORNERS, [F.lit(0), F.lit(0), w, F.lit(0), w, h, F.lit(0), h]))
    corners = {c: F.when(none, F.when(near, frame[c]).cast("double")).otherwise(F.col(f"found.{c}") * shrunk["scale"]) for c in detection.CORNERS}
    df = df.select(
        "image_id", "height", "width", "channels", "data", w.alias("image_w"), h.alias("image_h"), F.when(none, F.when(near, "full_frame_card_fallback").otherwise("card_not_detected")).otherwise(F.col("found.status")).alias("status"),
        F.when(none, F.when(near, 0.3).otherwise(0.0)).otherwise(F.col("found.best_candidate_score")).alias("best_candidate_score"), F.col("found.score").alias("score"), F.col("found.rectangularity").alias("rectangularity"), *[v.alias(k) for k, v in corners.items()],
    )
    pixels_of = ["image_id", "height", "width", "channels", "data"]
    figures = ["status", "confidence", "image_w", "image_h", *detection.CORNERS]
    done = detection.finish(df.select(*pixels_of, F.explode(F.array(F.struct(*[c for c in df.columns if c not in pixels_of]))).alias("f")).select(*pixels_of, "f.*"), config)
    return _fields(done.select(*pixels_of, F.explode(F.array(F.struct(*figures))).alias("f")).select(*pixels_of, "f.*"), config)


def _fields(cards: DataFrame, config: Config) -> DataFrame:
    """Rectification and localization of cards with pixels, status, confidence and corners; narrow."""
    cards = cards.withColumn("matrix", F.when(F.col("x1").isNotNull(), G.homography(G.corners(), config.width, config.height)))
    cards = cards.withColumn("warp", pixels.warped(F.col("data"), F.col("height"), F.col("width"), F.col("channels"), F.col("matrix"), config.width, config.height))
    cards = rectification.rectify(cards.withColumn("border_quality", F.coalesce("warp.border_quality", F.lit(0.0))), config)
    good = cards.where("rect_status <> 'rectification_failed' and warp is not null")
    canon = good.select(F.col("image_id").alias("card_id"), F.lit(config.width).alias("width"), F.lit(config.height).alias("height"), F.col("channels"), F.col("warp.data").alias("data"), "rect_status", "rect_confidence")
    # A card's pixels are read once for all boxes that may be tried; what follows is a projection without pixels.
    boxes = localization.all_steps(F.col("width"), F.col("height"), config)
    name = lambda box: F.concat_ws(",", *[c.cast("string") for c in box])
    canon = canon.withColumn("boxes", boxes).withColumn("shares", pixels.densities(F.col("data"), F.col("height"), F.col("width"), F.col("channels"), F.col("boxes")))
    named = F.map_from_arrays(F.transform("boxes", lambda b: name([b[i] for i in range(4)])), F.col("shares"))
    bare = canon.select("card_id", "width", "height", "rect_status", "rect_confidence", named.alias("shares"))
    fields = localization.localize(bare, lambda box: F.element_at("shares", name(box)), config).drop("shares")
    lost = cards.where("rect_status = 'rectification_failed' or warp is null").select(F.col("image_id").alias("card_id"), F.lit(None).cast("string").alias("field_name"), "rect_status", "rect_failure")
    return fields.unionByName(lost, allowMissingColumns=True)

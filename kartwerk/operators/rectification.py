"""Quality of a perspective correction, and its status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import geometry as G

Point = G.Point


def _sum(items: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, items)


def corner_quality(q: list[Point]) -> Column:
    """1, less 0.1 for each angle over 30 degrees off square, 0.15 more over 45, 0.2 for each pair under 50 px."""
    off = [F.abs(a - 90.0) for a in G.angles(q)]
    near = [F.when(G.distance(q[i], q[j]) < 50.0, 0.2).otherwise(0.0) for i in range(4) for j in range(i + 1, 4)]
    cost = _sum([F.when(o > 30.0, 0.1).otherwise(0.0) + F.when(o > 45.0, 0.15).otherwise(0.0) for o in off] + near)
    return F.greatest(F.lit(0.0), 1.0 - cost)


def geometry_validity(q: list[Point]) -> Column:
    """1, less 0.5 each for not convex and for crossing sides (one test), 0.2 for rectangularity under 0.7."""
    return F.greatest(F.lit(0.0), 1.0 - F.when(G.is_convex(q), 0.0).otherwise(1.0) - F.when(G.rectangularity(q) < 0.7, 0.2).otherwise(0.0))


def area_coverage(q: list[Point], w: Column, h: Column) -> Column:
    return F.when(w * h > 0, F.least(G.area(q) / (w * h), F.lit(1.0))).otherwise(0.0)


def confidence(detection: Column, corner: Column, validity: Column, coverage: Column, border: Column, config: Config = Config()) -> Column:
    c = detection * (0.7 + 0.3 * corner) * (0.7 + 0.3 * validity)
    c = c * F.when(coverage < config.area_coverage, 0.8).otherwise(1.0)
    if abs(config.width / config.height - config.aspect) > 0.2:
        c = c * 0.9
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c * (0.8 + 0.2 * border)))


def rectify(cards: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds quality figures, rect_status and rect_failure to detected cards.

    cards: status, confidence, image_w, image_h, corners, border_quality (of the warped image).
    """
    q = G.corners()
    able = F.col("status").isin("detected", "full_frame_card_fallback")
    corners = F.col("x1").isNotNull()
    df = cards.withColumns({"corner_quality": corner_quality(q), "geometry_validity": geometry_validity(q), "area_coverage": area_coverage(q, G.apart(F.col("image_w")), F.col("image_h")), "perspective_quality": G.rectangularity(q)})
    df = df.withColumn("rect_confidence", F.when(able & corners, confidence(F.col("confidence"), F.col("corner_quality"), F.col("geometry_validity"), F.col("area_coverage"), F.col("border_quality"), config)).otherwise(0.0))
    c = F.col("rect_confidence")
    ok = able & corners
    return df.withColumns({
        "rect_status": F.when(~ok | (c < config.rectification_floor), "rectification_failed").when(c < config.rectified, "rectification_low_confidence").otherwise("success"),
        "rect_failure": F.when(~able, F.concat(F.lit("Cannot rectify: card detection status is "), F.col("status"))).when(~corners, "No corners available for rectification")
        .when(c < config.rectification_floor, "Rectification confidence critically low").when(c < config.rectified, "Rectification confidence below threshold"),
    })

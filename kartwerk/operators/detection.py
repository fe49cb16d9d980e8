"""Card outlines: scoring, validation and choice among the candidates of an image.

Candidates are rows: image_id, cand_id, image_w, image_h, x1, y1 .. x4, y4 (ordered corners), convexity, edge_strength.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import geometry as G

CORNERS = [f"{c}{i}" for i in range(1, 5) for c in "xy"]


def contour_filter(contours: DataFrame, config: Config = Config()) -> DataFrame:
    """Contours that can be outlines: large enough, four vertices, or more with a large enough rotated box.

    contours: area, n_vertices, box_area. Adds outline, "polygon" or "box".
    """
    big = contours.where(F.col("area") >= config.min_contour_area).where("n_vertices >= 4")
    kind = F.when(F.col("n_vertices") == 4, "polygon").when(F.col("box_area") >= config.min_contour_area, "box")
    return big.withColumn("outline", kind).where("outline is not null")


def score(candidates: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds quad_area, area_ratio, aspect_ratio, rectangularity and score."""
    q = G.corners()
    df = candidates.withColumns({"quad_area": G.area(q), "aspect_ratio": G.aspect_ratio(q), "rectangularity": G.rectangularity(q)})
    df = df.withColumn("area_ratio", F.col("quad_area") / (F.col("image_w") * F.col("image_h")))
    return df.withColumn("score", total_score(F.col, config))


def total_score(get: Callable[[str], Column], config: Config = Config()) -> Column:
    """The score of a candidate whose figures get() names."""
    off = F.least(F.abs(get("aspect_ratio") - config.aspect) / config.aspect_tolerance, F.lit(1.0))
    return (
        config.area_weight * F.least(get("area_ratio") * 10.0, F.lit(1.0)) + config.aspect_weight * (1.0 - off)
        + config.rectangularity_weight * get("rectangularity") + config.convexity_weight * get("convexity") + config.edge_weight * G.apart(get("edge_strength"))
    )


def checks(config: Config = Config(), get: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """What a scored candidate can fail on its own figures."""
    image = get("image_w") * get("image_h")
    ar = get("aspect_ratio")
    return {
        "bad_area": get("area_ratio") * image < image * config.min_area_fraction,
        "bad_aspect": (ar < config.aspect - config.aspect_tolerance) | (ar > config.aspect + config.aspect_tolerance),
        "bad_rectangularity": get("rectangularity") < config.min_rectangularity,
        "bad_convexity": G.apart(get("convexity")) < config.min_convexity,
    }


def flaws(config: Config = Config(), get: Callable[[str], Column] = F.col) -> list[tuple[Column, Column]]:
    """What can be wrong with a scored candidate, in a fixed order: whether it is, and the text that says so."""
    bad = checks(config, get)
    text = lambda f, *c: F.format_string(f, *c)
    lo, hi = config.aspect - config.aspect_tolerance, config.aspect + config.aspect_tolerance
    own = [
        (bad["bad_area"], text("Area too small (%.3f of image)", get("area_ratio"))),
        (bad["bad_aspect"], text(f"Aspect ratio %.2f outside acceptable range [{lo:.2f}, {hi:.2f}]", get("aspect_ratio"))),
        (bad["bad_rectangularity"], text("Rectangularity too low (%.2f)", get("rectangularity"))),
        (bad["bad_convexity"], text("Convexity too low (%.2f)", get("convexity"))),
    ]
    q = [(get(f"x{i}"), get(f"y{i}")) for i in range(1, 5)]
    return own + G.flaws(q, get("image_w"), get("image_h"), config.min_corner_distance)


def all_issues(config: Config = Config(), get: Callable[[str], Column] = F.col) -> Column:
    """What is wrong with a scored candidate, as texts in a fixed order."""
    return G.texts(flaws(config, get))


def validate(scored: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds issues (texts in a fixed order), n_issues, too_small and is_valid. Only issues makes texts, so that a plan that
    doesn't read it makes none."""
    df = scored.withColumns({"issues": all_issues(config), "n_issues": G.number(flaws(config)), "too_small": F.coalesce(checks(config)["bad_area"], F.lit(False))})
    return df.withColumn("is_valid", F.col("n_issues") == 0)


def choose_in_row(candidates: Column, w: Column, h: Column, config: Config = Config()) -> Column:
    """choose() for candidates that lie in an array beside their image of w x h pixels: one struct, and no shuffle.

    candidates: structs of cand_id, corners, convexity and edge_strength. The struct has status, candidate_count,
    best_candidate_score, cand_id, score, rectangularity, corners and failure_issues; it is null without candidates."""

    def judged(c: Column) -> Column:
        q = [(c[f"x{i}"], c[f"y{i}"]) for i in range(1, 5)]
        area = G.area(q)
        first = F.struct(*[c[n].alias(n) for n in ("cand_id", *CORNERS, "convexity", "edge_strength")], w.alias("image_w"), h.alias("image_h"), (area / (w * h)).alias("area_ratio"), G.aspect_ratio(q).alias("aspect_ratio"), G.rectangularity(q).alias("rectangularity"))
        full = lambda x: F.struct((-total_score(lambda n: x[n], config)).alias("rank"), x["cand_id"].alias("cand_id"), *[x[n].alias(n) for n in (*CORNERS, "rectangularity")], all_issues(config, lambda n: x[n]).alias("issues"))
        return G.let(first, full)

    def chosen(all_of: Column) -> Column:
        good = F.array_min(F.filter(all_of, lambda c: F.size(c["issues"]) == 0))
        last = F.array_max(all_of)["issues"]
        failed = F.when(F.lower(F.array_join(last, " ")).contains("area"), "card_too_small").otherwise("card_geometry_invalid")
        return F.struct(
            F.when(good.isNotNull(), "detected").otherwise(failed).alias("status"), F.size(all_of).cast("long").alias("candidate_count"), (-F.array_min(all_of)["rank"]).alias("best_candidate_score"), good["cand_id"].alias("cand_id"),
            (-good["rank"]).alias("score"), good["rectangularity"].alias("rectangularity"), *[good[n].alias(n) for n in CORNERS], F.when(good.isNull(), last).alias("failure_issues"),
        )

    return F.when(F.size(candidates) > 0, G.let(F.transform(candidates, judged), chosen))


def choose(validated: DataFrame) -> DataFrame:
    """One row an image: the best-scored valid candidate, or the failure of an image that has none.

    A failure carries the best score but the issues of the last candidate tried. Minima by key are combined before the
    shuffle, so an image with very many candidates is no large group.
    """
    row = F.struct("cand_id", "score", "rectangularity", "image_w", "image_h", *CORNERS)
    rank = F.struct((-F.col("score")).alias("s"), F.col("cand_id").alias("c"))
    per = validated.groupBy("image_id").agg(
        F.count("*").alias("candidate_count"),
        F.min_by(F.when(F.col("is_valid"), row), F.when(F.col("is_valid"), rank)).alias("good"),
        F.max("score").alias("best_candidate_score"),
        F.max_by("issues", rank).alias("last_issues"),
        F.max_by("too_small", rank).alias("last_too_small"),
    )
    failed = F.when(F.col("last_too_small"), "card_too_small").otherwise("card_geometry_invalid")
    return per.select("image_id", F.when(F.col("good").isNotNull(), "detected").otherwise(failed).alias("status"), "candidate_count", "best_candidate_score", "good.*", F.when(F.col("good").isNull(), F.col("last_issues")).alias("failure_issues"))


def to_original(chosen: DataFrame, scale: Column) -> DataFrame:
    """Corners in the original image. They are multiplied by the detection scale, which is wrong for images that were
    shrunk; that is the defined behaviour."""
    return chosen.withColumns({c: F.col(c) * scale for c in CORNERS})


def in_images(chosen: DataFrame, sized: DataFrame, config: Config = Config()) -> DataFrame:
    """Corners and sizes of chosen outlines in the original images; outlines of shrunk images are told by their width.

    sized: image_id, image_w, image_h of the originals.
    """
    both = chosen.join(sized.select("image_id", F.col("image_w").alias("own_w"), F.col("image_h").alias("own_h")), "image_id")
    scale = F.when(F.col("image_w") < F.col("own_w"), config.detection_max_dim / F.greatest("own_w", "own_h")).otherwise(1.0)
    return to_original(both, scale).withColumns({"image_w": F.col("own_w"), "image_h": F.col("own_h")}).drop("own_w", "own_h")


def final_confidence(score: Column, rectangularity: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score * (1.0 - F.greatest(F.lit(0.0), 0.3 * (1.0 - rectangularity)))))


def finish(chosen: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds the bounding box and the final confidence to detected cards; corners that fail in the original image turn the
    status into card_geometry_invalid."""
    q = G.corners()
    found = G.apart(F.col("status")) == "detected"
    bad = found & (G.number(G.flaws(q, F.col("image_w"), F.col("image_h"), config.min_corner_distance)) > 0)
    df = chosen.withColumn("status", F.when(bad, "card_geometry_invalid").otherwise(F.col("status")))
    found = F.col("status") == "detected"
    box = {k: F.when(found, v).cast("long") for k, v in G.bounds(q).items()}
    return df.withColumns(box | {"confidence": F.when(found, final_confidence(F.col("score"), F.col("rectangularity"))).otherwise(F.col("best_candidate_score"))})


def full_frame(images: DataFrame, candidates: DataFrame, config: Config = Config()) -> DataFrame:
    """Images without candidates: the whole frame stands in where its sides are about those of a card.

    images: image_id, image_w, image_h. Only ids of candidates are shuffled.
    """
    alone = images.join(candidates.select("image_id").distinct(), "image_id", "left_anti")
    near = F.abs(F.when(F.col("image_h") > 0, F.col("image_w") / F.col("image_h")).otherwise(0.0) - config.aspect) <= 2 * config.aspect_tolerance
    return alone.select(
        "image_id", F.when(near, "full_frame_card_fallback").otherwise("card_not_detected").alias("status"),
        F.when(near, 0.3).otherwise(0.0).alias("confidence"),
        F.when(near, "Using full frame as fallback - no distinct card detected").otherwise("No card-like region detected").alias("failure_reason"),
        F.when(near, F.lit(0).cast("long")).alias("bx1"), F.when(near, F.lit(0).cast("long")).alias("by1"), F.when(near, F.col("image_w")).alias("bx2"), F.when(near, F.col("image_h")).alias("by2"),
    )


def detect(candidates: DataFrame, config: Config = Config(), sized: DataFrame | None = None) -> DataFrame:
    """Score, validate, choose and finish: one shuffle, by image. With sized, corners are taken to the original images
    before they are finished."""
    chosen = choose(validate(score(candidates, config), config))
    return finish(chosen if sized is None else in_images(chosen, sized, config), config)

"""Field boxes on the canonical card: proposals, refinement, confidence, alternatives and the card's verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import geometry as G

Density = Callable[[list[Column]], Column]
BOX = ["x1", "y1", "x2", "y2"]


def initial(region: list[Column], w: Column, h: Column) -> list[Column]:
    """The box of a region (shares of the sides) on a card, cut at its edges."""
    zero, (x1, y1, x2, y2) = F.lit(0).cast("long"), region
    return [F.greatest(zero, (x1 * w).cast("long")), F.greatest(zero, (y1 * h).cast("long")), F.least(w.cast("long"), (x2 * w).cast("long")), F.least(h.cast("long"), (y2 * h).cast("long"))]


def proposals(cards: DataFrame, config: Config = Config()) -> DataFrame:
    """Each card with six rows of initial boxes; cards: card_id, width, height. The regions are a literal array, so no
    join is planned."""
    rows = F.array(*[F.struct(F.lit(i).alias("field_no"), *[F.lit(v).alias(n) for n, v in zip(("field_name", "rx1", "ry1", "rx2", "ry2", "refinement", "expected_ar"), r)]) for i, r in enumerate(config.regions)])
    df = cards.select("*", F.explode(rows).alias("r")).select(*cards.columns, "r.*")
    df = df.withColumns(dict(zip(BOX, initial([F.col(f"r{c}") for c in BOX], F.col("width"), F.col("height")))))
    return df.drop("rx1", "ry1", "rx2", "ry2").where("x1 < x2 and y1 < y2")


def box_score(kind: Column, d: Column, box: list[Column]) -> Column:
    """How well a box with bright share d suits a kind of content."""
    p = G.bbox_properties(*box)
    area = p["area"].cast("double")
    return (
        F.when(kind == "digits", d * F.greatest(F.lit(0.0), 1.0 - F.abs(p["aspect"] - 4.0) / 4.0))
        .when(kind == "text_lines", d * (1.0 + 0.2 * F.least(p["width"] / p["height"], F.lit(5.0))))
        .when(kind == "short_digits", d * F.least(F.lit(1.0), 100.0 / area))
        .when(kind == "compact", d * F.least(F.lit(1.0), 5000.0 / area))
        .when(kind == "large_block", d * (0.5 + 0.5 * F.least(F.lit(1.0), area / 20000.0)))
        .otherwise(d)
    )


def _steps(box: list[Column], w: Column, h: Column, config: Config) -> list[tuple[dict[str, Column], Column | None]]:
    """The box itself, then its expansions, then its contractions; each with whether it is not degenerate (None: not asked)."""
    x1, y1, x2, y2 = box
    zero = F.lit(0).cast("long")
    out = []
    for i in range(1 + config.expansions + config.contractions):
        if i <= config.expansions:
            p = i * config.expansion
            b = [F.greatest(zero, x1 - p), F.greatest(zero, y1 - p), F.least(w.cast("long"), x2 + p), F.least(h.cast("long"), y2 + p)]
        else:
            p = (i - config.expansions) * config.contraction
            b = [F.least(x1 + p, w.cast("long")), F.least(y1 + p, h.cast("long")), F.greatest(zero, x2 - p), F.greatest(zero, y2 - p)]
        out.append((dict(zip(BOX, b)), None if i == 0 else (b[0] < b[2]) & (b[1] < b[3])))
    return out


def steps(box: list[Column], w: Column, h: Column, config: Config = Config()) -> Column:
    """The boxes that are tried, each with its number; degenerate ones are left out."""
    made = [(F.struct(F.lit(i).alias("step"), *[v.alias(c) for c, v in b.items()]), kept) for i, (b, kept) in enumerate(_steps(box, w, h, config))]
    return F.filter(F.array(*[s if kept is None else F.when(kept, s) for s, kept in made]), lambda x: x.isNotNull())


def all_steps(w: Column, h: Column, config: Config = Config()) -> Column:
    """Every box that refine() tries on a card, as an array of different [x1, y1, x2, y2]."""
    tried = [steps(initial([F.lit(v) for v in r[1:5]], w, h), w, h, config) for r in config.regions]
    return F.array_distinct(F.transform(F.concat(*tried), lambda s: F.array(*[s[c] for c in BOX])))


def refine(boxes: DataFrame, density: Density, config: Config = Config()) -> DataFrame:
    """Adds density (of the initial box), bx1 .. by2 and best_score: the first of the best-scored steps, or the initial
    box if nothing scores above zero. The choice is made inside the row; no window is needed."""
    tried = []
    for i, (step, kept) in enumerate(_steps([F.col(c) for c in BOX], F.col("width"), F.col("height"), config)):
        box = [step[c] for c in BOX]
        kind = F.col("refinement") if i else G.apart(F.col("refinement"))
        made = F.struct(box_score(kind, density(box), box).alias("score"), F.lit(-i).alias("order"), *[v.alias(f"b{c}") for c, v in step.items()])
        tried.append(made if kept is None else F.when(kept, made))
    best = F.greatest(*tried) if len(tried) > 1 else tried[0]  # null ones are passed over
    df = boxes.withColumns({"density": density([F.col(c) for c in BOX]), "best": best})
    # A generator keeps the planner from copying this expression into every later filter and column.
    df = df.select(*[c for c in df.columns if c != "best"], F.explode(F.array("best")).alias("best"))
    good = F.col("best.score") > 0
    return df.select(*[c for c in df.columns if c != "best"], *[F.when(good, F.col(f"best.b{c}")).otherwise(F.col(c)).alias(f"b{c}") for c in BOX], F.when(good, F.col("best.score")).otherwise(0.0).alias("best_score"))


def confidence(refined: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds loc_confidence, from the density of the initial and the shape of the refined box, aspect_match and status."""
    d = F.col("density")
    box = [F.col(f"b{c}") for c in BOX]
    p = G.bbox_properties(*box)
    area, ar = p["area"].cast("double"), p["aspect"]
    one = F.lit(1.0)
    off = lambda e: 1.0 - F.least(F.abs(ar - e) / e, F.lit(0.3))
    f = F.col("field_name")
    c = (
        F.when(f == "nid", F.least(one, 1.5 * d) * off(4.0) * F.when(p["center_y"] < 0.4 * F.col("height"), 1.0).otherwise(0.8))
        .when(f == "name", F.least(one, 1.3 * d) * off(3.0))
        .when(f == "dob", F.least(one, 1.4 * d) * F.least(one, 8000.0 / area))
        .when(f == "gender", F.least(one, 1.2 * d) * F.least(one, 5000.0 / area))
        .when(f == "governorate", F.least(one, 1.3 * d))
        .when(f == "address", F.least(one, 1.2 * d) * (0.5 + 0.5 * F.least(one, area / 15000.0)))
    )
    e = F.col("expected_ar")
    df = refined.withColumns({"loc_confidence": c, "aspect_match": F.greatest(F.lit(0.0), 1.0 - F.abs(ar - e) / e)})
    return df.withColumn("loc_status", F.when(F.col("loc_confidence") >= config.localized, "localized").otherwise("field_localization_uncertain"))


def clipping_score(box: list[Column], w: Column, h: Column, edge_mean: Column) -> Column:
    """0.7 at the card's edge, 0.5 for very bright or dark box edges, else 0.2; edge_mean null (no pixels): 0."""
    touches = (box[0] <= 2) | (box[1] <= 2) | (box[2] >= w - 2) | (box[3] >= h - 2)
    return F.when(touches, 0.7).when(edge_mean.isNull(), 0.0).when((edge_mean > 240) | (edge_mean < 15), 0.5).otherwise(0.2)


def alternatives(localized: DataFrame, density: Density, config: Config = Config()) -> DataFrame:
    """For boxes of low confidence the first three of four shifts (up, down, left, right) that keep some area, as rows:
    alt_no, ax1 .. ay2, alt_density, alt_confidence. Only the edge that would leave the card is held."""
    s = config.expansion
    x1, y1, x2, y2 = (F.col(f"b{c}") for c in BOX)
    zero, out = F.lit(0).cast("long"), []
    for dx, dy in ((0, -s), (0, s), (-s, 0), (s, 0)):
        b = [F.greatest(zero, x1 + dx), F.greatest(zero, y1 + dy), F.least(F.col("width").cast("long"), x2 + dx), F.least(F.col("height").cast("long"), y2 + dy)]
        out.append(F.when((b[0] < b[2]) & (b[1] < b[3]), F.struct(*[v.alias(f"a{c}") for v, c in zip(b, BOX)])))
    made = F.slice(F.filter(F.array(*out), lambda x: x.isNotNull()), 1, config.max_alternatives)
    df = localized.where(F.col("loc_confidence") < config.alternatives_below)
    df = df.select(*localized.columns, F.posexplode(made).alias("alt_no", "a")).select(*localized.columns, "alt_no", "a.*")
    return df.withColumn("alt_density", density([F.col(f"a{c}") for c in BOX])).withColumn("alt_confidence", 0.8 * F.col("alt_density"))


def card_success(localized: DataFrame) -> DataFrame:
    """One row a card: localized count, number of fields, success (half of them or more), status and message."""
    per = localized.groupBy("card_id").agg(F.count_if(F.col("loc_status") == "localized").alias("n_localized"), F.count("*").alias("n_fields"))
    ok = F.col("n_localized") >= 0.5 * F.col("n_fields")
    n = F.concat(F.col("n_localized").cast("string"), F.lit("/"), F.col("n_fields").cast("string"))
    return per.withColumns({"success": ok, "status": F.when(ok, "localized").otherwise("partial_localization"), "message": F.when(ok, F.concat(F.lit("Successfully localized "), n, F.lit(" fields"))).otherwise(F.concat(F.lit("Only "), n, F.lit(" fields localized with confidence")))})


def localize(cards: DataFrame, density: Density, config: Config = Config()) -> DataFrame:
    """Proposals, refinement and confidence of all six fields; narrow, no shuffle."""
    return confidence(refine(proposals(cards, config), density, config), config)


__all__ = ["all_steps", "alternatives", "box_score", "card_success", "clipping_score", "confidence", "initial", "localize", "proposals", "refine", "steps"]

"""Registered queries over pixels: images of 32 pixels' width whose rows are vectors of `embeddings`, two rows each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import rasters as R
from .operators import detection, localization
from .plans import cards as plans
from .registry import _REG, D_CONF, D_KIND, query, rnd

WIDTH, GROUP = 32, 16
#: image_id, idx (place in the image), r, c, gray, h.
_PIXELS = f"""px0 AS (SELECT vec_id, unnest(range(0, 64)) AS px, unnest(embedding) AS v FROM embeddings),
px1 AS (SELECT vec_id // {GROUP} AS image_id, (dense_rank() OVER (PARTITION BY vec_id // {GROUP} ORDER BY vec_id) - 1) * 64 + px AS idx, CAST(floor(least(greatest((CAST(v AS DOUBLE) + 0.5) * 255, 0), 255)) AS BIGINT) AS gray FROM px0),
pix AS (SELECT image_id, idx, idx // {WIDTH} AS r, idx % {WIDTH} AS c, gray, max(idx // {WIDTH} + 1) OVER (PARTITION BY image_id) AS h FROM px1)"""
_BOXES = f"""boxes AS (SELECT * FROM (SELECT image_id, h, b.n AS box_no, CASE b.n WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 3 + image_id % 7 ELSE 0 END AS x1, CASE b.n WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 3 + image_id % 5 ELSE 1 END AS y1,
  CASE b.n WHEN 0 THEN {WIDTH} WHEN 1 THEN 25 WHEN 2 THEN 16 + image_id % 11 ELSE 9 END AS x2, CASE b.n WHEN 0 THEN h WHEN 1 THEN h - 3 WHEN 2 THEN h - 3 - image_id % 2 ELSE 5 END AS y2 FROM (SELECT DISTINCT image_id, h FROM pix) i, (VALUES (0), (1), (2), (3)) b(n)) z WHERE x1 < x2 AND y1 < y2 AND y2 <= h)"""


def images(spark: SparkSession, d: str) -> DataFrame:
    """image_id, width, height and values; an image has at most GROUP vectors, so its group is bounded."""
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    grays = F.transform("embedding", lambda v: F.floor(F.least(F.greatest((v.cast("double") + 0.5) * 255, F.lit(0.0)), F.lit(255.0))))
    per = df.groupBy(F.floor(F.col("vec_id") / GROUP).alias("image_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", grays.alias("g")))).alias("rows"))
    made = per.select("image_id", F.flatten(F.transform("rows", lambda r: r["g"])).alias("values"))
    return made.withColumns({"width": F.lit(WIDTH).cast("long"), "height": F.floor(F.size("values") / WIDTH)})


def _boxed(df: DataFrame) -> DataFrame:
    """Each image with its boxes."""
    i, h, w = F.col("image_id"), F.col("height"), F.col("width")
    zero = F.lit(0).cast("long")
    made = [[zero, zero, w, h], [zero + 5, zero + 3, zero + 25, h - 3], [3 + i % 7, 3 + i % 5, 16 + i % 11, h - 3 - i % 2], [zero, zero + 1, zero + 9, zero + 5]]
    boxes = F.array(*[F.struct(*[c.cast("long").alias(n) for n, c in zip(localization.BOX, b)]) for b in made])
    out = df.select("*", F.posexplode(boxes).alias("box_no", "b")).select(*df.columns, F.col("box_no").cast("long").alias("box_no"), "b.*")
    return out.where("x1 < x2 and y1 < y2 and y2 <= height")


def _box() -> list:
    return [F.col(c) for c in localization.BOX]


@query("r4_border_quality", f"""WITH {_PIXELS}, m AS (SELECT *, least(greatest(5, CAST(floor(least(h, {WIDTH}) * 0.05E0) AS BIGINT)), h) AS d FROM pix)
SELECT image_id, round(least(1.0E0, (var_pop(gray) FILTER (WHERE r < d) + var_pop(gray) FILTER (WHERE r >= h - d) + var_pop(gray) FILTER (WHERE c < 5) + var_pop(gray) FILTER (WHERE c >= {WIDTH} - 5)) / 4.0E0 / 5000.0E0) + 1E-10, 9) AS border_quality FROM m GROUP BY image_id""")
def r4_border_quality(spark, d):
    w = F.col("width")
    df = images(spark, d).withColumns({"sums": R.table(R.summed(F.col("values"), 1), w), "squares": R.table(R.summed(F.col("values"), 1, square=True), w)})
    return df.select("image_id", rnd(R.border_quality(F.col("sums"), F.col("squares"), w, F.col("height")) + 1e-10, 9).alias("border_quality"))


@query("l17_clipping", f"""WITH {_PIXELS}, {_BOXES}, s AS (SELECT b.image_id, b.h, box_no, x1, y1, x2, y2, gray, r, c, least(3, y2 - y1) AS d, least(3, x2 - x1) AS e FROM boxes b JOIN pix p ON p.image_id = b.image_id AND r >= y1 AND r < y2 AND c >= x1 AND c < x2),
a AS (SELECT image_id, h, box_no, x1, y1, x2, y2, (avg(gray) FILTER (WHERE r < y1 + d) + avg(gray) FILTER (WHERE r >= y2 - d) + avg(gray) FILTER (WHERE c < x1 + e) + avg(gray) FILTER (WHERE c >= x2 - e)) / 4.0E0 AS m FROM s GROUP BY ALL)
SELECT image_id, box_no, round(m + 1E-8, 6) AS edge_mean, CASE WHEN x1 <= 2 OR y1 <= 2 OR x2 >= {WIDTH} - 2 OR y2 >= h - 2 THEN 0.7E0 WHEN m > 240 OR m < 15 THEN 0.5E0 ELSE 0.2E0 END AS clipping FROM a""")
def l17_clipping(spark, d):
    w = F.col("width")
    df = _boxed(images(spark, d).withColumn("sums", R.table(F.col("values"), w))).withColumn("m", R.edge_mean(F.col("sums"), w, _box()))
    return df.select("image_id", "box_no", rnd(F.col("m") + 1e-8).alias("edge_mean"), localization.clipping_score(_box(), w, F.col("height"), F.col("m")).alias("clipping"))


@query("l4_l5_box_density", f"""WITH {_PIXELS}, {_BOXES}, s AS (SELECT b.image_id, box_no, gray FROM boxes b JOIN pix p ON p.image_id = b.image_id AND r >= y1 AND r < y2 AND c >= x1 AND c < x2),
g AS (SELECT image_id, box_no, gray, count(*) AS k FROM s GROUP BY ALL), u AS (SELECT image_id, box_no, gray, CAST(sum(k) OVER w AS DOUBLE) AS below, CAST(sum(k * gray) OVER w AS DOUBLE) AS mass FROM g WINDOW w AS (PARTITION BY image_id, box_no ORDER BY gray)),
t AS (SELECT *, max(mass) OVER (PARTITION BY image_id, box_no) AS total, max(below) OVER (PARTITION BY image_id, box_no) AS n FROM u),
o AS (SELECT image_id, box_no, n, below, gray AS threshold, row_number() OVER (PARTITION BY image_id, box_no ORDER BY CASE WHEN below < n THEN (total * below - mass * n) * (total * below - mass * n) / (below * (n - below)) ELSE -1 END DESC, gray) AS rn FROM t)
SELECT image_id, box_no, CAST(n AS BIGINT) AS n_pixels, CASE WHEN below < n THEN threshold ELSE 0 END AS threshold, CASE WHEN below < n THEN round((n - below) / n, 9) WHEN threshold > 0 THEN 1.0E0 ELSE 0.0E0 END AS density FROM o WHERE rn = 1""")
def l4_l5_box_density(spark, d):
    df = _boxed(images(spark, d)).withColumn("crop", R.crop(F.col("values"), F.col("width"), _box()))
    df = df.withColumn("threshold", R.otsu(F.col("crop")))
    return df.select("image_id", "box_no", F.size("crop").cast("long").alias("n_pixels"), "threshold", rnd(R.bright_share(F.col("crop"), F.col("threshold")), 9).alias("density"))


def _near(offsets: str) -> str:
    """Each pixel with the neighbours named by offsets (dr, dc, weights), mirrored at the borders."""
    fold = lambda x, n: f"(CASE WHEN abs({x}) >= {n} THEN abs(2 * {n} - 2 - abs({x})) ELSE abs({x}) END)"
    return f"SELECT p.image_id, p.idx, p.r, p.c, p.h, p.gray, q.gray AS near, o.* FROM pix p, (VALUES {offsets}) o JOIN pix q ON q.image_id = p.image_id AND q.r = {fold('(p.r + o.dr)', 'p.h')} AND q.c = {fold('(p.c + o.dc)', WIDTH)}"


_K5 = {-2: 1, -1: 4, 0: 6, 1: 4, 2: 1}
_BLUR = ", ".join(f"({a}, {b}, {_K5[a] * _K5[b]})" for a in _K5 for b in _K5)
_SOBEL = ", ".join(f"({a}, {b}, {b * (2 if a == 0 else 1)}, {a * (2 if b == 0 else 1)})" for a in (-1, 0, 1) for b in (-1, 0, 1))


@query("i4_noise_d4_edges", f"""WITH {_PIXELS}, b AS (SELECT image_id, idx, gray, floor((sum(near * k) + 128) / 256) AS soft FROM ({_near(_BLUR).replace(') o JOIN', ') o(dr, dc, k) JOIN')}) GROUP BY image_id, idx, gray),
n AS (SELECT image_id, avg(abs(gray - soft)) AS noise FROM b GROUP BY image_id), e AS (SELECT image_id, idx, r, c, h, sqrt(CAST(sum(near * kx) * sum(near * kx) + sum(near * ky) * sum(near * ky) AS DOUBLE)) AS m FROM ({_near(_SOBEL).replace(') o JOIN', ') o(dr, dc, kx, ky) JOIN')}) GROUP BY image_id, idx, r, c, h),
s AS (SELECT image_id, any_value(h) AS h, (avg(m) FILTER (WHERE r < least(5, h)) + avg(m) FILTER (WHERE r >= h - least(5, h)) + avg(m) FILTER (WHERE c < 5) + avg(m) FILTER (WHERE c >= {WIDTH} - 5)) / 4.0E0 AS m FROM e GROUP BY image_id)
SELECT image_id, round(noise + 1E-10, 8) AS noise, round(CASE WHEN h < 3 THEN 0.0E0 ELSE least(1.0E0, m / 255.0E0) END, 8) AS edge_strength FROM n JOIN s USING (image_id)""")
def i4_noise_d4_edges(spark, d):
    w, h, v = F.col("width"), F.col("height"), F.col("values")
    df = images(spark, d).withColumns({"blur": R.blurred(v, w, h), "magnitudes": R.table(R.gradient(v, w, h), w)})
    return df.select("image_id", rnd(R.noise(v, F.col("blur")) + 1e-10, 8).alias("noise"), rnd(R.edge_strength(F.col("magnitudes"), w, h), 8).alias("edge_strength"))


#: Which boxes are prepared as which field.
_FIELDS = [(0, "name"), (1, "nid"), (1, "address"), (2, "dob"), (2, "governorate"), (3, "gender")]
F1 = f"""WITH {_PIXELS}, {_BOXES}, fields(box_no, field_name) AS (VALUES {", ".join(f"({n}, '{f}')" for n, f in _FIELDS)}),
cut AS (SELECT b.image_id, b.box_no, x2 - x1 AS w, y2 - y1 AS h, p.r - y1 AS r, p.c - x1 AS c, gray FROM boxes b JOIN pix p ON p.image_id = b.image_id AND p.r >= y1 AND p.r < y2 AND p.c >= x1 AND p.c < x2),
job AS (SELECT cut.*, field_name FROM cut JOIN fields USING (box_no)),
soft AS (SELECT a.image_id, a.field_name, a.r, a.c, floor((sum(q.gray * o.k) + 8) / 16) AS gray FROM job a, (VALUES {", ".join(f"({i}, {j}, {(2 - abs(i)) * (2 - abs(j))})" for i in (-1, 0, 1) for j in (-1, 0, 1))}) o(dr, dc, k)
  JOIN job q ON q.image_id = a.image_id AND q.field_name = a.field_name AND q.r = least(greatest(a.r + o.dr, 0), a.h - 1) AND q.c = least(greatest(a.c + o.dc, 0), a.w - 1) WHERE a.field_name = 'gender' GROUP BY ALL),
bw AS (SELECT image_id, field_name, r, c, gray FROM job WHERE field_name = 'nid' UNION ALL SELECT * FROM soft),
u AS (SELECT image_id, field_name, gray, CAST(sum(k) OVER w AS DOUBLE) AS below, CAST(sum(k * gray) OVER w AS DOUBLE) AS mass FROM (SELECT image_id, field_name, gray, count(*) AS k FROM bw GROUP BY ALL) z WINDOW w AS (PARTITION BY image_id, field_name ORDER BY gray)),
t AS (SELECT *, max(mass) OVER (PARTITION BY image_id, field_name) AS total, max(below) OVER (PARTITION BY image_id, field_name) AS n FROM u),
o AS (SELECT image_id, field_name, CASE WHEN below < n THEN gray ELSE 0 END AS threshold, row_number() OVER (PARTITION BY image_id, field_name ORDER BY CASE WHEN below < n THEN (total * below - mass * n) * (total * below - mass * n) / (below * (n - below)) ELSE -1 END DESC, gray) AS rn FROM t),
g11(d, k) AS (SELECT d, exp(-d * d / 8.0E0) / sum(exp(-d * d / 8.0E0)) OVER () FROM (SELECT unnest(range(-5, 6)) AS d) z),
dob AS (SELECT a.image_id, a.field_name, a.r, a.c, a.gray, sum(q.gray * v.k * s.k) AS m FROM job a, g11 v, g11 s JOIN job q ON q.image_id = a.image_id AND q.field_name = a.field_name AND q.r = least(greatest(a.r + v.d, 0), a.h - 1) AND q.c = least(greatest(a.c + s.d, 0), a.w - 1) WHERE a.field_name = 'dob' GROUP BY ALL),
eq AS (SELECT *, CAST(ceil(h / 8.0E0) AS BIGINT) AS th, CAST(ceil(w / 8.0E0) AS BIGINT) AS tw FROM job WHERE field_name IN ('name', 'address', 'governorate')),
dims AS (SELECT DISTINCT image_id, field_name, w, h, th, tw FROM eq), grid AS (SELECT d.*, ty, tx, i, j FROM dims d, (SELECT unnest(range(0, 8)) AS ty) a, (SELECT unnest(range(0, 8)) AS tx) b, (SELECT unnest(range(0, 4)) AS i) k, (SELECT unnest(range(0, 4)) AS j) l WHERE i < th AND j < tw),
mir AS (SELECT g.*, ty * th + i AS y, tx * tw + j AS x FROM grid g), src AS (SELECT m.image_id, m.field_name, ty, tx, m.th * m.tw AS area, e.gray FROM (SELECT *, (CASE WHEN h = 1 THEN 0 WHEN y % (2 * h - 2) < h THEN y % (2 * h - 2) ELSE 2 * h - 2 - y % (2 * h - 2) END) AS my, (CASE WHEN w = 1 THEN 0 WHEN x % (2 * w - 2) < w THEN x % (2 * w - 2) ELSE 2 * w - 2 - x % (2 * w - 2) END) AS mx FROM mir) m JOIN eq e ON e.image_id = m.image_id AND e.field_name = m.field_name AND e.r = my AND e.c = mx),
hist AS (SELECT t.image_id, t.field_name, t.ty, t.tx, t.area, v, count(s.gray) AS n FROM (SELECT DISTINCT image_id, field_name, ty, tx, area FROM src) t CROSS JOIN (SELECT unnest(range(0, 256)) AS v) k LEFT JOIN src s ON s.image_id = t.image_id AND s.field_name = t.field_name AND s.ty = t.ty AND s.tx = t.tx AND s.gray = v GROUP BY ALL),
lim AS (SELECT *, greatest(1, CAST(floor(2.0E0 * area / 256) AS BIGINT)) AS top FROM hist), ov AS (SELECT *, sum(greatest(n - top, 0)) OVER (PARTITION BY image_id, field_name, ty, tx) AS over FROM lim),
cl AS (SELECT *, least(n, top) + over // 256 + CASE WHEN over % 256 > 0 AND v % greatest(1, 256 // (over % 256)) = 0 AND v // greatest(1, 256 // (over % 256)) < over % 256 THEN 1 ELSE 0 END AS k FROM ov),
lut AS (SELECT image_id, field_name, ty, tx, v, least(255.0E0, round_even(CAST(sum(k) OVER (PARTITION BY image_id, field_name, ty, tx ORDER BY v) AS DOUBLE) * 255.0E0 / area, 0)) AS z FROM cl),
pt AS (SELECT *, r / CAST(th AS DOUBLE) - 0.5E0 AS y, c / CAST(tw AS DOUBLE) - 0.5E0 AS x FROM eq),
clahe AS (SELECT p.image_id, p.field_name, p.r, p.c, round_even((a.z * (1 - (x - floor(x))) + b.z * (x - floor(x))) * (1 - (y - floor(y))) + (d.z * (1 - (x - floor(x))) + e.z * (x - floor(x))) * (y - floor(y)), 0) AS g FROM pt p
  {" ".join(f"JOIN lut {n} ON {n}.image_id = p.image_id AND {n}.field_name = p.field_name AND {n}.v = p.gray AND {n}.ty = least(greatest(floor(y) + {i}, 0), 7) AND {n}.tx = least(greatest(floor(x) + {j}, 0), 7)" for n, i, j in (("a", 0, 0), ("b", 0, 1), ("d", 1, 0), ("e", 1, 1)))}),
made AS (SELECT bw.image_id, bw.field_name, r, c, CASE WHEN gray > threshold THEN 255 ELSE 0 END AS g FROM bw JOIN o ON o.image_id = bw.image_id AND o.field_name = bw.field_name AND rn = 1 UNION ALL SELECT image_id, field_name, r, c, CASE WHEN gray > m - 2.0E0 THEN 255 ELSE 0 END FROM dob UNION ALL SELECT image_id, field_name, r, c, CAST(g AS BIGINT) FROM clahe)
SELECT image_id, field_name, string_agg(CAST(CAST(g AS BIGINT) AS VARCHAR), ' ' ORDER BY r, c) AS pixels FROM made GROUP BY image_id, field_name"""


@query("f1_prepared_crops", F1)
def f1_prepared_crops(spark, d):
    """Crops of every image as fields, made ready for reading, pixel by pixel."""
    field = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(f).alias("field_name")) for n, f in _FIELDS])
    df = _boxed(images(spark, d)).select("*", F.explode(F.filter(field, lambda x: x["n"] == F.col("box_no"))).alias("f"))
    df = df.withColumn("crop", R.crop(F.col("values"), F.col("width"), _box()))
    made = R.prepared(F.col("crop"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("f.field_name"))
    return df.select("image_id", F.col("f.field_name").alias("field_name"), F.array_join(made.cast("array<string>"), " ").alias("pixels"))


# -- images to fields -------------------------------------------------------------------------------------------------
# A canvas as large as the outline makes the perspective a plain shift, which SQL can follow pixel by pixel.

CANVAS = Config(width=24, height=15, min_corner_distance=5.0)
_SCORE = "(0.25E0 * least(322.0E0 / 1024.0E0 * 10.0E0, 1.0E0) + 0.2E0 * (1.0E0 - least(abs(23.0E0 / 14.0E0 - 1.587E0) / 0.3E0, 1.0E0)) + 0.25E0 + 0.15E0 * 0.9E0 + 0.15E0 * 0.5E0)"
F7 = f"""WITH {_PIXELS}, dim AS (SELECT DISTINCT image_id, h FROM pix), reg(field_name, rx1, ry1, rx2, ry2, refinement, ear) AS (VALUES {_REG}),
canon AS (SELECT image_id AS card_id, r - image_id % 7 AS r, c - image_id % 8 AS c, gray FROM pix WHERE h = 32 AND image_id % 5 NOT IN (1, 2) AND r - image_id % 7 BETWEEN 0 AND 14 AND c - image_id % 8 BETWEEN 0 AND 23),
rc AS (SELECT card_id, {_SCORE} * 0.7E0 * 0.8E0 * (0.8E0 + 0.2E0 * least(1.0E0, (var_pop(gray) FILTER (WHERE r < 5) + var_pop(gray) FILTER (WHERE r >= 10) + var_pop(gray) FILTER (WHERE c < 5) + var_pop(gray) FILTER (WHERE c >= 19)) / 4.0E0 / 5000.0E0)) AS rect_confidence FROM canon GROUP BY card_id),
p AS (SELECT card_id, rect_confidence, field_name, refinement, ear, CAST(trunc(rx1 * 24) AS BIGINT) AS ix1, CAST(trunc(ry1 * 15) AS BIGINT) AS iy1, CAST(trunc(rx2 * 24) AS BIGINT) AS ix2, CAST(trunc(ry2 * 15) AS BIGINT) AS iy2 FROM rc, reg),
st AS (SELECT *, CASE WHEN k <= 4 THEN greatest(0, ix1 - 5 * k) ELSE least(24, ix1 + 3 * (k - 4)) END AS x1, CASE WHEN k <= 4 THEN greatest(0, iy1 - 5 * k) ELSE least(15, iy1 + 3 * (k - 4)) END AS y1,
  CASE WHEN k <= 4 THEN least(24, ix2 + 5 * k) ELSE greatest(0, ix2 - 3 * (k - 4)) END AS x2, CASE WHEN k <= 4 THEN least(15, iy2 + 5 * k) ELSE greatest(0, iy2 - 3 * (k - 4)) END AS y2 FROM p, (SELECT unnest(range(0, 8)) AS k) kk WHERE ix1 < ix2 AND iy1 < iy2),
ok AS (SELECT * FROM st WHERE x1 < x2 AND y1 < y2), g AS (SELECT s.card_id, field_name, k, gray, count(*) AS m FROM ok s JOIN canon q ON q.card_id = s.card_id AND q.r >= y1 AND q.r < y2 AND q.c >= x1 AND q.c < x2 GROUP BY ALL),
u AS (SELECT card_id, field_name, k, gray, CAST(sum(m) OVER w AS DOUBLE) AS below, CAST(sum(m * gray) OVER w AS DOUBLE) AS mass FROM g WINDOW w AS (PARTITION BY card_id, field_name, k ORDER BY gray)),
t AS (SELECT *, max(mass) OVER (PARTITION BY card_id, field_name, k) AS total, max(below) OVER (PARTITION BY card_id, field_name, k) AS n FROM u),
o AS (SELECT card_id, field_name, k, CASE WHEN below < n THEN (n - below) / n WHEN gray > 0 THEN 1.0E0 ELSE 0.0E0 END AS d, row_number() OVER (PARTITION BY card_id, field_name, k ORDER BY CASE WHEN below < n THEN (total * below - mass * n) * (total * below - mass * n) / (below * (n - below)) ELSE -1 END DESC, gray) AS rn FROM t),
sd AS (SELECT ok.*, d FROM ok JOIN o ON o.card_id = ok.card_id AND o.field_name = ok.field_name AND o.k = ok.k AND rn = 1), sc AS (SELECT *, {D_KIND} AS score FROM sd),
rk AS (SELECT *, row_number() OVER (PARTITION BY card_id, field_name ORDER BY score DESC, k) AS rn, max(CASE WHEN k = 0 THEN d END) OVER (PARTITION BY card_id, field_name) AS density FROM sc),
rf AS (SELECT card_id, rect_confidence, field_name, density, CASE WHEN score > 0 THEN x1 ELSE ix1 END AS bx1, CASE WHEN score > 0 THEN y1 ELSE iy1 END AS by1, CASE WHEN score > 0 THEN x2 ELSE ix2 END AS bx2, CASE WHEN score > 0 THEN y2 ELSE iy2 END AS by2 FROM rk WHERE rn = 1),
ra AS (SELECT *, (bx2 - bx1) / (by2 - by1) AS ar, CAST((bx2 - bx1) * (by2 - by1) AS DOUBLE) AS area FROM rf), cf AS (SELECT *, {D_CONF.replace("630", "15")} AS conf FROM ra)
SELECT card_id, field_name, CASE WHEN rect_confidence < 0.5 THEN 'rectification_low_confidence' ELSE 'success' END AS rect_status, CAST(NULL AS VARCHAR) AS rect_failure, round(rect_confidence, 9) AS rect_confidence, round(density, 9) AS density, bx1, by1, bx2, by2, round(conf, 9) AS loc_confidence, CASE WHEN conf >= 0.5 THEN 'localized' ELSE 'field_localization_uncertain' END AS loc_status FROM cf
UNION ALL SELECT image_id, NULL, 'rectification_failed', CASE WHEN h = 32 AND image_id % 5 = 1 THEN 'Cannot rectify: card detection status is card_geometry_invalid' WHEN abs(32.0E0 / h - 1.587E0) > 0.6E0 THEN 'Cannot rectify: card detection status is card_not_detected' ELSE 'Rectification confidence critically low' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM dim WHERE h <> 32 OR image_id % 5 IN (1, 2)"""


def outlined(spark: SparkSession, d: str) -> DataFrame:
    """The images with their pixels as bytes, and with outlines: a sound one, one that is too long, or none."""
    i = F.col("image_id")
    box = lambda n, x1, y1, x2, y2, convexity: F.struct(F.lit(n).cast("long").alias("cand_id"), *[v.cast("double").alias(c) for c, v in zip(detection.CORNERS, (x1, y1, x2, y1, x2, y2, x1, y2))], F.lit(convexity).alias("convexity"), F.lit(0.5).alias("edge_strength"))
    good, long = box(1, i % 8, i % 7, i % 8 + 23, i % 7 + 14, 0.9), box(2, F.lit(0), F.lit(0), F.lit(30), F.lit(3), 0.95)
    full = F.col("height") == 32
    found = F.when(full & (i % 5 == 1), F.array(long)).when(full & ~(i % 5).isin(1, 2), F.when(i % 3 == 0, F.array(long, good)).otherwise(F.array(good)))
    data = F.unhex(F.array_join(F.transform("values", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return images(spark, d).select("image_id", "height", "width", F.lit(1).alias("channels"), data.alias("data"), found.alias("candidates"))


@query("f7_fields", F7)
def f7_fields(spark, d):
    """From pixels and outlines to localized fields, all within an image's row."""
    df = plans.process_rows(outlined(spark, d), CANVAS)
    return df.select("card_id", "field_name", "rect_status", "rect_failure", rnd("rect_confidence", 9).alias("rect_confidence"), rnd("density", 9).alias("density"), "bx1", "by1", "bx2", "by2", rnd("loc_confidence", 9).alias("loc_confidence"), "loc_status")

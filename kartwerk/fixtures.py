"""Inputs for the registered queries, derived from the star-schema tables by SQL that both engines run alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Cards as read: card_id, nid_raw, dob_raw, gender_raw, governorate_raw.
CARD_READS = """
SELECT o.o_orderkey AS card_id,
  CASE WHEN o.o_orderkey % 23 = 0 THEN NULL
       WHEN o.o_orderkey % 19 = 0 THEN substr(raw, 1, 13)
       WHEN o.o_orderkey % 5 = 0 THEN translate(raw, '0123456789', '٠١٢٣٤٥٦٧٨٩')
       WHEN o.o_orderkey % 7 = 0 THEN concat(substr(raw,1,1), '-', substr(raw,2,6), ' ', substr(raw,8,7))
       ELSE raw END AS nid_raw,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL
       WHEN o.o_orderkey % 3 = 0 THEN concat(dd, '/', mm, '/', yyyy)
       WHEN o.o_orderkey % 11 = 0 THEN concat(dd, '.', mm, '.', yyyy)
       ELSE concat(yyyy, '-', mm, '-', dd) END AS dob_raw,
  CASE o.o_orderkey % 5 WHEN 0 THEN 'ذكر' WHEN 1 THEN 'أنثى' WHEN 2 THEN 'female' WHEN 3 THEN 'M' ELSE NULL END AS gender_raw,
  CASE o.o_orderkey % 8 WHEN 0 THEN 'القاهرة' WHEN 1 THEN 'Giza' WHEN 2 THEN 'الإسكندرية' WHEN 3 THEN 'أسيوط' WHEN 4 THEN 'Sharqia' WHEN 5 THEN 'اسوان' WHEN 6 THEN 'luxor' ELSE NULL END AS governorate_raw
FROM (
  SELECT o_orderkey, yyyy, mm, dd,
    concat(cent, substr(yyyy,3,2), CASE WHEN o_orderkey % 29 = 0 THEN '13' ELSE mm END,
           CASE WHEN o_orderkey % 31 = 0 THEN '31' ELSE dd END,
           CAST(o_orderkey % 10 AS STRING), lpad(CAST(o_custkey % 30 AS STRING), 2, '0'),
           CAST(c_nationkey % 10 AS STRING), lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0')) AS raw
  FROM (
    SELECT o_orderkey, o_custkey, c_nationkey,
      CASE WHEN o_orderkey % 17 = 0 THEN '4' WHEN EXTRACT(YEAR FROM o_orderdate) < 2000 THEN '2' ELSE '3' END AS cent,
      CAST(EXTRACT(YEAR FROM o_orderdate) AS STRING) AS yyyy,
      lpad(CAST(EXTRACT(MONTH FROM o_orderdate) AS STRING), 2, '0') AS mm,
      lpad(CAST(EXTRACT(DAY FROM o_orderdate) AS STRING), 2, '0') AS dd
    FROM orders JOIN customer ON o_custkey = c_custkey
  ) k
) o
"""

#: Candidate outlines: image_id, cand_id, image_w, image_h, four corners, convexity, edge_strength.
QUADS = """
SELECT l_orderkey AS image_id, cand_id, w AS image_w, h AS image_h,
  CAST(cx - hw + l_partkey % 7 AS DOUBLE) AS x1, CAST(cy - hh + l_suppkey % 5 AS DOUBLE) AS y1,
  CAST(cx + hw - l_suppkey % 9 AS DOUBLE) AS x2, CAST(cy - hh - l_partkey % 4 AS DOUBLE) AS y2,
  CAST(cx + hw + l_partkey % 11 AS DOUBLE) AS x3, CAST(cy + hh - l_suppkey % 6 AS DOUBLE) AS y3,
  CAST(cx - hw - l_suppkey % 8 AS DOUBLE) AS x4, CAST(cy + hh + l_partkey % 3 AS DOUBLE) AS y4,
  (80 + l_partkey % 20) / 100.0E0 AS convexity, (l_suppkey % 50) / 100.0E0 AS edge_strength
FROM (
  SELECT l_orderkey, l_partkey, l_suppkey,
    ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS cand_id,
    800 + (l_orderkey % 5) * 200 AS w, 500 + (l_orderkey % 4) * 150 AS h,
    400 + (l_orderkey % 5) * 100 AS cx, 250 + (l_orderkey % 4) * 75 AS cy,
    40 + l_partkey % 320 AS hw,
    25 + CAST(FLOOR((l_partkey % 320) * (30 + (l_suppkey * 7) % 70) / 100.0E0) AS BIGINT) AS hh
  FROM lineitem
) k
"""

#: Grey tiles of 8 x 8 pixels: vec_id, px (0-63), gray (0-255).
TILES_DUCKDB = """
SELECT vec_id, px, CAST(floor(least(greatest((CAST(v AS DOUBLE) + 0.5) * 255, 0), 255)) AS BIGINT) AS gray
FROM (SELECT vec_id, unnest(range(0, 64)) AS px, unnest(embedding) AS v FROM embeddings) k
"""

TILES_SPARK = """
SELECT vec_id, CAST(px AS BIGINT) AS px, CAST(floor(least(greatest((CAST(v AS DOUBLE) + 0.5D) * 255, 0), 255)) AS BIGINT) AS gray
FROM (SELECT vec_id, posexplode(embedding) AS (px, v) FROM {embeddings}) k
"""

#: Recognised texts of card fields, several of each: card_id, field_name, idx, text, ocr_confidence.
OCR_CANDIDATES = """
SELECT card_id, field_name, ROW_NUMBER() OVER (PARTITION BY card_id, field_name ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx,
  CASE field_name WHEN 'nid' THEN nid_raw WHEN 'dob' THEN dob_raw WHEN 'gender' THEN gender_raw WHEN 'governorate' THEN governorate_raw
    WHEN 'name' THEN concat('محمد ', CAST(l_partkey AS STRING)) ELSE concat(' شارع ', CAST(l_suppkey AS STRING), '  ') END AS text,
  round(l_discount * 10, 2) AS ocr_confidence
FROM (
  SELECT c.*, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount,
    CASE l_linenumber % 6 WHEN 0 THEN 'nid' WHEN 1 THEN 'name' WHEN 2 THEN 'dob' WHEN 3 THEN 'gender' WHEN 4 THEN 'governorate' ELSE 'address' END AS field_name
  FROM lineitem JOIN (CARDS) c ON l_orderkey = c.card_id
) k
"""

#: Short texts with marks, elongation, letter forms, both digit scripts and odd spaces.
ARABIC_TEXT = """
SELECT * FROM (VALUES
  (1, 'مُحَمَّد'), (2, 'القـــاهرة'), (3, 'أحمد إبراهيم آدم'), (4, 'مصطفى على'), (5, '٢٩٥٠١٠١١٢٣٤٥٦٧'), (6, '۲۹۵۰۱۰۱'),
  (7, '  ذكر  '), (8, 'أنثى'), (9, 'female'), (10, 'Male'), (11, 'دكر'), (12, 'انثي'), (13, 'abc 123 قنا'), (14, ''), (15, NULL),
  (16, '12-34/56'), (17, '١٢ ٣٤ x'), (18, 'ش. ٩ م'), (19, 'امرأة'), (20, 'رجل')
) AS t(id, text)
"""


def card_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer")}
    return spark.sql(CARD_READS.replace("FROM orders JOIN customer ON", "FROM {orders} JOIN {customer} ON"), **t)


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(QUADS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TILES_SPARK, embeddings=spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def ocr_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer", "lineitem")}
    cards = CARD_READS.replace("FROM orders JOIN customer ON", "FROM {orders} JOIN {customer} ON")
    return spark.sql(OCR_CANDIDATES.replace("FROM lineitem", "FROM {lineitem}").replace("CARDS", cards), **t)


def arabic_text(spark: SparkSession) -> DataFrame:
    return spark.sql(ARABIC_TEXT)


#: The same inputs for DuckDB.
ORACLE_CARD_READS, ORACLE_QUADS, ORACLE_TILES, ORACLE_TEXT = CARD_READS, QUADS, TILES_DUCKDB, ARABIC_TEXT
ORACLE_OCR = OCR_CANDIDATES.replace("CARDS", CARD_READS)

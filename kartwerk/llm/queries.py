"""The registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import score

    return score(common.documents(spark, sf_dir), common.crc_mod(F.col("doc_id"), 7) == 2)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(common.documents(spark, sf_dir).select("doc_id", "source"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id as li

    docs = common.documents(spark, sf_dir)
    held = li.held_out(F.col("doc_id"))
    model = li.learn(docs.where(~held))
    return li.identify(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "proportions")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_leaks

    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    hits = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_classes

    return line_classes(common.documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    out = near_duplicates(common.documents(spark, sf_dir), radius=2, shingle=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(common.documents(spark, sf_dir)).select("doc_id", "shard", "shard_row", "version")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    out = remove_repeats(common.documents(spark, sf_dir), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(common.documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, anchor=F.col("vec_id") % 100 == 0, label=label)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import extract, learn

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, learn(pages))


def queries() -> dict:
    return {
        "op1_katz": op1_katz,
        "op2_mixing": op2_mixing,
        "op3_language_id": op3_language_id,
        "op4_decontamination": op4_decontamination,
        "op5_line_dedup": op5_line_dedup,
        "op6_simhash": op6_simhash,
        "op7_sharding": op7_sharding,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_token_counts": op9_token_counts,
        "op10_quality_rules": op10_quality_rules,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_importance": op12_importance,
        "op13_html_extraction": op13_html_extraction,
    }


#: Every window of 50 words as text, so equality is that of the words themselves.
_SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
win AS (SELECT doc_id, p, string_agg(x, ' ') OVER f AS k, count(*) OVER f AS n FROM pos
        WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
least AS (SELECT k, min(doc_id) AS m FROM win WHERE n = 50 GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM win JOIN least USING (k) WHERE n = 50 AND m < doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """The other methods (estimates, expectation-maximisation, schedules, files) have no SQL form."""
    return {"op8_substring_dedup": _SUBSTRINGS, "op11_hard_negatives": _NEGATIVES}

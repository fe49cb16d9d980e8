"""The corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, mixing and sharding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all rows of docs and returns a
DataFrame. run() writes each result as Parquet in the shared folder and reads it back as the next stage's docs.

Null ids, null texts, repeated rows and empty tables are allowed; what becomes of them is said at each stage. Further
columns of the documents pass through the first four stages unchanged, whatever their names; the last one replaces those
named as what it adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartwerk.llm import common
from kartwerk.llm.decontamination import find_leaks
from kartwerk.llm.language_id import identify, learn
from kartwerk.llm.mixing import mix
from kartwerk.llm.near_copies import without_copies
from kartwerk.llm.sharding import shard

#: A document goes if its leading language has less than this share of its words.
LEAST_SHARE = 0.4
#: Near copies have this Jaccard similarity of five-word shingles at least; it is computed exactly for every link.
SIMILARITY, SHINGLE = 0.8, 5
#: Bits within which SimHash links are candidates that are confirmed first; the others are found by shared shingles.
RADIUS = 3
#: Columns that operators read.
READ = ("doc_id", "text", "lang", "source")


def aside(docs: DataFrame) -> DataFrame:
    """docs with all columns but those that operators read under other names, so that none clashes with an added one."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in READ else f"__own_{i}") for i, c in enumerate(docs.columns)])


def back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, under their names, from what became of aside(docs)."""
    return out.select(*[F.col(c if c in READ else f"__own_{i}").alias(c) for i, c in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too) and those that no language leads."""
    said = identify(aside(docs), learn(docs))
    return back(said.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)), docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the smallest doc_id, null ids last. Rows that share an id but not
    their text are rows of their own; of rows alike in all columns one stays."""
    return without_copies(docs, SIMILARITY, SHINGLE, RADIUS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold the question and the answer of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return back(find_leaks(aside(docs), items).where(F.size("hits") == 0), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: files in order of name, rows in order of position."""
    mixed = mix(aside(docs)).repartitionByRange(common.partitions(spark), "position").sortWithinPartitions("position")
    return back(mixed, docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, their row in it and the manifest's version; shards keep the order of the mix."""
    return shard(docs)


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Fingerprints, expectation-maximisation and schedules have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = common.new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        common.free_shuffles(spark)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

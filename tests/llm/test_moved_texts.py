"""Texts that are not needed elsewhere stay where they are read."""

import random

from pyspark.sql import functions as F

from kartwerk.llm import common
from kartwerk.llm.near_copies import without_copies


def written(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_only_near_copies_travel(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: f"{rng.getrandbits(1600):x}"
    texts = [" ".join(word() for _ in range(150)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t + " more") for i, t in enumerate(texts[:5])] + [(None, texts[7]), (3, texts[3])]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "2"}  # as larger tables are joined
    old = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        before = written(spark)
        out = sorted(r.doc_id for r in without_copies(spark.read.parquet(path)).collect())
        moved = written(spark) - before
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert out == list(range(200))
    assert moved < 0.5 * sum(len(t) for t in texts)


def test_sieve(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("a.b"))
    wanted = spark.range(0, 5000, 37).select(F.col("id").alias("w"))
    out, may = common.sieved(rows, F.xxhash64("doc_id"), wanted, F.xxhash64("w"))
    out, may = ({r.doc_id for r in x.collect()} for x in (out, may))
    assert out | may == set(range(5000)) and not out & may
    assert set(range(0, 5000, 37)) <= may and len(may) < 1000
    none = wanted.where("w < 0")
    assert [x.count() for x in common.sieved(rows, F.xxhash64("doc_id"), none, F.xxhash64("w"))] == [5000, 0]

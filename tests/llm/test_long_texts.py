"""What keeps pairs of long texts from being fetched, and what keeps texts from travelling twice."""

import tracemalloc
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from kartwerk.llm import common, near_copies


def hashes(rng, n):
    return np.unique(rng.integers(0, 1 << 64, n, np.uint64))


def test_pairs_of_long_texts_are_told_apart(spark):
    rng = np.random.default_rng(4)
    base, others = hashes(rng, 9000), [hashes(rng, 9000) for _ in range(3)]
    half = np.unique(np.concatenate([base[:4500], hashes(rng, 4500)]))
    close = [np.unique(np.concatenate([base[900:], hashes(rng, 60)])), base[:8150], base[:7300]]  # the last has half as many buckets
    sets = [base, *others, half, *close]
    rows = [(i, len(s), near_copies.bucket_counts(s)) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, n int, counts binary")
    pairs = spark.createDataFrame([(i, j) for i in range(len(sets)) for j in range(i)], "a long, b long")
    found = {tuple(r) for r in near_copies.possible(pairs, nodes, Fraction(4, 5)).collect()}
    true = {(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert {(5, 0), (6, 0), (7, 0)} <= true <= found
    assert not {p for p in found if set(p) & {1, 2, 3, 4}}


def test_counts_never_lose_a_link():
    rng = np.random.default_rng(5)
    for n in (0, 1, 100, 1023, 1024, 1025, 1100, 2048, 2049, 5000, 20_000):
        s = hashes(rng, n)
        for share in (1.0, 0.9, 0.5):
            t = np.unique(np.concatenate([s[: int(len(s) * share)], hashes(rng, n // 7)]))
            most = near_copies.most_shared([near_copies.bucket_counts(s)], [near_copies.bucket_counts(t)])[0]
            assert len(np.intersect1d(s, t)) <= most <= min(len(s), len(t))


def test_texts_lie_by_their_key_when_doubles_go(spark, monkeypatch):
    rows = [(i, f"a b c d e f g {i // 2}") for i in range(40)] + [(None, "a b c d e f g 3"), (4, "a b c d e f g 2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans, stored = {}, common.stored

    def noted(df, name, *args):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name, *args)

    monkeypatch.setattr(common, "stored", noted)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = near_copies.without_copies(docs).select(F.count("*"), F.countDistinct("text")).first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert tuple(out) == (20, 20)
    assert "Exchange hashpartitioning(key" in plans["texts"] and plans["texts"].count("Exchange hashpartitioning(") == 2 + plans["texts"].count("Exchange hashpartitioning(__chunk")


def test_counts_of_a_batch_are_compared_in_bounded_memory():
    counts = near_copies.bucket_counts(hashes(np.random.default_rng(6), 30_000))
    tracemalloc.start()
    most = near_copies.most_shared([counts] * 5000, [counts] * 5000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (most == 30_000).all() and peak < 30e6

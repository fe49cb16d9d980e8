"""Importance resampling against brute force: small blocks, wide codes, nulls, repeats, ties, long and empty texts."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from kartwerk.llm import importance

from .helpers import LOWER, corpus, frame, sentence

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
OTHER = "doc_id long, text string, score string, weight string, block string"


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def wanted(docs, target, buckets=10_000, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    a, b = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, x in docs:
        w, f = features(x)
        weight = sum(math.floor(1000 * math.log((t[bucket(y)] + 1) * a / ((s[bucket(y)] + 1) * b))) for y in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def drawn(spark, df, target, **more):
    aim = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    return sorted((tuple(r) for r in importance.resample(df, aim, **more).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("block, wide", [(16_000_000, False), (900, False), (2_000, True)])
def test_resample(spark, block, wide, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_BYTES", block)
    if wide:  # every pair's number is made dense before the third word
        real = importance._Features.__init__

        def more_words(self, *a):
            real(self, *a)
            self.n = 1 << 40  # as if there were more words

        monkeypatch.setattr(importance._Features, "__init__", more_words)
    rows = corpus(n=120)
    target = [rows[20][1], sentence(random.Random(1), 50), None, ""]
    got = drawn(spark, frame(spark, rows), target, percent=20)
    assert got == wanted([(r[0], r[1]) for r in rows], target, percent=20)
    assert sum(r[4] is not None for r in got) > 10


def test_odd_rows(spark):
    rng = random.Random(2)
    docs = [(None, sentence(rng, 30)), (None, None), (7, None), (7, sentence(rng, 25)), (7, sentence(rng, 40)), (8, "a"), (9, "A  b"), (10, "!?"), (11, "one two " * 400), (12, sentence(rng, 20_000)), (13, "é\x00É x\x7fY 9Z"), (14, "a " * 30), (15, "a " * 30)]
    docs += [(20 + i, sentence(rng, 30)) for i in range(20)] + [(40, docs[0][1])] * 3
    df = spark.createDataFrame([(*d, "x", "y", "z") for d in docs], OTHER).repartition(3)
    aim = [docs[3][1]]
    assert drawn(spark, df, aim, percent=50) == wanted(docs, aim, percent=50)


def test_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert drawn(spark, none, ["a b"]) == []
    docs = [(i, sentence(random.Random(i), 30)) for i in range(30)]
    assert drawn(spark, spark.createDataFrame(docs, "doc_id long, text string"), []) == wanted(docs, [])

"""Hard negatives against brute force, with pruning, cut cells and groups, ties, repeats, nulls and large numbers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kartwerk.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, row string, score string, cell string"


def wanted(rows, every=100, n_pos=5, n_neg=10):
    valid = [(i, [math.floor(256 * x) for x in e], lab) for i, e, lab, *_ in rows if None not in (i, e, lab) and not any(x is None or not math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, (i, a, lab) in enumerate(valid):
        if i % every:
            continue
        scored = sorted((-dot(a, e), j, o == lab) for m, (j, e, o) in enumerate(valid) if m != k)
        for s, j, _ in [x for x in scored if x[2]][:n_pos]:
            neg = [x for x in scored if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s][:n_neg]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(neg)]
    return sorted(out)


def mined(spark, rows, every=100):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, hn.mine(df, anchor=F.col("vec_id") % every == 0, label=F.col("label")).collect()))


def clustered(rng, n, dim=6, clusters=8, spread=0.05):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(centres)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("group, part", [(256, 8192), (3, 20)])
def test_mine(spark, group, part, monkeypatch):
    monkeypatch.setattr(hn, "GROUP", group)
    monkeypatch.setattr(hn, "PART", part)
    rows = clustered(random.Random(3), 600)
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(120)]  # one vector many times: ties, and a hot cell
    got = mined(spark, rows, 20)
    assert got and got == wanted(rows, 20)


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = clustered(rng, 60)
    rows += [(None, rows[0][1], 1), (61, None, 1), (62, rows[1][1], None), (63, [1.0, None], 1), (64, [float("nan")] * 6, 1), (65, [float("-inf")] * 6, 1)]
    rows += [rows[0], rows[0], (66, rows[0][1][:2], 0), (67, [], 1), (100, [0.0] * 6, 0), (200, [-x for x in rows[0][1]], 1), (-300, rows[2][1], 2)]
    assert mined(spark, rows, 100) == wanted(rows, 100)


def test_large_components(spark):
    """Products beyond 2^53 stay exact."""
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-(2**18), 2**18)) for _ in range(6)], i % 2) for i in range(40)]
    got = mined(spark, rows, 10)
    assert got and got == wanted(rows, 10)


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 0)]) == [(0, 1, 1, 2, 65536, 32768)]


def test_rows_are_sent_only_where_they_can_serve(spark, monkeypatch):
    """On clustered vectors of one length most rows stay out of most groups."""
    monkeypatch.setattr(hn, "GROUP", 1)
    sent = []
    meet = hn._meet

    def counted(cells, anchors, plan, parts, local, schema):
        n = cells.join(plan, "cell").where(F.col("reach").between(F.col("least"), F.col("most"))).count()
        sent.append(n / (cells.count() * anchors.select("grp").distinct().count()))
        return meet(cells, anchors, plan, parts, local, schema)

    monkeypatch.setattr(hn, "_meet", counted)
    rows = [(i, [x / math.hypot(*e) for x in e], lab) for i, e, lab in clustered(random.Random(6), 800, spread=0.02)]
    assert mined(spark, rows, 50) == wanted(rows, 50)
    assert sent[1] < 0.3

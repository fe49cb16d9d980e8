"""Quality rules with a robust multivariate verdict, in DataFrame expressions only.

Text statistics are computed per row with array functions. The verdict rejects transformed statistic vectors by their
Mahalanobis distance from minimum-covariance-determinant estimates per (language, source):

* Two starts per group (medians with quartile ranges; classical moments) are refined by concentration steps. A step
  keeps the h = 75 % of rows nearest to the current centre and takes their moments; the start whose final covariance
  has the smaller determinant wins.
* The h-th smallest distance comes from a histogram of distances on a fixed logarithmic grid (48 bins an octave), built
  by map-side partial aggregation, so no group is ever gathered and results don't depend on task order. A bin is kept
  whole, so a step keeps at least h rows.
* The 4x4 Cholesky factor of each group is a column expression. A floor is added to each variance: most statistics are
  constant in clean text, and without it any deviation would be infinitely far.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FEATURES = 4
#: Least standard deviation of each transformed statistic: log word length, then arcsine roots of the shares of symbols,
#: repeated lines and repeated words.
FLOORS = (0.03, 0.045, 0.12, 0.08)
SHARE = 0.75
STEPS = 4
#: Groups of fewer rows are judged with all rows of their language, then with all rows.
MIN_GROUP = 100
#: Squared distance beyond which a row is rejected: sixteen standard deviations' worth in one statistic is 256.
CUTOFF = 60.0
#: Statistics tables of at most so many rows (under 8 MB) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words covered by five-word windows that occur twice or more."""

    def covered(hashes: Column) -> Column:
        def spans(s: Column) -> Column:
            # neighbours in sorted order with the same hash are occurrences of one window
            twice = F.filter(s, lambda x, i: (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            at = F.array_sort(F.transform(twice, lambda x: x["i"]))
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).cast("long").alias("last"))
            return F.aggregate(at, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).cast("long").alias("n"), p.cast("long").alias("last")))["n"]

        paired = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(paired, spans))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))
    return F.when(F.size(words) < 5, F.lit(0).cast("long")).otherwise(let(windows, covered))


def _solid(text: Column) -> Column:
    return F.translate(text, common.SPACES, "")


def statistics(docs: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, the keys, and the counts of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    have = {c.lower() for c in docs.columns}
    names = [F.col(k).cast("string").alias(f"key_{i}") if k.lower() in have else F.lit(None).cast("string").alias(f"key_{i}") for i, k in enumerate(keys)]
    rows = docs.select("doc_id", *names, text.alias("text"))
    by_words = let(common.words_column(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")))
    lines = F.filter(F.split("text", "\n"), lambda x: _solid(x) != "")
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = rows.select(
        "doc_id", *[f"key_{i}" for i in range(len(keys))], by_words.alias("w"), by_lines.alias("l"),
        F.char_length(_solid(F.col("text"))).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return rows.select("doc_id", *[f"key_{i}" for i in range(len(keys))], "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def _chi_cdf(k: int, x: float) -> float:
    """Chi-square distribution function for an even number k of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def consistency_factor(share: float = SHARE, p: int = FEATURES) -> float:
    """What scales the covariance of the nearest `share` of normal rows to that of all."""
    lo, hi = 0.0, 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi_cdf(p, mid) < share else (lo, mid)
    return share / _chi_cdf(p + 2, lo)


def _factored(moments: DataFrame, scale: float) -> DataFrame:
    """grp, start, m0.., l00.., logdet from n, s_i and q_ij, by a Cholesky factorisation in column expressions."""
    p = range(FEATURES)
    df = moments.select("grp", "start", "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in p], *[F.col(f"q{i}{j}") for i in p for j in range(i + 1)])
    df = df.select("grp", "start", *[f"m{i}" for i in p], *[((F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * scale + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in p for j in range(i + 1)])
    for i in p:
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # rounding can leave a sliver below zero, never below the floor's size
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return df.select("grp", "start", *[f"m{i}" for i in p], *[f"l{i}{j}" for i in p for j in range(i + 1)], sum((2 * F.log(f"l{i}{i}") for i in p), F.lit(0.0)).alias("logdet"))


def _joined(rows: DataFrame, stats: DataFrame) -> DataFrame:
    n = stats.count()
    return rows.join(F.broadcast(stats) if n <= BROADCAST_ROWS else stats, "grp")


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(FEATURES):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        df = df.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(FEATURES)), F.lit(0.0)))


def _sums() -> list[Column]:
    p = range(FEATURES)
    return [F.count("*").cast("double").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in p], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in p for j in range(i + 1)]]


def _median_start(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges of each statistic from a histogram, as moments of a diagonal covariance."""
    p = range(FEATURES)
    long = rows.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.floor(F.col(f"x{i}") * 400).alias("bin")) for i in p])).alias("v"))
    bins = long.groupBy("grp", "v.k", "v.bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("grp", "k")
    bins = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), (F.col("bin") + 0.5) / 400))
    each = bins.groupBy("grp", "k").agg(at(0.5).alias("med"), at(0.25).alias("lo"), at(0.75).alias("hi"))
    wide = each.groupBy("grp").agg(*[F.max(F.when(F.col("k") == i, F.col("med"))).alias(f"s{i}") for i in p], *[F.max(F.when(F.col("k") == i, (F.col("hi") - F.col("lo")) / 1.349)).alias(f"r{i}") for i in p])
    q = [(F.col(f"s{i}") * F.col(f"s{j}") + (F.col(f"r{i}") * F.col(f"r{i}") if i == j else 0.0)).alias(f"q{i}{j}") for i in p for j in range(i + 1)]
    return wide.select("grp", F.lit(0).alias("start"), F.lit(1.0).alias("n"), *[f"s{i}" for i in p], *q)


def _concentrate(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """One concentration step: the moments of the nearest share of each group's rows, for each start."""
    near = _distance(_joined(rows, stats)).withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-3) * 48))
    bins = near.groupBy("grp", "start", "bin").agg(*_sums())
    w = Window.partitionBy("grp", "start")
    bins = bins.withColumn("before", F.sum("n").over(w.orderBy("bin")) - F.col("n")).withColumn("total", F.sum("n").over(w))
    kept = bins.where(F.col("before") < F.ceil(SHARE * F.col("total")))
    p = range(FEATURES)
    return kept.groupBy("grp", "start").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in p], *[F.sum(f"q{i}{j}").alias(f"q{i}{j}") for i in p for j in range(i + 1)])


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP, keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2 for every row.

    A null text has no words and fails the base rules. Null or missing keys form a group of their own. Repeated rows
    repeat. Empty tables give empty results. Rows that fail the base rules take no part in the estimates. Other columns
    are ignored.
    """
    rows = statistics(docs, keys)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    arc = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))))
    rows = rows.withColumn("base_failed", failed).select("*", F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)).alias("x0"), arc("n_symbols", "word_chars").alias("x1"), arc("n_dup_lines", "n_lines").alias("x2"), arc("n_repeat_words", "n_words").alias("x3"))
    rows = common.stored(rows, "statistics")
    name = lambda *c: F.to_json(F.array(*[F.col(x) for x in c]))
    good = rows.where(~F.col("base_failed"))
    sizes = good.groupBy("key_0", "key_1").agg(F.count("*").alias("n")).withColumn("of_0", F.sum("n").over(Window.partitionBy("key_0")))
    groups = sizes.select(F.col("key_0").alias("g0"), F.col("key_1").alias("g1"), F.when(F.col("n") >= min_group, name("key_0", "key_1")).when(F.col("of_0") >= min_group, name("key_0")).otherwise("[]").alias("grp"))
    groups = common.stored(groups, "groups")
    same = F.col("key_0").eqNullSafe(F.col("g0")) & F.col("key_1").eqNullSafe(F.col("g1"))
    good = good.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, same)
    # A row counts in its own group and in the wider ones that some other group falls back on.
    x = [f"x{i}" for i in range(FEATURES)]
    wider = F.array_distinct(F.array(F.col("grp"), name("key_0"), F.lit("[]")))
    needed = {r.grp for r in groups.where("grp = '[]'").select("grp").limit(1).collect()}
    short = groups.where("grp = to_json(array(g0))").select("grp").distinct()
    alone = good.select("grp", *x)
    if needed or short.limit(1).count():
        opened = good.select(F.explode(wider).alias("grp"), *x)
        alone = opened.join(groups.select("grp").distinct(), "grp", "left_semi")
    alone = common.stored(alone, "vectors")
    moments = alone.groupBy("grp").agg(*_sums()).withColumn("start", F.lit(1))
    moments = _median_start(alone).unionByName(moments)
    stats = common.stored(_factored(moments, 1.0), "estimates")
    for _ in range(STEPS):
        stats = common.stored(_factored(_concentrate(alone, stats), consistency_factor()), "estimates")
    best = stats.groupBy("grp").agg(F.min_by(F.struct(*[c for c in stats.columns if c != "grp"]), F.struct("logdet", "start")).alias("b")).select("grp", "b.*")
    # The verdict on every row that passes the base rules; each row has one group.
    best = groups.join(best, "grp").drop("grp", "start", "logdet")
    best = common.stored(best, "verdicts")
    verdict = rows.join(F.broadcast(best) if best.count() <= BROADCAST_ROWS else best, same, "left")
    verdict = _distance(verdict)
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff)).alias("kept"), F.when(~F.col("base_failed"), F.col("d2")).alias("distance2"))

"""The stages one after the other on a table whose right outcome is known."""

import random

import corpus_pipeline

from .helpers import SCHEMA, components, sentence


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    item = sentence(rng, 20) + ". " + sentence(rng, 8) + "."
    clean = [(i, sentence(rng, 80), "en", f"s{i % 2}", 1) for i in range(100, 160)]
    near = clean[0][1].split()
    near[40] = "changed"
    bad = [(500, None, "en", "s0", 1), (501, "", "en", "s0", 1), (502, "12 34 !!", "en", "s1", 1), (503, clean[1][1], "en", "s1", 1), (504, " ".join(near), "en", "s1", 1), (505, sentence(rng, 60) + " " + item + " " + sentence(rng, 60), "en", "s1", 1)]
    spark.createDataFrame(clean + bad + clean[5:7], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "mixing", "sharding"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == [c[0] for c in clean]
    assert {r.doc_id: r.text for r in out} == {c[0]: c[1] for c in clean}
    order = [r.source for r in sorted(out, key=lambda r: (r.shard, r.shard_row))]
    assert sum(a != b for a, b in zip(order, order[1:])) <= 6  # blocks of one source follow one another


def test_clashing_columns(spark, tmp_path):
    """Further columns keep their values, also under names that operators add."""
    rng = random.Random(13)
    names = ["score", "hits", "slot", "position", "block", "a.b"]
    rows = [(i, sentence(rng, 60), "en", "s", 1, *[f"{n}{i}" for n in names]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, hits string, slot string, position string, block string, `a.b` string")
    spark.createDataFrame([(1, sentence(rng, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted(map(tuple, docs.collect())) == rows


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_are_exact(spark):
    """Groups equal those of brute force over five-word shingles, for edited, appended and repetitive texts around 0.8."""
    rng = random.Random(14)
    texts = []
    for _ in range(25):
        base = sentence(rng, 120).split()
        texts.append(" ".join(base))
        texts += [" ".join(base) + " " + sentence(rng, n) for n in (25, 27, 29, 31, 33, 60)]  # 29 and fewer words are 0.8
        for n in (3, 5, 6, 8):
            copy = base[:]
            for at in rng.sample(range(120), n):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    again = "one two three four five six " * 40
    texts += [again + sentence(rng, 9), again + sentence(rng, 9), "Short text", "short TEXT", "short", "a b c d e f g h", "a b c d e f g h i"]
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in enumerate(texts) for w in [t.lower().split()]}
    want = components(sets, lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    kept = corpus_pipeline.simhash_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_repeated_and_null_ids(spark):
    """Rows of one id with different texts are rows of their own; of rows alike one stays; null ids come last."""
    rng = random.Random(15)
    a, b, c, d = (sentence(rng, 60) for _ in range(4))
    docs = [(1, a), (5, a), (5, b), (5, b), (None, c), (None, d), (7, d), (2**50, d), (None, None)]
    rows = [(i, t, "en", "s", 1) for i, t in docs]
    want = [(1, a), (5, b), (None, c), (7, d), (None, None)]
    for _ in range(2):
        kept = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
        assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(want, key=str)

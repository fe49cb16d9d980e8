"""Each operator against brute force on small tables, with nulls, blanks, ties, repeats, clashing columns and no rows."""

import collections
import hashlib
import json
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kartwerk.llm import common, decontamination, katz, language_id, line_dedup, mixing, quality_rules, sharding, simhash, substring_dedup, token_counts

from .helpers import LOWER, SCHEMA, components, corpus, frame, sentence, words


@pytest.fixture(scope="module")
def rows():
    return corpus()


# -- 1 ----------------------------------------------------------------------------------------------------------------


def katz_model(texts, train):
    tokens = {i: words((t or "").translate(LOWER)) + ["</s>"] for i, t in texts.items()}
    c = collections.Counter(w for i in train for w in tokens[i])
    pairs = collections.Counter(p for i in train for p in zip(["<s>", *tokens[i][:-1]], tokens[i]))
    n, cc, pc = sum(c.values()), collections.Counter(c.values()), collections.Counter(pairs.values())
    d1, d2 = (katz.discounts([0] + [x[k] for k in range(1, katz.K + 2)]) for x in (cc, pc))
    f = lambda d, k: (d[k] if k <= katz.K else 1) * k
    freed = n - sum(f(d1, k) for k in c.values())
    total, unknown = (n, freed / n) if freed > 1e-9 else (n + 1, 1 / (n + 1))
    uni = lambda w: f(d1, c[w]) / total if c[w] else unknown
    after = collections.defaultdict(dict)
    for (v, w), k in pairs.items():
        after[v][w] = k

    def p(v, w):
        if v not in after:
            return uni(w)
        m = sum(after[v].values())
        left = m - sum(f(d2, k) for k in after[v].values())
        t, left, g = (m, left, lambda k: f(d2, k)) if left > 1e-9 * m else (m + 1, 1, lambda k: k)
        return g(after[v][w]) / t if w in after[v] else left / t * uni(w) / (1 - sum(map(uni, after[v])))

    return tokens, c, n, p


@pytest.mark.parametrize("block", [50, 1_500_000])
def test_katz(spark, rows, block, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    texts = {r[0]: r[1] for r in rows}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens, c, n, p = katz_model(texts, [i for i in texts if not held(i)])
    for v in ("<s>", "one", next(w for w in c if c[w] > 1)):
        assert sum(p(v, w) for w in c) + p(v, "\0") == pytest.approx(1)
    got = {r.doc_id: r for r in katz.score(frame(spark, rows), common.crc_mod(F.col("doc_id"), 7) == 2).collect()}
    assert len(got) == len(rows)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in t))
        assert r.score == pytest.approx(sum(math.log10(p(v, w)) for v, w in zip(["<s>", *t[:-1]], t)))


def test_katz_without_rows(spark):
    assert katz.score(spark.createDataFrame([], SCHEMA), F.lit(False)).count() == 0


# -- 2 ----------------------------------------------------------------------------------------------------------------


def test_schedule_deviates_less_than_a_block():
    weights, blocks = {"a": 500, "b": 333, "c": 167}, {"a": 70, "b": 200, "c": 40}
    plan = mixing.phases(weights, blocks)
    slot = {}
    for s, ps in plan.items():
        for p in ps:
            for j in range(p["used"]):
                t = p["start"] + j // p["k"] * p["period"] + p["slots"][j % p["k"]]
                assert t not in slot
                slot[t] = s
    assert sorted(slot) == list(range(sum(blocks.values())))
    assert collections.Counter(slot.values()) == blocks
    done = collections.Counter()
    for t in range(min(max(t for t in slot if slot[t] == s) for s in blocks)):
        done[slot[t]] += 1
        for s, w in weights.items():
            assert abs(done[s] - (t + 1) * w / 1000) < 1


def test_long_schedule_keeps_to_unrounded_targets():
    """One source with a third of 6 million documents, 19 equal others and a rare one, by the exact targets."""
    sizes = {"big": 2_000_000, **{f"s{i}": 210_526 for i in range(19)}, "rare": 300}
    targets = {s: n**mixing.TEMPERATURE for s, n in sizes.items()} | {"rare": 2.0}
    plan = mixing.phases(mixing.integer_weights(targets), {s: -(-n // 32) for s, n in sizes.items()})
    slots = {s: [p["start"] + j // p["k"] * p["period"] + p["slots"][j % p["k"]] for p in ps for j in range(p["used"])] for s, ps in plan.items()}
    assert sorted(t for x in slots.values() for t in x) == list(range(sum(-(-n // 32) for n in sizes.values())))
    end, total = min(x[-1] for x in slots.values()), sum(targets.values())
    for s, x in slots.items():
        for j, t in enumerate(x):
            if t <= end:  # the share is furthest from what is done just before and just after a block
                assert abs(j - t * targets[s] / total) < 1 + 1e-6 and abs(j + 1 - (t + 1) * targets[s] / total) < 1 + 1e-6


def test_mix_keeps_every_row(spark, rows):
    many = [(i % 90, "t", "en", None if i % 7 == 0 else f"s{i % 7 % 3}", 1) for i in range(300)] + [(None, None, None, "rare", None)]
    df = frame(spark, many).withColumn("slot", F.lit("clash"))
    out = mixing.mix(df, {"s0": 0.5, "s1": 0.25, None: 0.25}, block_docs=4).collect()
    assert collections.Counter((r.doc_id, r.source) for r in out) == collections.Counter((m[0], m[3]) for m in many)
    assert len({r.position for r in out}) == len(many)
    by_slot = collections.defaultdict(set)
    for r in out:
        by_slot[r.slot].add(r.source)
    assert all(len(s) == 1 for s in by_slot.values())
    assert [r.source for r in out if r.slot == max(by_slot)][0] in ("s2", "rare")
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mix_of_many_sources(spark, monkeypatch):
    """Sources beyond the largest share one task; bounded blocks; every row has a place of its own."""
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 10)
    many = [(i, "t", "en", f"s{min(i % 40, 9)}" if i % 40 else None, 1) for i in range(800)]
    out = mixing.mix(frame(spark, many)).collect()
    assert collections.Counter(r.source for r in out) == collections.Counter(m[3] for m in many)
    assert len({r.position for r in out}) == len(many) and max(r.slot for r in out) < 16
    given = mixing.mix(frame(spark, many), {"s1": 1.0, "s9": 3.0}, block_docs=4).collect()
    assert len({r.position for r in given}) == len(many)
    assert {r.source for r in sorted(given, key=lambda r: r.position)[:60]} == {"s1", "s9"}


# -- 3 ----------------------------------------------------------------------------------------------------------------


def test_languages(spark):
    rng = random.Random(2)
    pools = {"aa": ["kolo", "mata", "zemi", "vodu", "rano"], "bb": ["thwick", "shrong", "blight", "crisp", "dwelf"], "cc": ["äyö", "üöli", "ränä", "öljy", "yötä"]}
    say = lambda k, n: " ".join(rng.choice(pools[k]) for _ in range(n))
    train = [(i, say(k, 40), k, "s", 0) for i, k in enumerate(list(pools) * 10)] + [(90, None, "aa", "s", 0), (91, "x", None, "s", 0)]
    model = language_id.learn(frame(spark, train))
    assert model.langs == ["aa", "bb", "cc"]
    asked = [(1, say("aa", 30), None, None, 0), (2, say("bb", 30) + " " + say("cc", 10), "aa", "s", 0), (3, None, "aa", "s", 0), (4, "123 !!", "aa", "s", 0), (5, "", "aa", "s", 0)]
    got = {r.doc_id: r for r in language_id.identify(frame(spark, asked).withColumn("score", F.lit("clash")), model).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["aa", "bb", "und", "und", "und"]
    assert got[2].proportions["bb"] == pytest.approx(0.75, abs=0.05) and set(got[2].proportions) == {"bb", "cc"}
    assert got[3].score == 0 and got[1].score == 1
    empty = language_id.learn(spark.createDataFrame([], SCHEMA))
    assert [r.lang_pred for r in language_id.identify(frame(spark, asked[:1]), empty).collect()] == ["und"]


# -- 4 ----------------------------------------------------------------------------------------------------------------


def test_wand_is_exact():
    """Equal to scoring all postings, of which it scores few where most passages have nothing to do with any item."""
    rng = random.Random(4)
    usual = [f"w{i}" for i in range(200)]
    items = [(i, sentence(rng, rng.randrange(5, 25)) + " " + " ".join(rng.sample(usual, 10))) for i in range(150)]
    index = decontamination.Index(items)
    scored = every = 0
    for n in (0, 1, 20, 60):
        rows = [np.unique([x for x in index.numbers((" ".join(rng.choices(usual, k=60)) + (" " + items[p][1] if p % 9 == 0 else "")).split()) if x >= 0]) for p in range(n)]
        passage = np.concatenate([np.full(len(r), p) for p, r in enumerate(rows)] + [np.zeros(0)]).astype(np.int64)
        number = np.concatenate([*rows, np.zeros(0)]).astype(np.int64)
        full = np.zeros((n, len(items)))
        ends = np.cumsum(index.n_blocks)
        for p, r in enumerate(rows):
            for t in r:
                blocks = range(ends[t] - index.n_blocks[t], ends[t])
                at = [j for b in blocks for j in range(index.block_start[b], index.block_start[b] + index.block_size[b])]
                full[p, index.items[at]] += index.impacts[at]
                every += len(at)
        for theta in (0.05, 0.2, 0.5):
            found, count = index.search(passage, number, theta)
            assert {(p, k) for p, k, _ in found} == set(zip(*map(list, np.nonzero(full >= theta - 1e-9))))
            assert all(abs(full[p, k] - x) < 1e-9 for p, k, x in found)
        scored += count
    assert 0 < scored < every / 4


def test_passages_overlap():
    """An item anywhere in a long text lies whole in a passage that is found."""
    rng = random.Random(41)
    item = sentence(rng, 60)
    index = decontamination.Index([(7, item), (8, sentence(rng, 64))])
    for at in (0, 63, 64, 100, 128, 999, 1000):
        text = sentence(rng, at) + " " + item + " " + sentence(rng, 1000 - at)
        assert [x[0] for x in decontamination.leaks(text, index, 0.9, 1.0, 1.0)] == [7]


def test_leaks(spark):
    rng = random.Random(6)
    items = [(i, sentence(rng, 20) + ". " + sentence(rng, 6) + ".") for i in range(8)] + [(8, None), (9, "..."), (10, "")]
    item = {i: t for i, t in items}
    edited = item[2].split()
    edited[4] = "other"
    texts = [sentence(rng, 300) + " " + item[0].upper() + " " + sentence(rng, 700), " ".join(edited), sentence(rng, 400), item[3].split(".")[0], None, "", item[1] + "\n" + item[5]]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(6, texts[6], "en", "s", 0)])
    its = spark.createDataFrame(items, "item_id long, text string")
    want = {0: [0], 1: [2], 2: [], 3: [], 4: [], 5: [], 6: [1, 5]}
    out = decontamination.find_leaks(docs.withColumn("hits", F.lit(1)), its).collect()
    assert len(out) == 8 and all([h.item_id for h in r.hits] == want[r.doc_id] for r in out)
    assert decontamination.find_leaks(docs, its.limit(0)).where("size(hits) > 0").count() == 0
    assert decontamination.find_leaks(docs.limit(0), its).count() == 0


def test_leaks_in_shards(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_SHARD_ITEMS", 3)
    rng = random.Random(7)
    items = [(i, sentence(rng, 25)) for i in range(10)]
    docs = frame(spark, [(i, f"{sentence(rng, 30)} {t} {sentence(rng, 30)}", "en", "s", 0) for i, t in items])
    out = decontamination.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(out) == 10 and all([h.item_id for h in r.hits] == [r.doc_id] for r in out)
    odd = frame(spark, [(None, items[3][1], "en", "s", 0), (None, None, "en", "s", 0), (4, items[5][1], "en", "s", 0), (4, "no", "en", "s", 0)] * 2)
    out = decontamination.find_leaks(odd, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id or -1, [h.item_id for h in r.hits]) for r in out) == sorted([(-1, [3]), (-1, []), (4, [5]), (4, [])] * 2)


# -- 5 ----------------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutate(rng, x, n):
    x = list(x)
    for _ in range(n):
        i = rng.randrange(len(x) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            x.insert(i, rng.choice("abé "))
        elif i < len(x):
            x[i : i + 1] = [] if kind == 1 else [rng.choice("abé")]
    return "".join(x)


def test_bit_parallel_edits(spark):
    rng = random.Random(8)
    pairs = [(a, mutate(rng, a, rng.randrange(5))) for a in ("".join(rng.choice("abé") for _ in range(rng.randrange(14))) for _ in range(300))]
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2, 3):
        got = df.select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b"), k).alias("w")).collect()
        assert all(r.w == (edits(r.a, r.b) <= k) for r in got)


def test_line_classes(spark):
    """Against brute force, with null, repeated and very large ids, rows alike and clashing columns."""
    rng = random.Random(9)
    base = [sentence(rng, 4) for _ in range(6)]
    say = lambda: "\n".join(mutate(rng, rng.choice(base), rng.randrange(4)) for _ in range(4)) + "\n \nshort"
    docs = [(i + 1, say(), "en", "s", 0) for i in range(14)] + [(3, say(), "en", "s", 0), (2**50, say(), "en", "s", 0), (2**50, say(), "en", "s", 0), (-5, say(), "en", "s", 0), (2**63 - 1, say(), "en", "s", 0)]
    docs += [(None, say(), "en", "s", 0), (None, "x", "en", "s", 0), (50, None, "en", "s", 0), (51, "", "en", "s", 0), docs[4], docs[4]]
    got = line_dedup.line_classes(frame(spark, docs).withColumn("line", F.lit(1))).collect()
    row = {r.text: r.row for r in line_dedup.named_rows(frame(spark, docs)).collect()}
    where = collections.defaultdict(list)
    for i, t, *_ in docs:
        for k, line in enumerate((t or "").split("\n")):
            if words(line):
                where[line].append((i is None, i or 0, row[t or ""], k))
    ids = {min(v): line for line, v in where.items()}
    link = lambda a, b: edits(ids[a], ids[b]) <= 2
    label = components(ids, link)
    want = collections.Counter()
    for v in where.values():
        first = label[min(v)]
        for at in v:
            want[None if at[0] else at[1], at[3], None if first[0] else first[1], first[2], first[3], sum(link(min(v), o) for o in ids if o != min(v))] += 1
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    assert sum(r.kept for r in got) == len(set(label.values()))
    assert all(r.doc_id == r.class_doc_id and r.line_no == r.class_line_no for r in got if r.kept)
    assert line_dedup.line_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_of_one_id_stay_apart(spark):
    a, b, c = "the river stone is bright", "a silver forest was quiet", "paper letters travel far"
    docs = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (2, a + "x", "en", "s", 0), (3, b + "y", "en", "s", 0), (4, c, "en", "s", 0), (4, c, "en", "s", 0)]
    got = line_dedup.line_classes(frame(spark, docs)).collect()
    assert len(got) == 6 and len({(r.class_doc_id, r.class_row) for r in got}) == 3
    assert sorted((r.doc_id, r.kept) for r in got) == [(1, True), (1, True), (2, False), (3, False), (4, False), (4, True)]


def test_links_of_short_lines(spark):
    """Lines of every length are within two edits of one another or not, those of one and two characters too."""
    rng = random.Random(10)
    lines = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(150)} | {"The thertion.", "The, thertion.", "nineteen characters", "nineteen characters."})
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string").withColumn("first", F.col("id").cast("decimal(38,0)"))
    want = {(j, i) for i, a in enumerate(lines) for j, b in enumerate(lines) if j > i and edits(a, b) <= 2}
    got = line_dedup.line_links(df).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


# -- 6 ----------------------------------------------------------------------------------------------------------------


def fingerprint(text, k=3):
    w = (text or "").translate(LOWER)
    w = words(w)
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("radius, tile", [(2, 2048), (14, 4)])
def test_simhash(spark, rows, radius, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    out = simhash.near_duplicates(frame(spark, rows).withColumn("fp", F.lit("clash")), radius).collect()
    fp = {r[0]: fingerprint(r[1]) for r in rows}
    assert {r.doc_id: r.fp % 2**64 for r in out} == fp
    assert {r.doc_id: r.component_id for r in out} == components(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= radius)


def test_simhash_odd_tables(spark, rows):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = frame(spark, rows[:4] + rows[:4] + [(None, "One", "en", "s", 3)])
    assert [r.component_id for r in simhash.near_duplicates(twice).where("doc_id is null").collect()] == [None]
    assert simhash.near_duplicates(twice).count() == 9


# -- 7 ----------------------------------------------------------------------------------------------------------------


def test_shards(spark, rows, tmp_path):
    docs = frame(spark, rows * 3).repartition(9).withColumn("shard", F.lit("clash"))
    out = sharding.shard(docs, target=1 << 20, path=str(tmp_path / "s"))
    key = lambda r: (r.doc_id, r.text)
    assert collections.Counter(map(key, out.collect())) == collections.Counter((r[0], r[1]) for r in rows * 3)
    assert out.select("shard").distinct().count() == 1
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0


def test_manifest(spark, rows, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "m"))
    assert store.version() == 0 and store.manifest()["shards"] == []
    store.append(frame(spark, rows))
    old = store.manifest()
    store.append(frame(spark, rows))
    assert store.read(1).count() == len(rows) and store.read().count() == 2 * len(rows)
    with pytest.raises(sharding.Conflict):
        store.commit(old)  # someone else made version 2
    store.compact()
    assert len(store.manifest()["shards"]) == 1 and store.read().count() == 2 * len(rows)
    assert store.vacuum() == 0 and store.read(1).count() == len(rows)
    assert store.vacuum(0) > 0 and store.read().count() == 2 * len(rows)


def test_large_arrivals_are_cut(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "c"))
    rng = random.Random(15)
    store.append(spark.createDataFrame([(i, "%030x" % rng.getrandbits(120)) for i in range(4000)], "i long, x string").coalesce(1))
    size = store.manifest()["shards"][0]["bytes"]
    store.compact(target=size // 5, order=("i",))
    m = store.manifest()["shards"]
    assert 4 <= len(m) <= 6 and sum(s["rows"] for s in m) == 4000 and max(s["rows"] for s in m) < 1200
    assert [r.i for s in m for r in spark.read.parquet(s["file"]).collect()] == list(range(4000))


def test_runs():
    store = sharding.ShardStore(None, "")
    sizes = [{"bytes": b} for b in (10, 11, 12, 90, 10, 10, 400, 5, 5, 30, 20)]
    assert store.runs(sizes, target=100) == [[0, 1, 2], [4, 5], [7, 8], [9, 10]]


# -- 8 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("window, large", [(50, 4000), (6, 2)])
def test_substrings(spark, rows, window, large, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LARGE_BUCKET", large)
    first: dict = {}
    own = {r[0]: words(r[1]) for r in rows}
    for i, w in own.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    want = {}
    for i, w in own.items():
        gone = {x for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for x in range(k, k + window)}
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    out = substring_dedup.remove_repeats(frame(spark, rows).withColumn("first", F.lit(1)), window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept).decode()) for r in out} == want
    assert sum(v[1] for v in want.values()) > 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256)).first()[0]


def test_substrings_by_sql(spark, rows, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from kartwerk.llm import queries

    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op8_substring_dedup"]).fetchall()
    out = queries.op8_substring_dedup(spark, str(tmp_path)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, out)) == sorted(want)


def test_substrings_without_rows(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


# -- 9 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 500, 24_000_000])
def test_token_counts(spark, rows, block, monkeypatch):
    """Equal to the library on whole texts: blocks of any size, null and repeated ids, rows alike and a long text."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "BLOCK_CHARS", block)
    path = public_tokenizers.path("word_bpe_49k.json")
    odd = ["a<|endoftext|>b<|startoftext|>", "J̌ É İ IT'S don't ''s 3½ ² 漢字 \x1c a b​c ΣΑΣ ǅ ß ſ", "x\x85y\x0bz", "🙂🙂 x́", "".join(map(chr, range(1, 0x250)))]
    given = rows + [(1000 + i, t, "en", "s", 0) for i, t in enumerate(odd)] + [(1, "one two", "en", "s", 0), (1, "three", "en", "s", 0), (1, "three", "en", "s", 0), (None, "a b c d", "en", "s", 0), (None, None, "en", "s", 0), (7, "long words " * 30_000, "en", "s", 0)]
    tok = Tokenizer.from_file(path)
    want = collections.Counter((r[0], len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in given)
    out = token_counts.count_tokens(frame(spark, given).withColumn("piece", F.lit(1)), path, limit=100).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in out) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in out)
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA), path).count() == 0


# -- 10 ---------------------------------------------------------------------------------------------------------------


def statistics(text):
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {x for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for x in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, rows):
    rng = random.Random(11)
    clean = [(1000 + i, sentence(rng, rng.randrange(40, 200)), "en", "s" if i % 3 else None, 0) for i in range(400)]
    junk = [(2000 + i, " ".join("x|#&" for _ in range(80)), "en", "s", 0) for i in range(5)] + [(2010, "a b c d e " * 30, "en", "s", 0)]
    out = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, rows + clean + junk).withColumn("n_words", F.lit(1))).collect()}
    for i, t, *_ in rows + clean + junk:
        r = out[i]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == statistics(t)
        assert r.base_failed == (got[0] < 10 or 100 * got[4] > 20 * got[0])
        assert not (r.base_failed and r.kept)
    assert all(out[i].kept for i, *_ in clean) and not any(out[i].kept for i, *_ in junk)
    assert quality_rules.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
    few = quality_rules.quality_rules(spark.createDataFrame(clean[:3], SCHEMA).select("doc_id", "text")).collect()
    assert all(r.kept for r in few)


def test_consistency_factor():
    assert quality_rules.consistency_factor(0.75, 4) == pytest.approx(0.75 / quality_rules._chi_cdf(6, 5.3853), rel=1e-3)


def test_queries_are_registered():
    from kartwerk.llm import queries

    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert json.dumps(queries.oracle_sql()) is not None

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "river stone bright garden window silver forest quiet morning paper yellow travel letter winter music silent harbor copper meadow candle".split()


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n, pool=WORDS):
    return " ".join(rng.choice(pool) + str(rng.randrange(400)) for _ in range(n))


def corpus(seed=5, n=40):
    """Texts with nulls, empty ones, exact and near copies, repeated passages and odd white space."""
    rng = random.Random(seed)
    shared = sentence(rng, 60)
    texts = [None, "", " \t\n", "One", "one two", "É É x  y\tz\n", "A b C d e f g"]
    for i in range(n):
        t = sentence(rng, rng.randrange(5, 150))
        if i % 3 == 0:
            t = t + "\n" + shared + " " + sentence(rng, 4)
        if i % 5 == 0:
            t = t.replace(" ", "  ", 3).upper()
        texts.append(t)
    texts += [texts[10], texts[10], texts[11] + " tail"]
    return [(i * 3 + 1, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(nodes)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}

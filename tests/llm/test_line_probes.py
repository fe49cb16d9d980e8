"""The probes of lines: what they hold, and that they are made by compiled code."""

from pyspark.sql import functions as F

from kartwerk.llm import line_dedup

LINES = ["abc", "abcd", "ab|é", "ééééé", "12345678", "a\U0001f600b\U0001f600c", "the quick brown fox jumps over the lazy dog", "x" * 301, " é" * 77]


def expected(line, k):
    """(segment, length, text, role) of each probe."""
    n, out = len(line), set()
    for delta in range(k + 1):
        length = n - delta
        base, extra = divmod(length, k + 1)
        for i in range(k + 1):
            at, size = i * base + max(0, i - (k + 1 - extra)), base + (i >= k + 1 - extra)
            for shift in range(max(-i, delta - (k - i)), min(i, delta + (k - i)) + 1):
                if length > k and at + shift >= 0 and at + shift + size <= n:
                    out.add((i, length, line[at + shift : at + shift + size], int(delta == shift == 0)))
    return out


def test_probes(spark):
    for k in (1, 2, 3):
        rows = spark.createDataFrame(list(enumerate(x for x in LINES if len(x) > k)), "id long, line string").withColumn("n", F.char_length("line"))
        wanted = [(i, *p) for i, x in enumerate(x for x in LINES if len(x) > k) for p in expected(x, k)]
        keys = spark.createDataFrame(wanted, "id long, i int, length int, part string, role int").select("id", F.xxhash64("i", "length", "part").alias("key"), "role")
        found = line_dedup._probes(rows, k)
        assert set(map(tuple, found.collect())) == set(map(tuple, keys.collect()))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan and "filter(" not in plan


def test_lines_with_a_word(spark):
    text = "\t \x0b\n a\n\x0c\r\n\xa0\n\n b \n\x00"
    found = line_dedup.lines_of(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    assert {(r.line_no, r.line) for r in found.collect()} == {(1, " a"), (3, "\xa0"), (5, " b "), (6, "\x00")}
    assert "translate" not in found._jdf.queryExecution().executedPlan().toString()

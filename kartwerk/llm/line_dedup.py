"""Line dedup by a segment-partition edit join, in DataFrame expressions only.

Lines within k edits share at least one of k+1 even segments of the shorter line, at a place that k edits can reach.

1. Distinct lines, with their first occurrence as id.
2. Each line puts its k+1 segments into an index keyed by (segment number, line length, text) and probes the indexes of
   the lengths from its own minus k to its own, at the places that are left when edits before and after the segment are
   counted (multi-match-aware selection: 12 probes a line for k = 2, of which 3 are its own index entries and travel
   once). Keys that name one line only are dropped in the same shuffle.
3. The lines behind the remaining keys are joined on them. The join's condition compares lengths, then letter counts
   (k edits change them by at most 2k in sum), then the banded edit distance, so only true links leave the join.
   Lines of up to k characters have no k+1 segments: they are compared directly with all lines of up to 2k.
4. Components of the links are the classes of lines.

The edit distance is a bit-parallel automaton over the band of 2k+1 diagonals: one word of bits for each number of
errors, one step a character, whatever the line's length.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .simhash import components

EDITS = 2
#: A line's place in the table is one number: doc_id above the least one, then so many digits of its row's hash, which order
#: the rows of an id, and of its number in the text. A null id counts as NO_ID, beyond all others. What tells rows of one id
#: apart is the whole hash, which travels beside the place.
ROW_DIGITS, LINE_DIGITS, LEAST_ID, NO_ID = 8, 10, 1 << 63, 1 << 64
#: Characters whose counts are compared before the edit distance.
COUNTED = "etanorislhducmpgbwv ,.éö|"


def _or(*x: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), x)


def within_edits(a: Column, b: Column, k: int = EDITS) -> Column:
    """Whether two strings differ by at most k edits. The bit for diagonal d says that the first j+d characters of a can
    be turned into the first j of b; there is one word of bits for each number of errors."""
    band = (1 << (2 * k + 1)) - 1
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")

    def run(both: Column) -> Column:
        x, y = both["x"], both["y"]
        # before the first character: e characters of a deleted with e errors
        start = F.struct(*[F.lit(((1 << (e + 1)) - 1) << k & band).alias(f"r{e}") for e in range(k + 1)], F.lit(0).alias("j"))

        def step(state: Column, c: Column) -> Column:
            j = state["j"]
            same = _or(*[F.when(F.get(x, j + (d - k)) == c, F.lit(1 << d)).otherwise(F.lit(0)) for d in range(2 * k + 1)])
            new: list[Column] = []
            for e in range(k + 1):
                r = state[f"r{e}"].bitwiseAND(same)
                if e:
                    last = state[f"r{e - 1}"]
                    r = _or(r, last, F.shiftright(last, 1), F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(band))
                new.append(r)
            return F.struct(*[r.alias(f"r{e}") for e, r in enumerate(new)], (j + 1).alias("j"))

        end = F.size(x) - F.size(y) + k
        return F.aggregate(y, start, step, lambda s: F.call_function("shiftright", s[f"r{k}"], end).bitwiseAND(F.lit(1)) == 1)

    close = F.abs(F.char_length(a) - F.char_length(b)) <= k
    return close & F.element_at(F.transform(F.array(F.struct(chars(a).alias("x"), chars(b).alias("y"))), run), 1)


def named_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row (64 hashed bits of the text, which tell rows of one id apart) and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, row, line_no (from 0) and line for each line with a word."""
    rows = named_rows(docs).select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.where(F.ltrim("line", F.lit(common.SPACES)) != "")  # it looks at no more than the first word's start


def _place() -> Column:
    """The place of a line as one decimal, in order of doc_id, row and line_no."""
    whole = F.coalesce(F.col("doc_id").cast("decimal(19,0)") + F.lit(Decimal(LEAST_ID)), F.lit(Decimal(NO_ID))).cast("decimal(20,0)")
    rest = (F.pmod(F.col("row"), F.lit(10**ROW_DIGITS)) * 10**LINE_DIGITS + F.col("line_no")).cast("decimal(18,0)")
    return (whole * F.lit(Decimal(10 ** (ROW_DIGITS + LINE_DIGITS))) + rest).cast("decimal(38,0)")


def _parts(place: Column) -> Column:
    """The doc_id and line_no of a place, by its digits."""
    digits = F.lpad(place.cast("string"), 38, "0")
    whole, line = F.substring(digits, 1, 20), F.substring(digits, 21 + ROW_DIGITS, LINE_DIGITS)
    doc_id = F.when(whole != str(NO_ID), (whole.cast("decimal(20,0)") - F.lit(Decimal(LEAST_ID))).cast("long"))
    return F.struct(doc_id.alias("class_doc_id"), line.cast("int").alias("class_line_no"))


def _probes(rows: DataFrame, k: int) -> DataFrame:
    """id, key and role for the probes of each line of rows (id, line, n): those that are its index entries too (role 1) and
    the others (role 0). The rule of a probe is data: as one expression a probe, the method would be too large to compile."""
    parts = k + 1
    kinds = [(delta, i, shift) for delta in range(k + 1) for i in range(parts) for shift in range(max(-i, delta - (k - i)), min(i, delta + (k - i)) + 1)]
    kind = F.array(*[F.struct(F.lit(d).alias("delta"), F.lit(i).alias("i"), F.lit(s).alias("shift")) for d, i, s in kinds])
    third = F.floor(F.col("n") / parts).cast("int")
    # Substrings count characters from the start, so each segment's surroundings are cut out once.
    around = [F.substring("line", F.greatest(F.lit(1), third * i - 2 * k), third + 5 * k + 2) for i in range(parts)]
    rows = rows.select("id", "n", *[a.alias(f"around_{i}") for i, a in enumerate(around)], F.explode(kind).alias("e")).select("*", "e.delta", "e.i", "e.shift")
    length = F.col("n") - F.col("delta")
    base, short = (length / parts).cast("int"), F.lit(parts) - length % parts  # the last segments have one more
    size = base + F.when(F.col("i") >= short, 1).otherwise(0)
    at = F.col("i") * base + F.greatest(F.lit(0), F.col("i") - short) + F.col("shift")
    rows = rows.select("id", "n", "delta", "i", "shift", length.alias("length"), at.alias("at"), size.alias("size"), third.alias("third"), *[f"around_{i}" for i in range(parts)])
    inside = (F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n")) & (F.col("length") >= parts)
    role = F.when((F.col("delta") == 0) & (F.col("shift") == 0), 1).otherwise(0)
    text = reduce(lambda rest, i: F.when(F.col("i") == i, F.col(f"around_{i}")).otherwise(rest), range(parts - 1), F.col(f"around_{parts - 1}"))
    first = F.greatest(F.lit(1), F.col("third") * F.col("i") - 2 * k)
    key = F.xxhash64("i", "length", F.substring(text, F.col("at") + 2 - first, F.col("size")))
    return rows.where(inside | (role == 1)).select("id", key.alias("key"), role.alias("role"))


def line_links(lines: DataFrame, k: int = EDITS) -> DataFrame:
    """Pairs (a, b) of ids of different lines within k edits, a > b, with their places first_a and first_b; lines has id
    (long), line and first, each line once."""
    every = lines.select("id", "first", "line", F.char_length("line").alias("n"))
    rows = every.where(F.col("n") > k)
    keyed = _probes(rows, k)
    w = Window.partitionBy("key")
    keyed = keyed.withColumn("lo", F.min("id").over(w)).withColumn("hi", F.max("id").over(w)).where("lo < hi")
    keyed = common.stored(keyed.groupBy("key", "id").agg(F.max("role").alias("role")), "keys")
    counts = [(F.char_length("line") - F.char_length(F.replace(F.col("line"), F.lit(c), F.lit("")))).alias(f"c{i}") for i, c in enumerate(COUNTED)]
    wanted = keyed.select("id").distinct().hint("merge")  # it grows with the lines: never broadcast
    known = common.stored(rows.join(wanted, "id", "left_semi").select("id", "first", "line", "n", *counts), "candidates")
    full = keyed.join(known, "id")
    index = full.where("role = 1").drop("role")
    probe = full.drop("role")
    index = index.select("key", *[F.col(c).alias(f"{c}_b") for c in index.columns if c != "key"])
    differ = sum((F.abs(F.col(f"c{i}") - F.col(f"c{i}_b")) for i in range(len(COUNTED))), F.lit(0)) <= 2 * k
    later = (F.col("n") > F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("id") > F.col("id_b")))
    pairs = probe.join(index, "key").where((F.col("n") - F.col("n_b") <= k) & later & differ & within_edits(F.col("line"), F.col("line_b"), k))
    tiny = every.where(F.col("n") <= k).toDF("id_b", "first_b", "line_b", "n_b")  # as few as there are strings of k characters
    short = every.where(F.col("n") <= 2 * k).join(F.broadcast(tiny), later & within_edits(F.col("line"), F.col("line_b"), k))
    columns = ["id", "first", "id_b", "first_b"]
    both = pairs.select(*columns).unionByName(short.select(*columns))
    up = F.col("id") > F.col("id_b")
    pick = lambda yes, no, name: F.when(up, F.col(yes)).otherwise(F.col(no)).alias(name)
    return both.select(pick("id", "id_b", "a"), pick("id_b", "id", "b"), pick("first", "first_b", "first_a"), pick("first_b", "first", "first_b")).distinct()


def line_classes(docs: DataFrame, k: int = EDITS) -> DataFrame:
    """doc_id, line_no, class_doc_id, class_row, class_line_no, n_links, kept for each line with a word.

    A class is all lines that links of at most k edits connect, named by the place of its first line: its doc_id (null
    ids last), row (64 hashed bits of its text) and line_no. n_links: different lines linked to this one. kept: this is the first
    line of its class. Null and empty texts have no lines. Rows that repeat a doc_id, or have none, with another text are
    rows of their own, in order of a hash; of rows alike in both only one keeps a line. A text may have any number of lines. Other
    columns are ignored; an empty table gives an empty result.
    """
    every = lines_of(docs)
    k0, k1 = F.xxhash64("line"), F.shiftleft(F.hash("line").cast("long"), 32).bitwiseXOR(F.crc32(F.col("line").cast("binary")))
    every = every.select("doc_id", "row", "line_no", k0.alias("k0"), k1.alias("k1"), "line")
    # 128 bits name a line, so that its text travels once here and never again with its occurrences
    lines = every.withColumn("at", _place()).groupBy("k0", "k1", "line").agg(F.min("at").alias("first"), F.min_by("row", "at").alias("first_row"))
    lines = common.stored(lines.withColumn("id", F.monotonically_increasing_id()), "lines")
    links = common.stored(line_links(lines, k), "line_links")
    ends = links.select(F.col("a").alias("node"), F.col("first_a").alias("first")).unionByName(links.select(F.col("b").alias("node"), F.col("first_b").alias("first")))
    ends = ends.groupBy("node").agg(F.count("*").alias("n_links"), F.min("first").alias("first")).join(components(links).hint("merge"), "node", "left")
    ends = ends.join(lines.select(F.col("id").alias("node"), "first_row").hint("merge"), "node")
    ends = common.stored(ends.withColumn("label", F.coalesce("label", "node")), "linked")
    heads = ends.groupBy("label").agg(F.min("first").alias("class_at"), F.min_by("first_row", "first").alias("head_row"))
    classes = ends.join(heads, "label").select(F.col("node").alias("id"), "n_links", "class_at", "head_row")
    named = lines.select("k0", "k1", "id", "first", "first_row").join(classes.hint("merge"), "id", "left")
    named = named.select("k0", "k1", _parts(F.coalesce("class_at", "first")).alias("p"), F.coalesce("head_row", "first_row").alias("class_row"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")).select("k0", "k1", "p.*", "class_row", "n_links")
    out = every.select("doc_id", "row", "line_no", "k0", "k1").join(named, ["k0", "k1"]).drop("k0", "k1")
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_doc_id")) & (F.col("row") == F.col("class_row")) & (F.col("line_no") == F.col("class_line_no")))
    # Rows alike in id and text: only one of them keeps lines.
    again = named_rows(docs).groupBy("doc_id", "row").count().where("count > 1").select(F.col("doc_id").alias("id"), F.col("row").alias("r"))
    if again.limit(1).count():
        again = common.stored(again, "repeated")
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("r"))
        number = F.row_number().over(Window.partitionBy("doc_id", "row", "line_no").orderBy("class_line_no"))
        twice = out.join(again, same, "left_semi").withColumn("kept", F.col("kept") & (number == 1))
        out = out.join(again, same, "left_anti").unionByName(twice)
    return out.select("doc_id", "line_no", "class_doc_id", "class_row", "class_line_no", "n_links", "kept")

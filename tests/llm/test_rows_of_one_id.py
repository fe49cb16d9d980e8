"""Rows that share an id, or have none, with different texts: each is treated by its own text."""

import random

from kartwerk.llm import line_dedup, substring_dedup

from .helpers import sentence, words


def test_windows_of_repeated_ids(spark):
    """Each row loses the windows that also start in a smaller id, and only at its own places."""
    rng = random.Random(8)
    x, y, z = sentence(rng, 80), sentence(rng, 80), sentence(rng, 20)
    rows = [(1, x), (5, x), (5, y), (5, y), (7, z + " " + y), (7, x + " " + z), (None, x), (None, y), (5, None), (2, "")]
    known = [(i, words(t)) for i, t in rows]

    def lost(i, ws, n=50):
        gone = set()
        for a in range(len(ws) - n + 1):
            w = ws[a : a + n]
            if i is not None and any(j is not None and j < i and any(v[b : b + n] == w for b in range(len(v) - n + 1)) for j, v in known):
                gone |= set(range(a, a + n))
        return len(gone)

    want = sorted((str(i), len(ws), lost(i, ws), " ".join(w for w in ws if lost(i, ws) < len(ws)) if lost(i, ws) in (0, len(ws)) else None) for i, ws in known)
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, bytes(r.kept).decode() if r.n_removed in (0, r.n_words) else None) for r in out)
    assert got == want
    assert ("5", 80, 0, y) in got and ("5", 80, 80, "") in got


def test_lines_of_repeated_ids(spark):
    """Different texts of one id, or of none, keep their lines; of rows alike one does."""
    rng = random.Random(9)
    texts = [sentence(rng, 9) for _ in range(6)]
    rows = [(3, texts[0]), (3, texts[1]), (3, texts[1]), (None, texts[2]), (None, texts[3]), (4, texts[0]), (-5, texts[4] + "\n" + texts[5])]
    out = line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(out) == 8
    assert sum(r.kept for r in out) == 6
    assert {r.doc_id for r in out if not r.kept} == {3, 4}


def test_rows_whose_places_collide(spark, monkeypatch):
    """Different lines at one place (same id, same number, equal digits of the row's hash) stay different classes."""
    monkeypatch.setattr(line_dedup, "ROW_DIGITS", 0)
    monkeypatch.setattr(line_dedup, "LINE_DIGITS", 18)
    rng = random.Random(10)
    rows = [(None, sentence(rng, 9)) for _ in range(30)] + [(7, sentence(rng, 9)) for _ in range(30)]
    rows += [(8, rows[0][1] + "x"), (9, rows[31][1])]
    out = line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sum(r.kept for r in out) == 60
    assert len({(r.class_doc_id, r.class_row, r.class_line_no) for r in out}) == 60
    assert {r.doc_id for r in out if not r.kept} == {None, 9}

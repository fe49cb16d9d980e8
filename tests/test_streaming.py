"""Roll-ups on a stream equal those of a table, with late, very late and repeated rows."""

import datetime

from kartwerk.streaming import cards

START = datetime.datetime(2026, 1, 1)
SCHEMA = "card_id long, field_name string, idx long, text string, ocr_confidence double, loc_status string, at timestamp"


def rows_of(minutes):
    return START + datetime.timedelta(minutes=minutes)


def test_rollups(spark, tmp_path):
    first = [(1, "nid", 1, "12", 0.5, "localized", 1), (1, "dob", 1, "x", 0.9, "no", 2), (2, "nid", 1, "7", 0.4, "no", 12)]
    late = [(1, "nid", 2, "13", 0.8, "localized", 3), (2, "nid", 1, "7", 0.4, "no", 12), (2, "nid", 2, "8", 0.4, "no", 13), (3, "dob", 1, "y", 0.1, "localized", 19)]
    beyond = [(9, "nid", 1, "end", 0.1, "no", 90)]
    lost = [(1, "nid", 3, "99", 1.0, "no", 4), (9, "nid", 2, "end", 0.2, "no", 95)]
    parts = [[(*r[:6], rows_of(r[6])) for r in p] for p in (first, late, beyond, lost)]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    table = spark.createDataFrame([r for p in parts[:2] for r in p], SCHEMA)
    for name, roll in (("texts", cards.best_texts), ("success", cards.card_rollup)):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "part*"))
        q = roll(stream, "at").writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        assert q.exception() is None
        want = sorted(map(str, roll(table if name == "texts" else table.where("idx = 1"), "at").collect()))
        got = sorted(str(r) for r in spark.table(name).collect() if r.card_id != 9)
        assert got == want, name
        state = [s["numRowsTotal"] for s in q.lastProgress["stateOperators"]]
        assert max(state) <= 4  # only what belongs to open windows is left

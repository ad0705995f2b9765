"""Files read back as written; a watched feed ends with the last change of each key."""

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from folioscope.operators.relational import latest
from folioscope.sources import files
from folioscope.streaming import changes


def test_records_sheet_and_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"key": "a", "n": 1}')
    (tmp_path / "in" / "b.json").write_text('{"key": "b",\n "n": 2}')
    (tmp_path / "in" / "c.json").write_text("{broken")
    schema = StructType([StructField("key", StringType()), StructField("n", LongType())])
    rows = files.read_records(spark, str(tmp_path / "in"), schema)
    assert sorted(map(tuple, rows.collect())) == [("a", 1), ("b", 2)]
    assert [tuple(r) for r in files.read_records(spark, str(tmp_path / "in"), schema, ["b"]).collect()] == [("b", 2)]
    sheet = spark.createDataFrame([("x", ["p", "q"], 'say "hi"\nagain'), ("", [], "")], "k string, tags array<string>, note string")
    files.write_sheet(sheet, str(tmp_path / "sheet"))
    assert [tuple(r) for r in files.read_sheet(spark, str(tmp_path / "sheet")).collect()] == [("x", "p; q", 'say "hi" again')]
    files.save_index(rows, str(tmp_path / "index"), 3)
    assert files.load_index(spark, str(tmp_path / "index"), 3).count() == 2
    assert files.load_index(spark, str(tmp_path / "index"), 4) is None


def test_watch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    feed, target, checkpoint = (str(tmp_path / n) for n in ("feed", "target", "checkpoint"))
    for part in range(3):
        events.where(f"event_id % 3 = {part}").coalesce(1).write.mode("append").parquet(feed)
        changes.watch(changes.read_feed(spark, feed, events.schema), target, checkpoint, "user_id", ["ts", "event_id"])
    got = changes.current(spark, target)
    assert got.count() == events.select("user_id").distinct().count()
    arrived = events.withColumn("part", F.col("event_id") % 3)
    expected = latest(arrived, "user_id", ["part", "ts", "event_id"]).drop("part")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))

"""A value is taken once, and not after its time."""

from datetime import datetime, timedelta

from tests.test_session_tail import rocks  # noqa: F401

ROW = "session_id string, at timestamp, op string, value string"


def test_taken_once_and_in_time(spark, rocks, tmp_path):  # noqa: F811
    from threadloom.streaming.handoff import taken

    start = datetime(2024, 1, 1)

    def run(batch, *rows):
        spark.createDataFrame([(s, start + timedelta(minutes=m), op, v) for m, s, op, v in rows], ROW).coalesce(1).write.parquet(str(tmp_path / f"in/{batch}"))
        stream = spark.readStream.schema(ROW).parquet(str(tmp_path / "in/*"))
        taken(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return [(r.session_id, r.value) for r in spark.read.parquet(str(tmp_path / "out")).filter(f"at >= timestamp '{start + timedelta(minutes=rows[0][0])}'").orderBy("at").collect()]

    assert run(1, (0, "a", "put", "one"), (1, "b", "put", "x"), (2, "a", "take", None), (3, "a", "take", None)) == [("a", "one"), ("a", None)]
    assert run(2, (10, "a", "put", "old"), (11, "a", "put", "new"), (12, "c", "take", None)) == [("c", None)]
    assert run(3, (20, "a", "take", None), (21, "d", "put", "late"), (22, "e", "put", "just")) == [("a", "new")]
    last = run(4, (82, "d", "take", None), (82, "e", "take", None), (83, None, "take", None), (84, "e", "take", None))
    assert sorted(last, key=str) == [("d", None), ("e", "just"), ("e", None)]

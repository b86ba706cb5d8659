from datetime import datetime, timedelta

from gridloom.streaming.change_stream import drained, latest_per_key, stream_of, without_repeats

DDL = "k string, at timestamp, v int"
T0 = datetime(2024, 1, 1)


def test_latest_over_late_and_repeated_deliveries(spark, tmp_path):
    rows = [("a", T0, 1), ("a", T0 + timedelta(days=2), 3), ("b", None, 4), (None, T0, 5), ("a", T0 + timedelta(days=1), 2), ("a", T0 + timedelta(days=2), 3)]
    folder = str(tmp_path / "in")
    for i, r in enumerate(rows):
        spark.createDataFrame([r], DDL).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    got = drained(latest_per_key(stream_of(spark, folder, schema, 1), ["k"], "at", ["v"]), ["k"])
    assert {(r.k, r.v) for r in got.collect()} == {("a", 3), ("b", 4), (None, 5)}
    once = drained(without_repeats(stream_of(spark, folder, schema), ["k"], "at", "60 days"), ["k", "at"], "append")
    assert once.where("k = 'a'").count() == 3

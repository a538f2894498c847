import math

from pyspark.sql import functions as F

from fitlake.streaming import live

from .test_fit_source import RECORDS, build


def drain(df, spark, name, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name).collect()


def samples(spark, tmp_path, batches):
    folder = tmp_path / "samples"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "who string, t long, value double, seq long").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema("who string, t long, value double, seq long").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.fit").write_bytes(build([(t + k, h, d) for t, h, d in RECORDS]))
    assert len(drain(live.stream_messages(spark, str(tmp_path / "in")), spark, "new_files", tmp_path)) == 12


def test_steps_cross_batches_and_late_ones_stay(spark, tmp_path):
    stream = samples(spark, tmp_path, [[("a", 1_000_000, 5.0, 0), ("a", 3_000_000, 6.0, 1), ("b", 7, 1.0, 0)], [("a", 2_000_000, 9.0, 2), ("a", 8_000_000, 7.0, 3)]])
    rows = drain(live.stream_steps(stream, ["who"]), spark, "steps", tmp_path)
    got = {(r.who, r.t): (r.dt, r.late) for r in rows}
    assert got[("a", 1_000_000)] == (None, False) and got[("a", 3_000_000)] == (2_000_000, False)
    assert got[("a", 2_000_000)] == (None, True) and got[("a", 8_000_000)] == (5_000_000, False)
    assert got[("b", 7)] == (None, False) and len(rows) == 5


def test_zones(spark, tmp_path):
    stream = samples(spark, tmp_path, [[("a", k * 1_000_000, float(k), k) for k in range(10)], [("a", 9_000_000_000, 1.0, 99)], [("a", 19_000_000_000, 1.0, 100)]])
    rows = drain(live.stream_zone_time(live.stream_steps(stream, ["who"]), ["who"], [4.5]), spark, "zones_live", tmp_path)
    assert {(r.zone, r.us) for r in rows if r.window.start.timestamp() == 0} == {(0, 4_000_000), (1, 5_000_000)}


def test_sessions_by_rest(spark, tmp_path):
    stream = samples(spark, tmp_path, [[("a", k * 1_000_000, 0.0, k) for k in (0, 1, 2, 30, 31)], [("a", 9_000_000_000, 1.0, 9)], [("a", 9_900_000_000, 1.0, 9)]])
    found = live.stream_sessions(stream.withColumn("ts", F.timestamp_micros("t")), ["who"])
    assert sorted(r.n for r in drain(found, spark, "rests", tmp_path))[-2:] == [2, 3]


def test_timer_crosses_batches(spark, tmp_path):
    rows = [[("a", 10, 1.0, 0), ("a", 20, 1.0, 1)], [("a", 30, 0.0, 2), ("a", 40, 0.0, 3), ("a", 50, 1.0, 4)], [("a", 70, 0.0, 5), ("b", 1, 0.0, 0)]]
    events = samples(spark, tmp_path, rows).withColumn("kind", F.when(F.col("value") > 0, "start").otherwise("stop"))
    assert sorted((r.who, r.a, r.b) for r in drain(live.stream_timer(events, ["who"]), spark, "timer_live", tmp_path)) == [("a", 10, 30), ("a", 50, 70)]


def test_effort_and_mean_max(spark, tmp_path):
    stream = samples(spark, tmp_path, [[("a", k * 1_000_000, 100.0 + k, k) for k in range(6)], [("a", k * 1_000_000, 100.0 + k, k) for k in range(6, 10)], [("a", 9_000_000_000, 1.0, 99)], [("a", 19_000_000_000, 1.0, 100)]])
    rows = drain(live.stream_effort(live.stream_steps(stream, ["who"]), ["who"], max_hr=190, rest_hr=50), spark, "effort_live", tmp_path)
    first = next(r for r in rows if r.window.start.timestamp() == 0)
    reserve = [(100 + k - 50) / 140 for k in range(1, 10)]
    assert first.work_j == sum(100.0 + k for k in range(1, 10))
    assert abs(first.trimp - sum(r * 0.64 * math.exp(1.92 * r) / 60 for r in reserve)) < 1e-9
    best = drain(live.stream_mean_max(stream, ["who"], [1, 4]), spark, "best_live", tmp_path)
    assert max(r.best for r in best if r.n == 4) == 107.5 and max(r.best for r in best if r.n == 1) == 109.0

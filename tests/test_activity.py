import math

import pytest

from fitlake.plans import activity
from fitlake.sinks.encode import encode, synthesize
from fitlake.sources import fit

from .test_fit_source import RECORDS, build
from .test_verbs import START

N = 240


@pytest.fixture(scope="module")
def messages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("activities")
    record = lambda t, **more: synthesize("record", {"timestamp": START + t} | more)
    first = [record(t, heart_rate=150, power=200 if t % 2 else 220, speed=3.0, distance=t * 3.0, altitude=100.0 + (t // 60) * 5) for t in range(N)]
    later = [record(1000 + t, heart_rate=120, distance=800.0 + t) for t in range(10)] + [record(1050, heart_rate=121, distance=820.0)]
    stop = synthesize("event", {"timestamp": START + 1020, "event": "timer", "event_type": "stop_all"})
    whole = first + later + [stop] + [
        synthesize("session", {"start_time": START + 1000, "timestamp": START + 1050, "sport": "cycling", "total_distance": 20.0}),
        synthesize("session", {"start_time": START, "timestamp": START + N - 1, "sport": "running", "total_distance": 900.0, "max_heart_rate": 150}),
    ]
    (folder / "two.fit").write_bytes(encode(whole))
    (folder / "bare.fit").write_bytes(build(RECORDS))
    (folder / "bad.fit").write_bytes(b"x")
    out = str(tmp_path_factory.mktemp("messages") / "m")
    fit.read_messages(spark, str(folder)).write.parquet(out)
    return spark.read.parquet(out)


def test_sessions_and_owners(messages):
    held = sorted((r.session, r.sport, r.rebuilt) for r in activity.sessions(messages).collect())
    assert held == [(0, "running", False), (0, "unknown", True), (1, "cycling", False)]
    counts = {(r.session, r["count"]) for r in activity.session_records(messages).groupBy("file_id", "session").count().collect()}
    assert counts == {(0, N), (1, 11), (0, 6)}


def test_totals_and_discrepancies(messages):
    owned = activity.session_records(messages)
    derived = activity.derived_totals(owned)
    run = derived.where("n_records = 240").collect()[0]
    assert run.elapsed_time_s == N - 1 and run.distance_m == (N - 1) * 3.0 and run.moving_time_s == N - 1
    assert (run.avg_power, run.max_power, run.ascent_m, run.descent_m) == (210.0, 220.0, 15.0, 0.0)
    found = activity.discrepancies(activity.sessions(messages), derived).collect()
    assert [(r.field, r.declared, r.derived) for r in found] == [("distance_m", 900.0, 717.0)]


def test_gaps(messages):
    owned = activity.session_records(messages)
    assert [(r.gap_us // 10**6, r.kind) for r in activity.gaps(owned, messages).collect()] == [(41, "manual_stop")]


def test_report(messages):
    rows = {(r.sport, r.n_records): r for r in activity.report(messages, ftp=210.0, max_hr=190, rest_hr=50).collect()}
    assert len(rows) == 3
    run, ride, bare = rows["running", N], rows["cycling", 11], rows["unknown", 6]
    assert run.load_basis == "power" and abs(run.weighted_power - 210) < 1e-6
    assert abs(run.load - (N - 1) / 3600 * 100) < 1e-6 and run.best_60 == 210.0 and run.best_300 is None
    assert abs(run.work_kj - sum(200 if t % 2 else 220 for t in range(N - 1)) / 1000) < 1e-9
    assert run.pace_s_per_km == 333.3 and run.omissions == []
    steps, hrr = [1] * 9 + [30], 0.5
    assert ride.load_basis == "hr-trimp" and abs(ride.load - sum(steps) / 60 * hrr * 0.64 * math.exp(1.92 * hrr)) < 1e-9
    assert bare.rebuilt and bare.load_basis == "hr-trimp"
    without = activity.report(messages).where("n_records = 11").collect()[0]
    assert without.load is None and "load: no threshold that fits the sensors" in without.omissions

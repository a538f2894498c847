"""Checks, zones and timers of files, and structure by laps, steps and lengths."""

import pytest

from fitlake.plans import activity, checks, structure
from fitlake.sinks.encode import encode, synthesize
from fitlake.sources import fit

from .test_verbs import START

record = lambda t, **more: synthesize("record", {"timestamp": START + t} | more)
session = lambda a, b, **more: synthesize("session", {"start_time": START + a, "timestamp": START + b} | more)
lap = lambda a, s, **more: synthesize("lap", {"start_time": START + a, "timestamp": START + a + s, "total_elapsed_time": float(s)} | more)
event = lambda t, kind: synthesize("event", {"timestamp": START + t, "event": "timer", "event_type": kind})


def doubtful():
    rows = [record(k, heart_rate=140, speed=3.0, distance=50.0, position_lat=50 + k * 2e-5, position_long=8.0) for k in range(150)]
    rows[20] = record(20, heart_rate=140, speed=3.0, distance=50.0, position_lat=50.1, position_long=8.0)
    rows[40] = record(40, heart_rate=140, speed=3.0, distance=50.0, position_lat=0.0, position_long=0.0)
    rows += [record(150, heart_rate=240, power=2600, distance=20.0), record(151, heart_rate=141, distance=0.0)]
    totals = session(0, 151, sport="running", total_elapsed_time=0.0, avg_heart_rate=150, max_heart_rate=140, total_distance=900.0)
    whole = synthesize("activity", {"timestamp": START + 151, "num_sessions": 2})
    return encode([synthesize("file_id", {"type": "activity", "time_created": START - 8 * 86400}), *rows, lap(0, 0), lap(0, 60), totals, whole])


def sound():
    rows = [record(k, heart_rate=100 + k % 50, power=100 + k, speed=3.0 + k % 2, distance=k * 3.5, position_lat=50 + k * 3e-5, position_long=8.0) for k in range(100)]
    zones = [synthesize("hr_zone", {"message_index": i, "high_bpm": b}) for i, b in ((1, 140), (0, 120))]
    timer = [event(0, "start"), event(30, "stop"), event(50, "start")]
    return encode([synthesize("file_id", {"type": "activity", "time_created": START}), *zones, *timer, *rows, lap(0, 99), session(0, 99, sport="running", total_elapsed_time=99.0), synthesize("activity", {"timestamp": START + 99, "num_sessions": 1})])


def by_hand():
    laps = [lap(k * 60, 60, lap_trigger="manual", avg_speed=5.0 if k % 2 else 2.0) for k in range(6)]
    return encode([*(record(k, speed=4.0) for k in range(360)), *laps, session(0, 360, sport="running")])


def by_steps():
    steps = [synthesize("workout_step", {"message_index": k, "intensity": kind}) for k, kind in enumerate(("warmup", "interval", "rest"))]
    order = [0, 1, 2, 1]
    return encode([*steps, *(record(k, speed=3.0) for k in range(240)), *(lap(k * 60, 60, wkt_step_index=x, avg_speed=3.0) for k, x in enumerate(order)), session(0, 240, sport="running")])


def pool():
    starts = [0, 30, 60, 110, 140, 170]
    lengths = [synthesize("length", {"start_time": START + a, "timestamp": START + a + 28, "total_elapsed_time": 28.0, "total_strokes": 20, "length_type": 1}) for a in starts]
    return encode([*(record(k * 10, heart_rate=120) for k in range(21)), *lengths, session(0, 200, sport="swimming", pool_length=25.0, total_distance=150.0)])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = {}
    for make in (doubtful, sound, by_hand, by_steps, pool):
        folder = tmp_path_factory.mktemp(make.__name__)
        (folder / "a.fit").write_bytes(make())
        target = str(tmp_path_factory.mktemp("messages") / make.__name__)
        fit.read_messages(spark, str(folder)).write.parquet(target)
        out[make.__name__] = spark.read.parquet(target)
    return out


def test_findings(tables):
    found = {r.code: r.value for r in checks.findings(tables["doubtful"]).collect()}
    assert found == {
        "HR_IMPLAUSIBLE": 1, "POWER_IMPLAUSIBLE": 1, "HR_FLATLINE": 150, "DISTANCE_FROZEN": 149, "DISTANCE_DECREASES": 2, "DISTANCE_RESET": 1,
        "SUMMARY_AVG_EXCEEDS_MAX": 1, "ZERO_DURATION_SESSION": 152, "MOVEMENT_WITHOUT_DISTANCE": 3.0, "LAP_ZERO_DURATION": 1, "LAP_COVERAGE_GAP": 60,
        "TIMESTAMPS_AFTER_CREATION": 8 * 86400 + 151, "NUM_SESSIONS_MISMATCH": 1, "NULL_ISLAND": 1, "GPS_SPIKES": 1,
    }
    assert checks.findings(tables["sound"]).collect() == []


def test_positions_go_unless_forensic(tables):
    messages = tables["doubtful"]
    held = activity.sessions(messages)
    judged = checks.judged_positions(activity.session_records(messages), messages, held)
    lost = lambda mode: sorted(r.t // 10**6 - START for r in checks.gated_positions(judged, mode).where("position_lat IS NULL AND distance = 50").collect())
    assert lost("lenient") == [20, 40] and lost("forensic") == []


def test_zones_of_the_file(tables):
    messages = tables["sound"]
    owned = activity.session_records(messages)
    got = {r.zone: (r.seconds, r.basis) for r in activity.time_in_zones(owned, messages, "heart_rate").collect()}
    want = [0, 0, 0]
    for k in range(99):
        want[(100 + k % 50 > 120) + (100 + k % 50 > 140)] += 1
    assert got == {z: (float(n), "file:hr_zone") for z, n in enumerate(want)}
    told = {r.zone: (r.seconds, r.basis) for r in activity.time_in_zones(owned, messages, "heart_rate", [250]).collect()}
    assert told == {0: (99.0, "settings"), 1: (0.0, "settings")}
    assert activity.time_in_zones(owned, messages, "power").count() == 0


def test_timers(tables):
    messages = tables["sound"]
    runs = activity.timers(activity.session_records(messages), messages)
    assert sorted((r.a // 10**6 - START, r.b // 10**6 - START) for r in runs.collect()) == [(0, 30), (50, 99)]
    (row,) = activity.report(messages).collect()
    assert row.timer_time_s == row.duration_s == 79.0


def test_structure_by_laps(tables):
    rows = structure.structure(tables["by_hand"]).orderBy("index").collect()
    assert {r.basis for r in rows} == {"laps:manual"} and [r.kind for r in rows] == ["recovery", "work"] * 3
    assert [r.repeat for r in rows] == [None, 1] * 3
    measured = structure.structure(tables["by_hand"], from_records=True).collect()
    assert {r.kind for r in measured} == {"steady"} and {r.intensity for r in measured} == {4.0}


def test_structure_by_steps(tables):
    rows = structure.structure(tables["by_steps"]).orderBy("index").collect()
    assert [(r.basis, r.kind, r.step_index) for r in rows] == [("steps:workout", k, s) for k, s in (("warmup", 0), ("work", 1), ("rest", 2), ("work", 1))]


def test_structure_of_swims(tables):
    messages = tables["pool"]
    rows = structure.structure(messages).orderBy("index").collect()
    assert [(r.basis, r.lengths, r.distance_m, r.duration_s, r.repeat) for r in rows] == [("lengths:sets", 3, 75.0, 84.0, 1)] * 2
    assert [r.swolf for r in activity.report(messages).collect()] == [48.0]


def test_alike():
    work = lambda s, x, n=None: {"duration_s": s, "intensity": x, "lengths": n}
    assert structure.alike(work(75.0, 1.0), work(100.0, 1.0)) and not structure.alike(work(74.0, 1.0), work(100.0, 1.0))
    assert structure.alike(work(60.0, None), work(60.0, 9.0)) and not structure.alike(work(60.0, 1.0), work(60.0, 1.2))
    assert structure.alike(work(60.0, 1.0, 4), work(90.0, 2.0, 4)) and not structure.alike(work(60.0, 1.0, 4), work(60.0, 1.0, 2))

import json

import pytest

from fitlake import cli
from fitlake.operators import verbs
from fitlake.plans import structure
from fitlake.sources import fit

from .test_fit_source import RECORDS, build
from .test_verbs import START, activity, fields

SCHEMA = "file_id string, part int, session int, i long, t long, power double, speed double, heart_rate double"


def rows(key, powers, speed=lambda k: 3.0):
    return [(key, 0, 0, k, k * 1_000_000, float(p) if p is not None else None, speed(k), 150.0) for k, p in enumerate(powers)]


def test_repeats_are_found_and_noise_is_not(spark):
    reps = [100] * 60 + ([300] * 60 + [100] * 40) * 4
    steady = [200 + k % 3 for k in range(300)]
    owned = spark.createDataFrame(rows("reps", reps) + rows("steady", steady) + rows("none", [None] * 50), SCHEMA)
    found = structure.intervals(owned, "power").orderBy("index").collect()
    assert {r.file_id for r in found} == {"reps"} and [r.kind for r in found] == ["recovery", "work"] * 4 + ["recovery"]
    assert [r.repeat for r in found if r.kind == "work"] == [1, 1, 1, 1]
    (group,) = structure.repeat_groups(structure.intervals(owned, "power")).collect()
    assert group.n == 4 and abs(group.duration_s - 59) <= 2 and abs(group.intensity - 300) < 15 and abs(group.rest_s - 39) <= 2


def test_stubs_merge():
    run = lambda kind, a, b: {"kind": kind, "n": b - a, "first_t": a * 10**6, "last_t": b * 10**6, "intensity": 1.0}
    merged = structure.merge_runs([run("work", 0, 5), run("work", 6, 40), run("recovery", 41, 45), run("work", 46, 80)])
    assert [(r["kind"], r["first_t"] // 10**6, r["last_t"] // 10**6) for r in merged] == [("recovery", 0, 5), ("work", 6, 80)]


def test_insights(spark):
    owned = spark.createDataFrame(
        rows("faster", [0 if k % 2 else 200 for k in range(200)], lambda k: 3.0 if k < 100 else 3.3) + rows("slower", [200] * 200, lambda k: 3.0 if k < 100 else 2.7),
        SCHEMA,
    )
    sports = spark.createDataFrame([("faster", 0, 0, "cycling"), ("slower", 0, 0, "running")], "file_id string, part int, session int, sport string")
    got = {(r.file_id, r.code): round(r.value, 3) for r in structure.insights(owned, sports).collect()}
    assert got == {("faster", "PACING_NEGATIVE_SPLIT"): 10.0, ("faster", "COASTING_HIGH"): 50.0, ("slower", "PACING_POSITIVE_SPLIT"): -10.0, ("slower", "HR_DRIFT_HIGH"): 10.0}


def test_cli(tmp_path, capsys):
    source, out = tmp_path / "a.fit", tmp_path / "b.fit"
    source.write_bytes(activity())
    assert cli.main(["parse", str(source), "--strip-pii"]) == 0
    held = json.loads(capsys.readouterr().out)
    assert held["messages"][0]["fields"]["serial_number"] is None and all(m["name"] != "user_profile" for m in held["messages"])
    assert cli.main(["trim", str(source), "--after", "+1s", "--before", "-2", "-o", str(out)]) == 0
    assert [r["timestamp"] - START for r in fields(out.read_bytes(), "record")] == [1, 2, 3]
    assert cli.main(["edit", str(source), "--sport", "cycling", "--time-shift=-01:00", "-o", str(out)]) == 0
    assert fields(out.read_bytes(), "session")[0]["start_time"] == START - 3600
    assert cli.main(["scrub", str(source), "--keep-identity", "--drop-all-gps", "-o", str(out)]) == 0
    assert fields(out.read_bytes(), "user_profile") and fields(out.read_bytes(), "record")[0]["position_lat"] is None
    assert cli.main(["reveal", str(source)]) == cli.main(["validate", str(source)]) == cli.main(["inspect", str(source)]) == 0
    source.write_bytes(build(RECORDS)[:-4])
    assert cli.main(["parse", str(source)]) == 2 and cli.main(["doctor", str(source), "--platform", "strava"]) == 2
    assert cli.main(["repair", str(source), "-o", str(out)]) == 0 and cli.exit_code(out.read_bytes()) == 0
    source.write_bytes(b"no")
    assert cli.main(["parse", str(source)]) == 4 and cli.main(["repair", str(source), "-o", str(out)]) == 4
    for wrong in (["nothing"], ["parse"]):
        with pytest.raises(SystemExit, match="64"):
            cli.main(wrong)
    assert cli.main(["parse", str(tmp_path / "absent")]) == 64


def test_doctor():
    bare = build(RECORDS)
    found = verbs.doctor(bare, "garmin-connect")
    assert [f["remedy"] for f in found if f["code"] == "VAL_GC_NO_SESSION"] == ["repair"]
    left = verbs.doctor(verbs.repair(bare), "garmin-connect")
    assert [(f["code"], f["remedy"]) for f in left] == [("VAL_GC_NO_MANUFACTURER", None)]
    assert fit.parse(verbs.repair(bare)).provenance == []

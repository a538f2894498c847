import struct

import pytest

from fitlake.operators import verbs
from fitlake.sinks import canonical
from fitlake.sinks.encode import encode, synthesize
from fitlake.sources import fit

from .test_fit_source import RECORDS, T0, build

START = T0 + fit.EPOCH_OFFSET


def activity(lat=48.0, n=6, **session):
    records = [synthesize("record", {"timestamp": START + i, "position_lat": lat + i / 100, "position_long": 11.0, "heart_rate": 100 + i, "distance": i * 2.5}) for i in range(n)]
    ends = {"timestamp": START + n - 1, "start_time": START}
    return encode(
        [synthesize("file_id", {"type": "activity", "manufacturer": 1, "product": 7, "serial_number": 12345, "time_created": START})]
        + [synthesize("user_profile", {"friendly_name": "Ada", "weight": 70.0})]
        + [synthesize("event", {"timestamp": START, "event": "timer", "event_type": "start"})]
        + records
        + [synthesize("event", {"timestamp": START + n - 1, "event": "timer", "event_type": "stop_all"})]
        + [synthesize("lap", ends | {"message_index": 0}), synthesize("session", ends | {"sport": "running", "total_distance": (n - 1) * 2.5, "max_heart_rate": 105, "start_position_lat": lat} | session)]
        + [synthesize("activity", {"timestamp": START + n - 1, "num_sessions": 1})]
    )


def fields(content, name):
    found = fit.parse(content)
    assert not found.error and not found.provenance
    return [m["fields"] for m in found.messages if m["name"] == name]


@pytest.mark.parametrize("arch", ["<", ">"])
def test_lossless_round_trip(arch):
    layout = b"\x41\x00\x00" + struct.pack("<H", 20) + b"\x01" + bytes((3, 1, 2))
    unknown = b"\x42\x00\x00" + struct.pack("<H", 777) + b"\x01" + bytes((9, 3, 0x0D)) + b"\x02abc"
    source = build(RECORDS, arch=arch, extra=layout + bytes((0x80 | 1 << 5 | 31, 120)) + unknown)
    before = fit.parse(source).messages
    after = fit.parse(encode(before))
    assert not after.provenance
    assert [(m["name"], m["fields"]) for m in after.messages] == [(m["name"], m["fields"]) for m in before]


def test_more_shapes_than_slots():
    messages = [synthesize("record", {"timestamp": START, "heart_rate": 1} | {k: 1 for k in keys}) for keys in ([], ["power"], ["cadence"], ["power", "cadence"]) * 9]
    many = [synthesize("developer_data_id", {"developer_data_index": i}) for i in range(3)]
    shapes = [m for k in range(20) for m in [synthesize("zones_target", {"functional_threshold_power": 200 + k}), synthesize("file_id", {"product_name": "x" * (k + 1)})]]
    found = fit.parse(encode(messages + many + shapes))
    assert not found.provenance and len(found.messages) == len(messages + many + shapes)


def test_repair_of_a_cut_file():
    whole = activity()
    cut = whole[: whole.index(b"Ada") + 120]
    assert fit.parse(cut).provenance
    fixed = verbs.repair(cut)
    assert len(fields(fixed, "session")) == len(fields(fixed, "lap")) == len(fields(fixed, "activity")) == 1
    assert fields(fixed, "record") and verbs.validate(fixed) == []
    with pytest.raises(verbs.VerbError, match="NOTHING_TO_SALVAGE"):
        verbs.repair(encode([synthesize("file_id", {"type": "activity"})]))


def test_trim_rebuilds_totals():
    out = verbs.trim(activity(), START + 1, START + 3)
    assert [r["timestamp"] - START for r in fields(out, "record")] == [1, 2, 3]
    (session,) = fields(out, "session")
    assert session["total_elapsed_time"] == 2 and session["total_distance"] == 5.0 and session["sport"] == "running"
    assert session["avg_heart_rate"] == 102 and session["max_heart_rate"] == 103
    with pytest.raises(verbs.VerbError, match="TRIM_EMPTY"):
        verbs.trim(activity(), START + 1000)
    with pytest.raises(verbs.VerbError, match="NO_TRIM_WINDOW"):
        verbs.trim(activity())


def test_edits():
    out = verbs.edit(activity(), sport="cycling", product=9, time_shift_s=3600, total_distance_m=25.0)
    (session,), records = fields(out, "session"), fields(out, "record")
    assert session["sport"] == "cycling" and session["total_distance"] == 25.0 and session["start_time"] == START + 3600
    assert records[-1]["distance"] == 25.0 and records[0]["timestamp"] == START + 3600
    assert fields(out, "file_id")[0]["product"] == 9
    for options, code in (({}, "NO_EDIT_REQUESTED"), ({"sport": "nonsense"}, "UNKNOWN_ENUM_NAME"), ({"time_shift_s": 1 << 33}, "EDIT_OUT_OF_RANGE"), ({"total_distance_m": 1e9}, "EDIT_OUT_OF_RANGE")):
        with pytest.raises(verbs.VerbError, match=code):
            verbs.edit(activity(), **options)


def test_scrub_and_reveal():
    told = {(f["category"], f["message"], f["field"]): f["count"] for f in verbs.reveal(activity())}
    assert told[("serials", "file_id", "serial_number")] == 1 and told[("identity", "user_profile", "weight")] == 1
    assert told[("location", "record", "position_lat")] == 6
    out = verbs.scrub(activity(), gps=1500.0)
    assert not fields(out, "user_profile") and fields(out, "file_id")[0]["serial_number"] is None
    assert [r["position_lat"] is None for r in fields(out, "record")] == [True, True, False, False, True, True]
    assert fields(out, "session")[0]["start_position_lat"] is None and fields(out, "session")[0]["max_heart_rate"] == 105
    assert [f["category"] for f in verbs.reveal(verbs.scrub(activity(), gps="all"))] == []


def test_validation():
    assert verbs.validate(activity()) == verbs.validate(activity(), "garmin-connect") == verbs.validate(activity(), "strava") == []
    bare = build(RECORDS)
    assert [f["code"] for f in verbs.validate(bare, "strava")] == ["VAL_STRAVA_NOT_ACTIVITY", "VAL_STRAVA_NO_SESSION"]
    assert "VAL_GC_NO_FILE_ID" in [f["code"] for f in verbs.validate(bare, "garmin-connect")]
    assert verbs.validate(bare[:-3])[0]["code"] == "VAL_SPEC_VIOLATION"
    assert verbs.validate(b"", "strava")[0]["code"] == "VAL_UNPARSEABLE"


def test_folders(spark, tmp_path):
    (tmp_path / "a.fit").write_bytes(activity())
    (tmp_path / "b.fit").write_bytes(b"nothing")
    rows = {r.path.rsplit("/", 1)[1]: r for r in verbs.rewrite(spark, str(tmp_path), verbs.edit, sport="cycling").collect()}
    assert fields(bytes(rows["a.fit"].output), "session")[0]["sport"] == "cycling"
    assert rows["b.fit"].output is None and rows["b.fit"].error in ("NOT_FIT_FORMAT", "FIT_TOO_SMALL")
    assert {r.code for r in verbs.findings(spark, str(tmp_path), verbs.validate, platform="strava").collect()} == {"VAL_UNPARSEABLE"}
    assert verbs.findings(spark, str(tmp_path), verbs.reveal).where("category = 'location'").count() == 1
    codes = verbs.exit_codes(fit.read_files(spark, str(tmp_path))).select("exit_code").collect()
    assert sorted(r.exit_code for r in codes) == [0, 3]


@pytest.mark.parametrize(
    "value, text",
    [(1.0, "1"), (-0.0, "0"), (0.1, "0.1"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-7, "1e-7"), (0.000001, "0.000001"),
     (123456.789, "123456.789"), (5e-324, "5e-324"), (-1.5e-9, "-1.5e-9"), (1.7976931348623157e308, "1.7976931348623157e+308"), (100, "100")],
)
def test_canonical_numbers(value, text):
    assert canonical.number(value) == text


def test_canonical_text():
    assert canonical.dumps({"b": [1, None, True], "a": "é\n", "\U0001f600": 1, "דּ": 2}) == '{"a":"é\\n","b":[1,null,true],"\U0001f600":1,"דּ":2}'
    assert canonical.json_safe({"x": b"\x01", "y": 1 << 60, "z": float("nan")}) == {"x": "01", "y": str(1 << 60), "z": None}
    for bad in (float("inf"), 1 << 60):
        with pytest.raises(ValueError):
            canonical.dumps(bad)


def test_trim_keeps_several_sessions():
    records = [synthesize("record", {"timestamp": START + i, "heart_rate": 100 + i, "distance": i * 2}) for i in range(60)]
    session = lambda a, b, sport: synthesize("session", {"timestamp": START + b, "start_time": START + a, "sport": sport, "total_elapsed_time": b - a})
    content = encode([synthesize("file_id", {"type": "activity", "time_created": START}), *records, session(0, 19, "running"), session(20, 39, "cycling"), session(40, 59, "swimming")])
    held = fields(verbs.trim(content, START + 10, START + 29), "session")
    assert [(x["sport"], x["start_time"] - START, x["timestamp"] - START, x["total_distance"]) for x in held] == [("running", 10, 19, 18.0), ("cycling", 20, 29, 18.0)]
    assert fields(verbs.trim(content, START + 10, START + 29), "activity")[0]["num_sessions"] == 2


def test_chained_parts_stay_parts():
    chained = activity() + activity(50.0)
    for changed in (verbs.edit(chained, sport="rowing"), verbs.scrub(chained), verbs.repair(chained), verbs.trim(chained, after=START + 1)):
        found = fit.parse(changed)
        assert found.parts == 2 and not found.provenance
        assert [m["part"] for m in found.messages if m["name"] == "session"] == [0, 1]


def test_what_is_removed_and_what_stays_unresolved():
    counts = verbs.removed(activity(), gps="all")
    assert counts == {"identity": 1, "serials": 1, "body_metrics": 0, "location": 6}
    assert verbs.clean_categories(activity()) == ["body_metrics"] and "identity" in verbs.clean_categories(verbs.scrub(activity()))
    assert verbs.diagnosis(activity(), "garmin-connect") == {"will_upload": True, "blocking": [], "advisory": [], "unresolved": []}
    bad = verbs.diagnosis(encode([synthesize("file_id", {"type": "course", "time_created": START, "manufacturer": 1})]), "garmin-connect")
    assert not bad["will_upload"] and bad["unresolved"] == ["VAL_GC_NOT_ACTIVITY"]


def test_texts(tmp_path, capsys):
    from fitlake import cli, texts

    path = tmp_path / "a.fit"
    path.write_bytes(activity())
    assert cli.main(["parse", str(path), "--summary"]) == 0 and "6 record" in capsys.readouterr().out
    assert cli.main(["reveal", str(path), "--text"]) == 0 and "serials file_id serial_number 1" in capsys.readouterr().out
    assert cli.main(["parse", str(path), "--no-unknown", "--include-raw", "--strip-pii"]) == 0
    told = capsys.readouterr().out
    assert '"raw":' in told and "PII_STRIPPED" in told and "Ada" not in told
    assert texts.clock(59.5) == "1:00" and texts.clock(3661) == "1:01:01" and texts.findings([]) == "nothing"
    assert texts.analysis({"sessions": []}) == "no sessions"

"""Kinds of gaps, the registry of codes, what repair does to local times, and the analyze verb."""

import json
import re
from pathlib import Path

from fitlake import cli
from fitlake.functions import codes
from fitlake.operators import verbs
from fitlake.plans import activity
from fitlake.sinks.encode import encode, synthesize
from fitlake.sources import fit

from .test_checks import event, lap, record, session, sound
from .test_verbs import START


def damaged(whole: bytes, after: int) -> bytes:
    """The file with bytes of no meaning after a record, and a definition that lets a reader go on."""
    at = [m["byte_offset"] for m in fit.parse(whole).messages if m["name"] == "record"][after]
    body = whole[14 : at] + b"\x2e" * 9 + whole[14 : 14 + 6 + 3 * whole[19]] + whole[at:-2]
    head = whole[:4] + len(body).to_bytes(4, "little") + whole[8:12]
    out = head + fit.crc16(head).to_bytes(2, "little") + body
    return out + fit.crc16(out).to_bytes(2, "little")


def test_kinds_of_gaps(spark, tmp_path):
    times = [0, 1, 21, 61, 100, 140, 141, 200]
    stop = synthesize("event", {"timestamp": START + 70, "event": "timer", "event_type": "stop", "data": 1})
    events = [event(0, "start"), stop, event(99, "start"), event(120, "stop_all"), event(139, "start"), event(141, "stop_all")]
    clean = encode([*(record(t, heart_rate=100) for t in times), *events, session(0, 200, sport="running")])
    (tmp_path / "a.fit").write_bytes(clean)
    messages = fit.read_messages(spark, str(tmp_path))
    found = activity.gaps(activity.session_records(messages), messages).orderBy("t").collect()
    assert [(r.gap_us // 10**6, r.kind) for r in found] == [(20, "smart_recording"), (40, "unknown"), (39, "auto_pause"), (40, "manual_stop"), (59, "manual_stop")]
    late = encode([*(record(t, heart_rate=100) for t in (0, 1, 2, 60)), event(0, "start"), event(1, "stop_all"), session(0, 60, sport="running")])
    (tmp_path / "a.fit").write_bytes(late)
    messages = fit.read_messages(spark, str(tmp_path))
    assert [r.kind for r in activity.gaps(activity.session_records(messages), messages).collect()] == ["post_timer"]


def test_corrupt_gaps(spark, tmp_path):
    whole = encode([*(record(t, heart_rate=100) for t in (0, 1, 60, 61, 120)), session(0, 120, sport="running")])
    bad = damaged(whole, 2)
    assert len(fit.parse(bad).skipped) == 1
    (tmp_path / "a.fit").write_bytes(bad)
    messages, files = fit.read_messages(spark, str(tmp_path)), fit.read_files(spark, str(tmp_path))
    found = activity.gaps(activity.session_records(messages), messages, files).orderBy("t").collect()
    assert [r.kind for r in found] == ["corruption", "unknown"]
    assert "VAL_GC_CORRUPTION_GAPS" in {f["code"] for f in verbs.validate(bad, "garmin-connect")}
    assert "VAL_GC_CORRUPTION_GAPS" not in {f["code"] for f in verbs.validate(damaged(whole, 1), "garmin-connect")}


def test_repair_drops_impossible_local_times():
    make = lambda hours: encode([record(0), record(1), lap(0, 1), synthesize("activity", {"timestamp": START, "local_timestamp": START + hours * 3600})])
    local = lambda content: next(m["fields"]["local_timestamp"] for m in fit.parse(content).messages if m["name"] == "activity")
    assert local(verbs.repair(make(30))) is None and local(verbs.repair(make(2))) == START + 7200


def test_all_codes_are_registered():
    package = Path(cli.__file__).parent
    text = "".join(p.read_text() for p in package.rglob("*.py") if "llm" not in p.parts and p.name not in ("codes.py", "queries.py", "structure.py"))
    used = set(re.findall(r'(?:note|_resync|VerbError|StrictError|_row)\([^"\n]*"([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)"', text)) | set(re.findall(r'"(VAL_[A-Z_]+)"', text))
    known = {row["code"] for row in codes.rows()}
    assert len(used) > 40 and used <= known


def test_cli_of_codes_modes_and_reports(spark, tmp_path, capsys):
    path = tmp_path / "a.fit"
    path.write_bytes(sound())
    assert cli.main(["codes"]) == 0 and len(json.loads(capsys.readouterr().out)) == len(codes.rows())
    assert cli.main(["analyze", str(path), "--ftp", "200"]) == 0
    held = json.loads(capsys.readouterr().out)
    assert held["sessions"][0]["load_basis"] == "power" and held["findings"] == [] and held["structure"] == []
    path.write_bytes(sound()[:-2])
    assert cli.main(["parse", str(path), "--mode", "strict"]) == 3 and cli.main(["parse", str(path)]) == 2
    path.write_bytes(b"no")
    assert cli.main(["analyze", str(path)]) == 4 and cli.main(["parse", str(path), "--mode", "strict"]) == 4

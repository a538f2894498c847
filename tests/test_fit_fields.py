"""Fields that share bytes, counters that begin anew, developer fields, profiles and modes."""

import struct

import pytest

from fitlake.operators import verbs
from fitlake.sources import fit

from .test_fit_source import RECORDS, T0, build


def layout(local, number, fields, developer=()):
    head = bytes((0x40 | (0x20 if developer else 0) | local, 0, 0)) + struct.pack("<H", number) + bytes((len(fields),))
    head += b"".join(bytes(f) for f in fields)
    return head + (bytes((len(developer),)) + b"".join(bytes(d) for d in developer) if developer else b"")


def body(*parts):
    return fit.parse(build([], extra=b"".join(parts)))


def test_speed_and_distance_in_three_bytes():
    pack = lambda speed, rolling: (speed | rolling << 12).to_bytes(3, "little")
    rows = [pack(350, 4000), pack(0xFFF, 4090), pack(10, 20)]
    found = body(layout(1, 20, [(8, 3, 0x0D)]), *(b"\x01" + r for r in rows)).messages
    assert [m["fields"].get("speed") for m in found] == [3.5, None, 0.1]
    assert [m["fields"]["distance"] for m in found] == [250.0, 4090 / 16, (4096 + 20) / 16]


def test_power_counter_and_balance():
    rows = [(2**32 - 6, 0x80 | 48), (4, 48), (9, 0x80 | 110)]
    found = [m["fields"] for m in body(layout(1, 20, [(29, 4, 0x86), (30, 1, 2)]), *(b"\x01" + struct.pack("<IB", *r) for r in rows)).messages]
    assert [f["accumulated_power"] for f in found] == [2**32 - 6, 2**32 + 4, 2**32 + 9]
    assert [f.get("right_balance_pct") for f in found] == [48, 52, None]


def test_timer_trigger_only_of_timers():
    rows = [(0, 1), (9, 1), (0, 7)]
    found = [m["fields"].get("timer_trigger") for m in body(layout(1, 21, [(0, 1, 0), (3, 4, 0x86)]), *(b"\x01" + struct.pack("<BI", *r) for r in rows)).messages]
    assert found == ["auto", None, 7]


def test_monitoring_times_of_16_bits():
    start = (T0 & ~0xFFFF) + 0xFFF0
    parts = [layout(1, 55, [(253, 4, 0x86), (24, 1, 0x0D)]), b"\x01" + struct.pack("<IB", start, 3 << 5 | 6), layout(2, 55, [(26, 2, 0x84), (27, 1, 2)])]
    parts += [b"\x02" + struct.pack("<HB", (start + step) & 0xFFFF, 60) for step in (5, 60)]
    found = [m["fields"] for m in body(*parts).messages]
    assert [f["timestamp"] - fit.EPOCH_OFFSET - start for f in found] == [0, 5, 60]
    assert (found[0]["activity_type"], found[0]["intensity"]) == (6, 3)
    lost = body(layout(2, 55, [(26, 2, 0x84)]), b"\x02\x05\x00")
    assert [p["code"] for p in lost.provenance] == ["TIME_WITHOUT_ANCHOR"]


def test_heart_beats_of_12_bits():
    lows = [0xF10, 0x010, 0xFFF, 0x020]
    packed = sum(x << 12 * k for k, x in enumerate(lows)).to_bytes(6, "little")
    found = body(layout(1, 132, [(9, 4, 0x86)]), b"\x01" + struct.pack("<I", 0x5F00), layout(2, 132, [(10, 6, 0x0D)]), b"\x02" + packed).messages
    assert found[1]["fields"]["event_times_s"] == [0x5F10 / 1024, 0x6010 / 1024, 0x6020 / 1024]


def test_developer_field_described_late():
    use = layout(1, 20, [(3, 1, 2)], [(7, 2, 0)])
    describe = layout(2, 206, [(0, 1, 2), (1, 1, 2), (2, 1, 2), (3, 4, 7)]) + b"\x02" + bytes((0, 7, 0x84)) + b"air\0"
    found = body(use, b"\x01" + struct.pack("<BH", 100, 515), describe, b"\x01" + struct.pack("<BH", 101, 516))
    assert [m["fields"] for m in found.messages if m["name"] == "record"] == [{"heart_rate": 100, "air": 515}, {"heart_rate": 101, "air": 516}]
    assert [p["code"] for p in found.provenance] == ["DEVELOPER_FIELD_BACKFILLED"]
    never = body(use, b"\x01" + struct.pack("<BH", 100, 515))
    assert never.messages[0]["fields"]["dev_0_7"] == "0302"
    assert [p["code"] for p in never.provenance] == ["DEVELOPER_FIELD_UNDESCRIBED"]


def test_unusable_fields_are_kept_and_counted():
    found = body(layout(1, 20, [(3, 1, 2), (7, 3, 0x84)]), *[b"\x01\x64\x01\x02\x03"] * 3)
    assert [m["fields"]["power"] for m in found.messages] == ["010203"] * 3
    (note,) = found.provenance
    assert note["code"] == "FIELD_KEPT_RAW" and note["detail"].endswith("3 times")
    whole = build(RECORDS, extra=layout(1, 20, [(253, 4, 0x86), (7, 3, 0x84)]) + b"\x01" + struct.pack("<I", T0 + 9) + b"\x01\x02\x03")
    again = fit.parse(verbs.repair(whole))
    assert [m["fields"]["power"] for m in again.messages if "power" in m["fields"]] == ["010203"]


def test_profile_of_a_table():
    table = "global_num,message,field_num,field,kind,scale,offset,units\n4242,tyre,0,pressure,,100,,bar\n20,record,3,pulse,number,,,bpm\n"
    profile = fit.overlay(fit.profile_from_csv(table))
    whole = build(RECORDS, extra=layout(1, 4242, [(0, 2, 0x84)]) + b"\x01" + struct.pack("<H", 250))
    found = fit.parse(whole, profile=profile).messages
    assert found[0]["fields"]["pulse"] == 100 and found[0]["fields"]["distance"] == 0.0
    assert (found[-1]["name"], found[-1]["fields"]) == ("tyre", {"pressure": 2.5})
    assert fit.parse(whole).messages[-1]["name"] == "unknown_4242"


def test_modes(spark, tmp_path):
    whole = build(RECORDS)
    assert len(fit.parse(whole, "strict").messages) == len(fit.parse(whole, "forensic").messages) == 6
    for bad, code in ((whole[:-1], "FILE_CRC_MISSING"), (b"no", "FIT_TOO_SMALL"), (build([]), "FIT_NO_CONTENT")):
        with pytest.raises(fit.StrictError) as refusal:
            fit.parse(bad, "strict")
        assert refusal.value.code == code
    with pytest.raises(ValueError):
        fit.parse(whole, "loose")
    for name, content in (("a", whole), ("b", whole[:-1])):
        (tmp_path / f"{name}.fit").write_bytes(content)
    rows = {r.path[-5:]: (r.error, r.n_messages) for r in fit.read_files(spark, str(tmp_path), "strict").collect()}
    assert rows == {"a.fit": (None, 6), "b.fit": ("FILE_CRC_MISSING", 0)}
    assert fit.read_messages(spark, str(tmp_path), "strict").count() == 6
    assert fit.read_messages(spark, str(tmp_path)).count() == 12

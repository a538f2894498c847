import gzip
import struct

import pytest

from fitlake.sources import fit

T0 = 1_149_152_400


def build(records, *, arch="<", extra=b""):
    fields = [(253, 4, 0x86), (3, 1, 0x02), (5, 4, 0x86)]
    head = b"\x40\x00" + (b"\x00" if arch == "<" else b"\x01") + struct.pack(arch + "H", 20)
    body = head + bytes([len(fields)]) + b"".join(bytes(f) for f in fields)
    for t, hr, dist in records:
        body += b"\x00" + struct.pack(arch + "IBI", t, hr, dist)
    body += extra
    header = struct.pack("<BBHI4s", 14, 0x20, 21141, len(body), b".FIT")
    whole = header + struct.pack("<H", fit.crc16(header)) + body
    return whole + struct.pack("<H", fit.crc16(whole))


RECORDS = [(T0 + i, 100 + i if i != 3 else 0xFF, i * 250) for i in range(6)]


@pytest.mark.parametrize("arch", ["<", ">"])
def test_whole_file(arch):
    found = fit.parse(build(RECORDS, arch=arch))
    assert found.error is None and not found.provenance and len(found.messages) == 6
    assert found.messages[0]["fields"] == {"timestamp": T0 + fit.EPOCH_OFFSET, "heart_rate": 100, "distance": 0.0}
    assert found.messages[3]["fields"]["heart_rate"] is None  # absent, not 255
    assert found.messages[0]["fields"]["distance"] == 0.0  # zero, not absent


def test_compressed_timestamps_roll_over():
    layout = b"\x41\x00\x00" + struct.pack("<H", 20) + b"\x01" + bytes((3, 1, 2))
    start = (T0 & ~31) + 30
    extra = layout + bytes((0x80 | 1 << 5 | 31, 120)) + bytes((0x80 | 1 << 5 | 1, 121))
    found = fit.parse(build([(start, 100, 0)], extra=extra))
    times = [m["fields"]["timestamp"] - fit.EPOCH_OFFSET for m in found.messages]
    assert times == [start, start + 1, start + 3]


def test_chained_wrapped_and_junk():
    one = build(RECORDS)
    found = fit.parse(gzip.compress(one + one + b"junk!"))
    assert found.parts == 2 and len(found.messages) == 12
    assert [p["code"] for p in found.provenance] == ["UNWRAPPED", "TRAILING_JUNK"]


def test_damage_never_raises_and_is_accounted_for():
    whole = build(RECORDS)
    for cut in range(len(whole)):
        found = fit.parse(whole[:cut])
        assert found.error or found.provenance
    for at in range(0, len(whole)):
        fit.parse(whole[:at] + bytes((whole[at] ^ 0x41,)) + whole[at + 1 :])
    assert fit.parse(b'<gpx version="1.1"></gpx>').error == "NOT_FIT_FORMAT"
    assert fit.parse(b"<gpx></gpx>").error == "FIT_TOO_SMALL" and fit.parse(b"").error == "FIT_EMPTY"


def test_folder_to_records(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.fit").write_bytes(build([(t + k, h, d) for t, h, d in RECORDS]))
    (tmp_path / "bad.fit").write_bytes(b"no activity")
    files = fit.read_files(spark, str(tmp_path)).collect()
    assert sorted(f.n_messages for f in files) == [0, 6, 6, 6]
    rows = fit.read_records(spark, str(tmp_path)).collect()
    assert len(rows) == 18 and sum(r.heart_rate is None for r in rows) == 3
    assert max(r.distance for r in rows) == 12.5


def test_odd_headers_are_read():
    """A missing magic is tolerated with a size in use, and an odd size with the magic."""
    whole = build(RECORDS)
    n = len(fit.parse(whole).messages)
    for header in (whole[:8] + b"xxxx" + whole[12:], b"\x0c" + whole[1:12] + whole[14:], bytes((20,)) + whole[1:14] + bytes(6) + whole[14:]):
        found = fit.parse(header)
        assert not found.error and len(found.messages) == n
    assert fit.parse(b"\x0c" + bytes(30)).error == "FIT_NO_CONTENT"
    assert [fit.sniff(x) for x in (b"\xef\xbb\xbf <gpx>", b" <TrainingCenterDatabase", b"<!DOCTYPE html>", b"<x/>", b"[1]", b"plain", b"\x00")] == ["gpx", "tcx", "html", "xml", "json", "text", None]


def test_frames_cover_every_byte():
    whole = build(RECORDS)
    for content in (whole, b"junk" + whole + b"tail", whole + whole, whole[:-20], whole[:60] + b"\xff" * 9 + whole[60:]):
        held = list(fit.frames(content))
        at = 0
        for x in held:
            assert x["byte_offset"] == at
            at += x["size"]
        assert at == len(content)
    kinds = [x["kind"] for x in fit.frames(whole + whole)]
    assert kinds.count("header") == kinds.count("checksum") == 2 and "skipped" not in kinds


def test_options_of_reading():
    found = fit.parse(build(RECORDS), include_raw=True)
    assert all(len(m["raw"]) == len(m["wire"]["fields"]) for m in found.messages)
    assert fit.parse(build(RECORDS)[:-40]).estimated >= 1
    assert fit.file_type([]) == "unknown" and fit.file_type([{"global_num": 0, "part": 0, "fields": {"type": 77}}]) == "unknown_77"

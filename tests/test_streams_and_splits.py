"""Streams by name, beats, owners, and splits by distance."""

import struct

from fitlake.plans import activity
from fitlake.sinks.encode import encode, synthesize
from fitlake.sources import fit

from .test_checks import record, session
from .test_fit_fields import layout
from .test_fit_source import T0, build


def read(spark, folder, content):
    (folder / "a.fit").write_bytes(content)
    return fit.read_messages(spark, str(folder))


def test_streams_of_developers_too(spark, tmp_path):
    describe = layout(2, 206, [(0, 1, 2), (1, 1, 2), (2, 1, 2), (3, 12, 7)]) + b"\x02" + bytes((0, 7, 0x84)) + b"Form Power!\0"
    use = layout(1, 20, [(253, 4, 0x86), (6, 2, 0x84), (73, 4, 0x86)], [(7, 2, 0)])
    rows = b"".join(b"\x01" + struct.pack("<IHIH", T0 + k, 2000, 3000 + k * 1000, 40 + k) for k in range(3))
    messages = read(spark, tmp_path, build([], extra=describe + use + rows))
    owned = activity.session_records(messages)
    found = {r.stream: (r.n, r.avg, r.max) for r in activity.stream_totals(activity.long_streams(messages), owned).collect()}
    assert found == {"form_power": (3, 41.0, 42.0), "speed": (3, 4.0, 5.0)}


def test_beats_and_owners(spark, tmp_path):
    beats = layout(1, 78, [(0, 6, 0x84)]) + b"\x01" + struct.pack("<HHH", 800, 810, 0xFFFF) + layout(2, 78, [(0, 2, 0x84)]) + b"\x02" + struct.pack("<H", 790)
    assert [r.intervals_s for r in activity.hrv(read(spark, tmp_path, build([], extra=beats))).collect()] == [[0.8, 0.81, 0.79]]
    ids = [synthesize("file_id", {"manufacturer": m, "product": 5}) for m in (1, 2)]
    whole = encode([*ids, synthesize("user_profile", {"friendly_name": "ann", "weight": 70.5}), record(0)])
    (row,) = activity.owners(read(spark, tmp_path, whole)).collect()
    assert (row.manufacturer, row.product, row.friendly_name, row.weight, row.age) == ("1", "5", "ann", "70.5", None)


def brute(points, length):
    """(duration, distance, mean heart rate, climb) of splits, by walking along the points (t, d, hr, alt)."""
    out, held, start, at, before = [], [points[0]], points[0][0], points[0][1], points[0]
    edge, high, up = at + length, points[0][3], 0.0
    for p in points[1:]:
        while p[1] >= edge and p[1] > before[1]:
            cross = before[0] + (edge - before[1]) / (p[1] - before[1]) * (p[0] - before[0])
            out.append((cross - start, length, sum(x[2] for x in held) / len(held) if held else None, up if held else None))
            start, at, edge, held, up = cross, edge, edge + length, [], 0.0
        up += max(0.0, p[3] - high)
        high = p[3]
        held.append(p)
        before = p
    if before[1] - at > 0.5:
        out.append((before[0] - start, before[1] - at, sum(x[2] for x in held) / len(held), up))
    return out


def test_splits(spark, tmp_path):
    points, d = [], 7.0
    for k in range(300):
        points.append((k, round(d, 2), 100 + k % 40, 100.0 + (k % 30)))
        d += 3 + (k % 7) + (2500 if k == 200 else 0)
    rows = [record(t, distance=m, heart_rate=h, altitude=a) for t, m, h, a in points]
    messages = read(spark, tmp_path, encode([*rows, session(0, 299, sport="running")]))
    found = activity.distance_splits(activity.session_records(messages)).orderBy("split").collect()
    want = brute(points, 1000.0)
    assert len(found) == len(want) and [r.partial for r in found] == [False] * (len(want) - 1) + [True]
    for r, (seconds, metres, heart, up) in zip(found, want, strict=True):
        assert abs(r.duration_s - seconds) < 1e-5 and abs(r.distance_m - metres) < 1e-6 and abs(r.pace_s - seconds / metres * 1000) < 1e-4
        assert (r.avg_heart_rate is None) == (heart is None) and (heart is None or abs(r.avg_heart_rate - heart) < 1e-9)
        assert r.ascent_m == up

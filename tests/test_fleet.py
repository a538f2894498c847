"""Files made of events: how they are written, read and kept."""

import random
import struct

from pyspark.sql import functions as F

from fitlake.plans import activity, checks, document, fleet
from fitlake.plans.keep import keep
from fitlake.sources import fit

SF = "/root/testdata/sf0.001"


def event(event_id: int, n: int = 1, **more) -> fleet.Event:
    return fleet.Event(**{"user_id": 1, "event_id": event_id, "event_type": "view", "n": n, "t": fleet.T0 + 4 * n, "hr": 100, "power": None, "speed": 100, "distance": 3 * n, "altitude": 100, "cadence": 60} | more)


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_crc_of_all_lengths():
    def plain(data, crc=0):
        for byte in data:
            crc = (crc >> 8) ^ fit._CRC_BYTES[(crc ^ byte) & 0xFF]
        return crc

    dice = random.Random(1)
    for size in [*range(0, 12), 255, 256, 257, 258, 511, 512, 513, 4099, 70_001]:
        data = dice.randbytes(size)
        assert fit.crc16(data) == plain(data)
        assert fit.crc16(data, 0xBEEF) == plain(data, 0xBEEF)


def test_two_times_in_a_message():
    """The last that is known holds for what follows."""
    known, unknown = struct.pack("<I", fit.FIRST_ABSOLUTE + 64), b"\xff" * 4
    body = fleet.layout(0, 20, [(253, 4, 0x86), (253, 4, 0x86)]) + fleet.layout(1, 20, [(3, 1, 2)]) + b"\0" + known + unknown + bytes((0x80 | 1 << 5 | 3, 99))
    found = fit.parse(fleet.whole(body)).messages
    assert [m["fields"].get("timestamp") for m in found] == [None, fit.FIRST_ABSOLUTE + 67 + fit.EPOCH_OFFSET]


def test_pool_is_read_from_a_table(spark):
    """Files of pools are made and read once, however often the plan of a query names them."""
    for name in ("fit_swims", "fit_swolf"):
        plan = plan_of(getattr(fleet, name)(spark, SF))
        assert "MapIn" not in plan and "FlatMapGroups" not in plan


def test_files_of_several_users_share_a_batch(spark):
    """A user's file is whole, wherever batches end."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = {r.user_id: r.n for r in spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        files = fleet._files(fleet.rows(spark, SF), fleet.workout).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {int(r.file_id): sum(m["global_num"] == 20 for m in fit.parse(bytes(r.content)).messages) for r in files} == wanted
    assert len(files) == len(wanted)


def test_low_times_that_look_absent():
    """A low half of only ones can't be written as such."""
    first = (0xFFFF - (fleet.T0 - fit.EPOCH_OFFSET)) % 65536
    steps = [first, 59_990, 17]
    ids = [next(i for i in range(60_000) if i * 37 % 60_000 == step) for step in steps]
    found = fit.parse(fleet.whole(fleet._low_times([event(i, n) for n, i in enumerate(ids, 1)]))).messages[1:]
    assert [m["fields"]["timestamp"] - fleet.T0 for m in found] == [first, first + 59_990, first + 60_007]
    assert [m["fields"]["activity_type"] for m in found] == [i % 255 & 31 for i in ids]


def test_counters_that_look_absent():
    """A counter of only ones can't be written in four bytes."""
    ids = [999] * 7 + [302, 5, 999]
    found = fit.parse(fleet.whole(fleet._shared_bytes([event(i, n) for n, i in enumerate(ids, 1)]))).messages
    sums = [4_294_960_000 + sum(x % 1000 for x in ids[:n]) for n in range(1, len(ids) + 1)]
    assert sums[7] == 2**32 - 1
    assert [m["fields"]["accumulated_power"] for m in found] == sums


def test_tables_are_made_when_asked_for(spark, tmp_path):
    """Messages need no sessions, laps no records with their owners."""
    (tmp_path / "events.parquet").symlink_to(f"{SF}/events.parquet")
    made = lambda: {name for _, sf_dir, name in fleet._WRITTEN if sf_dir == str(tmp_path)}
    assert fleet.fit_messages(spark, str(tmp_path)).count() and made() == {"messages"}
    assert fleet.fit_laps(spark, str(tmp_path)).count() and made() == {"messages", "sessions"}


def test_gaps_that_meet_at_a_stop(spark):
    """A stop where two gaps meet lies in both; gaps and stops meet on a sorted line, not in pairs."""
    t0 = fleet.T0
    rows = [fleet.synthesize("record", {"timestamp": t0 + s}) for s in (0, 40, 80, 120, 160)]
    stops = [fleet._timer(t0 + 40, "stop_all", 1), fleet._timer(t0 + 100, "stop", 0), fleet._timer(t0 + 90, "stop", 1)]
    found = keep(fit.messages_of(spark.createDataFrame([("a", bytearray(fleet.encode([*rows, *stops])))], "file_id string, content binary")), "found")
    held, owned = activity.kept(found)
    gaps = activity.gaps(owned, found, held=held)
    assert [(r.t // 10**6 - t0, r.kind) for r in gaps.orderBy("t").collect()] == [(0, "auto_pause"), (40, "auto_pause"), (80, "manual_stop"), (120, "post_timer")]
    assert not [line for line in plan_of(gaps).splitlines() if "Join" in line and "stop_t" in line and "end_t" in line]


def held_at_once(monkeypatch, query, spark, sf_dir):
    """The most files of which messages are held at once while a query's Python function runs over one batch of all."""
    import weakref

    import pyarrow as pa

    class Found(fit.Parsed):
        pass

    alive, most, batch = weakref.WeakSet(), [0], []
    content = fleet.encode(fleet._workout([event(k, k) for k in range(1, 9)]))

    def parse(data):
        out = Found(messages=[{"global_num": 20}])
        alive.add(out)
        most[0] = max(most[0], len(alive))
        return out

    def caught(self, run, schema):
        batch.append(run)
        return self

    monkeypatch.setattr(Found, "__hash__", object.__hash__)
    monkeypatch.setattr(fit, "parse", parse)
    monkeypatch.setattr(fleet, "_files", lambda found, build: found)
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", caught)
    query(spark, sf_dir)
    rows = pa.RecordBatch.from_pydict({"file_id": [str(k) for k in range(50)], "content": [content] * 50})
    assert sum(x.num_rows for x in batch[-1](iter([rows]))) == 50
    return most[0]


def test_damage_holds_one_file(spark, monkeypatch):
    """Messages of a file are let go before the next is read."""
    assert held_at_once(monkeypatch, fleet.fit_damage, spark, SF) <= 2


def test_verbs_are_done_once(spark):
    """What a verb writes is kept, however often the plan of a query names it."""
    for name in ("fit_trimmed", "fit_edited"):
        assert "MapIn" not in plan_of(getattr(fleet, name)(spark, SF))


def test_streams_without_maps_of_whole_sessions(spark):
    """Enhanced fields win, rows without a stream have null, and no map of all rows is searched for each of them."""
    rows = [fleet.synthesize("record", {"timestamp": fleet.T0 + k, "speed": 1.0, "enhanced_speed": 2.0 if k != 1 else None, "heart_rate": 90 + k if k else None}) for k in range(3)]
    found = keep(fit.messages_of(spark.createDataFrame([("a", bytearray(fleet.encode(rows)))], "file_id string, content binary")), "found")
    out = document.session_streams(found, activity.kept(found)[1])
    assert "stream" in plan_of(out) and "map_from_entries(collect_list" not in plan_of(out)
    row = out.collect()[0]
    assert row.times == [fleet.T0, fleet.T0 + 1, fleet.T0 + 2]
    assert [(x.stream, x["values"]) for x in row.streams] == [("heart_rate", [None, 91.0, 92.0]), ("speed", [2.0, 1.0, 2.0])]


def test_findings_take_given_tables(spark, monkeypatch):
    """Sessions and owners that are there are not made anew."""
    found = fleet.messages(spark, SF)
    held, owned = fleet._held(spark, SF), fleet._owned(spark, SF)
    monkeypatch.setattr(activity, "kept", None)
    assert checks.findings(found, held, owned).columns == ["file_id", "part", "session", "code", "value"]

"""Activity files made of the driver's events, and the whole path from bytes to reports as queries on them.

A user is an athlete with one file, an event is a record of it. The files are written by the encoder (or byte
by byte, for layouts that the encoder doesn't write), read by the parser, and go through the model; the SQL
beside each query says the same of the events alone.
"""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import series, verbs
from ..sinks.encode import encode, synthesize
from ..sources import fit
from . import activity, checks, document, structure
from .keep import keep
from .queries import query, table

#: Seconds of the first record, between records, of a stop before an error, of a pause before a signup.
T0, STEP_S, STOP_S, PAUSE_S = 1_700_000_000, 4, 43, 16
LAP_RECORDS = 20
#: Bytes of files that go on together, and tasks for each core that make files: their times differ.
FILES_BYTES, TASKS_PER_CORE = 4 << 20, 3
ZONES = (110, 130, 150)

#: The records of all oracles.
_N = """(SELECT user_id, event_id, event_type, value, row_number() OVER w AS n,
  sum((event_type = 'error')::INT) OVER w AS k, sum((event_type = 'signup')::INT) OVER w AS s
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
_R = f"""(SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY n) - t AS dt FROM (
  SELECT user_id, event_id, event_type, n, ({T0} + {STEP_S} * n + {STOP_S} * k + {PAUSE_S} * s)::BIGINT AS t,
    CASE WHEN event_id % 13 <> 0 THEN 90 + event_id % 90 END AS hr,
    CASE WHEN event_id % 17 <> 0 THEN CASE WHEN (n // 8) % 2 = 1 THEN 300 ELSE 120 END + event_id % 10 END AS power,
    (event_id % 50) / 10.0 AS speed, 3.0 * n AS distance, 100.0 + event_id * 7 % 41 AS altitude, 60 + event_id % 60 AS cadence
  FROM {_N}))"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as records, with whole seconds as t."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    i = F.col("event_id")
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    df = table(spark, sf_dir, "events").repartition(tasks, "user_id").withColumn("n", F.row_number().over(w))
    for name, kind in (("k", "error"), ("s", "signup")):
        df = df.withColumn(name, F.sum((F.col("event_type") == kind).cast("int")).over(w))
    power = F.when(F.floor(F.col("n") / 8) % 2 == 1, 300).otherwise(120) + i % 10
    return df.select(
        "user_id", "event_id", "event_type", "n", (T0 + STEP_S * F.col("n") + STOP_S * F.col("k") + PAUSE_S * F.col("s")).alias("t"),
        F.when(i % 13 != 0, 90 + i % 90).alias("hr"), F.when(i % 17 != 0, power).alias("power"), (i % 50 * 100).alias("speed"),
        (3 * F.col("n")).alias("distance"), (100 + i * 7 % 41).alias("altitude"), (60 + i % 60).alias("cadence"),
    )


class Event(NamedTuple):
    """A row of ``rows``."""

    user_id: int
    event_id: int
    event_type: str
    n: int
    t: int
    hr: int | None
    power: int | None
    speed: int
    distance: int
    altitude: int
    cadence: int


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[Event]:
    for batch in batches:
        yield from map(Event._make, zip(*(column.to_pylist() for column in batch.columns), strict=True))


def _files(found: DataFrame, build: Callable[[list[Event]], bytes]) -> DataFrame:
    """(file_id, content) of each user's file."""

    def batch_of(ids: list[str], contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(contents, pa.binary())], names=["file_id", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, contents, size = [], [], 0
        for user_id, user in groupby(_events(batches), key=lambda x: x.user_id):
            ids.append(str(user_id))
            contents.append(build(list(user)))
            size += len(contents[-1])
            if size >= FILES_BYTES:
                yield batch_of(ids, contents)
                ids, contents, size = [], [], 0
        if ids:
            yield batch_of(ids, contents)

    # A user's rows lie in one partition, see rows(); sorted there, they come one user after the other.
    return found.select(*Event._fields).sortWithinPartitions("user_id", "n").mapInArrow(run, "file_id string, content binary")


def _timer(t: int, kind: str, data: int | None = None) -> dict:
    return synthesize("event", {"timestamp": t, "event": "timer", "event_type": kind, "data": data})


def _workout(user: list[Event]) -> list[dict]:
    """The messages of a file with records, laps, a session that says more distance than there is, zones, and stops before errors."""
    t, uid = [x.t for x in user], user[0].user_id
    span, metres = t[-1] - t[0], 3 * (len(t) - 1)
    maker = {"type": "activity", "time_created": t[0], "manufacturer": 1, "product": uid % 50, "serial_number": 1000 + uid}
    out = [synthesize("file_id", maker)]
    out.append(synthesize("user_profile", {"friendly_name": f"user {uid}", "age": 20 + uid % 50}))
    out += [synthesize("hr_zone", {"message_index": k, "high_bpm": bound}) for k, bound in enumerate(ZONES)]
    out.append(_timer(t[0], "start"))
    before = None
    for x in user:
        if before is not None and x.event_type == "error" and x.event_id % 4 != 3:
            out += [_timer(before + 1, "stop_all", 1 if x.event_id % 4 == 1 else 0), _timer(x.t, "start")]
        values = {"timestamp": x.t, "heart_rate": x.hr, "power": x.power, "speed": x.speed / 1000, "distance": x.distance, "altitude": x.altitude, "cadence": x.cadence}
        out.append(synthesize("record", values))
        before = x.t
    for k, at in enumerate(range(0, len(t), LAP_RECORDS)):
        held = t[at : at + LAP_RECORDS]
        out.append(synthesize("lap", {"timestamp": held[-1], "message_index": k, "start_time": held[0], "total_elapsed_time": held[-1] - held[0], "total_distance": 3 * (len(held) - 1), "lap_trigger": "distance"}))
    said = {"total_elapsed_time": span, "total_timer_time": span / 2, "total_distance": metres * 1.1 if uid % 3 == 0 else metres, "avg_heart_rate": 100, "max_heart_rate": 250}
    out.append(synthesize("session", {"timestamp": t[-1], "message_index": 0, "start_time": t[0], "sport": "running" if uid % 2 else "cycling"} | said))
    out.append(synthesize("activity", {"timestamp": t[-1], "num_sessions": 1, "total_timer_time": span / 2}))
    return out


def workout(user: list[Event]) -> bytes:
    return encode(_workout(user))


def workouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(rows(spark, sf_dir), workout)


#: The tables of each fleet, written once in an application, each when it is first asked for: messages, sessions, records with their owners.
_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def _written(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _WRITTEN:
        _WRITTEN[key] = keep(make(), name)
    return _WRITTEN[key]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "messages", lambda: fit.messages_of(workouts(spark, sf_dir)))


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "sessions", lambda: activity.sessions(messages(spark, sf_dir)))


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "owned", lambda: activity.session_records(messages(spark, sf_dir), _held(spark, sf_dir)))


def _fleet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return messages(spark, sf_dir), _held(spark, sf_dir), _owned(spark, sf_dir)


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of the files of pool lengths, which queries read several times."""
    return _written(spark, sf_dir, "pool", lambda: fit.messages_of(_files(rows(spark, sf_dir), swim)))


def _user() -> Column:
    return F.col("file_id").cast("long").alias("user_id")


_SECONDS = lambda c: (F.col(c) / series.MICROS).cast("long").alias(c)


@query(f"""SELECT user_id, global_num, count(*) AS n FROM (
  SELECT user_id, unnest([0, 3, 8, 8, 8, 21, 18, 34]) AS global_num FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, 20 FROM events
  UNION ALL SELECT user_id, 19 FROM {_N} WHERE (n - 1) % {LAP_RECORDS} = 0
  UNION ALL SELECT user_id, unnest([21, 21]) FROM {_N} WHERE n > 1 AND event_type = 'error' AND event_id % 4 <> 3) GROUP BY ALL""")
def fit_messages(spark, sf_dir):
    """What the parser finds in what the encoder wrote: messages by kind."""
    return messages(spark, sf_dir).groupBy(_user(), F.col("global_num").cast("long").alias("global_num")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT user_id, t, hr::DOUBLE AS heart_rate, power::DOUBLE AS power, speed::DOUBLE AS speed, distance::DOUBLE AS distance, altitude::DOUBLE AS altitude, cadence::DOUBLE AS cadence FROM {_R}")
def fit_records(spark, sf_dir):
    found = activity.records(messages(spark, sf_dir))
    return found.select(_user(), _SECONDS("t"), "heart_rate", "power", "speed", "distance", "altitude", "cadence")


@query(f"""SELECT user_id, 0 AS session, min(t) AS a, max(t) AS b, CASE WHEN user_id % 2 = 1 THEN 'running' ELSE 'cycling' END AS sport,
  round(3 * (count(*) - 1) * CASE WHEN user_id % 3 = 0 THEN 1.1 ELSE 1 END, 2)::DOUBLE AS distance_m, (max(t) - min(t))::DOUBLE AS elapsed_time_s, false AS rebuilt
FROM {_R} GROUP BY user_id""")
def fit_sessions(spark, sf_dir):
    held = _held(spark, sf_dir)
    return held.select(_user(), F.col("session").cast("int").alias("session"), _SECONDS("a"), _SECONDS("b"), "sport", "declared.distance_m", "declared.elapsed_time_s", "rebuilt")


_TIMER = f"""(SELECT user_id, ((max(t) - min(t)) - {STOP_S + STEP_S - 1} * count(*) FILTER (n > 1 AND event_type = 'error' AND event_id % 4 <> 3))::DOUBLE AS timer_time_s
FROM {_R} GROUP BY user_id)"""


@query(f"""SELECT user_id, count(*) AS n_records, (max(t) - min(t))::DOUBLE AS elapsed_time_s, 3.0::DOUBLE * (count(*) - 1) AS distance_m,
  sum(least(dt, 30)) FILTER (dt > 0 AND speed > 0.1)::DOUBLE AS moving_time_s, round(avg(hr), 6) AS avg_heart_rate, max(hr)::DOUBLE AS max_heart_rate,
  round(avg(power), 6) AS avg_power, max(power)::DOUBLE AS max_power, round(avg(speed), 6) AS avg_speed, max(timer_time_s) AS timer_time_s
FROM {_R} JOIN {_TIMER} USING (user_id) GROUP BY user_id HAVING count(*) > 1""")
def fit_derived_totals(spark, sf_dir):
    found, held, owned = _fleet(spark, sf_dir)
    totals = activity.derived_totals(owned, found, held).where("n_records > 1")
    mean = lambda c: F.round(c, 6).alias(c)
    return totals.select(_user(), "n_records", "elapsed_time_s", "distance_m", F.nullif("moving_time_s", F.lit(0.0)).alias("moving_time_s"), mean("avg_heart_rate"), "max_heart_rate", mean("avg_power"), "max_power", mean("avg_speed"), "timer_time_s")


@query(f"SELECT user_id, timer_time_s FROM {_TIMER}")
def fit_timer(spark, sf_dir):
    found, held, owned = _fleet(spark, sf_dir)
    timed = activity.timer_seconds(activity.timers(owned, found, held))
    return timed.select(_user(), "timer_time_s")


@query(f"""SELECT user_id, t - dt AS t, t AS end_t, CASE WHEN event_type = 'signup' THEN 'smart_recording' WHEN event_id % 4 = 3 THEN 'unknown'
  WHEN event_id % 4 = 1 THEN 'auto_pause' ELSE 'manual_stop' END AS kind
FROM (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY n) AS dt FROM (SELECT user_id, event_id, event_type, n, t FROM {_R})) WHERE dt >= 10""")
def fit_gaps(spark, sf_dir):
    found, held, owned = _fleet(spark, sf_dir)
    return activity.gaps(owned, found, held=held).select(_user(), _SECONDS("t"), _SECONDS("end_t"), "kind")


@query(f"""SELECT user_id, min(t) AS t, max(t) AS end_t, (max(t) - min(t))::DOUBLE AS elapsed_s, 3.0::DOUBLE * (count(*) - 1) AS distance_m, 0 AS session
FROM {_R} GROUP BY user_id, (n - 1) // {LAP_RECORDS}""")
def fit_laps(spark, sf_dir):
    found = activity.laps(messages(spark, sf_dir), _held(spark, sf_dir))
    return found.select(_user(), _SECONDS("t"), _SECONDS("end_t"), "elapsed_s", "distance_m", F.col("session").cast("int").alias("session"))


@query(f"""SELECT u.user_id, g.zone, coalesce(s, 0)::DOUBLE AS seconds, 'file:hr_zone' AS basis
FROM (SELECT DISTINCT user_id FROM {_R} WHERE hr IS NOT NULL) u CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS zone) g
LEFT JOIN (SELECT user_id, (hr > 110)::INT + (hr > 130)::INT + (hr > 150)::INT AS zone, sum(least(dt, 30)) AS s FROM {_R} WHERE dt > 0 AND hr IS NOT NULL GROUP BY 1, 2) z
  ON z.user_id = u.user_id AND z.zone = g.zone""")
def fit_zones(spark, sf_dir):
    found, _, owned = _fleet(spark, sf_dir)
    return activity.time_in_zones(owned, found, "heart_rate").select(_user(), "zone", "seconds", "basis")


@query(f"""WITH w AS (SELECT user_id, round(pow(avg(CASE WHEN rn >= 30 THEN pow(m, 4) END), 0.25), 4) AS weighted_power FROM (
  SELECT user_id, row_number() OVER p AS rn, avg(power) OVER (PARTITION BY user_id ORDER BY n ROWS 29 PRECEDING) AS m FROM {_R} WHERE power IS NOT NULL WINDOW p AS (PARTITION BY user_id ORDER BY n)) GROUP BY user_id),
b AS (SELECT user_id, round(max(m5), 4) AS best_5 FROM (SELECT user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY n) >= 5
  AND count(power) OVER (PARTITION BY user_id ORDER BY n ROWS 4 PRECEDING) >= 5 THEN avg(power) OVER (PARTITION BY user_id ORDER BY n ROWS 4 PRECEDING) END AS m5 FROM {_R}) GROUP BY user_id),
e AS (SELECT user_id, round(sum(power * least(dt, 30)) FILTER (dt > 0) / 1000.0, 6) AS work_kj, (sum(least(dt, 30)) FILTER (dt > 0 AND hr IS NOT NULL))::DOUBLE AS hr_s,
  round(sum(least(dt, 30) / 60.0 * r * 0.64 * exp(1.92 * r)) FILTER (dt > 0), 6) AS trimp FROM (SELECT *, least(1, greatest(0, (hr - 50) / 140.0)) AS r FROM {_R}) GROUP BY user_id)
SELECT user_id, work_kj, hr_s, trimp, weighted_power, best_5 FROM e LEFT JOIN w USING (user_id) LEFT JOIN b USING (user_id)""")
def fit_effort(spark, sf_dir):
    found = activity.effort(_owned(spark, sf_dir), max_hr=190, rest_hr=50)
    near = lambda c, d: F.round(c, d).alias(c)
    return found.select(_user(), near("work_kj", 6), "hr_s", near("trimp", 6), near("weighted_power", 4), near("best_5", 4))


@query(f"""WITH d AS (SELECT user_id, (max(t) - min(t))::DOUBLE AS span, 3.0::DOUBLE * (count(*) - 1) AS m, avg(hr) AS hr, max(hr)::DOUBLE AS top, max(timer_time_s) AS timer
  FROM {_R} JOIN {_TIMER} USING (user_id) GROUP BY user_id HAVING count(*) > 1),
f AS (SELECT user_id, 'timer_time_s' AS field, span / 2 AS declared, timer AS derived, greatest(2, 0.02 * span / 2) AS most FROM d
  UNION ALL SELECT user_id, 'distance_m', round(m * CASE WHEN user_id % 3 = 0 THEN 1.1 ELSE 1 END, 2), m, greatest(10, 0.02 * round(m * CASE WHEN user_id % 3 = 0 THEN 1.1 ELSE 1 END, 2)) FROM d
  UNION ALL SELECT user_id, 'avg_heart_rate', 100, hr, 3 FROM d UNION ALL SELECT user_id, 'max_heart_rate', 250, top, 7.5 FROM d)
SELECT user_id, field, declared::DOUBLE AS declared, round(derived, 6) AS derived FROM f WHERE abs(derived - declared) > most""")
def fit_discrepancies(spark, sf_dir):
    found, held, owned = _fleet(spark, sf_dir)
    out = activity.discrepancies(held, activity.derived_totals(owned, found, held).where("n_records > 1"))
    return out.select(_user(), "field", "declared", F.round("derived", 6).alias("derived"))


@query(f"""WITH RECURSIVE r AS (SELECT user_id, n, altitude AS ref, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM {_R} WHERE n = 1
  UNION ALL SELECT x.user_id, x.n, CASE WHEN abs(x.altitude - ref) >= 3 THEN x.altitude ELSE ref END, up + CASE WHEN x.altitude - ref >= 3 THEN x.altitude - ref ELSE 0 END,
    down + CASE WHEN ref - x.altitude >= 3 THEN ref - x.altitude ELSE 0 END FROM r JOIN {_R} x ON x.user_id = r.user_id AND x.n = r.n + 1)
SELECT user_id, max(up)::DOUBLE AS ascent_m, max(down)::DOUBLE AS descent_m FROM r GROUP BY user_id""")
def fit_ascent(spark, sf_dir):
    found = series.ascent(_owned(spark, sf_dir), activity.OWN, activity.ORDER, "altitude")
    return found.select(_user(), F.col("ascent").alias("ascent_m"), F.col("descent").alias("descent_m"))


@query(f"""WITH s AS (SELECT user_id, n, t, hr, power, (distance - 3)::DOUBLE AS d, altitude - lag(altitude) OVER (PARTITION BY user_id ORDER BY n) AS climb, floor((distance - 3) / 50.0)::BIGINT + 1 AS split FROM {_R}),
c AS (SELECT user_id, k AS split, t0 + ((round((k * 50 - d0) / (d - d0) * (t - t0) * 1000000))::BIGINT) / 1000000.0 AS finish FROM (
  SELECT *, unnest(range(floor(d0 / 50.0)::BIGINT + 1, floor(d / 50.0)::BIGINT + 1)) AS k FROM (
    SELECT *, lag(d) OVER (PARTITION BY user_id ORDER BY n) AS d0, lag(t) OVER (PARTITION BY user_id ORDER BY n) AS t0 FROM s) WHERE d > d0)),
h AS (SELECT user_id, split, avg(hr) AS hr, max(d) AS last_d, max(t) AS last_t, coalesce(sum(climb) FILTER (climb > 0), 0) AS up FROM s GROUP BY ALL),
e AS (SELECT user_id, split, finish, 50.0 AS metres, false AS partial FROM c
  UNION ALL SELECT user_id, split, last_t, last_d - (split - 1) * 50.0, true FROM h ANTI JOIN c USING (user_id, split) WHERE last_d - (split - 1) * 50.0 > 0.5)
SELECT e.user_id, e.split, round((finish - coalesce(lag(finish) OVER (PARTITION BY e.user_id ORDER BY e.split), f))::DOUBLE, 3) AS duration_s, metres::DOUBLE AS distance_m, partial, round(hr, 6) AS avg_heart_rate, up::DOUBLE AS ascent_m
FROM e JOIN h USING (user_id, split) JOIN (SELECT user_id, min(t) AS f FROM s GROUP BY 1 HAVING count(*) > 1) x ON x.user_id = e.user_id""")
def fit_splits(spark, sf_dir):
    found = activity.distance_splits(_owned(spark, sf_dir), 50.0)
    return found.select(_user(), "split", F.round("duration_s", 3).alias("duration_s"), "distance_m", "partial", F.round("avg_heart_rate", 6).alias("avg_heart_rate"), F.col("ascent_m").cast("double").alias("ascent_m"))


_SMOOTH = f"(SELECT user_id, n, t, power, median(power) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS v FROM {_R} WHERE power IS NOT NULL)"
_BANDS = f"""(SELECT user_id, n, t, power, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'recovery') AS state FROM (
  SELECT s.*, CASE WHEN v >= 1.10 * reference THEN 'work' WHEN v <= 0.85 * reference THEN 'recovery' END AS c FROM {_SMOOTH} s JOIN (
    SELECT user_id, (h[1 + floor(0.2 * (len(h) - 1))::INT] + h[1 + floor(0.8 * (len(h) - 1))::INT]) / 2 AS reference FROM (
      SELECT user_id, list_sort(list(v)) AS h FROM {_SMOOTH} WHERE v > 0 GROUP BY user_id)) USING (user_id)))"""
#: Runs of a state without stubs: a short one has the state of the last that wasn't.
_MERGED = f"""(SELECT user_id, run2, any_value(kind2) AS kind, min(a) AS a, max(b) AS b, sum(x * m) / sum(m) AS intensity, sum(m) AS m FROM (
  SELECT *, sum(CASE WHEN kind2 = before THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY run) AS run2 FROM (
    SELECT *, lag(kind2) OVER (PARTITION BY user_id ORDER BY run) AS before FROM (
      SELECT *, coalesce(last_value(CASE WHEN b - a >= CASE state WHEN 'work' THEN 20 ELSE 15 END THEN state END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'recovery') AS kind2 FROM (
        SELECT user_id, run, state, min(t) AS a, max(t) AS b, avg(power) AS x, count(*) AS m FROM (
          SELECT *, sum(CASE WHEN state = p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS run FROM (
            SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY n) AS p FROM {_BANDS})) GROUP BY user_id, run, state)))) GROUP BY user_id, run2)"""
_CLEAR = f"""(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY run2) AS i, kind, a, b, (b - a)::DOUBLE AS duration, intensity FROM {_MERGED} WHERE user_id IN (
  SELECT user_id FROM {_MERGED} GROUP BY user_id HAVING count(*) FILTER (kind = 'work') >= 3 AND sum(m) >= 11
    AND coalesce(stddev_pop(b - a) FILTER (kind = 'work'), 0) <= 0.40 * avg(b - a) FILTER (kind = 'work')))"""
_REPEATS = f"""(WITH RECURSIVE c AS (SELECT * FROM {_CLEAR}), w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM c WHERE kind = 'work'),
r AS (SELECT user_id, i, k, duration AS d, intensity AS v, 1 AS repeat FROM w WHERE k = 1
  UNION ALL SELECT w.user_id, w.i, w.k, CASE WHEN same THEN r.d ELSE w.duration END, CASE WHEN same THEN r.v ELSE w.intensity END, r.repeat + (NOT same)::INT FROM r JOIN w ON w.user_id = r.user_id AND w.k = r.k + 1,
    LATERAL (SELECT abs(r.d - w.duration) <= 0.25 * greatest(r.d, w.duration) AND abs(r.v - w.intensity) <= 0.10 * greatest(r.v, w.intensity) AS same))
SELECT c.user_id, c.i, c.kind, c.a, c.b, c.duration, c.intensity, r.repeat FROM c LEFT JOIN r ON r.user_id = c.user_id AND r.i = c.i)"""


@query(f"SELECT user_id, i::BIGINT AS place, kind, a AS first_t, b AS last_t, duration AS duration_s, round(intensity, 6) AS intensity, repeat::INT AS repeat FROM {_REPEATS}")
def fit_intervals(spark, sf_dir):
    """Bands of power, runs without stubs, the gates on what is clear, and repeats by the first of each group."""
    found = structure.intervals(_owned(spark, sf_dir), "power")
    return found.select(_user(), F.col("index").cast("long").alias("place"), "kind", _SECONDS("first_t"), _SECONDS("last_t"), "duration_s", F.round("intensity", 6).alias("intensity"), "repeat")


@query(f"""SELECT user_id, repeat::INT AS repeat, count(*) AS n, round(avg(duration), 6) AS duration_s, round(avg(intensity), 6) AS intensity, round(avg(rest), 6) AS rest_s FROM (
  SELECT *, CASE WHEN after_kind = 'recovery' AND next_work = repeat THEN after_s END AS rest FROM (
    SELECT *, lead(kind) OVER (PARTITION BY user_id ORDER BY i) AS after_kind, lead(duration) OVER (PARTITION BY user_id ORDER BY i) AS after_s FROM {_REPEATS}) x
  LEFT JOIN (SELECT user_id, i, lead(repeat) OVER (PARTITION BY user_id ORDER BY i) AS next_work FROM {_REPEATS} WHERE kind = 'work') USING (user_id, i) WHERE kind = 'work')
GROUP BY user_id, repeat HAVING count(*) >= 2""")
def fit_repeat_groups(spark, sf_dir):
    found = structure.repeat_groups(structure.intervals(_owned(spark, sf_dir), "power"))
    near = lambda c: F.round(c, 6).alias(c)
    return found.select(_user(), "repeat", "n", near("duration_s"), near("intensity"), near("rest_s"))


@query(f"""WITH l AS (SELECT user_id, max(t) - min(t) AS d FROM {_R} GROUP BY user_id, (n - 1) // {LAP_RECORDS})
SELECT user_id, 'LAP_ZERO_DURATION' AS code, count(*)::DOUBLE AS value FROM l WHERE d = 0 GROUP BY user_id
UNION ALL SELECT user_id, 'LAP_COVERAGE_GAP', s::DOUBLE FROM (SELECT user_id, sum(d) AS s FROM l GROUP BY user_id) JOIN (SELECT user_id, max(t) - min(t) AS span FROM {_R} GROUP BY user_id) USING (user_id) WHERE span > 0 AND s < 0.9 * span""")
def fit_findings(spark, sf_dir):
    """What is doubtful about laps."""
    found = checks.findings(*_fleet(spark, sf_dir)).where(F.col("code").isin("LAP_ZERO_DURATION", "LAP_COVERAGE_GAP"))
    return found.select(_user(), "code", "value")


@query(f"""SELECT user_id, avg_speed * 0 + CASE WHEN user_id % 2 = 1 THEN 0 ELSE 1 END AS cycling, n_streams FROM (
  SELECT user_id, avg(speed) AS avg_speed, 2 + (count(hr) > 0)::INT + (count(power) > 0)::INT + 2 AS n_streams FROM {_R} GROUP BY user_id)""")
def fit_streams(spark, sf_dir):
    """How many streams each athlete's records hold, by cleaned names."""
    found = messages(spark, sf_dir)
    names = activity.long_streams(found).groupBy("file_id").agg(F.count_distinct("stream").alias("n_streams"))
    held = activity.sessions(found).select("file_id", (F.col("sport") == "cycling").cast("double").alias("cycling"))
    return names.join(held, "file_id").select(_user(), "cycling", "n_streams")


@query(f"""SELECT user_id, round_even(timer_time_s, 1) AS duration_s, round_even(m, 1) AS distance_m, CASE WHEN m > 0 THEN round_even(moving / m * 1000, 1) END AS pace_s_per_km, n_records,
  CASE WHEN weighted IS NOT NULL THEN 'power' WHEN least(1, hr_s / timer_time_s) >= 0.5 THEN 'hr-trimp' END AS load_basis
FROM (SELECT user_id, count(*) AS n_records, 3.0::DOUBLE * (count(*) - 1) AS m, (sum(least(dt, 30)) FILTER (dt > 0 AND speed > 0.1))::DOUBLE AS moving,
    sum(least(dt, 30)) FILTER (dt > 0 AND hr IS NOT NULL) AS hr_s, CASE WHEN count(power) >= 30 THEN 1 END AS weighted FROM {_R} GROUP BY user_id HAVING count(*) >= 10) JOIN {_TIMER} USING (user_id)""")
def fit_report(spark, sf_dir):
    """A report per session: durations, distance and pace by their ladders, the basis of the load."""
    found = activity.report(messages(spark, sf_dir), ftp=250, max_hr=190, rest_hr=50).where("n_records >= 10")
    return found.select(_user(), "duration_s", "distance_m", "pace_s_per_km", "n_records", "load_basis")


@query(f"SELECT user_id, 1 AS manufacturer, user_id % 50 AS product, 'user ' || user_id AS friendly_name, 20 + user_id % 50 AS age FROM (SELECT DISTINCT user_id FROM events)")
def fit_owners(spark, sf_dir):
    """The first message of a kind says whose file it is."""
    found = activity.owners(messages(spark, sf_dir))
    return found.select(_user(), F.col("manufacturer").cast("int").alias("manufacturer"), F.col("product").cast("long").alias("product"), "friendly_name", F.col("age").cast("long").alias("age"))


@query(f"""SELECT user_id, 1 AS schema, 'activity' AS file_type, count(*) AS n_times, count(hr) AS n_hr, sum(distance)::DOUBLE AS distance, (count(*) + {LAP_RECORDS - 1}) // {LAP_RECORDS} AS n_laps,
  6 + 2 + (count(*) + {LAP_RECORDS - 1}) // {LAP_RECORDS} + 2 * count(*) FILTER (n > 1 AND event_type = 'error' AND event_id % 4 <> 3) AS n_messages FROM {_R} GROUP BY user_id""")
def fit_documents(spark, sf_dir):
    """One document per file: its session with streams and laps, and the messages that aren't records."""
    found = document.documents(messages(spark, sf_dir))
    stream = "struct<stream:string,values:array<double>>"
    shape = f"struct<schema:int,parts:array<struct<file_type:string,sessions:array<struct<times:array<long>,laps:array<struct<t:long>>,streams:array<{stream}>>>,messages:array<struct<name:string>>>>>"
    part = F.col("d.parts")[0]
    one = found.withColumn("d", F.from_json("document", shape)).select(_user(), F.col("d.schema").alias("schema"), part["file_type"].alias("file_type"), part["sessions"][0].alias("s"), F.size(part["messages"]).cast("long").alias("n_messages"))
    values = lambda name: F.filter("s.streams", lambda x: x["stream"] == name)[0]["values"]
    total = F.aggregate(values("distance"), F.lit(0.0), lambda acc, x: acc + x)
    return one.select(
        "user_id", "schema", "file_type", F.size("s.times").cast("long").alias("n_times"), F.coalesce(F.size(F.array_compact(values("heart_rate"))), F.lit(0)).cast("long").alias("n_hr"),
        total.alias("distance"), F.size("s.laps").cast("long").alias("n_laps"), "n_messages",
    )


# Pools.


def swim(user: list[Event]) -> bytes:
    """A file of pool lengths, with a rest of 15 s before an error and 2 s before others."""
    at, out = T0, []
    for x in user:
        at += 15 if x.event_type == "error" else 2
        elapsed = 20 + x.event_id % 10 + 0.5 * (x.event_id % 2)
        end = at + 20 + x.event_id % 10
        out.append(synthesize("length", {"timestamp": end, "message_index": x.n - 1, "start_time": at, "total_elapsed_time": elapsed, "total_strokes": 10 + x.event_id % 8, "length_type": int(x.event_id % 9 != 0)}))
        at = end
    total = synthesize("session", {"timestamp": at, "start_time": T0, "sport": "swimming", "total_elapsed_time": at - T0, "total_distance": 25 * len(user), "pool_length": 25})
    return encode([synthesize("file_id", {"type": "activity", "time_created": T0}), *out, total])


_SWIM = f"""(SELECT *, {T0} + sum(gap + secs) OVER (PARTITION BY user_id ORDER BY n) AS e FROM (SELECT user_id, event_id, n, CASE WHEN event_type = 'error' THEN 15 ELSE 2 END AS gap,
  20 + event_id % 10 AS secs, 20 + event_id % 10 + 0.5 * (event_id % 2) AS elapsed, 10 + event_id % 8 AS strokes, event_id % 9 <> 0 AS active FROM {_N}))"""


@query(f"SELECT user_id, round(avg(round_even(strokes + elapsed, 0)), 6) AS swolf FROM {_SWIM} WHERE active GROUP BY user_id")
def fit_swolf(spark, sf_dir):
    found = activity.swolf(activity.lengths(_pool(spark, sf_dir)))
    return found.select(_user(), F.round("swolf", 6).alias("swolf"))


@query(f"""SELECT user_id, s AS place, count(*) AS lengths, sum(elapsed)::DOUBLE AS duration_s, 25.0::DOUBLE * count(*) AS distance_m FROM (
  SELECT *, sum(CASE WHEN e - secs - p < 10 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS s FROM (
    SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY n) AS p FROM {_SWIM} WHERE active)) GROUP BY user_id, s""")
def fit_swims(spark, sf_dir):
    """Swims of a pool: a rest of 10 s at the wall ends one, and so does a length that isn't active, if it is long enough."""
    found = _pool(spark, sf_dir)
    held = _written(spark, sf_dir, "pool_sessions", lambda: activity.sessions(found))
    out = structure.swim_intervals(structure.with_signal(activity.session_records(found, held), held), found, held)
    return out.select(_user(), F.col("place").cast("long").alias("place"), "lengths", "duration_s", "distance_m")


# Bytes that the encoder doesn't write.


def whole(body: bytes) -> bytes:
    header = struct.pack("<BBHI4s", 14, 0x20, 21141, len(body), b".FIT")
    held = header + struct.pack("<H", fit.crc16(header)) + body
    return held + struct.pack("<H", fit.crc16(held))


def layout(local: int, number: int, fields: list[tuple[int, int, int]], developer: list[tuple[int, int, int]] = (), big: bool = False) -> bytes:
    """A definition; ``developer`` has (number, size, index)."""
    head = bytes((0x40 | 0x20 * bool(developer) | local, 0, int(big))) + struct.pack(">H" if big else "<H", number) + bytes((len(fields),))
    out = head + b"".join(map(bytes, fields))
    return out + (bytes((len(developer),)) + b"".join(map(bytes, developer)) if developer else b"")


def wire_messages(spark: SparkSession, sf_dir: str, build: Callable[[list[Event]], bytes]) -> DataFrame:
    return fit.messages_of(_files(rows(spark, sf_dir), lambda user: whole(build(user))))


def _field(name: str) -> Column:
    return F.get_json_object("fields", f"$.{name}")


def _compressed(user: list[Event]) -> bytes:
    out, t = [layout(0, 20, [(253, 4, 0x86)]), layout(1, 20, [(3, 1, 2)]), b"\0" + struct.pack("<I", T0 - fit.EPOCH_OFFSET)], T0 - fit.EPOCH_OFFSET
    for i in (x.event_id for x in user):
        t += 1 + i % 31
        out.append(bytes((0x80 | 1 << 5 | t & 31, 60 + i % 100)))
    return b"".join(out)


@query(f"""SELECT user_id, ({T0} + sum(1 + event_id % 31) OVER (PARTITION BY user_id ORDER BY n))::BIGINT AS t, 60 + event_id % 100 AS heart_rate FROM {_N}
UNION ALL SELECT DISTINCT user_id, {T0}, NULL FROM events""")
def fit_compressed_times(spark, sf_dir):
    found = wire_messages(spark, sf_dir, _compressed)
    return found.select(_user(), _field("timestamp").cast("long").alias("t"), _field("heart_rate").cast("long").alias("heart_rate"))


def _low_times(user: list[Event]) -> bytes:
    out, t = [layout(0, 55, [(253, 4, 0x86)]), layout(1, 55, [(26, 2, 0x84), (24, 1, 0x0D)]), b"\0" + struct.pack("<I", T0 - fit.EPOCH_OFFSET)], T0 - fit.EPOCH_OFFSET
    out.append(layout(2, 55, [(253, 4, 0x86), (24, 1, 0x0D)]))
    for i in (x.event_id for x in user):
        t += i * 37 % 60_000
        # A low half of only ones would be absent, so such a time is written whole.
        out.append(b"\2" + struct.pack("<IB", t, i % 255) if t & 0xFFFF == 0xFFFF else b"\1" + struct.pack("<HB", t & 0xFFFF, i % 255))
    return b"".join(out)


@query(f"""SELECT user_id, ({T0} + sum(event_id * 37 % 60000) OVER (PARTITION BY user_id ORDER BY n))::BIGINT AS t, event_id % 255 & 31 AS activity_type, event_id % 255 >> 5 AS intensity FROM {_N}""")
def fit_low_times(spark, sf_dir):
    """The low half of a time goes on from the last whole one; an activity shares its byte with an intensity."""
    found = wire_messages(spark, sf_dir, _low_times).where("msg_seq > 0")
    return found.select(_user(), _field("timestamp").cast("long").alias("t"), _field("activity_type").cast("long").alias("activity_type"), _field("intensity").cast("long").alias("intensity"))


def _shared_bytes(user: list[Event]) -> bytes:
    out, rolled, power = [layout(k, 20, [(8, 3, 0x0D), (29, size, base), (30, 1, 2)]) for k, size, base in ((0, 4, 0x86), (1, 8, 0x8F))], 0, 4_294_960_000
    for i in (x.event_id for x in user):
        rolled, power = rolled + 1 + i % 3000, power + i % 1000
        # A counter of only ones would be absent in four bytes, so it is written in eight.
        low, wide = power % 2**32, power % 2**32 == 2**32 - 1
        out.append(bytes((wide,)) + (i % 4095 | (rolled & 0xFFF) << 12).to_bytes(3, "little") + struct.pack("<QB" if wide else "<IB", low, i % 255))
    return b"".join(out)


@query(f"""SELECT user_id, n, (event_id % 4095) / 100.0::DOUBLE AS speed, (sum(1 + event_id % 3000) OVER w)::DOUBLE / 16 AS distance, (4294960000 + sum(event_id % 1000) OVER w)::BIGINT AS power,
  CASE WHEN event_id % 255 & 127 <= 100 THEN CASE WHEN event_id % 255 >= 128 THEN event_id % 255 & 127 ELSE 100 - (event_id % 255 & 127) END END::DOUBLE AS right_pct
FROM {_N} WINDOW w AS (PARTITION BY user_id ORDER BY n)""")
def fit_shared_bytes(spark, sf_dir):
    """Speed and distance in three bytes, a counter of power beyond 32 bits, the right leg's share."""
    found = wire_messages(spark, sf_dir, _shared_bytes)
    return found.select(_user(), (F.col("msg_seq") + 1).alias("n"), _field("speed").cast("double").alias("speed"), _field("distance").cast("double").alias("distance"), _field("accumulated_power").cast("long").alias("power"), _field("right_balance_pct").cast("double").alias("right_pct"))


def _beats(user: list[Event]) -> bytes:
    out, ticks = [layout(0, 132, [(9, 4, 0x86)]), layout(1, 132, [(10, 3, 0x0D)]), b"\0" + struct.pack("<I", 5000)], 5000
    for i in (x.event_id for x in user):
        first = ticks + 1 + i % 500
        ticks = first + 1 + i % 400
        out.append(b"\1" + (first & 0xFFF | (ticks & 0xFFF) << 12).to_bytes(3, "little"))
    return b"".join(out)


@query(f"""SELECT user_id, n, (a & 4095 <> 4095)::INT + (b & 4095 <> 4095)::INT AS beats, (CASE WHEN a & 4095 <> 4095 THEN a ELSE 0 END + CASE WHEN b & 4095 <> 4095 THEN b ELSE 0 END)::DOUBLE / 1024 AS total_s
FROM (SELECT user_id, n, (5000 + sum(2 + event_id % 500 + event_id % 400) OVER w)::BIGINT AS b, (5000 + sum(2 + event_id % 500 + event_id % 400) OVER w)::BIGINT - 1 - event_id % 400 AS a
  FROM {_N} WINDOW w AS (PARTITION BY user_id ORDER BY n))""")
def fit_beats(spark, sf_dir):
    """Beat times in 12 bits each, which go on from the last; ones that look absent are passed over."""
    found = wire_messages(spark, sf_dir, _beats).where("msg_seq > 0")
    times = F.from_json(_field("event_times_s"), "array<double>")
    return found.select(_user(), F.col("msg_seq").alias("n"), F.size(times).alias("beats"), F.aggregate(times, F.lit(0.0), lambda acc, x: acc + x).alias("total_s"))


def _odd_fields(user: list[Event]) -> bytes:
    """Fields of all base types, absent ones, arrays, texts, and fields whose type or size makes no sense."""
    out = [layout(0, 65_000, [(0, 1, 0x01), (1, 2, 0x83), (2, 4, 0x85), (3, 8, 0x8E), (4, 8, 0x8F), (5, 1, 0x0A), (6, 4, 0x88), (7, 8, 0x89), (8, 8, 0x07), (9, 2, 0x0D), (10, 6, 0x84), (11, 3, 0x84), (12, 2, 0x33)], big=True)]
    for i in (x.event_id for x in user):
        ints = struct.pack(">bhiqQB", 127 if i % 5 == 0 else -(i % 100), 0x7FFF if i % 5 == 1 else -i % 1000, 0x7FFFFFFF if i % 5 == 2 else -i, 2**63 - 1 if i % 5 == 3 else -i * 10**9, 2**64 - 1 if i % 5 == 4 else i * 10**9, i % 7)
        floats = struct.pack(">fd", float("nan") if i % 3 == 0 else i % 1000 + 0.5, float("inf") if i % 3 == 1 else i + 0.25)
        text = b"" if i % 4 == 0 else b"a\0b" if i % 4 == 1 else f"x{i % 1000}".encode()
        rest = bytes((255, 255)) if i % 2 else bytes((i % 256, 7))
        out.append(b"\0" + ints + floats + text.ljust(8, b"\0") + rest + struct.pack(">HHH", i % 100, 0xFFFF, i % 9 if i % 3 else 0xFFFF) + bytes((1, 2, 3)) + bytes((4, 5)))
    return b"".join(out)


@query(f"""SELECT user_id, n, CASE WHEN event_id % 5 <> 0 THEN -(event_id % 100) END AS s8, CASE WHEN event_id % 5 <> 1 THEN (1000 - event_id % 1000) % 1000 END AS s16, CASE WHEN event_id % 5 <> 2 THEN -event_id END AS s32,
  CASE WHEN event_id % 5 <> 3 THEN -event_id * 1000000000 END AS s64, CASE WHEN event_id % 5 <> 4 THEN event_id * 1000000000 END AS u64, nullif(event_id % 7, 0) AS u8z,
  CASE WHEN event_id % 3 <> 0 THEN event_id % 1000 + 0.5 END::DOUBLE AS f32, CASE WHEN event_id % 3 <> 1 THEN event_id + 0.25 END::DOUBLE AS f64,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '["a","b"]' ELSE 'x' || event_id % 1000 END AS text, CASE WHEN event_id % 2 = 0 THEN printf('%02x', event_id % 256) || '07' END AS bytes,
  CASE WHEN event_id % 3 <> 0 THEN '[' || event_id % 100 || ',null,' || event_id % 9 || ']' ELSE '[' || event_id % 100 || ']' END AS list, '010203' AS odd_size, '0405' AS odd_type FROM {_N}""")
def fit_odd_fields(spark, sf_dir):
    """Unknown messages and fields keep their numbers; sentinels of all types are null, 0 is a value but for z types."""
    found = wire_messages(spark, sf_dir, _odd_fields).where("name = 'unknown_65000'")
    number = lambda k, name, kind="long": _field(f"field_{k}").cast(kind).alias(name)
    return found.select(
        _user(), (F.col("msg_seq") + 1).alias("n"), number(0, "s8"), number(1, "s16"), number(2, "s32"), number(3, "s64"), number(4, "u64"), number(5, "u8z"),
        number(6, "f32", "double"), number(7, "f64", "double"), F.nullif(_field("field_8"), F.lit("null")).alias("text"), _field("field_9").alias("bytes"),
        _field("field_10").alias("list"), _field("field_11").alias("odd_size"), _field("field_12").alias("odd_type"),
    )


def _developer(user: list[Event]) -> bytes:
    """Developer fields: of a known vendor, of another, described late, and never."""
    described = lambda index, num, base, name, scale: b"\2" + bytes((index, num, base, scale)) + name.encode().ljust(24, b"\0")
    out = [layout(1, 207, [(3, 1, 2), (2, 2, 0x84)]), b"\1" + struct.pack("<BH", 0, 95), b"\1" + struct.pack("<BH", 1, 9999)]
    out += [layout(2, 206, [(0, 1, 2), (1, 1, 2), (2, 1, 2), (6, 1, 2), (3, 24, 7)]), described(0, 0, 0x84, "Power", 1), described(1, 0, 0x02, "My Field!", 10)]
    out.append(layout(3, 20, [(253, 4, 0x86)], [(0, 2, 0), (0, 1, 1), (1, 1, 1), (2, 2, 1)]))
    for i in (x.event_id for x in user):
        out.append(b"\3" + struct.pack("<IHBBH", T0 - fit.EPOCH_OFFSET + i, i % 1000, i % 255, i % 200, i % 500))
    out.append(described(1, 1, 0x02, "late", 1))
    return b"".join(out)


@query(f"""SELECT user_id, {T0} + event_id AS t, event_id % 1000 AS running_power, CASE WHEN event_id % 255 = 0 THEN 0.0 ELSE (event_id % 255) / 10.0 END::DOUBLE AS mine, event_id % 200 AS late,
  printf('%02x', event_id % 500 % 256) || printf('%02x', event_id % 500 // 256) AS unknown FROM events""")
def fit_developer_fields(spark, sf_dir):
    """Names by vendor, values by description (also a late one), and the bytes of what nothing describes."""
    found = wire_messages(spark, sf_dir, _developer).where("global_num = 20")
    return found.select(
        _user(), _field("timestamp").cast("long").alias("t"), _field("running_power").cast("long").alias("running_power"), F.get_json_object("fields", "$['My Field!']").cast("double").alias("mine"),
        _field("late").cast("long").alias("late"), _field("dev_1_2").alias("unknown"),
    )


# Damage.


def _damaged(user: list[Event]) -> bytes:
    sound, kind = workout(user), user[0].user_id % 10
    if kind == 1:
        return sound[:-1]
    if kind == 2:
        return b"junk" * 5 + sound
    if kind == 3:
        return sound + b"tail"
    if kind == 4:
        return sound[:-2] + bytes((sound[-2] ^ 1, sound[-1]))
    if kind == 5:
        return gzip.compress(sound, mtime=0)
    if kind == 6:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as archive:
            archive.writestr(zipfile.ZipInfo("b.fit"), sound)
            archive.writestr(zipfile.ZipInfo("a.FIT"), sound)
            archive.writestr(zipfile.ZipInfo("c.txt"), b"text")
        return held.getvalue()
    if kind == 7:
        return sound + sound
    if kind == 8:
        return sound[:8] + b"xxxx" + sound[12:]
    return b'<?xml version="1.0"?><gpx></gpx>' if kind == 9 else sound


@query("""SELECT user_id, error, parts, codes, n_messages FROM (
  SELECT *, CASE k WHEN 9 THEN 'NOT_FIT_FORMAT' END AS error, CASE WHEN k = 9 THEN 0 WHEN k IN (6, 7) THEN 2 ELSE 1 END AS parts,
    CASE k WHEN 1 THEN 'FILE_CRC_MISSING' WHEN 2 THEN 'PREAMBLE_SKIPPED' WHEN 3 THEN 'TRAILING_JUNK' WHEN 4 THEN 'FILE_CRC_MISMATCH' WHEN 5 THEN 'UNWRAPPED' WHEN 6 THEN 'UNWRAPPED'
      WHEN 8 THEN 'HEADER_INVALID,HEADER_CRC_MISMATCH,FILE_CRC_MISMATCH' WHEN 9 THEN 'NOT_FIT_FORMAT' ELSE '' END AS codes,
    CASE WHEN k = 9 THEN 0 WHEN k IN (6, 7) THEN 2 * m ELSE m END::BIGINT AS n_messages
  FROM (SELECT user_id, user_id % 10 AS k, 8 + count(*) + (count(*) + 19) // 20 + 2 * count(*) FILTER (n > 1 AND event_type = 'error' AND event_id % 4 <> 3) AS m FROM """ + _N + """ GROUP BY user_id))""")
def fit_damage(spark, sf_dir):
    """Containers, chains, junk and broken checksums: what is read, and the codes of what isn't as it should be."""

    def read(content: bytes) -> list[dict]:
        found = fit.parse(content)
        return [{"error": found.error, "parts": found.parts, "codes": ",".join(p["code"] for p in found.provenance), "n_messages": len(found.messages)}]

    return _told(_files(rows(spark, sf_dir), _damaged), read, "user_id long, error string, parts int, codes string, n_messages long")


# Verbs.


def _verb(spark: SparkSession, sf_dir: str, change: Callable[[bytes], bytes]) -> DataFrame:
    """The messages of all files after a verb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                columns = [pa.array([file_id.as_py()], pa.string()), pa.array([change(content.as_py())], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["file_id", "content"])

    return fit.messages_of(workouts(spark, sf_dir).mapInArrow(run, "file_id string, content binary"))


def _told(files: DataFrame, tell: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """What ``tell`` says of each file, one file at a time."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    shape = pa.schema([(name, kinds[c.split()[1]]) for name, c in zip(names, schema.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, content in zip(batch["file_id"], batch["content"], strict=True):
                user_id = int(i.as_py())
                found += [{"user_id": user_id} | {k: x[k] for k in names[1:]} for x in tell(content.as_py())]
                if len(found) >= 20_000:
                    yield pa.RecordBatch.from_pylist(found, shape)
                    found = []
            yield pa.RecordBatch.from_pylist(found, shape)

    return files.mapInArrow(run, schema)


@query(f"SELECT user_id, true AS same, count(*) > 0 AS any FROM events GROUP BY user_id")
def fit_rewritten(spark, sf_dir):
    """What was read, written again: the same bytes, and the same messages."""

    tell = lambda c: [{"same": c == encode(fit.parse(c).messages), "any": len(c) > 0}]
    return _told(workouts(spark, sf_dir), tell, "user_id long, same boolean, any boolean")


@query(f"""SELECT user_id, count(*) AS n_records, min(t) + 3600 AS a, max(t) + 3600 AS b, 'rowing' AS sport, 77 AS manufacturer FROM {_R} GROUP BY user_id""")
def fit_edited(spark, sf_dir):
    """Another sport, another maker, all times an hour later."""
    found = keep(_verb(spark, sf_dir, lambda c: verbs.edit(c, sport="rowing", manufacturer=77, time_shift_s=3600)), "edited")
    held = activity.sessions(found).select(*activity.PART, "a", "b", "sport")
    made = activity.owners(found).select(*activity.PART, "manufacturer")
    n = activity.records(found).groupBy(*activity.PART).agg(F.count(F.lit(1)).alias("n_records"))
    return held.join(made, activity.PART).join(n, activity.PART).select(_user(), "n_records", _SECONDS("a"), _SECONDS("b"), "sport", F.col("manufacturer").cast("int").alias("manufacturer"))


@query(f"""SELECT user_id, count(*) AS n_records, min(t) AS a, max(t) AS b, (max(t) - min(t))::DOUBLE AS elapsed_time_s, CASE WHEN count(*) > 1 THEN 3.0::DOUBLE * (count(*) - 1) END AS distance_m
FROM {_R} WHERE t <= {T0 + 120} GROUP BY user_id""")
def fit_trimmed(spark, sf_dir):
    """The first two minutes: records that stay, and a session made anew of them."""

    def first(content: bytes) -> bytes:
        try:
            return verbs.trim(content, before=T0 + 120)
        except verbs.VerbError:
            return b""

    found = keep(_verb(spark, sf_dir, first), "trimmed")
    held = activity.sessions(found).select(*activity.PART, "a", "b", "declared.elapsed_time_s", "declared.distance_m")
    n = activity.records(found).groupBy(*activity.PART).agg(F.count(F.lit(1)).alias("n_records"))
    return held.join(n, activity.PART).select(_user(), "n_records", _SECONDS("a"), _SECONDS("b"), "elapsed_time_s", "distance_m")


@query("""SELECT user_id, 0::BIGINT AS profiles, 0::BIGINT AS serials, count(*) AS n_records FROM events GROUP BY user_id""")
def fit_scrubbed(spark, sf_dir):
    """No profile of an athlete and no serial number stays; records do."""
    found = _verb(spark, sf_dir, verbs.scrub)
    count = lambda c: F.count_if(c)
    return found.groupBy(_user()).agg(
        count(F.col("global_num") == 3).alias("profiles"), count(_field("serial_number").isNotNull()).alias("serials"), count(F.col("global_num") == 20).alias("n_records")
    )


@query("""SELECT user_id, category, message, field, 1::BIGINT AS count FROM (SELECT DISTINCT user_id FROM events), (VALUES
  ('identity', 'user_profile', NULL), ('identity', 'user_profile', 'age'), ('identity', 'user_profile', 'friendly_name'), ('serials', 'file_id', 'serial_number')) v(category, message, field)""")
def fit_disclosed(spark, sf_dir):
    return _told(workouts(spark, sf_dir), verbs.reveal, "user_id long, category string, message string, field string, count long")


@query("""SELECT user_id, unnest(['body_metrics', 'location']) AS category FROM (SELECT DISTINCT user_id FROM events)""")
def fit_clean_categories(spark, sf_dir):
    """The categories of which a file discloses nothing."""
    return _told(workouts(spark, sf_dir), lambda c: [{"category": x} for x in verbs.clean_categories(c)], "user_id long, category string")


@query("""SELECT DISTINCT user_id, 'error' AS level, 'VAL_SPEC_VIOLATION' AS code, 'repair' AS remedy FROM events WHERE user_id % 10 IN (1, 2, 3, 4, 8, 9)""")
def fit_diagnosed(spark, sf_dir):
    """What a strict reader objects to, with the verb that puts it right; containers and chains are sound."""
    return _told(_files(rows(spark, sf_dir), _damaged), verbs.doctor, "user_id long, level string, code string, remedy string")


@query(f"""SELECT user_id, level, code FROM (SELECT DISTINCT user_id FROM events), (VALUES ('error', 'VAL_GC_NO_SESSION'), ('error', 'VAL_GC_NO_LAP'), ('error', 'VAL_GC_NO_ACTIVITY'), ('error', 'VAL_GC_NO_FILE_ID')) v(level, code)""")
def fit_validated(spark, sf_dir):
    """What a platform misses in files of records and events alone."""
    codes = {"VAL_GC_NO_SESSION", "VAL_GC_NO_LAP", "VAL_GC_NO_ACTIVITY", "VAL_GC_NO_FILE_ID"}
    tell = lambda c: [x for x in verbs.validate(c, "garmin-connect") if x["code"] in codes]
    return _told(_files(rows(spark, sf_dir), _without_summary), tell, "user_id long, level string, code string")


def _without_summary(user: list[Event]) -> bytes:
    return encode([m for m in _workout(user) if m["global_num"] in (20, 21)])[:-7]


@query(f"""SELECT user_id, count(*) - 1 + (max(n) = 0)::INT AS n_records, 1::BIGINT AS n_sessions, 1::BIGINT AS n_laps, 1::BIGINT AS n_activities, true AS clean FROM {_R} GROUP BY user_id HAVING count(*) > 1""")
def fit_repaired(spark, sf_dir):
    """Files without their end and summaries, made whole: the last record is lost, all else is there again."""

    def mended(content: bytes) -> list[dict]:
        try:
            again = fit.parse(verbs.repair(content))
        except verbs.VerbError:
            return []
        counts = Counter(m["global_num"] for m in again.messages)
        return [{"n_records": counts[20], "n_sessions": counts[18], "n_laps": counts[19], "n_activities": counts[34], "clean": not again.provenance}]

    files = _files(rows(spark, sf_dir), _without_summary)
    return _told(files, mended, "user_id long, n_records long, n_sessions long, n_laps long, n_activities long, clean boolean")

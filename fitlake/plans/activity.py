"""The model of activities over whole folders: sessions, their records, derived totals, discrepancies, reports.

All tables come from one table of messages (``read_messages``). Write it as Parquet before asking for
more than one of them, so that files are parsed once. Everything is keyed by file, part and session;
records meet only the sessions of their own file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar, sports
from ..operators import matching, series
from .keep import keep

PART = ["file_id", "part"]
OWN = [*PART, "session"]
ORDER = ["t", "i"]
STREAMS = ("heart_rate", "power", "speed", "distance", "altitude", "cadence", "position_lat", "position_long")
#: Fixed values: (floor, share of the declared value) beyond which a derived total differs.
TOLERANCES = {
    "elapsed_time_s": (2.0, 0.02),
    "timer_time_s": (2.0, 0.02),
    "distance_m": (10.0, 0.02),
    "ascent_m": (10.0, 0.15),
    "descent_m": (10.0, 0.15),
    "avg_heart_rate": (2.0, 0.03),
    "max_heart_rate": (2.0, 0.03),
    "avg_power": (5.0, 0.05),
    "max_power": (5.0, 0.05),
    "avg_speed": (0.2, 0.03),
    "max_speed": (0.2, 0.03),
}
#: Seconds that a step counts for at most, speed from which an athlete moves, shortest gap, windows of a curve.
STEP_CAP_S = 30
MOVING_MPS = 0.1
LEAST_GAP_S = 10
CURVE_S = (5, 60, 300, 1200)
#: Factors of training impulse by sex, least share of time with heart rate for a load.
TRIMP_SCALE, TRIMP_EXPONENT, TRIMP_EXPONENT_FEMALE = 0.64, 1.92, 1.67
LEAST_COVERAGE = 0.5


def _number(name: str) -> Column:
    return F.get_json_object("fields", f"$.{name}").cast("double")


def _micros(name: str) -> Column:
    return F.get_json_object("fields", f"$.{name}").cast("long") * series.MICROS


#: What records say, parsed once a row.
_RECORD = "timestamp long, " + ", ".join(f"{name} double" for s in STREAMS for name in (s, f"enhanced_{s}"))


def records(messages: DataFrame) -> DataFrame:
    """Wide records: file_id, part, i (place in the file), byte_offset, t (microseconds, null if unknown), one column a stream."""
    rows = messages.where("global_num = 20").withColumn("said", F.from_json("fields", _RECORD))
    return rows.select(
        *PART, F.col("msg_seq").alias("i"), "byte_offset", (F.col("said.timestamp") * series.MICROS).alias("t"),
        *(F.coalesce(f"said.enhanced_{s}", f"said.{s}").alias(s) for s in STREAMS),
    )


def sport_name(said: Column) -> Column:
    """The name of a sport; unknown_<n> for a number that has none, unknown where nothing is said."""
    return F.when(said.rlike("^[0-9]+$"), F.concat(F.lit("unknown_"), said)).otherwise(F.coalesce(said, F.lit("unknown")))


def sessions(messages: DataFrame) -> DataFrame:
    """Sessions by part: session (from 0, by start, unknown starts last), a and b, sport, declared totals, rebuilt.

    A part with records but no session gets one that spans them; ``rebuilt`` tells so.
    """
    declared = {
        "elapsed_time_s": "total_elapsed_time", "timer_time_s": "total_timer_time", "distance_m": "total_distance",
        "ascent_m": "total_ascent", "descent_m": "total_descent",
        **{f"{k}_{s}": f"{k}_{s}" for k in ("avg", "max") for s in ("heart_rate", "power", "speed")},
    }
    held = messages.where("global_num = 18").select(
        *PART, "msg_seq", _micros("start_time").alias("a"), _micros("timestamp").alias("b"),
        sport_name(F.get_json_object("fields", "$.sport")).alias("sport"), F.get_json_object("fields", "$.sub_sport").alias("sub_sport"),
        F.struct(*(_number(name).alias(key) for key, name in declared.items())).alias("declared"),
    )
    first = Window.partitionBy(*PART).orderBy(F.col("a").asc_nulls_last(), "msg_seq")
    held = held.withColumn("session", F.row_number().over(first) - 1).withColumn("rebuilt", F.lit(False)).drop("msg_seq")
    spans = records(messages).groupBy(*PART).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    bare = spans.join(held.select(*PART).distinct(), PART, "left_anti").select(
        *PART, "a", "b", F.lit("unknown").alias("sport"), F.lit(0).alias("session"), F.lit(True).alias("rebuilt")
    )
    return held.unionByName(bare, allowMissingColumns=True)


def _bounds(messages: DataFrame, held: DataFrame | None) -> DataFrame:
    held = sessions(messages) if held is None else held
    return held.select(*PART, "session", F.coalesce("a", F.lit(10**18)).alias("a"), F.coalesce("b", "a", F.lit(10**18)).alias("b"))


def session_records(messages: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Records with the session that owns them, and whether its time holds them. ``held`` spares making the sessions anew."""
    rows = records(messages)
    return rows.join(matching.assign_sessions(rows, _bounds(messages, held), PART, "i"), [*PART, "i"])


def kept(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, records with their owners) as written tables, for the many branches of a report."""
    held = keep(sessions(messages), "sessions")
    return held, keep(session_records(messages, held), "owned")


def _placed(rows: DataFrame, messages: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Rows (keys, i, t) with the session that owns them."""
    owners = matching.assign_sessions(rows, _bounds(messages, held), PART, "i").select(*PART, "i", "session")
    return rows.join(owners, [*PART, "i"])


def laps(messages: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Laps by the session that holds their start: i, t (start), end_t, elapsed_s, timer_s, distance_m, trigger, step_index, averages."""
    rows = messages.where("global_num = 19").select(
        *PART, F.col("msg_seq").alias("i"), _micros("start_time").alias("t"), _micros("timestamp").alias("end_t"),
        _number("total_elapsed_time").alias("elapsed_s"), _number("total_timer_time").alias("timer_s"), _number("total_distance").alias("distance_m"),
        F.get_json_object("fields", "$.lap_trigger").alias("trigger"), _number("wkt_step_index").cast("int").alias("step_index"),
        *(_number(f"avg_{s}").alias(f"avg_{s}") for s in ("power", "speed", "heart_rate")),
    )
    return _placed(rows, messages, held)


def lengths(messages: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Pool lengths by session: i, t (start), end_t, elapsed_s, strokes, active (true if nothing says otherwise)."""
    rows = messages.where("global_num = 101").select(
        *PART, F.col("msg_seq").alias("i"), _micros("start_time").alias("t"), _micros("timestamp").alias("end_t"),
        _number("total_elapsed_time").alias("elapsed_s"), _number("total_strokes").alias("strokes"),
        (F.coalesce(_number("length_type"), F.lit(1.0)) == 1).alias("active"),
    )
    return _placed(rows, messages, held)


def swolf(found: DataFrame) -> DataFrame:
    """Per session: mean of strokes plus seconds, each rounded, of active lengths that know both."""
    score = F.bround(F.col("strokes") + F.col("elapsed_s"))
    return found.where("active").groupBy(*OWN).agg(F.avg(score).alias("swolf")).where("swolf IS NOT NULL")


def _control(messages: DataFrame) -> DataFrame:
    """Starts and stops of the timer: i, t, event_type, timer (start or stop), auto."""
    kinds = {"start": "start", "stop": "stop", "stop_all": "stop", "stop_disable_all": "stop"}
    event_type = F.get_json_object("fields", "$.event_type")
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[event_type]
    rows = messages.where("global_num = 21").where(F.get_json_object("fields", "$.event").eqNullSafe("timer"))
    auto = F.get_json_object("fields", "$.timer_trigger").eqNullSafe("auto")
    rows = rows.select(*PART, F.col("msg_seq").alias("i"), _micros("timestamp").alias("t"), event_type.alias("event_type"), kind.alias("timer"), auto.alias("auto"))
    return rows.where("t IS NOT NULL AND timer IS NOT NULL")


def timers(owned: DataFrame, messages: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(keys, a, b) while the timer of a session ran; without events, from its first record to its last."""
    timed = owned.where("t IS NOT NULL").select(*OWN, "i", "t", F.lit(None).cast("string").alias("timer"))
    both = timed.unionByName(_placed(_control(messages), messages, held).select(*OWN, "i", "t", "timer"))
    return series.timer_intervals(both, OWN, ORDER, F.col("timer").eqNullSafe("start"), F.col("timer").eqNullSafe("stop"))


def timer_seconds(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy(*OWN).agg((F.sum(F.col("b") - F.col("a")) / series.MICROS).alias("timer_time_s"))


#: The messages and fields that hold an athlete's zones, by stream.
ZONES = {"heart_rate": (8, "high_bpm", "file:hr_zone"), "power": (9, "high_value", "file:power_zone")}


def file_zones(messages: DataFrame, stream: str) -> DataFrame:
    """Per part that says them: bounds of the zones of ``stream``, by message index."""
    number, name, basis = ZONES[stream]
    held = messages.where(F.col("global_num") == number).select(
        *PART, F.coalesce(_number("message_index"), F.col("msg_seq").cast("double")).alias("at"), "msg_seq", _number(name).alias("bound")
    )
    entry = F.struct("at", "msg_seq", "bound")
    bounds = F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["bound"])
    return held.where("bound IS NOT NULL").groupBy(*PART).agg(bounds.alias("bounds")).withColumn("basis", F.lit(basis))


def time_in_zones(owned: DataFrame, messages: DataFrame, stream: str, settings: list[float] | None = None) -> DataFrame:
    """(keys, zone, seconds, basis): capped time with as many bounds below the value; zones without time are 0.

    Bounds come from ``settings``, else from the file. They are never guessed: without any there are no rows.
    """
    if settings:
        bounds = owned.select(*PART).distinct().withColumns({"bounds": F.array(*(F.lit(float(x)) for x in settings)), "basis": F.lit("settings")})
    else:
        bounds = file_zones(messages, stream)
    rows = owned.join(bounds, PART)
    steps = series.pairwise_dt(rows, OWN, ORDER).where(F.col("dt") > 0).where(F.col(stream).isNotNull())
    zone = F.size(F.filter("bounds", lambda b: F.col(stream) > b))
    spent = steps.groupBy(*OWN, zone.alias("zone")).agg(F.sum(series.capped_time(F.col("dt"), STEP_CAP_S)).alias("seconds"))
    spine = rows.where(F.col(stream).isNotNull()).select(*OWN, "bounds", "basis").distinct()
    spine = spine.select(*OWN, "basis", F.explode(F.sequence(F.lit(0), F.size("bounds"))).alias("zone"))
    return spine.join(spent, [*OWN, "zone"], "left").select(*OWN, "zone", F.coalesce("seconds", F.lit(0.0)).alias("seconds"), "basis")


def stream_name(label: Column) -> Column:
    """A name for a stream out of any label: lower case, other characters than letters and digits as one underscore."""
    return F.trim(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "_"), F.lit("_"))


def long_streams(messages: DataFrame) -> DataFrame:
    """(keys, i, t, stream, value) of every number that records hold, those of developers too, by cleaned names.

    Enhanced fields take the place of their plain ones where both are there."""
    rows = messages.where("global_num = 20").select(
        *PART, F.col("msg_seq").alias("i"), _micros("timestamp").alias("t"), F.explode(F.from_json("fields", "map<string,string>")).alias("label", "text")
    )
    value = F.expr("try_cast(text AS double)")
    rows = rows.select(*PART, "i", "t", stream_name(F.col("label")).alias("label"), value.alias("value")).where("value IS NOT NULL AND label <> 'timestamp'")
    plain = F.regexp_replace("label", "^enhanced_", "")
    first = F.min_by("value", F.struct(~F.col("label").startswith("enhanced_"), "label"))
    return rows.groupBy(*PART, "i", "t", plain.alias("stream")).agg(first.alias("value"))


def row_streams(messages: DataFrame) -> DataFrame:
    """(keys, i, said): per record what ``long_streams`` has, as an array of (stream, value) by name, found without a shuffle of values."""
    one = F.transform(F.map_entries(F.from_json("fields", "map<string,string>")), lambda x: F.struct(stream_name(x["key"]).alias("label"), x["value"].try_cast("double").alias("value")))
    known = F.filter(one, lambda x: x["value"].isNotNull() & (x["label"] != "timestamp"))
    ranked = F.transform(known, lambda x: F.struct(F.regexp_replace(x["label"], "^enhanced_", "").alias("stream"), (~x["label"].startswith("enhanced_")).alias("plain"), x["label"].alias("label"), x["value"].alias("value")))
    rows = messages.where("global_num = 20").select(*PART, F.col("msg_seq").alias("i"), F.sort_array(ranked).alias("ranked"))
    first = F.filter("ranked", lambda x, k: (k == 0) | (F.get("ranked", k - 1)["stream"] != x["stream"]))
    said = F.transform(first, lambda x: F.struct(x["stream"].alias("stream"), x["value"].alias("value")))
    return rows.select(*PART, "i", said.alias("said"))


def stream_totals(streams: DataFrame, owned: DataFrame) -> DataFrame:
    """Per session and stream: n, avg, max; positions, distance and the kind of activity have no mean."""
    named = streams.where(~F.col("stream").isin("position_lat", "position_long", "distance", "activity_type"))
    both = named.join(owned.select(*OWN, "i"), [*PART, "i"])
    return both.groupBy(*OWN, "stream").agg(F.count("value").alias("n"), F.avg("value").alias("avg"), F.max("value").alias("max"))


def hrv(messages: DataFrame) -> DataFrame:
    """Per part: beat-to-beat intervals in seconds, of all messages that hold some, in order."""
    held = F.from_json(F.coalesce(F.get_json_object("fields", "$.time"), F.lit("[]")), "array<double>")
    one = F.array(_number("time"))
    rows = messages.where("global_num = 78").select(*PART, "msg_seq", F.coalesce(held, one).alias("times"))
    ordered = F.sort_array(F.collect_list(F.struct("msg_seq", "times")))
    flat = F.filter(F.flatten(F.transform(ordered, lambda x: x["times"])), lambda x: x.isNotNull())
    return rows.groupBy(*PART).agg(flat.alias("intervals_s"))


def owners(messages: DataFrame) -> DataFrame:
    """Per part: what the first file_id and the first user_profile say of device and athlete (null: nothing)."""
    first = lambda number, *names: [
        F.min_by(F.get_json_object("fields", f"$.{n}"), F.when(F.col("global_num") == number, F.col("msg_seq"))).alias(n) for n in names
    ]
    device = first(0, "manufacturer", "product", "product_name", "serial_number")
    athlete = first(3, "friendly_name", "gender", "age", "weight", "height")
    return messages.where("global_num IN (0, 3)").groupBy(*PART).agg(*device, *athlete)


def distance_splits(owned: DataFrame, length: float = 1000.0, pace_m: float = 1000.0) -> DataFrame:
    """One row per split of ``length`` metres: split (from 1), distance_m, duration_s, pace_s (of ``pace_m``), avg_heart_rate,
    avg_power, ascent_m, descent_m, partial. Its ends are interpolated; a record that reaches an end counts in the next
    split; a last one of more than half a metre is partial. Climb is that of neighbouring altitudes."""
    w = series.over(OWN, ORDER)
    rows = owned.where("distance IS NOT NULL AND t IS NOT NULL")
    ends = series.splits(rows, OWN, ORDER, "distance", length).groupBy(*OWN, "split").agg(F.min("t").alias("end_t"))
    rows = rows.withColumns({"origin": F.first("distance").over(w), "far": F.max("distance").over(w.rowsBetween(series.Window.unboundedPreceding, 0))})
    rows = rows.withColumn("split", (F.floor((F.col("far") - F.col("origin")) / length) + 1).cast("long"))
    high = rows.where("altitude IS NOT NULL").withColumn("step", F.col("altitude") - F.lag("altitude").over(w))
    climbed = high.groupBy(*OWN, "split").agg(
        F.coalesce(F.sum(F.greatest("step", F.lit(0.0)).cast("double")), F.lit(0.0)).alias("ascent_m"),
        F.coalesce(F.sum(F.when(F.col("step") < 0, -F.col("step"))), F.lit(0.0)).alias("descent_m"),
    )
    held = rows.groupBy(*OWN, "split").agg(
        F.avg("heart_rate").alias("avg_heart_rate"), F.avg("power").alias("avg_power"),
        F.max_by("distance", F.struct("t", "i")).alias("last_m"), F.max("t").alias("last_t"), F.first("origin").alias("origin"),
    )
    spans = rows.groupBy(*OWN).agg(F.min("t").alias("start_t"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    whole = ends.withColumn("partial", F.lit(False))
    rest = held.join(ends.select(*OWN, "split"), [*OWN, "split"], "left_anti").withColumn("rest_m", F.col("last_m") - F.col("origin") - (F.col("split") - 1) * length)
    rest = rest.where("rest_m > 0.5").select(*OWN, "split", F.col("last_t").alias("end_t"), F.lit(True).alias("partial"), "rest_m")
    every = whole.withColumn("rest_m", F.lit(None).cast("double")).unionByName(rest).join(spans, OWN)
    begin = F.coalesce(F.lag("end_t").over(series.over(OWN, ["split"])), "start_t")
    every = every.withColumn("duration_s", (F.col("end_t") - begin) / series.MICROS).withColumn("distance_m", F.coalesce("rest_m", F.lit(float(length))))
    every = every.withColumn("pace_s", F.when(F.col("duration_s") > 0, F.col("duration_s") / F.col("distance_m") * pace_m))
    facts = held.select(*OWN, "split", "avg_heart_rate", "avg_power")
    return (
        every.join(facts, [*OWN, "split"], "left")
        .join(climbed, [*OWN, "split"], "left")
        .select(*OWN, "split", "distance_m", "duration_s", "pace_s", "avg_heart_rate", "avg_power", "ascent_m", "descent_m", "partial")
    )


def derived_totals(owned: DataFrame, messages: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """Per session, of its records alone: elapsed time, distance (last less first), moving time, means, maxima, climb.

    With ``messages`` there is timer_time_s too, and only steps that begin while the timer runs are moving time.
    """
    present = F.col("distance").isNotNull()
    aggs = [
        F.count(F.lit(1)).alias("n_records"),
        F.when(F.count("t") >= 2, (F.max("t") - F.min("t")) / series.MICROS).alias("elapsed_time_s"),
        F.when(F.count("distance") >= 2, F.max_by("distance", F.when(present, F.struct("t", "i"))) - F.min_by("distance", F.when(present, F.struct("t", "i")))).alias("distance_m"),
        *(f(s).alias(f"{k}_{s}") for s in ("heart_rate", "power", "speed", "cadence") for k, f in (("avg", F.avg), ("max", F.max))),
    ]
    totals = owned.groupBy(*OWN).agg(*aggs)
    steps = series.pairwise_dt(owned, OWN, ORDER).where("dt > 0").where(F.col("speed") > MOVING_MPS).select(*OWN, "t", "dt")
    if messages is not None:
        running = timers(owned, messages, held)
        steps = matching.inside_any(steps, running, OWN)
        totals = totals.join(timer_seconds(running), OWN, "left")
    moving = steps.groupBy(*OWN).agg(F.sum(F.least("dt", F.lit(STEP_CAP_S * series.MICROS))).alias("moving_us"))
    has_speed = F.col("max_speed").isNotNull()
    climb = series.ascent(owned, OWN, ORDER, "altitude").withColumnsRenamed({"ascent": "ascent_m", "descent": "descent_m"})
    return (
        totals.join(moving, OWN, "left")
        .join(climb, OWN, "left")
        .withColumn("moving_time_s", F.when(has_speed, F.coalesce("moving_us", F.lit(0)) / series.MICROS))
        .drop("moving_us")
    )


def relative_elapsed(messages: DataFrame) -> DataFrame:
    """Per part whose records have no absolute time: seconds between the first and the last of the device's own times.

    ``messages`` has ``raw_time`` (the raw numbers of timestamps), as ``fit.relative_times`` gives.
    """
    held = messages.where("global_num = 20 AND raw_time IS NOT NULL").groupBy(*PART)
    ends = held.agg(F.min_by("raw_time", "msg_seq").alias("a"), F.max_by("raw_time", "msg_seq").alias("b"), F.count(F.lit(1)).alias("n"))
    return ends.where("n >= 2 AND b >= a").select(*PART, (F.col("b") - F.col("a")).cast("double").alias("elapsed_time_s"))


def discrepancies(declared: DataFrame, derived: DataFrame) -> DataFrame:
    """(file_id, part, session, field, declared, derived, delta) beyond the tolerances; nothing is corrected."""
    fields = {f: t for f, t in TOLERANCES.items() if f in derived.columns}
    flat = declared.where("NOT rebuilt").select(*OWN, *(F.col(f"declared.{f}").alias(f) for f in fields))
    return matching.reconcile(flat, derived.select(*OWN, *fields), OWN, fields)


def _first_stops(found: DataFrame, stops: DataFrame) -> DataFrame:
    """(keys, i, auto) of the first stop by its place in the file that lies in a gap, both ends included.

    Gaps of a session only meet at their ends. They are sorted by time together with the stops, so a stop looks at the
    last gap that began, and at the one before it, which may end where this one begins."""
    w = series.over(OWN, ["t"])
    gap = F.struct("i", "t", "end_t")
    line = found.select(*OWN, "t", gap.alias("gap"), F.lag(gap).over(w).alias("ended"), F.lit(0).alias("side"))
    spans = found.groupBy(*OWN).agg(F.min("t").alias("a"), F.max("end_t").alias("b"))
    held = stops.join(spans, PART).where(F.col("stop_t").between(F.col("a"), F.col("b"))).select(*OWN, F.col("stop_t").alias("t"), F.lit(1).alias("side"), "stop_i", "auto")
    last = Window.partitionBy(*OWN).orderBy("t", "side")
    both = line.unionByName(held, allowMissingColumns=True).withColumns({c: F.last(F.when(F.col("side") == 0, F.struct("gap", "ended")), ignorenulls=True).over(last)[c] for c in ("gap", "ended")})
    near = both.where("side = 1").select(*OWN, "stop_i", "auto", F.col("t").alias("stop_t"), F.explode(F.array("gap", "ended")).alias("gap"))
    near = near.where(F.col("stop_t").between(F.col("gap.t"), F.col("gap.end_t"))).select(*OWN, F.col("gap.i").alias("i"), "stop_i", "auto")
    return near.groupBy(*OWN, "i").agg(F.min_by("auto", "stop_i").alias("auto"))


def gaps(owned: DataFrame, messages: DataFrame, files: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """Gaps of 10 s and more between records, each with the first kind that fits: corruption (bytes were skipped between
    the two), manual_stop or auto_pause (the first stop that lies in it), post_timer (after the timer's last stop),
    smart_recording (to 30 s), unknown. ``files`` has the skipped bytes (``read_files``); without it none is corrupt."""
    w = series.over(OWN, ORDER)
    ends = {"end_t": F.lead("t").over(w), "end_offset": F.lead("byte_offset").over(w)}
    found = owned.where("t IS NOT NULL").withColumns(ends).withColumn("gap_us", F.col("end_t") - F.col("t"))
    found = found.where(F.col("gap_us") >= LEAST_GAP_S * series.MICROS).select(*OWN, "i", "t", "end_t", "byte_offset", "end_offset", "gap_us")
    control = _control(messages)
    stops = control.where("event_type IN ('stop', 'stop_all')").select(*PART, F.col("i").alias("stop_i"), F.col("t").alias("stop_t"), "auto")
    first = _first_stops(found, stops)
    last = _placed(control.withColumnRenamed("timer", "state"), messages, held).groupBy(*OWN).agg(F.max_by(F.struct("state", F.col("t").alias("at")), F.struct("t", "i")).alias("last"))
    found = found.join(first, [*OWN, "i"], "left").join(last, OWN, "left")
    corrupt = F.lit(False)
    if files is not None:
        found = found.join(files.select("file_id", "skipped"), "file_id", "left")
        corrupt = F.exists(F.coalesce("skipped", F.array().cast("array<struct<a:bigint,b:bigint>>")), lambda x: (F.col("byte_offset") < x["a"]) & (F.col("end_offset") > x["b"]))
    kind = (
        F.when(corrupt, "corruption")
        .when(F.col("auto"), "auto_pause")
        .when(~F.col("auto"), "manual_stop")
        .when((F.col("last.state") == "stop") & (F.col("t") >= F.col("last.at")), "post_timer")
        .when(F.col("gap_us") <= STEP_CAP_S * series.MICROS, "smart_recording")
        .otherwise("unknown")
    )
    return found.select(*OWN, "t", "end_t", "gap_us", kind.alias("kind"))


def effort(owned: DataFrame, max_hr: float | None = None, rest_hr: float | None = None, female: bool = False) -> DataFrame:
    """Per session: work_kj, weighted_power, best mean power by window, trimp and hr_s (null without thresholds)."""
    steps = series.pairwise_dt(owned, OWN, ORDER)
    spent = series.capped_time(F.col("dt"), STEP_CAP_S)
    aggs = [
        (F.sum(F.col("power") * spent) / 1000).alias("work_kj"),
        F.sum(F.when(F.col("heart_rate").isNotNull(), spent)).alias("hr_s"),
    ]
    if max_hr is not None and rest_hr is not None and max_hr > rest_hr:
        reserve = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("heart_rate") - rest_hr) / (max_hr - rest_hr)))
        exponent = TRIMP_EXPONENT_FEMALE if female else TRIMP_EXPONENT
        aggs.append(F.sum(F.when(F.col("heart_rate").isNotNull(), spent / 60 * reserve * TRIMP_SCALE * F.exp(exponent * reserve))).alias("trimp"))
    else:
        aggs.append(F.lit(None).cast("double").alias("trimp"))
    curve = series.mean_max(owned, OWN, ORDER, "power", list(CURVE_S))
    weighted = series.weighted_mean(owned, OWN, ORDER, "power").withColumnRenamed("weighted", "weighted_power")
    return steps.groupBy(*OWN).agg(*aggs).join(weighted, OWN, "left").join(curve, OWN, "left")


def report(
    messages: DataFrame, ftp: float | None = None, max_hr: float | None = None, rest_hr: float | None = None, female: bool = False
) -> DataFrame:
    """One row per session: sport, durations, distance, pace, sensors, effort, load with its basis, and what is omitted.

    The load comes from power and ``ftp``, else from heart rate if it covers half of the time, else there is none.
    Pace and cadence are shown as the sport does.
    """
    held, owned = kept(messages)
    joined = held.join(derived_totals(owned, messages, held), OWN, "left").join(swolf(lengths(messages, held)), OWN, "left").join(effort(owned, max_hr, rest_hr, female), OWN, "left")
    known = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit(0.0)) for n in names))
    duration = known("timer_time_s", "elapsed_time_s", "declared.timer_time_s", "declared.elapsed_time_s")
    distance = known("distance_m", "declared.distance_m")
    pace_time = known("moving_time_s", "timer_time_s", "declared.timer_time_s", "elapsed_time_s", "declared.elapsed_time_s")
    joined = joined.withColumns({"duration_s": duration, "covered_m": distance, "pace_s_per_km": F.when(distance > 0, pace_time / distance * 1000)})
    joined = joined.withColumn("profile", sports.profile_of(F.col("sport"), F.col("sub_sport")))
    joined = joined.withColumn("style", sports.pace_style(F.col("profile")))
    speed = F.when(pace_time > 0, distance / pace_time)
    text = F.coalesce(sports.pace_text(sports.pace(speed, F.col("style")), F.col("style"), suffix=True), F.concat(scalar.format_speed_kmh(speed), F.lit(" km/h")))
    ratio = F.col("weighted_power") / F.lit(ftp).cast("double")
    by_power = F.col("duration_s") / 3600 * ratio * ratio * 100
    covered = F.least(F.lit(1.0), F.col("hr_s") / F.col("duration_s")) >= LEAST_COVERAGE
    by_heart = F.when(covered, F.col("trimp"))
    basis = F.when(by_power.isNotNull(), "power").when(by_heart.isNotNull(), "hr-trimp")
    missing = F.array_compact(F.array(
        F.when(F.col("avg_power").isNull(), "power: no samples"),
        F.when(F.col("avg_heart_rate").isNull(), "heart rate: no samples"),
        F.when(F.col("covered_m").isNull(), "distance: neither derived nor declared"),
        F.when(basis.isNull(), "load: no threshold that fits the sensors"),
    ))
    return joined.select(
        *OWN, "sport", "sub_sport", "profile", "rebuilt", "n_records", F.bround("duration_s", 1).alias("duration_s"), "timer_time_s", "moving_time_s", "swolf",
        F.bround("covered_m", 1).alias("distance_m"), F.bround("pace_s_per_km", 1).alias("pace_s_per_km"), text.alias("pace"),
        sports.primary_signal(F.col("profile"), F.col("avg_power").isNotNull(), F.col("avg_speed").isNotNull()).alias("primary_signal"),
        sports.cadence_display(F.col("avg_cadence"), F.col("profile")).alias("cadence"), "ascent_m", "descent_m",
        *(f"{k}_{s}" for s in ("heart_rate", "power", "speed", "cadence") for k in ("avg", "max")),
        "work_kj", "weighted_power", (F.col("weighted_power") / F.nullif(F.col("avg_power"), F.lit(0.0))).alias("variability"),
        *(f"best_{n}" for n in CURVE_S), F.coalesce(by_power, by_heart).alias("load"), basis.alias("load_basis"), missing.alias("omissions"),
    )

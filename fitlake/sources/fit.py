"""Activity files in the FIT layout: bytes to frames to typed messages, intact or damaged.

``parse`` is a plain function of bytes; ``read_messages`` and ``read_files`` run it over whole folders
with the ``binaryFile`` source. Files are independent and can't be split, so they are the unit of
parallelism. Nothing is lost silently: whatever is dropped, repaired or read in another way leaves an
entry in ``provenance`` with a code and a byte offset. A sentinel becomes null before any scaling;
0 stays 0. Unknown messages, fields and enum values keep their numbers.
"""

from __future__ import annotations

import csv
import gzip
import io
import json
import math
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: seconds from 1970 to 1989-12-31, the first absolute time, the CRC's nibbles.
EPOCH_OFFSET = 631_065_600
FIRST_ABSOLUTE = 0x10000000
CRC_NIBBLES = (
    0x0000, 0xCC01, 0xD801, 0x1400, 0xF001, 0x3C00, 0x2800, 0xE401,
    0xA001, 0x6C00, 0x7800, 0xB401, 0x5000, 0x9C01, 0x8801, 0x4400,
)
#: Base type, its code for ``struct``, and the sentinel that means absent.
BASE_TYPES = {
    0x00: ("B", 0xFF), 0x01: ("b", 0x7F), 0x02: ("B", 0xFF), 0x83: ("h", 0x7FFF), 0x84: ("H", 0xFFFF),
    0x85: ("i", 0x7FFFFFFF), 0x86: ("I", 0xFFFFFFFF), 0x07: ("s", None), 0x88: ("f", None), 0x89: ("d", None),
    0x0A: ("B", 0), 0x8B: ("H", 0), 0x8C: ("I", 0), 0x0D: ("B", 0xFF), 0x8E: ("q", 0x7FFFFFFFFFFFFFFF),
    0x8F: ("Q", 0xFFFFFFFFFFFFFFFF), 0x90: ("Q", 0),
}
SEMICIRCLES = 2**31 / 180
#: Message number, name, and fields as number: (name, kind, scale, offset, units).
MESSAGES = {
    0: ("file_id", {0: ("type", "enum:file", 1, 0, ""), 1: ("manufacturer", "number", 1, 0, ""), 2: ("product", "number", 1, 0, ""), 3: ("serial_number", "number", 1, 0, ""), 4: ("time_created", "date_time", 1, 0, ""), 8: ("product_name", "string", 1, 0, "")}),
    3: ("user_profile", {0: ("friendly_name", "string", 1, 0, ""), 1: ("gender", "number", 1, 0, ""), 2: ("age", "number", 1, 0, "years"), 3: ("height", "number", 100, 0, "m"), 4: ("weight", "number", 10, 0, "kg"), 8: ("resting_heart_rate", "number", 1, 0, "bpm"), 11: ("default_max_heart_rate", "number", 1, 0, "bpm")}),
    8: ("hr_zone", {254: ("message_index", "number", 1, 0, ""), 1: ("high_bpm", "number", 1, 0, "bpm"), 2: ("name", "string", 1, 0, "")}),
    9: ("power_zone", {254: ("message_index", "number", 1, 0, ""), 1: ("high_value", "number", 1, 0, "W"), 2: ("name", "string", 1, 0, "")}),
    26: ("workout", {4: ("sport", "enum:sport", 1, 0, ""), 6: ("num_valid_steps", "number", 1, 0, ""), 8: ("wkt_name", "string", 1, 0, "")}),
    27: ("workout_step", {254: ("message_index", "number", 1, 0, ""), 0: ("wkt_step_name", "string", 1, 0, ""), 7: ("intensity", "enum:intensity", 1, 0, "")}),
    55: ("monitoring", {253: ("timestamp", "date_time", 1, 0, ""), 3: ("cycles", "number", 2, 0, "cycles"), 24: ("current_activity_type_intensity", "bytes", 1, 0, ""), 26: ("timestamp_16", "number", 1, 0, "s"), 27: ("heart_rate", "number", 1, 0, "bpm")}),
    132: ("hr", {253: ("timestamp", "date_time", 1, 0, ""), 6: ("filtered_bpm", "number", 1, 0, "bpm"), 9: ("event_timestamp", "number", 1024, 0, "s"), 10: ("event_timestamp_12", "bytes", 1, 0, "")}),
    7: ("zones_target", {1: ("max_heart_rate", "number", 1, 0, "bpm"), 2: ("threshold_heart_rate", "number", 1, 0, "bpm"), 3: ("functional_threshold_power", "number", 1, 0, "W")}),
    12: ("sport", {0: ("sport", "enum:sport", 1, 0, ""), 1: ("sub_sport", "number", 1, 0, ""), 3: ("name", "string", 1, 0, "")}),
    18: ("session", {253: ("timestamp", "date_time", 1, 0, ""), 254: ("message_index", "number", 1, 0, ""), 0: ("event", "enum:event", 1, 0, ""), 1: ("event_type", "enum:event_type", 1, 0, ""), 2: ("start_time", "date_time", 1, 0, ""), 5: ("sport", "enum:sport", 1, 0, ""), 6: ("sub_sport", "number", 1, 0, ""), 7: ("total_elapsed_time", "number", 1000, 0, "s"), 8: ("total_timer_time", "number", 1000, 0, "s"), 9: ("total_distance", "number", 100, 0, "m"), 11: ("total_calories", "number", 1, 0, "kcal"), 14: ("avg_speed", "number", 1000, 0, "m/s"), 15: ("max_speed", "number", 1000, 0, "m/s"), 16: ("avg_heart_rate", "number", 1, 0, "bpm"), 17: ("max_heart_rate", "number", 1, 0, "bpm"), 18: ("avg_cadence", "number", 1, 0, "rpm"), 20: ("avg_power", "number", 1, 0, "W"), 21: ("max_power", "number", 1, 0, "W"), 22: ("total_ascent", "number", 1, 0, "m"), 23: ("total_descent", "number", 1, 0, "m"), 25: ("first_lap_index", "number", 1, 0, ""), 26: ("num_laps", "number", 1, 0, ""), 44: ("pool_length", "number", 100, 0, "m"), 3: ("start_position_lat", "number", SEMICIRCLES, 0, "deg"), 4: ("start_position_long", "number", SEMICIRCLES, 0, "deg"), 29: ("nec_lat", "number", SEMICIRCLES, 0, "deg"), 30: ("nec_long", "number", SEMICIRCLES, 0, "deg"), 31: ("swc_lat", "number", SEMICIRCLES, 0, "deg"), 32: ("swc_long", "number", SEMICIRCLES, 0, "deg"), 38: ("end_position_lat", "number", SEMICIRCLES, 0, "deg"), 39: ("end_position_long", "number", SEMICIRCLES, 0, "deg")}),
    19: ("lap", {253: ("timestamp", "date_time", 1, 0, ""), 254: ("message_index", "number", 1, 0, ""), 0: ("event", "enum:event", 1, 0, ""), 1: ("event_type", "enum:event_type", 1, 0, ""), 2: ("start_time", "date_time", 1, 0, ""), 7: ("total_elapsed_time", "number", 1000, 0, "s"), 8: ("total_timer_time", "number", 1000, 0, "s"), 9: ("total_distance", "number", 100, 0, "m"), 13: ("avg_speed", "number", 1000, 0, "m/s"), 14: ("max_speed", "number", 1000, 0, "m/s"), 15: ("avg_heart_rate", "number", 1, 0, "bpm"), 16: ("max_heart_rate", "number", 1, 0, "bpm"), 19: ("avg_power", "number", 1, 0, "W"), 20: ("max_power", "number", 1, 0, "W"), 23: ("intensity", "enum:intensity", 1, 0, ""), 24: ("lap_trigger", "enum:lap_trigger", 1, 0, ""), 71: ("wkt_step_index", "number", 1, 0, ""), 3: ("start_position_lat", "number", SEMICIRCLES, 0, "deg"), 4: ("start_position_long", "number", SEMICIRCLES, 0, "deg"), 5: ("end_position_lat", "number", SEMICIRCLES, 0, "deg"), 6: ("end_position_long", "number", SEMICIRCLES, 0, "deg"), 27: ("nec_lat", "number", SEMICIRCLES, 0, "deg"), 28: ("nec_long", "number", SEMICIRCLES, 0, "deg"), 29: ("swc_lat", "number", SEMICIRCLES, 0, "deg"), 30: ("swc_long", "number", SEMICIRCLES, 0, "deg")}),
    20: ("record", {253: ("timestamp", "date_time", 1, 0, ""), 0: ("position_lat", "number", SEMICIRCLES, 0, "deg"), 1: ("position_long", "number", SEMICIRCLES, 0, "deg"), 2: ("altitude", "number", 5, 500, "m"), 3: ("heart_rate", "number", 1, 0, "bpm"), 4: ("cadence", "number", 1, 0, "rpm"), 5: ("distance", "number", 100, 0, "m"), 6: ("speed", "number", 1000, 0, "m/s"), 7: ("power", "number", 1, 0, "W"), 8: ("compressed_speed_distance", "bytes", 1, 0, ""), 13: ("temperature", "number", 1, 0, "C"), 29: ("accumulated_power", "number", 1, 0, "W"), 30: ("left_right_balance", "number", 1, 0, ""), 73: ("enhanced_speed", "number", 1000, 0, "m/s"), 78: ("enhanced_altitude", "number", 5, 500, "m")}),
    21: ("event", {253: ("timestamp", "date_time", 1, 0, ""), 0: ("event", "enum:event", 1, 0, ""), 1: ("event_type", "enum:event_type", 1, 0, ""), 3: ("data", "number", 1, 0, ""), 4: ("event_group", "number", 1, 0, "")}),
    23: ("device_info", {253: ("timestamp", "date_time", 1, 0, ""), 0: ("device_index", "number", 1, 0, ""), 2: ("manufacturer", "number", 1, 0, ""), 3: ("serial_number", "number", 1, 0, ""), 4: ("product", "number", 1, 0, ""), 27: ("product_name", "string", 1, 0, "")}),
    34: ("activity", {253: ("timestamp", "date_time", 1, 0, ""), 0: ("total_timer_time", "number", 1000, 0, "s"), 1: ("num_sessions", "number", 1, 0, ""), 2: ("type", "number", 1, 0, ""), 3: ("event", "enum:event", 1, 0, ""), 4: ("event_type", "enum:event_type", 1, 0, ""), 5: ("local_timestamp", "local_date_time", 1, 0, "")}),
    78: ("hrv", {0: ("time", "number", 1000, 0, "s")}),
    101: ("length", {253: ("timestamp", "date_time", 1, 0, ""), 254: ("message_index", "number", 1, 0, ""), 2: ("start_time", "date_time", 1, 0, ""), 3: ("total_elapsed_time", "number", 1000, 0, "s"), 5: ("total_strokes", "number", 1, 0, ""), 7: ("swim_stroke", "number", 1, 0, ""), 12: ("length_type", "number", 1, 0, "")}),
    206: ("field_description", {0: ("developer_data_index", "number", 1, 0, ""), 1: ("field_definition_number", "number", 1, 0, ""), 2: ("fit_base_type_id", "number", 1, 0, ""), 3: ("field_name", "string", 1, 0, ""), 6: ("scale", "number", 1, 0, ""), 7: ("offset", "number", 1, 0, ""), 8: ("units", "string", 1, 0, "")}),
    207: ("developer_data_id", {1: ("application_id", "bytes", 1, 0, ""), 2: ("manufacturer_id", "number", 1, 0, ""), 3: ("developer_data_index", "number", 1, 0, "")}),
}
#: Names of enum values.
ENUMS = {
    "file": {1: "device", 2: "settings", 4: "activity", 5: "workout", 6: "course", 15: "monitoring_a", 32: "monitoring_b"},
    "event": {0: "timer", 3: "workout", 4: "workout_step", 8: "session", 9: "lap", 26: "activity"},
    "event_type": {0: "start", 1: "stop", 4: "stop_all", 8: "stop_disable", 9: "stop_disable_all"},
    "intensity": {0: "active", 1: "rest", 2: "warmup", 3: "cooldown", 4: "recovery", 5: "interval", 6: "other"},
    "lap_trigger": {0: "manual", 1: "time", 2: "distance", 3: "position_start", 4: "position_lap", 5: "position_waypoint", 6: "position_marked", 7: "session_end", 8: "fitness_equipment"},
    "timer_trigger": {0: "manual", 1: "auto", 2: "fitness_equipment"},
    "sport": {0: "generic", 1: "running", 2: "cycling", 3: "transition", 4: "fitness_equipment", 5: "swimming", 10: "training", 11: "walking", 12: "cross_country_skiing", 13: "alpine_skiing", 15: "rowing", 16: "mountaineering", 17: "hiking", 18: "multisport", 19: "paddling", 21: "e_biking"},
}
#: Makers whose products are named by one table; tables come with the profile (``PRODUCTS``).
PRODUCT_TABLES = {1: "garmin_product", 15: "garmin_product", 13: "garmin_product", 89: "garmin_product", 263: "favero_product"}
#: Names of products by table and number. Add to it as to a profile.
PRODUCTS: dict[str, dict[int, str]] = {"favero_product": {10: "assioma_uno", 12: "assioma_duo"}, "garmin_product": {}}
#: Developer fields of vendors (number of the maker, name of the field) that are known streams.
VENDOR_FIELDS = {
    (95, "power"): "running_power", (95, "leg spring stiffness"): "leg_spring_stiffness", (95, "form power"): "form_power",
    (95, "air power"): "air_power", (303, "core temperature"): "core_temperature", (303, "skin temperature"): "skin_temperature",
    (76, "smo2"): "smo2", (76, "thb"): "thb",
}
MAX_RESYNCS = 64
#: Flag of the right side, bits of the share, and scale of the two balance fields.
BALANCES = {"left_right_balance": (0x80, 0x7F, 1), "left_right_balance_100": (0x8000, 0x3FFF, 100)}
#: Remarks on fields; the file itself is sound.
FIELD_NOTES = {"FIELD_KEPT_RAW", "DEVELOPER_FIELD_UNDESCRIBED", "DEVELOPER_FIELD_BACKFILLED", "TIME_WITHOUT_ANCHOR"}
#: What a strict reader lets pass: containers, and developer fields that say too little or say it late.
STRICT_ALLOWS = {"UNWRAPPED", "DEVELOPER_FIELD_UNDESCRIBED", "DEVELOPER_FIELD_BACKFILLED"}
MAX_UNWRAPPED = 256 << 20
Profile = dict[int, tuple[str, dict[int, tuple[str, str, float, float, str]]]]


class StrictError(ValueError):
    """The first defect of a file that is read strictly."""

    def __init__(self, code: str, offset: int | None, detail: str = ""):
        super().__init__(f"{code} at byte {offset}" + (f": {detail}" if detail else ""))
        self.code, self.offset = code, offset


def overlay(more: Profile, base: Profile | None = None) -> Profile:
    """A profile with ``more`` messages and fields; where both name a field, ``more`` wins."""
    out = dict(MESSAGES if base is None else base)
    for number, (name, fields) in more.items():
        out[number] = (name, {**out.get(number, ("", {}))[1], **fields})
    return out


def profile_from_csv(text: str) -> Profile:
    """Messages and fields from CSV with a header: global_num, message, field_num, field, kind, scale, offset, units.

    ``kind`` is number, string, bytes, date_time or local_date_time; empty cells mean number, 1, 0 and no units.
    """
    out: Profile = {}
    for row in csv.DictReader(io.StringIO(text)):
        fields = out.setdefault(int(row["global_num"]), (row["message"], {}))[1]
        cell = lambda name, other: (row.get(name) or "").strip() or other  # noqa: E731, B023
        fields[int(row["field_num"])] = (row["field"], cell("kind", "number"), float(cell("scale", "1")), float(cell("offset", "0")), cell("units", ""))
    return out


@dataclass
class Parsed:
    messages: list[dict] = field(default_factory=list)
    provenance: list[dict] = field(default_factory=list)
    error: str | None = None
    parts: int = 0
    bytes_skipped: int = 0
    #: Messages that a truncated file would have had.
    estimated: int | None = None
    skipped: list[tuple[int, int]] = field(default_factory=list)

    def note(self, code: str, action: str, offset: int | None, detail: str = "") -> None:
        self.provenance.append({"code": code, "action": action, "byte_offset": offset, "detail": detail})


def _byte_step(byte: int) -> int:
    crc = 0
    for nibble in (byte & 15, byte >> 4):
        crc = (crc >> 4) ^ CRC_NIBBLES[(crc ^ nibble) & 15]
    return crc


_CRC_BYTES = [_byte_step(byte) for byte in range(256)]


@cache
def _crc_words(level: int) -> np.ndarray:
    """What a register of the CRC becomes after 2**level words of zeros."""
    if level:
        before = _crc_words(level - 1)
        return before[before]
    state = np.arange(65536, dtype=np.uint16)
    for _ in range(2):
        state = (state >> 8) ^ np.array(_CRC_BYTES, np.uint16)[state & 0xFF]
    return state


def crc16(data: bytes, crc: int = 0) -> int:
    table = _CRC_BYTES
    if len(data) >= 256:
        # The CRC is linear: neighbouring words are joined in a tree. Zeros in front change nothing.
        words = np.frombuffer(data, "<u2", len(data) // 2).astype(np.uint16)
        words[0] ^= crc
        level = 0
        while len(words) > 1:
            if len(words) % 2:
                words = np.concatenate([np.zeros(1, np.uint16), words])
            words = _crc_words(level)[words[::2]] ^ words[1::2]
            level += 1
        crc, data = int(_crc_words(0)[words[0]]), data[len(data) & ~1 :]
    for byte in data:
        crc = (crc >> 8) ^ table[(crc ^ byte) & 0xFF]
    return crc


def unwrap(data: bytes, out: Parsed) -> bytes:
    """The file inside gzip or zip containers, three deep at most; sizes are bounded against bombs."""
    for _ in range(3):
        if data[:2] == b"\x1f\x8b":
            with gzip.open(io.BytesIO(data)) as inner:
                data = inner.read(MAX_UNWRAPPED + 1)
            out.note("UNWRAPPED", "reinterpreted", 0, "gzip")
        elif data[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                names = sorted(n for n in archive.namelist() if n.lower().endswith(".fit"))
                if sum(archive.getinfo(n).file_size for n in names) > MAX_UNWRAPPED:
                    raise ValueError("the archive unpacks to too much")
                data = b"".join(archive.read(n) for n in names)
            out.note("UNWRAPPED", "reinterpreted", 0, "zip: " + ",".join(names))
        else:
            return data
        if len(data) > MAX_UNWRAPPED:
            raise ValueError("the container unpacks to too much")
    return data


def _element(raw, code: str, sentinel, kind: str, scale: float, offset: float):
    if code in "fd":
        return None if math.isnan(raw) or math.isinf(raw) else raw
    if raw == sentinel:
        return None
    if kind.startswith("enum:"):
        return ENUMS.get(kind[5:], {}).get(raw, raw)
    if kind == "date_time":
        return raw + EPOCH_OFFSET if raw >= FIRST_ABSOLUTE else None
    if kind == "local_date_time":
        return raw + EPOCH_OFFSET if raw >= FIRST_ABSOLUTE else None
    return raw / scale - offset if scale != 1 or offset else raw


def _unusable(length: int, base: int) -> str | None:
    """Why the value of a field is kept as bytes, if it is."""
    if base not in BASE_TYPES:
        return f"unknown base type {base:#04x}"
    size = 1 if base == 0x07 else struct.calcsize(BASE_TYPES[base][0])
    return None if length and length % size == 0 else f"{length} bytes for base type {base:#04x}"


def _value(data: bytes, base: int, little: bool, kind: str, scale: float, offset: float):
    """The value of a field; None if absent, and the bytes themselves if their type or size makes no sense."""
    if base == 0x07 or kind == "string":
        texts = [x.decode("utf-8", "replace") for x in data.split(b"\0") if x]
        return None if not texts else texts[0] if len(texts) == 1 else texts
    if base not in BASE_TYPES:
        return data.hex()
    if base == 0x0D or kind == "bytes":
        return None if set(data) <= {0xFF} else data.hex()
    code, sentinel = BASE_TYPES[base]
    size = struct.calcsize(code)
    if not data or len(data) % size:
        return data.hex()
    raws = struct.unpack(("<" if little else ">") + code * (len(data) // size), data)
    values = [_element(r, code, sentinel, kind, scale, offset) for r in raws]
    while values and values[-1] is None:
        values.pop()
    return None if not values else values[0] if len(raws) == 1 else values


#: How a field of a plan is read: whole numbers, scaled ones, names, times, floats, and all others by ``_value``.
_WHOLE, _SCALED, _NAMED, _TIME, _FLOAT, _OTHER = range(6)


def _plan(little: bool, fields: list[tuple[int, int, int]], known: dict) -> tuple[struct.Struct, list[tuple]]:
    """How to read a message: all its fields at once, and (label, how, sentinel, scale or names, offset, place, base, kind) of each."""
    codes, steps = "<" if little else ">", []
    for place, (num, length, base) in enumerate(fields):
        label, kind, scale, offset, _ = known.get(num, (f"field_{num}", "number", 1, 0, ""))
        if num == 253:
            label, kind = "timestamp", "date_time"
            base = 0x86 if length == 4 else base  # declared as bytes now and then
        code, absent = BASE_TYPES.get(base, ("s", None))
        if code == "s" or base == 0x0D or kind in ("string", "bytes") or length != struct.calcsize(code):
            codes, how = codes + f"{length}s", _OTHER
        else:
            codes += code
            how = _FLOAT if code in "fd" else _NAMED if kind.startswith("enum:") else _TIME if kind in ("date_time", "local_date_time") else _SCALED if scale != 1 or offset else _WHOLE
        steps.append((label, how, absent, ENUMS.get(kind[5:], {}) if how == _NAMED else scale, offset, place, base, kind))
    return struct.Struct(codes), steps


class _Part:
    """One header, its body and its checksum."""

    def __init__(self, data: bytes, start: int, size: int, out: Parsed, number: int, profile: Profile, layout: list | None = None):
        self.data, self.out, self.number, self.profile, self.layout = data, out, number, profile, layout
        #: Developer fields that nothing has described yet: (values, name, bytes, little, place in the wire) of each.
        self.pending: dict[tuple[int, int], list[tuple]] = {}
        self.salvaged: dict[tuple[int, int, str], int] = {}
        self.unanchored = 0
        self.rolling: int | None = None  # last 12-bit distance, then the whole distance in sixteenths of a metre
        self.rolled = 0
        self.power_last, self.power_wraps = 0, 0
        self.heart_ticks: int | None = None
        self.local: dict[int, tuple] = {}
        self.described: dict[tuple[int, int], tuple[str, int, float, float]] = {}
        self.makers: dict[int, int | None] = {}
        self.last_time: int | None = None
        declared = struct.unpack_from("<I", data, start + 4)[0]
        if size >= 14 and start + 14 <= len(data) and (stored := struct.unpack_from("<H", data, start + 12)[0]) and stored != crc16(data[start : start + 12]):
            out.note("HEADER_CRC_MISMATCH", "kept", start)
        self.begin, self.end = start + size, start + size + declared
        self.sound = self.begin  # where the last whole message ends
        if not declared and len(data) > self.begin + 2:
            self.end = len(data) - 2
            out.note("DATA_SIZE_ZERO", "reinterpreted", start + 4)
        self.declared = declared
        if self.end > len(data):
            out.note("FILE_TRUNCATED", "kept", len(data), f"{self.end - len(data)} bytes are missing")
            self.end = len(data)
        self.at, self.resyncs = min(self.begin, self.end), 0
        before = len(out.messages)
        while self.at < self.end and self._frame():
            pass
        self._remarks()
        decoded = self.sound - self.begin
        if self.begin + declared > len(data) and decoded > 0:
            # What the whole file would hold, if it went on like this.
            out.estimated = round((len(out.messages) - before) * declared / decoded)
        self.consumed = self.end
        if self.end + 2 <= len(data):
            stored = struct.unpack_from("<H", data, self.end)[0]
            if stored != crc16(data[start : self.end]):
                why = "never finished" if not stored else "damaged in its structure" if self.resyncs else "changed in place, or written so"
                out.note("FILE_CRC_MISMATCH", "kept", self.end, why)
            self.consumed = self.end + 2
        else:
            out.note("FILE_CRC_MISSING", "kept", self.end)
            self.consumed = len(data)

    def _remarks(self) -> None:
        """One entry for each kind of field that couldn't be read as it should be."""
        for (defined_at, num, why), count in sorted((k, n) for k, n in self.salvaged.items() if n):
            self.out.note("FIELD_KEPT_RAW", "kept", defined_at, f"field {num}: {why}, {count} times")
        for (index, num), held in sorted(self.pending.items()):
            self.out.note("DEVELOPER_FIELD_UNDESCRIBED", "kept", None, f"dev_{index}_{num}, {len(held)} times")
        if self.unanchored:
            self.out.note("TIME_WITHOUT_ANCHOR", "kept", None, f"{self.unanchored} messages")

    def _frame(self) -> bool:
        at, head = self.at, self.data[self.at]
        if head & 0x80:
            return self._data(at, (head >> 5) & 3, head & 31)
        if head & 0x40:
            return self._definition(at, head)
        return self._data(at, head & 15, None)

    def _layout(self, at: int, head: int):
        """(end, little, number, fields, developer fields) of a definition at ``at``, or None."""
        data, end = self.data, self.end
        if at + 6 > end or data[at + 2] > 1 or not data[at + 5]:
            return None
        little = data[at + 2] == 0
        number = struct.unpack_from("<H" if little else ">H", data, at + 3)[0]
        stop = at + 6 + 3 * data[at + 5]
        if stop > end:
            return None
        fields = [tuple(data[p : p + 3]) for p in range(at + 6, stop, 3)]
        developer = []
        if head & 0x20:
            if stop + 1 > end or stop + 1 + 3 * data[stop] > end:
                return None
            developer = [tuple(data[p : p + 3]) for p in range(stop + 1, stop + 1 + 3 * data[stop], 3)]
            stop += 1 + 3 * len(developer)
        return stop, little, number, fields, developer

    def _definition(self, at: int, head: int) -> bool:
        layout = self._layout(at, head)
        if layout is None:
            return self._resync(at, "BAD_DEFINITION")
        self.at = layout[0]
        if self.layout is not None:
            self.layout.append((self.number, at, layout[0] - at, "definition"))
        _, little, number, fields, developer = layout
        raw = []
        for num, length, base in fields:
            if (why := _unusable(length, base)) and not (num == 253 and length == 4):
                self.salvaged.setdefault((at, num, why), 0)
                raw.append((at, num, why))
        name, known = self.profile.get(number, (f"unknown_{number}", {}))
        size = sum(s for _, s, _ in fields) + sum(s for _, s, _ in developer)
        clocks = [k for k, (num, length, _) in enumerate(fields) if num == 253 and length == 4]
        timed = any(num == 253 for num, _, _ in fields)
        self.local[head & 15] = (little, number, fields, developer, size, name, *_plan(little, fields, known), clocks, timed, set(raw))
        return True

    def _resync(self, at: int, code: str) -> bool:
        """Go on at the next plausible definition: one with known base types that a frame of a known kind follows."""
        self.resyncs += 1
        if self.resyncs <= MAX_RESYNCS:
            for p in range(at + 1, self.end - 6):
                head = self.data[p]
                if head & 0xC0 != 0x40 or head & 0x10 or self.data[p + 1]:
                    continue
                layout = self._layout(p, head)
                if layout and all(b in BASE_TYPES and s for _, s, b in layout[3]):
                    after = layout[0]
                    if after >= self.end or self.data[after] & 0x40 or self.data[after] & 15 in {*self.local, head & 15}:
                        self.out.bytes_skipped += p - at
                        self.out.skipped.append((at, p))
                        self.out.note(code, "skipped", at, f"{p - at} bytes")
                        self.at = p
                        return True
        self.out.bytes_skipped += self.end - at
        self.out.note(code, "dropped", at, f"{self.end - at} bytes to the end")
        self.at = self.end
        return False

    def _data(self, at: int, local: int, shift: int | None) -> bool:
        if local not in self.local:
            return self._resync(at, "UNDEFINED_LOCAL_TYPE")
        little, number, fields, developer, size, name, held, plan, clocks, timed, salvaged = self.local[local]
        if at + 1 + size > self.end:
            self.out.note("TRUNCATED_FRAME", "dropped", at, f"{self.end - at} bytes")
            self.at = self.end
            return False
        values, wire_dev = {}, []
        raws = held.unpack_from(self.data, at + 1)
        p = at + 1 + held.size
        for k in clocks:
            if raws[k] != 0xFFFFFFFF:
                self.last_time = raws[k]
        for label, how, absent, scale, offset, place, base, kind in plan:
            raw = raws[place]
            if how == _OTHER:
                values[label] = _value(raw, base, little, kind, scale, offset)
            elif how == _FLOAT:
                values[label] = raw if math.isfinite(raw) else None
            elif raw == absent:
                values[label] = None
            elif how == _SCALED:
                values[label] = raw / scale - offset
            elif how == _WHOLE:
                values[label] = raw
            elif how == _TIME:
                values[label] = raw + EPOCH_OFFSET if raw >= FIRST_ABSOLUTE else None
            else:
                values[label] = scale.get(raw, raw)
        for key in salvaged:
            self.salvaged[key] += 1
        for num, length, index in developer:
            data = self.data[p : p + length]
            p += length
            wire_dev.append((num, length, index, self.described.get((index, num), (None, None))[1]))
            if (index, num) in self.described:
                label, base, scale, offset = self.described[index, num]
                label = f"{label}_{index}_{num}" if label in values else label
                values[label] = _value(data, base, little, "number", scale, offset)
            else:
                values[f"dev_{index}_{num}"] = data.hex()
                self.pending.setdefault((index, num), []).append((values, f"dev_{index}_{num}", data, little, wire_dev, len(wire_dev) - 1))
        if shift is not None and "timestamp" not in values and self.last_time is None:
            self.unanchored += 1
        elif shift is not None and "timestamp" not in values:
            anchor = self.last_time
            self.last_time = (anchor & ~31) + shift + (32 if shift < (anchor & 31) else 0)
            values["timestamp"] = self.last_time + EPOCH_OFFSET if self.last_time >= FIRST_ABSOLUTE else None
        if number in self.EXPANDERS:
            self.EXPANDERS[number](self, values)
        if isinstance(product := values.get("product"), int):
            table = PRODUCT_TABLES.get(values.get("manufacturer"))
            if table and product in PRODUCTS.get(table, {}):
                values["product_label"] = PRODUCTS[table][product]
        if number == 207 and values.get("developer_data_index") is not None:
            self.makers[values["developer_data_index"]] = values.get("manufacturer_id")
        if number == 206 and values.get("field_name") is not None:
            label = values["field_name"] if isinstance(values["field_name"], str) else values["field_name"][0]
            label = VENDOR_FIELDS.get((self.makers.get(values.get("developer_data_index")), label.strip().lower()), label)
            key = values.get("developer_data_index"), values.get("field_definition_number")
            self.described[key] = (
                label,
                values.get("fit_base_type_id") or 0,
                values.get("scale") or 1,
                values.get("offset") or 0,
            )
            self._backfill(key, at)
        wire = {"little": little, "fields": fields, "developer": wire_dev, "payload": self.data[at + 1 : p], "compressed": shift is not None and not timed}
        self.out.messages.append(
            {"part": self.number, "byte_offset": at, "global_num": number, "name": name, "fields": values, "wire": wire}
        )
        if self.layout is not None:
            self.layout.append((self.number, at, p - at, "data"))
        self.at = self.sound = p
        return True

    def _backfill(self, key: tuple[int, int], at: int) -> None:
        """Reads the developer fields that came before their description."""
        held = self.pending.pop(key, [])
        label, base, scale, offset = self.described[key]
        for values, raw_name, data, little, wire_dev, place in held:
            del values[raw_name]
            name = f"{label}_{key[0]}_{key[1]}" if label in values else label
            values[name] = _value(data, base, little, "number", scale, offset)
            wire_dev[place] = (*wire_dev[place][:3], base)
        if held:
            self.out.note("DEVELOPER_FIELD_BACKFILLED", "reinterpreted", at, f"{label}, {len(held)} times")

    def _record_parts(self, values: dict) -> None:
        """Speed and distance that share three bytes, a power counter beyond 32 bits, the right leg's share."""
        packed = values.get("compressed_speed_distance")
        if isinstance(packed, str) and len(packed) == 6:
            bits = int.from_bytes(bytes.fromhex(packed), "little")
            speed, rolling = bits & 0xFFF, bits >> 12
            self.rolled += rolling if self.rolling is None else (rolling - self.rolling) % 4096
            self.rolling = rolling
            if values.get("speed") is None and speed != 0xFFF:
                values["speed"] = speed / 100
            if values.get("distance") is None:
                values["distance"] = self.rolled / 16
        power = values.get("accumulated_power")
        if isinstance(power, int):
            self.power_wraps += power < self.power_last
            self.power_last = power
            values["accumulated_power"] = power + (self.power_wraps << 32)
        self._balance(values)

    def _balance(self, values: dict) -> None:
        for name, (right, bits, scale) in BALANCES.items():
            raw = values.get(name)
            if isinstance(raw, int) and (share := (raw & bits) / scale) <= 100:
                values["right_balance_pct"] = share if raw & right else 100.0 - share

    def _event_parts(self, values: dict) -> None:
        if values.get("event") == "timer" and isinstance(values.get("data"), int):
            values["timer_trigger"] = ENUMS["timer_trigger"].get(values["data"], values["data"])

    def _monitoring_parts(self, values: dict) -> None:
        """The low half of a time, and the activity whose number shares a byte with its intensity."""
        low = values.get("timestamp_16")
        if isinstance(low, int) and values.get("timestamp") is None:
            if self.last_time is None:
                self.unanchored += 1
            else:
                self.last_time += (low - (self.last_time & 0xFFFF)) & 0xFFFF
                values["timestamp"] = self.last_time + EPOCH_OFFSET if self.last_time >= FIRST_ABSOLUTE else None
        packed = values.get("current_activity_type_intensity")
        if isinstance(packed, str) and len(packed) == 2:
            values["activity_type"], values["intensity"] = int(packed, 16) & 31, int(packed, 16) >> 5

    def _heart_parts(self, values: dict) -> None:
        """Beat times in 12 bits each, lowest bits first, which go on from the last whole one."""
        whole = values.get("event_timestamp")
        whole = [x for x in (whole if isinstance(whole, list) else [whole]) if x is not None]
        if whole:
            self.heart_ticks = round(whole[-1] * 1024)
        packed = values.get("event_timestamp_12")
        if not isinstance(packed, str) or self.heart_ticks is None:
            return
        bits, times = int.from_bytes(bytes.fromhex(packed), "little"), []
        for k in range(len(packed) * 4 // 12):
            low = bits >> 12 * k & 0xFFF
            if low != 0xFFF:
                self.heart_ticks += (low - self.heart_ticks) & 0xFFF
                times.append(self.heart_ticks / 1024)
        values["event_times_s"] = times

    EXPANDERS = {18: _balance, 19: _balance, 20: _record_parts, 21: _event_parts, 55: _monitoring_parts, 132: _heart_parts}


def _looks_like_header(data: bytes, at: int) -> bool:
    return at + 12 <= len(data) and 12 <= data[at] <= 64 and at + data[at] <= len(data) and data[at + 8 : at + 12] == b".FIT"


def _first_header(data: bytes, out: Parsed) -> tuple[int, int] | None:
    """(place, size) of a file's header, also of one that is odd; None if there is none.

    The size may be wrong if the magic is there, and the magic may be missing if the size is one of the two
    that are in use. Up to 4 KB may stand before a header with the magic.
    """
    if len(data) < 12:
        out.error = "FIT_TOO_SMALL" if data else "FIT_EMPTY"
        out.note(out.error, "dropped", 0, f"{len(data)} bytes")
        return None
    at = 0
    if data[0] not in (12, 14) and data[8:12] != b".FIT":
        at = data.find(b".FIT", 0, 4096) - 8
        if at <= 0 or not 12 <= data[at] <= 64:
            out.error = "NOT_FIT_FORMAT"
            out.note("NOT_FIT_FORMAT", "dropped", 0, sniff(data) or "")
            return None
        out.note("PREAMBLE_SKIPPED", "skipped", 0, f"{at} bytes")
    size, magic = data[at], data[at + 8 : at + 12] == b".FIT"
    if size in (12, 14):
        if not magic:
            out.note("HEADER_INVALID", "kept", at, "without the magic")
        return at, size
    if 12 <= size <= 64 and at + size <= len(data):
        out.note("HEADER_INVALID", "kept", at, f"a size of {size}")
        return at, size
    out.note("HEADER_INVALID", "reinterpreted", at, f"a size of {size}, read as 14")
    return at, 14 if at + 14 <= len(data) else 12


def sniff(data: bytes) -> str | None:
    """What bytes are that hold no activity: gpx, tcx, html, xml, json, text, or None; by their first 512."""
    head = data[:512].lstrip(b"\xef\xbb\xbf \t\r\n").lower()
    if head.startswith(b"<"):
        marks = ((b"<gpx", "gpx"), (b"<trainingcenterdatabase", "tcx"), (b"<!doctype html", "html"), (b"<html", "html"))
        return next((kind for mark, kind in marks if mark in head), "xml")
    if head.startswith((b"{", b"[")):
        return "json"
    plain = head[:256]
    return "text" if plain and all(0x09 <= x <= 0x7E for x in plain) else None


def parse(
    content: bytes, mode: str = "lenient", profile: Profile | None = None, strip_pii: bool = False,
    include_unknown: bool = True, include_raw: bool = False,
) -> Parsed:
    """All messages of a file, of all its chained parts; never raises on what bytes hold, unless strict.

    ``mode`` is lenient, forensic (the same here; later steps then flag what they doubt and drop nothing)
    or strict (StrictError at the first defect). ``profile`` takes the place of MESSAGES. ``strip_pii`` drops
    profiles of athletes and serial numbers, ``include_unknown`` keeps messages that the profile doesn't name,
    ``include_raw`` adds the raw numbers of each message as ``raw``. What is left out is counted in the provenance.
    """
    if mode not in ("lenient", "forensic", "strict"):
        raise ValueError(f"unknown mode {mode}")
    out = _parse(content, MESSAGES if profile is None else profile)
    if mode == "strict":
        if defect := next((p for p in out.provenance if p["code"] not in STRICT_ALLOWS), None):
            raise StrictError(defect["code"], defect["byte_offset"], defect["detail"])
        if not out.messages:
            raise StrictError("FIT_NO_CONTENT", None)
    if not out.messages and not out.error:
        out.error = "FIT_NO_CONTENT"
    if strip_pii:
        _strip_pii(out)
    if not include_unknown:
        known = [m for m in out.messages if not m["name"].startswith("unknown_")]
        if dropped := len(out.messages) - len(known):
            out.note("UNKNOWN_MESSAGES_OMITTED", "ignored", None, f"{dropped} messages")
        out.messages = known
    if include_raw:
        for m in out.messages:
            m["raw"] = raw_numbers(m["wire"])
    return out


def _strip_pii(out: Parsed) -> None:
    kept = [m for m in out.messages if m["name"] != "user_profile"]
    hidden = [m for m in kept if m["fields"].get("serial_number") is not None]
    for m in hidden:
        m["fields"]["serial_number"] = None
    if len(kept) < len(out.messages) or hidden:
        out.note("PII_STRIPPED", "dropped", None, f"{len(out.messages) - len(kept)} messages, {len(hidden)} serial numbers")
    out.messages = kept


def raw_numbers(wire: dict) -> dict[int, int | float | list | str]:
    """The raw numbers of a message's fields by number, before sentinels and scaling; texts and odd sizes as hex."""
    at, out = 0, {}
    for num, size, base in wire["fields"]:
        data, at = wire["payload"][at : at + size], at + size
        if _unusable(size, base) or base == 0x07:
            out[num] = data.hex()
            continue
        code = BASE_TYPES[base][0]
        held = struct.unpack(("<" if wire["little"] else ">") + code * (size // struct.calcsize(code)), data)
        out[num] = held[0] if len(held) == 1 else list(held)
    return out


def frames(content: bytes, profile: Profile | None = None) -> Iterator[dict]:
    """What a file is made of, byte for byte: (part, byte_offset, size, kind) of headers, definitions, data and checksums.

    Skipped bytes are frames too, so that sizes add up to the file.
    """
    found = Parsed()
    data = unwrap(content, found)
    layout: list[tuple[int, int, int, str]] = []
    header = _first_header(data, found)
    at, size, number = (*header, 0) if header else (0, 0, 0)
    while header:
        part = _Part(data, at, size, found, number, MESSAGES if profile is None else profile, layout)
        layout.append((number, at, min(size, len(data) - at), "header"))
        if part.end < part.consumed:
            layout.append((number, part.end, part.consumed - part.end, "checksum"))
        at, number = part.consumed, number + 1
        if not _looks_like_header(data, at):
            break
        size = data[at]
    end, last = 0, 0
    for number, at, size, kind in sorted(layout, key=lambda x: x[1]):
        if at > end:
            yield {"part": number, "byte_offset": end, "size": at - end, "kind": "skipped"}
        yield {"part": number, "byte_offset": at, "size": size, "kind": kind}
        end, last = at + size, number
    if end < len(data):
        yield {"part": last, "byte_offset": end, "size": len(data) - end, "kind": "skipped"}


def _parse(content: bytes, profile: Profile) -> Parsed:
    out = Parsed()
    try:
        data = unwrap(content, out)
    except (OSError, EOFError, ValueError, zipfile.BadZipFile) as error:
        out.error = "NOT_FIT_FORMAT"
        out.note("NOT_FIT_FORMAT", "dropped", 0, str(error))
        return out
    header = _first_header(data, out)
    if header is None:
        return out
    at, size = header
    while True:
        at = _Part(data, at, size, out, out.parts, profile).consumed
        out.parts += 1
        if not _looks_like_header(data, at):
            break
        size = data[at]
    if at < len(data):
        out.note("TRAILING_JUNK", "skipped", at, f"{len(data) - at} bytes")
    return out


FILES_SCHEMA = "file_id string, path string, size_bytes long, error string, file_type string, parts int, n_messages long, n_estimated long, bytes_skipped long, skipped array<struct<a:long,b:long>>, provenance array<struct<code:string,action:string,byte_offset:long,detail:string>>"
MESSAGES_SCHEMA = "file_id string, part int, msg_seq long, byte_offset long, global_num int, name string, fields string"


def content_of(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of a folder: path, size_bytes, file_id (SHA-256 of the bytes as they lie there), content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("file_id"), "content")


def _read(content: bytes, mode: str, profile: Profile | None) -> Parsed:
    """What ``parse`` finds; a file that a strict reader refuses has an error and no messages."""
    try:
        return parse(content, mode, profile)
    except StrictError as refusal:
        return Parsed(error=refusal.code, provenance=[{"code": refusal.code, "action": "dropped", "byte_offset": refusal.offset, "detail": "refused by strict reading"}])


def messages_of(files: DataFrame, mode: str = "lenient", profile: Profile | None = None) -> DataFrame:
    """A row per message of (file_id, content) in file order; ``fields`` is JSON, for ``parse_json`` or ``get_json_object``."""
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
    names = [c.split()[0] for c in MESSAGES_SCHEMA.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, rows, size = json.JSONEncoder().encode, [], 0
        for batch in batches:
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                file_id = file_id.as_py()
                for i, m in enumerate(_read(content.as_py(), mode, profile).messages):
                    fields = text(m["fields"])
                    rows.append((file_id, m["part"], i, m["byte_offset"], m["global_num"], m["name"], fields))
                    size += len(fields)
                    if len(rows) >= 20_000 or size >= 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return files.select("file_id", "content").mapInArrow(run, MESSAGES_SCHEMA)


def read_messages(spark: SparkSession, path: str, mode: str = "lenient", profile: Profile | None = None) -> DataFrame:
    """The messages of all files of a folder."""
    return messages_of(content_of(spark, path).select("file_id", "content"), mode, profile)


def file_type(messages: list[dict], part: int | None = None) -> str:
    """What the first file_id says that a file, or a part of it, is: only an activity has sessions."""
    said = next((m["fields"].get("type") for m in messages if m["global_num"] == 0 and part in (None, m["part"])), None)
    return "unknown" if said is None else said if isinstance(said, str) else f"unknown_{said}"


def primary_part(messages: list[dict]) -> int | None:
    """The part that stands for a file: the first activity, else the first."""
    parts = sorted({m["part"] for m in messages})
    return next((p for p in parts if file_type(messages, p) == "activity"), parts[0] if parts else None)


def read_files(spark: SparkSession, path: str, mode: str = "lenient", profile: Profile | None = None) -> DataFrame:
    """A row per file: its identity, what was read, and the provenance of everything that wasn't."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                found = _read(bytes(row.content), mode, profile)
                yield pd.DataFrame([{"file_id": row.file_id, "path": row.path, "size_bytes": row.size_bytes, "error": found.error, "file_type": file_type(found.messages), "parts": found.parts, "n_messages": len(found.messages), "n_estimated": found.estimated, "bytes_skipped": found.bytes_skipped, "skipped": [{"a": a, "b": b} for a, b in found.skipped], "provenance": found.provenance}])

    return content_of(spark, path).mapInPandas(run, FILES_SCHEMA)


def read_records(spark: SparkSession, path: str, streams: tuple[str, ...] = ("heart_rate", "power", "speed", "distance", "altitude", "cadence")) -> DataFrame:
    """Records as a wide table: file_id, part, i, t (microseconds), and a column for each named stream."""
    records = read_messages(spark, path).where("global_num = 20")
    number = lambda name: F.get_json_object("fields", f"$.{name}").cast("double")
    return records.select(
        "file_id", "part", F.col("msg_seq").alias("i"),
        (F.get_json_object("fields", "$.timestamp").cast("long") * 1_000_000).alias("t"),
        *(F.coalesce(number(f"enhanced_{s}"), number(s)).alias(s) for s in streams),
    )

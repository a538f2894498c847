"""Every code that files, verbs and checks can give, with what it says."""

from __future__ import annotations

#: Codes by kind.
ERRORS = {
    "NOT_FIT_FORMAT": "no activity file, or a container that can't be opened",
    "FIT_NO_CONTENT": "a file without messages",
    "FIT_EMPTY": "a file without bytes",
    "FIT_TOO_SMALL": "a file that is shorter than a header",
    "REPAIR_NOTHING_TO_SALVAGE": "neither sessions nor records with times",
    "NO_TRIM_WINDOW": "trim without bounds",
    "TRIM_EMPTY": "no record lies within the bounds",
    "NO_EDIT_REQUESTED": "edit without changes",
    "UNKNOWN_ENUM_NAME": "a sport that has no number",
    "EDIT_NO_DISTANCE": "no distance to scale, or no positive one to scale to",
    "EDIT_OUT_OF_RANGE": "a field can't hold the new value",
    "SELF_CHECK_FAILED": "what a verb wrote didn't read back clean",
}
PROVENANCE = {
    "UNWRAPPED": "taken out of a container",
    "PREAMBLE_SKIPPED": "bytes before the header",
    "TRAILING_JUNK": "bytes after the last part",
    "HEADER_INVALID": "a header of an odd size, or without the magic",
    "PII_STRIPPED": "profiles of athletes and serial numbers left out on demand",
    "UNKNOWN_MESSAGES_OMITTED": "messages that the profile doesn't name left out on demand",
    "HEADER_CRC_MISMATCH": "the header's checksum is wrong",
    "FILE_CRC_MISMATCH": "the file's checksum is wrong",
    "FILE_CRC_MISSING": "the file ends before its checksum",
    "DATA_SIZE_ZERO": "the header gives no size; the rest of the file was taken",
    "FILE_TRUNCATED": "the file ends before its data",
    "TRUNCATED_FRAME": "the last message is cut",
    "BAD_DEFINITION": "a definition that makes no sense",
    "UNDEFINED_LOCAL_TYPE": "a message without definition",
    "FIELD_KEPT_RAW": "a field whose type or size makes no sense, kept as bytes",
    "DEVELOPER_FIELD_UNDESCRIBED": "a developer field that nothing describes, kept as bytes",
    "DEVELOPER_FIELD_BACKFILLED": "a developer field that is described after its first use",
    "TIME_WITHOUT_ANCHOR": "a relative time before any absolute one",
}
CHECKS = {
    "HR_IMPLAUSIBLE": "heart rates above 230",
    "HR_FLATLINE": "a heart rate that doesn't change for more than 120 records",
    "POWER_IMPLAUSIBLE": "power above 2,500 W",
    "DISTANCE_DECREASES": "distances that fall",
    "DISTANCE_RESET": "distances that begin anew",
    "DISTANCE_FROZEN": "a distance that stands still at speed",
    "SUMMARY_AVG_EXCEEDS_MAX": "a declared mean above its maximum",
    "SUMMARY_NEGATIVE_TOTAL": "a declared total below 0",
    "ZERO_DURATION_SESSION": "records in a session that declares no time",
    "MOVEMENT_WITHOUT_DISTANCE": "speed, but no distance",
    "LAP_ZERO_DURATION": "laps without time",
    "LAP_COVERAGE_GAP": "laps that cover less than nine tenths of a session",
    "POOL_ZERO_LENGTH": "active lengths below 2 s",
    "POOL_LENGTH_IMPLAUSIBLE": "a pool below 15 m or above 55 m",
    "UNRELIABLE_ABSOLUTE_TIME": "times before 2010",
    "TIMESTAMPS_AFTER_CREATION": "times more than a week after the file was made",
    "RECORDS_REORDERED": "records out of order",
    "RECORDS_OUTSIDE_SESSIONS": "records that no session holds",
    "ACTIVITY_MESSAGE_MISSING": "records without an activity message",
    "NUM_SESSIONS_MISMATCH": "another number of sessions than declared",
    "LOCAL_TIMESTAMP_IMPLAUSIBLE": "a local time more than 26 h away",
    "ENHANCED_PAIR_DISAGREES": "a field held twice with different values",
    "NULL_ISLAND": "positions at 0, 0",
    "GPS_SPIKES": "positions that were reached and left too fast",
}
VALIDATION = {
    "VAL_UNPARSEABLE": "the file can't be read",
    "VAL_SPEC_VIOLATION": "a strict reader refuses the file",
    "VAL_GC_NO_FILE_ID": "no file_id",
    "VAL_GC_NOT_ACTIVITY": "file_id names no activity",
    "VAL_GC_NO_TIME_CREATED": "file_id has no time",
    "VAL_GC_NO_MANUFACTURER": "file_id has no maker",
    "VAL_GC_NO_SESSION": "no session",
    "VAL_GC_NO_ACTIVITY": "no activity message",
    "VAL_GC_NO_LAP": "no lap",
    "VAL_GC_NO_EVENTS": "no events",
    "VAL_GC_CORRUPTION_GAPS": "gaps where bytes were skipped",
    "VAL_GC_NONMONOTONIC_SOURCE": "records out of order",
    "VAL_GC_NO_TIMER_STOP": "events, but no stop",
    "VAL_GC_LOCAL_TIMESTAMP": "an impossible local time",
    "VAL_STRAVA_NOT_ACTIVITY": "file_id names no activity",
    "VAL_STRAVA_NO_RECORDS": "no records",
    "VAL_STRAVA_NO_SESSION": "records, but no session",
}
REGISTRY = {"error": ERRORS, "provenance": PROVENANCE, "check": CHECKS, "validation": VALIDATION}


def rows() -> list[dict]:
    """(kind, code, meaning) of all codes, in order of kind and code."""
    return [{"kind": kind, "code": code, "meaning": held[code]} for kind, held in sorted(REGISTRY.items()) for code in sorted(held)]

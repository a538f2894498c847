"""One file at a time from a shell: ``python -m fitlake.cli VERB FILE``. Folders are for Spark.

Exit codes: 0 clean, 2 read with remarks, 3 nothing usable, 4 no activity file, 64 wrong usage.
"""

from __future__ import annotations

import argparse
import hashlib
import re
import sys
from datetime import datetime, timezone
from pathlib import Path

from . import texts
from .functions import codes
from .functions.scalar import zone_bounds
from .operators import verbs
from .sinks import canonical
from .sources.fit import StrictError, file_type, parse, read_files, read_messages

OK, REMARKS, UNUSABLE, NOT_FIT, USAGE = 0, 2, 3, 4, 64
NO_ACTIVITY_FILE = {"NOT_FIT_FORMAT", "FIT_TOO_SMALL"}


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        print(f"error: {message}", file=sys.stderr)
        raise SystemExit(USAGE)


def document(content: bytes, strip_pii: bool = False, mode: str = "lenient", include_unknown: bool = True, include_raw: bool = False) -> dict:
    """What a file holds, as plain values: identity, messages in order, provenance, error."""
    found = parse(content, mode, strip_pii=strip_pii, include_unknown=include_unknown, include_raw=include_raw)
    return canonical.json_safe({
        "file_type": file_type(found.messages),
        "sha256": hashlib.sha256(content).hexdigest(),
        "size_bytes": len(content),
        "parts": found.parts,
        "messages": [
            {"part": m["part"], "byte_offset": m["byte_offset"], "name": m["name"], "fields": m["fields"]} | ({"raw": m["raw"]} if include_raw else {})
            for m in found.messages
        ],
        "provenance": found.provenance,
        "error": found.error,
    })


def exit_code(content: bytes) -> int:
    found = parse(content)
    if found.error in NO_ACTIVITY_FILE:
        return NOT_FIT
    return UNUSABLE if found.error or not found.messages else REMARKS if found.provenance else OK


def moment(text: str, start: int, end: int) -> int:
    """Seconds since 1970 of a bound: +90s and +5m count from the start, -10m from the end; else seconds or ISO 8601."""
    if found := re.fullmatch(r"([+-])(\d+(?:\.\d+)?)([smh]?)", text):
        size = float(found[2]) * {"": 1, "s": 1, "m": 60, "h": 3600}[found[3]]
        return round(start + size if found[1] == "+" else end - size)
    if text.isdigit():
        return int(text)
    at = datetime.fromisoformat(text)
    return round((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp())


def shift(text: str) -> int:
    """Seconds of a shift: a number of them or ±HH:MM."""
    if found := re.fullmatch(r"([+-]?)(\d{1,2}):(\d{2})", text):
        return (-1 if found[1] == "-" else 1) * (int(found[2]) * 3600 + int(found[3]) * 60)
    return int(text)


def _parser() -> argparse.ArgumentParser:
    parser = _Parser(prog="fitlake")
    sub = parser.add_subparsers(dest="verb", required=True, parser_class=_Parser)
    made = {name: sub.add_parser(name) for name in ("parse", "inspect", "repair", "validate", "edit", "trim", "doctor", "reveal", "scrub")}
    made["analyze"] = sub.add_parser("analyze")
    for p in made.values():
        p.add_argument("file")
    sub.add_parser("codes")
    for name in ("parse", "analyze"):
        made[name].add_argument("--mode", choices=("lenient", "strict", "forensic"), default="lenient")
    for option in ("--ftp", "--max-hr", "--rest-hr"):
        made["analyze"].add_argument(option, type=float)
    made["analyze"].add_argument("--female", action="store_true")
    for name in ("repair", "edit", "trim", "scrub"):
        made[name].add_argument("-o", "--output", required=True)
    for option in ("--strip-pii", "--include-raw", "--no-unknown", "--summary"):
        made["parse"].add_argument(option, action="store_true")
    for option in ("--hr-zones", "--power-zones"):
        made["analyze"].add_argument(option, type=zone_bounds)
    for name in ("analyze", "doctor", "reveal"):
        made[name].add_argument("--text", action="store_true")
    made["inspect"].add_argument("--limit", type=int, default=50)
    for name in ("validate", "doctor"):
        made[name].add_argument("--platform", choices=("strict-spec", "garmin-connect", "strava"), default="strict-spec")
    for option, kind in (("--sport", str), ("--sub-sport", int), ("--manufacturer", int), ("--product", int), ("--total-distance", float), ("--time-shift", shift)):
        made["edit"].add_argument(option, type=kind)
    made["trim"].add_argument("--after")
    made["trim"].add_argument("--before")
    for category in verbs.PERSONAL:
        made["scrub"].add_argument("--keep-" + category.replace("_", "-"), action="store_true")
    made["scrub"].add_argument("--gps-radius", type=float)
    made["scrub"].add_argument("--drop-all-gps", action="store_true")
    return parser


def _changed(args: argparse.Namespace, content: bytes) -> bytes:
    if args.verb == "repair":
        return verbs.repair(content)
    if args.verb == "edit":
        return verbs.edit(content, args.sport, args.sub_sport, args.manufacturer, args.product, args.time_shift, args.total_distance)
    if args.verb == "trim":
        times = [t for m in parse(content).messages if m["name"] in ("record", "length") and (t := m["fields"].get("timestamp")) is not None]
        if not times:
            raise verbs.VerbError("TRIM_EMPTY")
        bounds = [None if x is None else moment(x, min(times), max(times)) for x in (args.after, args.before)]
        return verbs.trim(content, *bounds)
    kept = tuple(c for c in verbs.PERSONAL if not getattr(args, f"keep_{c}"))
    return verbs.scrub(content, kept, "all" if args.drop_all_gps else args.gps_radius)


def analyze(args: argparse.Namespace) -> dict:
    """Sessions, structure and findings of one file. This verb alone starts Spark."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .functions import sports
    from .plans import activity, checks, structure

    spark = SparkSession.builder.appName("fitlake").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    messages = read_messages(spark, str(Path(args.file).resolve()), args.mode).cache()
    files = read_files(spark, str(Path(args.file).resolve()), args.mode)
    sessions, owned = activity.kept(messages)
    pieces = structure.structure(messages)
    styles = activity.report(messages, args.ftp, args.max_hr, args.rest_hr, args.female).cache()
    named = styles.select(*activity.OWN, sports.pace_style(F.col("profile")).alias("style"), (F.col("sport") == "swimming").alias("swim"))
    label = sports.interval_label(F.col("n"), F.col("duration_s"), F.lit(None).cast("double"), F.col("intensity"), F.col("rest_s"), F.col("style"), F.col("swim"))
    repeats = structure.repeat_groups(pieces).join(named, activity.OWN).withColumn("label", label).drop("style", "swim")
    zones = [activity.time_in_zones(owned, messages, s, b).withColumn("stream", F.lit(s)) for s, b in (("heart_rate", args.hr_zones), ("power", args.power_zones))]
    held = lambda df, *order: [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]
    return canonical.json_safe({
        "sessions": held(styles, "part", "session"),
        "structure": held(pieces, "part", "session", "index"),
        "repeats": held(repeats, "part", "session", "repeat"),
        "splits": held(activity.distance_splits(owned), "part", "session", "split"),
        "zones": held(zones[0].unionByName(zones[1]), "part", "session", "stream", "zone"),
        "insights": held(structure.insights(owned, sessions, repeats=repeats), "part", "session", "code"),
        "gaps": held(activity.gaps(owned, messages, files, sessions), "part", "session", "t"),
        "discrepancies": held(activity.discrepancies(sessions, activity.derived_totals(owned, messages, sessions)), "part", "session", "field"),
        "findings": held(checks.findings(messages), "part", "session", "code"),
    })


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.verb == "codes":
        print(canonical.dumps(codes.rows()))
        return OK
    try:
        content = Path(args.file).read_bytes()
    except OSError as error:
        print(f"error: {error}", file=sys.stderr)
        return USAGE
    try:
        if args.verb == "parse":
            held = document(content, args.strip_pii, args.mode, not args.no_unknown, args.include_raw)
            print(texts.summary(held) if args.summary else canonical.dumps(held))
        elif args.verb == "analyze":
            if parse(content, args.mode).messages:
                held = analyze(args)
                print(texts.analysis(held) if args.text else canonical.dumps(held))
        elif args.verb == "inspect":
            for m in parse(content).messages[: args.limit]:
                print(f"{m['byte_offset']:>8} {m['global_num']:>5} {m['name']:<20} {len(m['wire']['payload'])} bytes")
        elif args.verb in ("validate", "doctor", "reveal"):
            found = verbs.reveal(content) if args.verb == "reveal" else getattr(verbs, args.verb)(content, args.platform)
            shown = texts.findings(found) if getattr(args, "text", False) else canonical.dumps(found)
            print(shown)
            if args.verb != "reveal":
                return REMARKS if found else OK
        else:
            Path(args.output).write_bytes(_changed(args, content))
            return OK
    except verbs.VerbError as failure:
        print(f"error: {failure}", file=sys.stderr)
        return NOT_FIT if failure.code in NO_ACTIVITY_FILE else UNUSABLE
    except StrictError as refusal:
        print(f"error: {refusal}", file=sys.stderr)
        return NOT_FIT if refusal.code in NO_ACTIVITY_FILE else UNUSABLE
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return USAGE
    return exit_code(content)


if __name__ == "__main__":
    sys.exit(main())

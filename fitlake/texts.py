"""Reports for people, as lines of text; for programs there is JSON."""

from __future__ import annotations

#: How many discrepancies and gaps a report names before it only counts the rest.
MOST_DISCREPANCIES, MOST_GAPS = 4, 6


def clock(seconds: float) -> str:
    """m:ss, or h:mm:ss from an hour on; half seconds up."""
    whole = int(seconds + 0.5)
    hours, rest = divmod(whole, 3600)
    return f"{hours}:{rest // 60:02d}:{rest % 60:02d}" if hours else f"{rest // 60}:{rest % 60:02d}"


def _first(items: list[str], most: int, sep: str = ", ") -> str:
    return sep.join(items[:most]) + (f" and {len(items) - most} more" if len(items) > most else "")


def summary(document: dict) -> str:
    """What a file is, what it holds, and what was wrong with it; ``document`` is that of the parse verb."""
    counts: dict[str, int] = {}
    for m in document["messages"]:
        counts[m["name"]] = counts.get(m["name"], 0) + 1
    lines = [f"{document['file_type']}, {document['parts']} parts, {document['size_bytes']} bytes"]
    lines += [f"  {n} {name}" for name, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    lines += [f"  {p['code']} at {p['byte_offset']}: {p['detail']}".rstrip(": ") for p in document["provenance"]]
    return "\n".join(lines + ([f"  error: {document['error']}"] if document["error"] else []))


def analysis(held: dict) -> str:
    """Sessions with their paces, efforts, repeats, gaps, discrepancies and insights; ``held`` is that of the analyze verb."""
    if not held["sessions"]:
        return "no sessions"
    lines = []
    for s in held["sessions"]:
        own = lambda name, s=s: [x for x in held[name] if (x["part"], x["session"]) == (s["part"], s["session"])]
        facts = [
            clock(s["duration_s"]) if s["duration_s"] else None,
            f"{s['distance_m'] / 1000:.2f} km" if s["distance_m"] else None,
            s["pace"],
            f"{s['avg_power']:.0f} W" if s["avg_power"] and s["primary_signal"] == "power" else None,
            f"{s['avg_heart_rate']:.0f} bpm" if s["avg_heart_rate"] else None,
        ]
        lines.append(f"session {s['session'] + 1}: {s['sport']}" + (" (rebuilt)" if s["rebuilt"] else ""))
        lines.append("  " + ", ".join(x for x in facts if x))
        if repeats := own("repeats"):
            lines.append("  repeats: " + "; ".join(x["label"] for x in repeats))
        if s["load"] is not None:
            lines.append(f"  load {s['load']:.0f} by {s['load_basis']}")
        if gaps := own("gaps"):
            lines.append("  gaps: " + _first([f"{g['kind']} {clock(g['gap_us'] / 1e6)}" for g in gaps], MOST_GAPS))
        if found := own("discrepancies"):
            lines.append("  said, found: " + _first([f"{d['field']} {d['declared']:g}, {d['derived']:g}" for d in found], MOST_DISCREPANCIES, "; "))
        lines += [f"  {x['code']} {x['value']:.1f}" for x in own("insights")]
        lines += [f"  left out: {x}" for x in s["omissions"]]
    return "\n".join(lines)


def findings(found: list[dict]) -> str:
    """A line for each finding of validate, doctor or reveal."""
    return "\n".join(" ".join(str(v) for v in x.values() if v is not None) for x in found) or "nothing"

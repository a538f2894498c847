"""Messages back to activity files: little-endian, a definition for each new shape, both checksums.

A message that was read keeps its ``wire`` (layout and payload), so it is written again without loss,
also where nothing is known about its fields. ``synthesize`` makes messages from names and values.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from functools import cache

from ..sources.fit import BASE_TYPES, ENUMS, EPOCH_OFFSET, FIRST_ABSOLUTE, MESSAGES, SEMICIRCLES, crc16

LOCAL_SLOTS = 16
_NUMBERS = {name: number for number, (name, _) in MESSAGES.items()}


def places(wire: dict) -> Iterable[tuple[int, int, int, int]]:
    """(field number, start in the payload, size, base type) of each field that isn't a developer's."""
    at = 0
    for num, size, base in wire["fields"]:
        yield num, at, size, base
        at += size


def sentinel(base: int, size: int) -> bytes:
    """What fills an absent field of ``size`` bytes, little-endian."""
    code, absent = BASE_TYPES.get(base, ("B", 0xFF))
    if code == "s":
        return bytes(size)
    if code in "fd" or size % struct.calcsize(code):
        return b"\xff" * size
    return struct.pack("<" + code, absent) * (size // struct.calcsize(code))


def _swapped(data: bytes, base: int | None) -> bytes:
    code = BASE_TYPES.get(base, ("B", 0))[0]
    width = 1 if code == "s" else struct.calcsize(code)
    return b"".join(data[p : p + width][::-1] for p in range(0, len(data), width))


def canonical(message: dict) -> dict:
    """The message with a little-endian wire that holds its time, which a compressed header had instead."""
    wire = message["wire"]
    fields, payload = list(wire["fields"]), wire["payload"]
    if not wire["little"]:
        at, parts = 0, []
        for size, base in [(s, b) for _, s, b in fields] + [(s, b) for _, s, _, b in wire["developer"]]:
            parts.append(_swapped(payload[at : at + size], base))
            at += size
        payload = b"".join(parts)
    time = message["fields"].get("timestamp")
    if wire.get("compressed") and time is not None:
        fields, payload = [(253, 4, 0x86), *fields], struct.pack("<I", time - EPOCH_OFFSET) + payload
    return message | {"wire": {"little": True, "fields": fields, "developer": wire["developer"], "payload": payload}}


@cache
def _widths(name: str, scale: float) -> list[tuple[int, int, struct.Struct]]:
    """(base type, its sentinel, layout) of the widths that a new number of a field may have, the least first."""
    grows = name in ("distance", "serial_number", "accumulated_power") or name.startswith(("total_", "enhanced_"))
    least = 0x86 if grows and scale != 1 or name == "serial_number" else 0x84 if scale != 1 else 0x02
    widths = [0x02, 0x84, 0x86, 0x8F]
    return [(b, BASE_TYPES[b][1], struct.Struct("<" + BASE_TYPES[b][0])) for b in widths[widths.index(least) :]]


_SIGNED, _TIME = struct.Struct("<i"), struct.Struct("<I")


def _number(name: str, scale: float, raw: int) -> tuple[int, bytes]:
    """Base type and bytes of a new number: the least width that its field may need, or a wider one if the value asks for it."""
    if scale == SEMICIRCLES or raw < 0:
        return 0x85, _SIGNED.pack(raw)
    return next((base, held.pack(raw)) for base, absent, held in _widths(name, scale) if raw < absent)


@cache
def _known(name: str) -> dict[str, tuple]:
    """label: (number, kind, scale, offset, numbers of names) of a message's fields."""
    return {
        label: (num, kind, scale, offset, {v: k for k, v in ENUMS[kind[5:]].items()} if kind.startswith("enum:") else None)
        for num, (label, kind, scale, offset, _) in MESSAGES[_NUMBERS[name]][1].items()
    }


def synthesize(name: str, values: dict) -> dict:
    """A message from names and values; the width of a number comes from its field and value. Nulls are left out."""
    known = _known(name)
    fields, payload = [], []
    for label, value in values.items():
        if value is None:
            continue
        num, kind, scale, offset, numbers = known[label]
        if kind == "string":
            data, base = value.encode() + b"\0", 0x07
        elif numbers is not None:
            data, base = bytes((value if isinstance(value, int) else numbers[value],)), 0x00
        elif kind in ("date_time", "local_date_time"):
            data, base = _TIME.pack(value - EPOCH_OFFSET), 0x86
        else:
            base, data = _number(label, scale, round((value + offset) * scale))
        fields.append((num, len(data), base))
        payload.append(data)
    wire = {"little": True, "fields": fields, "developer": [], "payload": b"".join(payload)}
    return {"part": 0, "byte_offset": None, "global_num": _NUMBERS[name], "name": name, "fields": dict(values), "wire": wire}


def encode(messages: Iterable[dict]) -> bytes:
    """One file of all ``messages``. Shapes share 16 local slots, which are taken in turn."""
    slots: dict[tuple, int] = {}
    held: list = [None] * LOCAL_SLOTS
    turn, body = 0, bytearray()
    for message in messages:
        wire = message["wire"]
        if not wire["little"] or wire.get("compressed"):
            wire = canonical(message)["wire"]
        shape = (message["global_num"], tuple(wire["fields"]), tuple([d[:3] for d in wire["developer"]]))
        slot = slots.get(shape)
        if slot is None:
            if held[turn] is not None:
                del slots[held[turn]]
            slot, slots[shape], held[turn] = turn, turn, shape
            fields, developer = shape[1:]
            body += bytes((0x40 | (0x20 if developer else 0) | turn, 0, 0)) + struct.pack("<HB", shape[0], len(fields))
            body += b"".join(map(bytes, fields))
            if developer:
                body += bytes((len(developer),)) + b"".join(map(bytes, developer))
            turn = (turn + 1) % LOCAL_SLOTS
        body.append(slot)
        body += wire["payload"]
    header = struct.pack("<BBHI4s", 14, 0x20, 21141, len(body), b".FIT")
    whole = header + struct.pack("<H", crc16(header)) + bytes(body)
    return whole + struct.pack("<H", crc16(whole))


def raw_value(message: dict, num: int) -> int | None:
    """The first raw number of a field of a canonical message; None if it is absent or no number."""
    for n, at, size, base in places(message["wire"]):
        code, absent = BASE_TYPES.get(base, ("s", None))
        if n == num and code not in "sfd" and size >= struct.calcsize(code):
            raw = struct.unpack_from("<" + code, message["wire"]["payload"], at)[0]
            return None if raw == absent else raw
    return None


def with_raw(message: dict, num: int, raw: int | None) -> dict:
    """A copy of a canonical message with another raw number in a field, or with none (the sentinel, never 0).

    Raises ValueError if the field can't hold it. A message without the field comes back as it is.
    """
    wire = message["wire"]
    for n, at, size, base in places(wire):
        if n != num:
            continue
        if raw is None:
            data = sentinel(base, size)
        else:
            code, absent = BASE_TYPES[base]
            try:
                data = struct.pack("<" + code, raw)
            except struct.error as error:
                raise ValueError(f"{message['name']}.{num} can't hold {raw}") from error
            if raw == absent or len(data) != size:
                raise ValueError(f"{message['name']}.{num} can't hold {raw}")
        payload = wire["payload"][:at] + data + wire["payload"][at + size :]
        return message | {"wire": wire | {"payload": payload}}
    return message


def absolute(raw: int | None) -> int | None:
    """Seconds since 1970 of a raw time; None if it is absent or relative to a device's start."""
    return raw + EPOCH_OFFSET if raw is not None and raw >= FIRST_ABSOLUTE else None

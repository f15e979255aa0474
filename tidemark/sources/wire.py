"""Envelopes in protobuf's wire format, read without a generated class or a connector."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import EVENT_SCHEMA

# Field numbers of the messages.
ENVELOPE = {1: "metadata", 2: "payload"}
METADATA = {1: "search", 2: "count", 3: "properties", 5: "created_at_ns", 7: "event_type", 9: "foreign_id", 10: "foreign_type", 11: "track", 12: "id"}
ENTRY = {1: "key", 2: "value"}
LISTS, TEXTS = ("search", "count", "properties"), ("event_type", "foreign_id", "foreign_type")


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("a number of more than 64 bits")


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: whole numbers, or bytes of what has a length."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind in (1, 5):
            width = 8 if kind == 1 else 4
            (value,) = struct.unpack_from("<Q" if kind == 1 else "<I", raw, at)
            at += width
        elif kind == 2:
            size, at = _varint(raw, at)
            if at + size > len(raw):
                raise ValueError("a field goes beyond the message")
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield number, value


def _signed(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def _entry(raw: bytes) -> dict:
    return {ENTRY[n]: v for n, v in fields(raw) if n in ENTRY}


def decode(raw: bytes) -> dict:
    """The event columns of an envelope, unset ones as protobuf's defaults; ``metadata_missing`` if it has no metadata."""
    found: dict = {"id": 0, "created_at_ns": 0, **dict.fromkeys(TEXTS, ""), **{n: [] for n in LISTS}, "track": {}, "payload": b"", "metadata_missing": True}
    for number, value in fields(raw):
        if number == 2:
            found["payload"] = value
        if number != 1:
            continue
        found["metadata_missing"] = False
        for inner, part in fields(value):
            name = METADATA.get(inner)
            if name in LISTS:
                pair = _entry(part)
                found[name].append({k: pair.get(k, b"").decode() for k in ("key", "value")})
            elif name in TEXTS:
                found[name] = part.decode()
            elif name == "track":
                pair = _entry(part)
                found[name][pair.get("key", b"").decode()] = pair.get("value", 0)
            elif name:
                found[name] = _signed(part)
    return found


def parse_protobuf(raw: Column) -> Column:
    """A struct of the event columns and ``metadata_missing`` of each envelope; null for a null and for what is no envelope."""
    kind = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in EVENT_SCHEMA)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [*EVENT_SCHEMA.fieldNames(), "metadata_missing"]
        for messages in parts:
            rows = []
            for m in messages:
                try:
                    one = decode(bytes(m)) if m is not None else None
                except (ValueError, IndexError, TypeError, AttributeError, struct.error):
                    one = None
                rows.append({n: one[n] for n in names} if one else dict.fromkeys(names))
            yield pd.DataFrame(rows, columns=names)

    return F.pandas_udf(run, f"struct<{kind}, metadata_missing: boolean>")(raw)

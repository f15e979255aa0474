"""Expressions over event columns: segments, date tags, tokens, ids, validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import ALL_FIELD, ALL_VALUE, DATE_TAGS, EMPTY, EVENT_TYPE, FIRST_TAGGED, LAST_TAGGED, SEGMENT_STEP, SEPARATOR


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def seconds(ns: Column) -> Column:
    """Whole seconds, cut towards zero."""
    return _div(ns, 1_000_000_000)


def segment(ns: Column, step: int = SEGMENT_STEP) -> Column:
    return _div(seconds(ns), step)


def bucket(ns: Column, width: int) -> Column:
    """The start of the time bucket, in seconds."""
    return _div(seconds(ns), width) * F.lit(width).cast("long")


def kv(key, value) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(key).alias("key"), lit(value).alias("value"))


def date_tags(ns: Column) -> Column:
    """The four date terms in UTC; empty values outside the years that have them."""
    s = seconds(ns)
    known = s.between(FIRST_TAGGED, LAST_TAGGED)
    time = F.timestamp_seconds(s)
    return F.array(*(kv(name, F.when(known, F.date_format(time, form)).otherwise("")) for name, form in DATE_TAGS.items()))


def filled(pairs: Column) -> Column:
    """Pairs with a mark in place of empty values."""
    return F.transform(pairs, lambda p: kv(p["key"], F.when(p["value"] == "", F.lit(EMPTY)).otherwise(p["value"])))


def token(field, value) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.concat(lit(field), F.lit(SEPARATOR), lit(value))


def tokens(search: Column, event_type: Column, foreign_type: Column, foreign_id: Column, whitelist: list[str] | None = None) -> Column:
    """The distinct terms by which an event is found.

    Pairs with an empty key or value have none, nor have keys outside a non-empty whitelist. The owner,
    the event type and the term of all events replace pairs of the same field, in that order.
    """
    reserved = [EVENT_TYPE, ALL_FIELD]

    def free(p: Column) -> Column:
        fine = (p["key"] != "") & (p["value"] != "") & (p["key"] != foreign_type) & ~p["key"].isin(reserved)
        return fine & p["key"].isin(list(whitelist)) if whitelist else fine

    own = F.transform(F.filter(search, free), lambda p: token(p["key"], p["value"]))
    owner = F.when(foreign_type.isin(reserved), F.array().cast("array<string>")).otherwise(F.array(token(foreign_type, foreign_id)))
    return F.array_distinct(F.concat(own, owner, F.array(token(EVENT_TYPE, event_type), token(ALL_FIELD, ALL_VALUE))))


def validation_error(foreign_id: Column, foreign_type: Column, event_type: Column, metadata_missing: Column | None = None) -> Column:
    """The first thing that an envelope lacks, or an empty text."""
    lacks = lambda c: c.isNull() | (c == "")
    checks = F.when(lacks(foreign_id), "missing foreign_id").when(lacks(foreign_type), "missing foreign_type").when(lacks(event_type), "missing event_type").otherwise("")
    return checks if metadata_missing is None else F.when(metadata_missing, "missing metadata").otherwise(checks)


def hit_id(id_: Column, doc_seq: Column) -> Column:
    """An event's id, or its place plus one where it has none."""
    return F.when(F.coalesce(id_, F.lit(0)) != 0, id_).otherwise(doc_seq + 1)


def stream_id(partition: Column, offset: Column) -> Column:
    """A record's id from its partition and offset."""
    return F.shiftleft(partition.cast("long"), 56).bitwiseOR(offset.cast("long"))

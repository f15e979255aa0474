"""Envelopes from JSON lines, free JSON and tracking URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.events import hit_id, kv, validation_error
from tidemark.functions.flatten import flatten_column
from tidemark.schema import EVENT_SCHEMA, KVS
from tidemark.sources.wire import parse_protobuf

_WIDE = ("id", "created_at_ns")


def parse_envelope(text: Column) -> Column:
    """An envelope's JSON form {"metadata": {...}, "payload": ...}; null for malformed JSON. 64-bit integers may be texts."""
    fields = ", ".join(f"{f.name}: {'string' if f.name in _WIDE else f.dataType.simpleString()}" for f in EVENT_SCHEMA if f.name != "payload")
    return F.from_json(text, f"struct<metadata: struct<{fields}>, payload: binary>")


def event_columns(envelope: str) -> list[Column]:
    """The event columns of a parsed envelope column."""
    names = [f for f in EVENT_SCHEMA if f.name != "payload"]
    column = lambda f: F.col(f"{envelope}.metadata.{f.name}")
    return [*((column(f).cast("long") if f.name in _WIDE else column(f)).alias(f.name) for f in names), F.col(f"{envelope}.payload").alias("payload")]


def from_envelope_json(df: DataFrame, json_col: str) -> DataFrame:
    """Event columns of envelope lines, and ``metadata_missing``."""
    parsed = df.withColumn("_e", parse_envelope(F.col(json_col)))
    return parsed.select(*[c for c in df.columns if c != json_col], *event_columns("_e"), F.col("_e.metadata").isNull().alias("metadata_missing"))


def from_envelope_protobuf(df: DataFrame, raw_col: str) -> DataFrame:
    """Event columns of envelopes in protobuf's wire format, and ``metadata_missing``, true too for what can't be read."""
    parsed = df.withColumn("_e", parse_protobuf(F.col(raw_col)))
    names = EVENT_SCHEMA.fieldNames()
    return parsed.select(*[c for c in df.columns if c != raw_col], *(F.col(f"_e.{n}").alias(n) for n in names), F.coalesce("_e.metadata_missing", F.lit(True)).alias("metadata_missing"))


def _metadata(df: DataFrame) -> Column:
    """The metadata object: original names, defaults written out, 64-bit integers as text."""
    lists = {n: F.coalesce(n, F.array()) if n in df.columns else F.array().cast(KVS) for n in ("search", "count", "properties")}
    track = F.coalesce("track", F.create_map().cast("map<string,bigint>")) if "track" in df.columns else F.create_map().cast("map<string,bigint>")
    number = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("0")).alias(n)
    texts = [F.coalesce(n, F.lit("")).alias(n) for n in ("event_type", "foreign_id", "foreign_type")]
    return F.struct(*(c.alias(n) for n, c in lists.items()), number("created_at_ns"), *texts, track.alias("track"), number("id"))


def to_envelope_json(df: DataFrame) -> Column:
    """The JSON form {"metadata": {...}, "payload": base64} of event columns."""
    payload = F.coalesce(F.base64("payload"), F.lit("")) if "payload" in df.columns else F.lit("")
    return F.to_json(F.struct(_metadata(df).alias("metadata"), payload.alias("payload")), {"ignoreNullFields": "false"})


def to_hit_json(df: DataFrame) -> Column:
    """The JSON form {"id", "score", "metadata"} of hits: events with ``score`` and ``doc_seq``."""
    return F.to_json(F.struct(hit_id(F.col("id"), F.col("doc_seq")).cast("string").alias("id"), F.col("score").cast("float").alias("score"), _metadata(df).alias("metadata")), {"ignoreNullFields": "false"})


def from_free_json(df: DataFrame, json_col: str, now_ns: int) -> DataFrame:
    """Events of frames {search, count, properties, created_at_ns, foreign_id, foreign_type, event_type, payload}.

    The three objects are flattened with ids moved to the values; ``error`` says what a frame lacks. The
    result can be pushed to a store as it is, which leaves out the frames with an error.
    """
    frame = F.try_parse_json(F.col(json_col))
    get = lambda name, kind: F.try_variant_get("_f", f"$.{name}", kind)
    parsed = df.withColumn("_f", frame)
    created = F.coalesce(F.nullif(get("created_at_ns", "long"), F.lit(0)), F.lit(now_ns))
    none = F.array().cast("array<struct<key:string,value:string>>")
    flat = {n: F.coalesce(flatten_column(get(n, "string"), expand=True), none) for n in ("search", "count", "properties")}
    out = parsed.withColumns({"id": F.lit(0).cast("long"), "created_at_ns": created, **{n: get(n, "string") for n in ("event_type", "foreign_type", "foreign_id")}, **flat, "track": F.lit(None).cast("map<string,bigint>"), "payload": F.encode(get("payload", "string"), "UTF-8")})
    missing = F.when(F.col("_f").isNull(), "bad json").otherwise(validation_error(F.col("foreign_id"), F.col("foreign_type"), F.col("event_type")))
    return out.withColumn("error", missing).drop("_f", json_col)


def parse_pixel_path(path: Column) -> Column:
    """(event_type, foreign_type, foreign_id, search) of '/png/<event_type>/<foreign_type>/<foreign_id>/k:v/k:v...'.

    Parts that aren't exactly a key and a value, neither empty, are dropped.
    """
    parts = F.split(path, "/")
    part = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    extra = F.slice(parts, F.lit(6), F.greatest(F.size(parts) - 5, F.lit(0)))
    cut = F.filter(F.transform(extra, lambda x: F.split(x, ":")), lambda c: (F.size(c) == 2) & (c[0] != "") & (c[1] != ""))
    return F.struct(part(3).alias("event_type"), part(4).alias("foreign_type"), part(5).alias("foreign_id"), F.transform(cut, lambda c: kv(c[0], c[1])).alias("search"))

"""From envelopes to indexed events."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import events as E
from tidemark.schema import SEGMENT_STEP


def validate(df: DataFrame) -> DataFrame:
    """``df`` with ``error``: what the envelope lacks first, or an empty text. ``metadata_missing``, where there is such a column, comes first of all."""
    missing = F.col("metadata_missing") if "metadata_missing" in df.columns else None
    return df.withColumn("error", E.validation_error(F.col("foreign_id"), F.col("foreign_type"), F.col("event_type"), missing))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their error)."""
    checked = validate(df)
    return checked.where(F.col("error") == "").drop("error"), checked.where(F.col("error") != "")


def prepare(df: DataFrame, now_ns: int | None = None, step: int = SEGMENT_STEP, whitelist: list[str] | None = None, ignore_types: list[str] | None = None) -> DataFrame:
    """Valid events with defaults, date tags, segment and tokens; to be applied once.

    Events of ignored types and invalid ones are left out. A missing time is ``now_ns``.
    """
    if ignore_types:
        df = df.where(~F.coalesce(F.col("event_type").isin(list(ignore_types)), F.lit(False)))
    valid, _ = split_valid(df)
    now = time.time_ns() if now_ns is None else now_ns
    created = F.when(F.coalesce("created_at_ns", F.lit(0)) == 0, F.lit(now)).otherwise(F.col("created_at_ns"))
    none = F.array().cast("array<struct<key:string,value:string>>")
    dated = valid.withColumn("created_at_ns", created)
    tagged = dated.withColumn("search", F.concat(E.filled(F.coalesce("search", none)), E.date_tags(F.col("created_at_ns"))))
    for name in ("count", "properties"):
        tagged = tagged.withColumn(name, F.coalesce(F.col(name), none) if name in df.columns else none)
    terms = E.tokens(F.col("search"), F.col("event_type"), F.col("foreign_type"), F.col("foreign_id"), whitelist)
    return tagged.withColumn("segment", E.segment(F.col("created_at_ns"), step)).withColumn("tokens", terms)

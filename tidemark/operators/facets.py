"""Facets, field discovery, samples and charts over matching events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import events as E
from tidemark.operators.search import DAY, segment_range
from tidemark.schema import SEGMENT_STEP


def facets(df: DataFrame, fields: dict[str, bool]) -> DataFrame:
    """(section, key, value, n) of all requested facets in one pass over ``df``.

    Keys of ``fields`` ask for facets of ``search`` and ``count`` pairs whatever their value says, by
    occurrences; ``event_type`` and ``foreign_id`` ask for those sections if true. What is requested
    is picked before the grouping, so only it is shuffled, after partial counts.
    """
    keys = list(fields)
    tagged = lambda name: F.transform(F.filter(name, lambda p: p["key"].isin(keys)), lambda p: F.struct(F.lit(name).alias("section"), p["key"].alias("key"), p["value"].alias("value")))
    parts = [tagged("search"), tagged("count")]
    one = lambda section, key, value: F.array(F.struct(F.lit(section).alias("section"), key.alias("key"), value.alias("value")))
    if fields.get("event_type"):
        parts.append(one("event_type", F.lit("event_type"), F.col("event_type")))
    if fields.get("foreign_id"):
        parts.append(one("foreign_id", F.col("foreign_type"), F.col("foreign_id")))
    return df.select(F.explode(F.concat(*parts)).alias("f")).groupBy("f.section", "f.key", "f.value").agg(F.count(F.lit(1)).alias("n"))


def facet(df: DataFrame, section: str, keys: list[str]) -> DataFrame:
    """(key, value, n, total) of one list of pairs; ``total`` counts the key's occurrences."""
    found = facets(df, dict.fromkeys(keys, False)).where(F.col("section") == section).drop("section")
    return found.withColumn("total", F.sum("n").over(Window.partitionBy("key")))  # over the counts: the events are read once


def event_types(df: DataFrame) -> DataFrame:
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def foreign_ids(df: DataFrame) -> DataFrame:
    return df.groupBy("foreign_type", "foreign_id").agg(F.count(F.lit(1)).alias("n"))


def possible(df: DataFrame) -> DataFrame:
    """(key, n): occurrences of every key of ``search`` and ``count``; event_type and foreign_id stand for all events."""
    reserved = ["event_type", "foreign_id"]
    keys = df.select(F.explode(F.concat(F.transform("search", lambda p: p["key"]), F.transform("count", lambda p: p["key"]))).alias("key")).where(~F.col("key").isin(reserved))
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    everything = df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*map(F.lit, reserved))).alias("key"), "n")
    return counted.union(everything)


def sample(df: DataFrame, limit: int) -> DataFrame:
    """The first events in scan order, sorted by time."""
    return df.orderBy("segment", "doc_seq").limit(limit).orderBy("created_at_ns", "doc_seq")


def chart(df: DataFrame, width: int, unique: bool = True, approximate: bool = False) -> DataFrame:
    """(bucket, event_type, n[, n_unique]): events and distinct owners by time bucket and type; empty buckets are absent."""
    owner = F.struct("foreign_type", "foreign_id")
    uniques = [(F.approx_count_distinct(F.xxhash64("foreign_type", "foreign_id")) if approximate else F.count_distinct(owner)).alias("n_unique")] if unique else []
    return df.groupBy(E.bucket(F.col("created_at_ns"), width).alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"), *uniques)


def chart_bounds(from_second: int, to_second: int, width: int, step: int = SEGMENT_STEP, now: int | None = None) -> tuple[int, int]:
    """Start of the first bucket of the range, and of the one a day after its last segment begins."""
    first, last = checked_range(from_second, to_second, step, now)
    return first * step // width * width, (last * step + DAY) // width * width


def one_pass(df: DataFrame, fields: dict[str, bool], width: int = 0) -> DataFrame:
    """(part, section, key, value, bucket, n, n_unique) of all parts of an aggregate in one reading of ``df``.

    ``part`` is total, possible, facet or chart (with ``width``). Every event puts out its parts as one array; they
    are counted before the shuffle, owners of a chart's bucket and type once each, then the owners are counted.
    """
    empty = F.lit(None).cast("string")

    def piece(part: str, section=empty, key=empty, value=empty, owner=empty):
        bucket = E.bucket(F.col("created_at_ns"), width) if part == "chart" else F.lit(None).cast("long")
        return F.struct(F.lit(part).alias("part"), section.alias("section"), key.alias("key"), value.alias("value"), bucket.alias("bucket"), owner.alias("owner"))

    keys, reserved = list(fields), ["event_type", "foreign_id"]
    parts = [F.array(piece("total"))]
    for name in ("search", "count"):
        section = F.lit(name)
        parts.append(F.transform(F.filter(name, lambda p: p["key"].isin(keys)), lambda p: piece("facet", section, p["key"], p["value"])))  # noqa: B023
        parts.append(F.transform(F.filter(name, lambda p: ~p["key"].isin(reserved)), lambda p: piece("possible", key=p["key"])))
    if fields.get("event_type"):
        parts.append(F.array(piece("facet", F.lit("event_type"), F.lit("event_type"), F.col("event_type"))))
    if fields.get("foreign_id"):
        parts.append(F.array(piece("facet", F.lit("foreign_id"), F.col("foreign_type"), F.col("foreign_id"))))
    if width:
        owner = F.concat(F.length("foreign_type").cast("string"), F.lit(":"), F.col("foreign_type"), F.col("foreign_id"))
        parts.append(F.array(piece("chart", value=F.col("event_type"), owner=owner)))
    named = ["part", "section", "key", "value", "bucket"]
    counted = df.select(F.explode(F.concat(*parts)).alias("p")).groupBy(*(F.col(f"p.{c}").alias(c) for c in [*named, "owner"])).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*named).agg(F.sum("n").alias("n"), F.count("owner").alias("n_unique"))


def checked_range(from_second: int, to_second: int, step: int = SEGMENT_STEP, now: int | None = None) -> tuple[int, int]:
    first, last = segment_range(from_second, to_second, step, now)
    if first > last:
        raise ValueError("bad date range, to_second must be older than from_second")
    return first, last

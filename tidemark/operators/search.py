"""Search, fetch and scans over prepared events (columns of the schema, segment, tokens, doc_seq)."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import events as E
from tidemark.plans.query import Query, leaves, predicate, score, term
from tidemark.schema import SEGMENT_STEP

DAY = 86400


@dataclass(frozen=True)
class Request:
    """A time range in seconds (0: the last 24 hours), a query and a limit."""

    query: Query | None
    from_second: int = 0
    to_second: int = 0
    limit: int = 0

    def __post_init__(self) -> None:
        if self.query is None:
            raise ValueError("missing Query")
        if self.limit < 0:
            raise ValueError("limit must not be negative")

    @staticmethod
    def from_dict(d: dict) -> Request:
        return Request(Query.from_dict(d.get("query")), int(d.get("from_second") or 0), int(d.get("to_second") or 0), int(d.get("limit") or 0))


def segment_range(from_second: int, to_second: int, step: int = SEGMENT_STEP, now: int | None = None) -> tuple[int, int]:
    """First and last segment of a time range, both inclusive; a range that ends before it starts is empty."""
    now = int(time.time()) if now is None else now
    to_second = to_second or now
    from_second = from_second or now - DAY
    return from_second // step, to_second // step


def in_range(df: DataFrame, from_second: int, to_second: int, step: int = SEGMENT_STEP, now: int | None = None, exact: bool = False) -> DataFrame:
    """Events of the range's segments, whole segments at both ends unless ``exact``."""
    first, last = segment_range(from_second, to_second, step, now)
    found = df.where(F.col("segment").between(first, last))
    if "day" in df.columns:  # the partition column of a store
        found = found.where(F.col("day").between(first * step // DAY, last * step // DAY))
    if exact:
        found = found.where(E.seconds(F.col("created_at_ns")).between(from_second, to_second))
    return found


def matches(df: DataFrame, request: Request, step: int = SEGMENT_STEP, now: int | None = None) -> DataFrame:
    """All events of the range that match."""
    return in_range(df, request.from_second, request.to_second, step, now).where(predicate(request.query))


def idf_weights(df: DataFrame, query: Query) -> dict[tuple[str, str], float]:
    """ln(1 + N / df) of each term of a query over ``df``, in one pass."""
    terms = list({(t.field, t.value) for t in leaves(query)})
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(predicate(term(*t))).alias(f"t{i}") for i, t in enumerate(terms))).head()
    return {t: math.log(1 + counts["n"] / counts[f"t{i}"]) if counts[f"t{i}"] else 0.0 for i, t in enumerate(terms)}


def total(df: DataFrame, query: Query) -> DataFrame:
    """One row: how many match."""
    return df.where(predicate(query)).agg(F.count(F.lit(1)).alias("total"))


def top(df: DataFrame, query: Query, limit: int, weights: dict | None = None) -> DataFrame:
    """The best ``limit`` matches by score; ties go to the earlier event in scan order."""
    scored = df.where(predicate(query)).withColumn("score", score(query, weights))
    return scored.orderBy(F.desc("score"), "segment", "doc_seq").limit(limit)


def fetch(df: DataFrame, query: Query, limit: int = 0) -> DataFrame:
    """Matches in scan order with score 0, at most ``limit`` (0: all; then their order is left open)."""
    found = df.where(predicate(query)).withColumn("score", F.lit(0.0))
    return found.orderBy("segment", "doc_seq").limit(limit) if limit else found


def list_segments(df: DataFrame, step: int = SEGMENT_STEP) -> DataFrame:
    """The start of every segment that has events, in nanoseconds."""
    return df.select((F.col("segment") * F.lit(step * 1_000_000_000)).alias("segment_start_ns")).distinct()


def lookup_segment(df: DataFrame, ns: int, step: int = SEGMENT_STEP) -> DataFrame:
    """The events of the segment that holds an instant."""
    whole = abs(ns) // 1_000_000_000 // step  # whole numbers: a float can't hold nanoseconds
    found = df.where(F.col("segment") == (whole if ns >= 0 else -whole))
    return found.where(F.col("day") == math.floor((whole if ns >= 0 else -whole) * step / DAY)) if "day" in df.columns else found


def postings(df: DataFrame, *also: str) -> DataFrame:
    """(field, term, segment, doc_seq) of every token, and the columns ``also``, for stores that keep an inverted table."""
    cut = F.split("token", "\u0001", 2)
    return df.select("segment", "doc_seq", *also, F.explode("tokens").alias("token")).select(cut[0].alias("field"), cut[1].alias("term"), "segment", "doc_seq", *also)


def search_postings(table: DataFrame, query: Query) -> DataFrame:
    """(segment, doc_seq) of matches by an inverted table: one grouping for any tree, and only the tree's terms are read.

    A tree that matches events without any of its terms (a bare ``not``) needs the term of all events in it.
    """
    def terms(q: Query) -> set[tuple[str, str]]:
        own = {(q.field, q.value)} if q.type == "TERM" and q.field and q.value else set()
        return own.union(*(terms(c) for c in (*q.queries, *([q.not_] if q.not_ else []))))

    wanted = terms(query)
    cond = F.lit(False)
    for f, v in sorted(wanted):
        cond = cond | ((F.col("field") == f) & (F.col("term") == v))
    docs = table.where(cond).groupBy("segment", "doc_seq").agg(
        F.collect_set(E.token(F.col("field"), F.col("term"))).alias("tokens"), F.max(F.when(F.col("field") == "event_type", F.col("term"))).alias("event_type")
    )
    return docs.where(F.coalesce(predicate(query), F.lit(False))).select("segment", "doc_seq")

"""An event store: Parquet by day, with the search services over it."""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.events import hit_id
from tidemark.operators import facets, search
from tidemark.operators.ingest import prepare, split_valid
from tidemark.plans.query import predicate
from tidemark.schema import EVENT_SCHEMA, SEGMENT_STEP

log = logging.getLogger("tidemark")

#: A sequence number: the batch, the partition that brought the event, and the event's place in it.
PARTITION_BITS, ROW_BITS = 18, 26
MOST_BATCHES = 1 << (63 - PARTITION_BITS - ROW_BITS)


class EventStore:
    """Events under ``path``; a day is a folder, and files are sorted by segment so that scans skip row groups.

    With ``postings`` every push also writes the events' terms, sorted by field and term, for :meth:`search_postings`.
    Several processes may push at once: each push claims a batch number and writes a folder of its own, and readers
    see whole batches only.
    """

    def __init__(self, spark: SparkSession, path: str, step: int = SEGMENT_STEP, whitelist: list[str] | None = None, ignore_types: list[str] | None = None, cache: bool = False, postings: bool = False):
        self.spark, self.path, self.step, self.whitelist, self.ignore_types, self.cache, self.with_postings = spark, path.rstrip("/"), step, whitelist, ignore_types, cache, postings
        self._cached: DataFrame | None = None

    def _folder(self, name: str):
        """A folder of the store and its file system."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        return at, fs

    def _numbers(self, name: str) -> list[int]:
        at, fs = self._folder(name)
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit())

    def _mark(self, name: str, batch: int) -> bool:
        """Whether this call created a batch's file in a folder of marks; the file system has to create exclusively, as HDFS does."""
        at, fs = self._folder(name)
        if fs.getScheme() == "file":  # Hadoop's local one looks and creates in two steps
            try:
                os.close(os.open(os.path.join(at.toUri().getPath(), str(batch)), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        file = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, str(batch))
        try:
            fs.create(file, False).close()
        except Py4JJavaError:
            if not fs.exists(file):
                raise
            return False
        return True

    def _claim_batch(self) -> int:
        """The next free batch number: whoever creates its file has it."""
        batch = max(self._numbers("_batches"), default=-1) + 1
        while not self._mark("_batches", batch):
            batch += 1
        if batch >= MOST_BATCHES:
            raise RuntimeError(f"{MOST_BATCHES} batches are what a store can number; write its events to a new one")
        return batch

    def push(self, envelopes: DataFrame, now_ns: int | None = None, strict: bool = False) -> None:
        """Append the valid ones; ``strict`` raises if there is any other.

        Every event gets a sequence number, ``doc_seq``: the order of arrival, batch by batch and within a batch in
        the order of its partitions. Files are cut by time and number, so a busy hour is spread over several.
        """
        if strict:
            _, bad = split_valid(envelopes)
            first = bad.select("error").head()
            if first:
                raise ValueError(first["error"])
        began, batch = time.time(), self._claim_batch()
        place = F.monotonically_increasing_id()
        part, row = F.shiftrightunsigned("doc_seq", 33), F.col("doc_seq").bitwiseAND(F.lit((1 << 33) - 1))
        fits = (part < 1 << PARTITION_BITS) & (row < 1 << ROW_BITS)
        numbered = F.lit(batch << (PARTITION_BITS + ROW_BITS)) + F.shiftleft(part, ROW_BITS) + row
        events = prepare(envelopes.withColumn("doc_seq", place), now_ns, self.step, self.whitelist, self.ignore_types)
        events = events.withColumn("doc_seq", F.when(fits, numbered).otherwise(F.raise_error(F.lit("too many events in a partition, or partitions in a batch")).cast("long")))
        placed = events.withColumn("day", F.floor(F.col("segment") * self.step / search.DAY).cast("long")).drop("metadata_missing", "error")
        placed.repartitionByRange("day", "segment", "doc_seq").sortWithinPartitions("day", "segment", "doc_seq").write.partitionBy("day").parquet(f"{self.path}/events/batch={batch}")
        if self.with_postings:
            terms = search.postings(self._read("events", [batch]), "day")
            terms.repartitionByRange("day", "field", "term", "doc_seq").sortWithinPartitions("day", "field", "term", "segment", "doc_seq").write.partitionBy("day").parquet(f"{self.path}/postings/batch={batch}")
        self._mark("_done", batch)
        self.forget()
        log.info("push: batch %d in %.2f s", batch, time.time() - began)

    def forget(self) -> None:
        """Drop the cached snapshot."""
        if self._cached is not None:
            self._cached.unpersist()
        self._cached = None

    def _read(self, name: str, batches: list[int]) -> DataFrame:
        """What is in the folders of the batches that have any rows."""
        at, fs = self._folder(name)
        filled = {s.getPath().getParent().getName() for s in fs.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, "batch=*/day=*"))}
        paths = [f"{self.path}/{name}/batch={b}" for b in batches if f"batch={b}" in filled]
        if paths:
            return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*paths)
        none = prepare(self.spark.createDataFrame([], EVENT_SCHEMA), 1).withColumns({"doc_seq": F.lit(0).cast("long"), "day": F.lit(0), "batch": F.lit(0)})
        return none if name == "events" else search.postings(none, "day")

    def events(self) -> DataFrame:
        """A snapshot of all events of the batches that are complete."""
        if not self.cache:
            return self._read("events", self._numbers("_done"))
        if self._cached is None:
            self._cached = self._read("events", self._numbers("_done")).persist()
        return self._cached

    def postings(self) -> DataFrame:
        """(field, term, segment, doc_seq, day) of a store that keeps them."""
        return self._read("postings", self._numbers("_done"))

    def _matches(self, request: search.Request, now: int | None) -> DataFrame:
        return search.in_range(self.events(), request.from_second, request.to_second, self.step, now)

    def search(self, request: dict | search.Request, now: int | None = None) -> dict:
        """{"total": matches, "hits": the best ``limit``}, from one reading of the range: the count is taken on the way."""
        began = time.time()
        r = request if isinstance(request, search.Request) else search.Request.from_dict(request)
        ranged = self._matches(r, now)
        if not r.limit:
            total, hits = search.total(ranged, r.query).head()["total"], []
        else:
            seen = Observation()
            found = ranged.where(predicate(r.query)).observe(seen, F.count(F.lit(1)).alias("total"))
            hits = search.top(found, r.query, r.limit).withColumn("hit_id", hit_id(F.col("id"), F.col("doc_seq"))).collect()
            total = seen.get["total"]
        log.info("search: %d matches in %.2f s", total, time.time() - began)
        return {"total": total, "hits": hits}

    def search_postings(self, request: dict | search.Request, now: int | None = None) -> DataFrame:
        """(segment, doc_seq) of the matches, from the stored terms alone."""
        r = request if isinstance(request, search.Request) else search.Request.from_dict(request)
        return search.search_postings(search.in_range(self.postings(), r.from_second, r.to_second, self.step, now), r.query)

    def fetch(self, request: dict | search.Request, now: int | None = None) -> Iterator[Row]:
        """Matches in scan order, one after the other."""
        r = request if isinstance(request, search.Request) else search.Request.from_dict(request)
        return search.fetch(self._matches(r, now), r.query, r.limit).orderBy("segment", "doc_seq").toLocalIterator()

    def aggregate(self, request: dict, now: int | None = None) -> dict[str, DataFrame | tuple[int, int]]:
        """Facets, possible fields, total, sample and chart of {query, fields, sample_limit, time_bucket_sec}.

        All but the sample come from one pass over the events: ``parts``, which is kept until it is unpersisted.
        """
        r = search.Request.from_dict(request.get("query") if "query" in request and "query" in (request["query"] or {}) else request)
        facets.checked_range(r.from_second, r.to_second, self.step, now)
        found, width = search.matches(self.events(), r, self.step, now), int(request.get("time_bucket_sec") or 0)
        parts = facets.one_pass(found, request.get("fields") or {}, width).persist()
        of = lambda name: parts.where(F.col("part") == name)
        everything = of("total").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        reserved = everything.select(F.explode(F.array(F.lit("event_type"), F.lit("foreign_id"))).alias("key"), "n")
        out: dict = {"parts": parts, "total": everything.select(F.col("n").alias("total")), "facets": of("facet").select("section", "key", "value", "n"), "possible": of("possible").select("key", "n").union(reserved)}
        if request.get("sample_limit"):
            out["sample"] = facets.sample(found, int(request["sample_limit"]))
        if width:
            out["chart"] = of("chart").select("bucket", F.col("value").alias("event_type"), "n", "n_unique")
            out["chart_bounds"] = facets.chart_bounds(r.from_second, r.to_second, width, self.step, now)
        return out

    def list_segments(self) -> list[int]:
        return [r[0] for r in search.list_segments(self.events(), self.step).orderBy("segment_start_ns").collect()]

    def lookup_segment(self, ns: int) -> DataFrame:
        return search.lookup_segment(self.events(), ns, self.step)

    def health(self) -> dict:
        return {"success": True, "time": int(time.time())}

"""Structured Streaming: events from files or Kafka to a store, and live charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.events import stream_id
from tidemark.schema import EVENT_SCHEMA
from tidemark.sources.envelopes import event_columns, parse_envelope, to_envelope_json
from tidemark.sources.store import EventStore


def read_files(spark: SparkSession, folder: str, form: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """Envelopes that arrive as files in a folder."""
    return spark.readStream.schema(EVENT_SCHEMA).format(form).option("maxFilesPerTrigger", files_per_batch).load(folder)


def read_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Envelopes as JSON from a topic, with ids of partition and offset; needs Spark's Kafka connector."""
    return from_records(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load())


def from_records(records: DataFrame) -> DataFrame:
    """Event columns of a topic's records (value, partition, offset); those that can't be decoded are left out."""
    parsed = records.select(parse_envelope(F.col("value").cast("string")).alias("e"), "partition", "offset").where(F.col("e.metadata").isNotNull())
    return parsed.select(stream_id(F.col("partition"), F.col("offset")).alias("id"), *event_columns("e")[1:])


def to_records(events: DataFrame) -> DataFrame:
    """Rows (key, value) for a topic: the owner, and the envelope as JSON."""
    return events.select(F.col("foreign_id").alias("key"), to_envelope_json(events).alias("value"))


def write_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Rows (value) to a topic, compressed with snappy; needs Spark's Kafka connector."""
    sink = df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.compression.type", "snappy")
    return sink.option("checkpointLocation", checkpoint).start()


def ingest(envelopes: DataFrame, store: EventStore, checkpoint: str, once: bool = True, now_ns: int | None = None) -> StreamingQuery:
    """Append every micro-batch to a store. Events of any age are taken; a batch that is run again appends again (at least once)."""
    writer = envelopes.writeStream.foreachBatch(lambda batch, _: store.push(batch, now_ns)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def live_chart(events: DataFrame, width: int, watermark: str) -> DataFrame:
    """(window, event_type, n_unique) of closed windows: owners are deduplicated by state that the watermark bounds."""
    timed = events.withColumn("time", F.timestamp_micros(F.call_function("div", F.col("created_at_ns"), F.lit(1000)))).withWatermark("time", watermark)
    window = timed.withColumn("window", F.window("time", f"{width} seconds"))
    owners = window.select("window", "event_type", "foreign_type", "foreign_id").dropDuplicates()
    return owners.groupBy("window", "event_type").agg(F.count(F.lit(1)).alias("n_unique"))

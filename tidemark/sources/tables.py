"""The sample tables as envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.events import kv
from tidemark.functions.text import rounded

NONE = F.array
_KVS = "array<struct<key:string,value:string>>"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanoseconds(name: str) -> F.Column:
    """A timestamp column as nanoseconds; the session's time zone is UTC."""
    return F.unix_micros(F.col(name).cast("timestamp")) * 1000


def event_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table ``events``: the flat JSON of ``props`` is searchable, the rounded value counts."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    props = F.from_json("props", "map<string,double>")
    flat = F.transform(F.map_entries(F.coalesce(props, F.from_json(F.lit("{}"), "map<string,double>"))), lambda e: kv(e["key"], rounded(e["value"])))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), nanoseconds("ts").alias("created_at_ns"), "event_type", F.lit("user").alias("foreign_type"), F.col("user_id").cast("string").alias("foreign_id"),
        flat.alias("search"), F.array(kv("bucket", rounded(F.col("value")))).alias("count"), F.array().cast(_KVS).alias("properties"), F.col("event_id").alias("doc_seq"),
    )


def order_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table ``orders``, of years without date tags."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), nanoseconds("o_orderdate").alias("created_at_ns"), F.lit("order").alias("event_type"), F.lit("customer").alias("foreign_type"), F.col("o_custkey").cast("string").alias("foreign_id"),
        F.array(kv("status", F.col("o_orderstatus")), kv("priority", F.col("o_orderpriority"))).alias("search"), F.array().cast(_KVS).alias("count"), F.array().cast(_KVS).alias("properties"), F.col("o_orderkey").alias("doc_seq"),
    )

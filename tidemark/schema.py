"""The event schema and the constants of the token index."""

from pyspark.sql import types as T

KV = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
KVS = T.ArrayType(KV, containsNull=False)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("created_at_ns", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("foreign_type", T.StringType()),
        T.StructField("foreign_id", T.StringType()),
        T.StructField("search", KVS),
        T.StructField("count", KVS),
        T.StructField("properties", KVS),
        T.StructField("track", T.MapType(T.StringType(), T.LongType())),
        T.StructField("payload", T.BinaryType()),
    ]
)

SEGMENT_STEP = 3600
EMPTY = "__empty"
SEPARATOR = "\u0001"
EVENT_TYPE = "event_type"
#: The field and value of the term that every event has.
ALL_FIELD, ALL_VALUE = "tidemark", "match_all"
DATE_TAGS = {"year": "yyyy", "year-month": "yyyy-MM", "year-month-day": "yyyy-MM-dd", "year-month-day-hour": "yyyy-MM-dd-HH"}
#: Seconds for which date tags are known: from 2010 to the last one of a signed 32-bit clock.
FIRST_TAGGED, LAST_TAGGED = 1262304000, 2147483647

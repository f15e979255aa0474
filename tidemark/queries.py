"""One query for each operator over the sample tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import events as E
from tidemark.functions import text
from tidemark import scratch
from tidemark.functions.flatten import flatten_rows, flatten_to_json
from tidemark.operators import enrich, facets, search
from tidemark.operators.ingest import prepare, validate
from tidemark.plans.query import Query, all_of, any_of, best_of, match_all, predicate, score, term
from tidemark.sources import envelopes
from tidemark.sources.store import EventStore
from tidemark.sources.tables import event_envelopes, order_envelopes, read
from tidemark.streaming import pipeline

NOW_NS = 1_706_745_600_000_000_000
FROM, TO = 1704153601, 1704240001
CLICK, SEVEN = term("event_type", "click"), term("k", "7")


def events(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return prepare(event_envelopes(spark, sf_dir), NOW_NS, **options)


def _ids(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: events(spark, sf_dir).where(predicate(q)).select(F.col("id").alias("event_id"))


def _scores(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: events(spark, sf_dir).where(predicate(q)).select(F.col("id").alias("event_id"), score(q).alias("score"))


def segment_assign(spark, d):
    return event_envelopes(spark, d).select(F.col("id").alias("event_id"), E.segment(F.col("created_at_ns")).alias("segment"))


def _tag(name: str):
    return F.get(F.filter("search", lambda p: p["key"] == name), F.lit(0))["value"].alias(name.replace("-", "_"))


def ingest_prepare(spark, d):
    tags = [_tag(n) for n in ("year", "year-month", "year-month-day", "year-month-day-hour")]
    return events(spark, d).select(F.col("id").alias("event_id"), "created_at_ns", "event_type", "foreign_type", "foreign_id", *tags)


def ingest_prepare_old_dates(spark, d):
    return prepare(order_envelopes(spark, d), NOW_NS).select(F.col("id").alias("o_orderkey"), _tag("year"))


def flatten_kv(spark, d):
    return flatten_rows(read(spark, d, "events").select("event_id", "props"), "props", max_depth=2)


def flatten_expand_id(spark, d):
    nested = F.format_string('{"order":{"customer_id":{"%d":{"seen":true}}}}', "o_custkey")
    return flatten_rows(read(spark, d, "orders").select("o_orderkey", nested.alias("json")), "json", max_depth=4, expand=True)


def list_segments(spark, d):
    return search.list_segments(events(spark, d))


def scan_match_all(spark, d):
    return search.total(events(spark, d), match_all())


def scan_time_range(spark, d):
    return search.matches(events(spark, d), search.Request(match_all(), FROM, TO)).select(F.col("id").alias("event_id"))


def search_topk(spark, d):
    return search.top(events(spark, d), any_of(term("event_type", "click", 2.0), SEVEN), 10).select(F.col("id").alias("event_id"), "score")


def search_total(spark, d):
    return search.total(events(spark, d), any_of(CLICK, SEVEN))


def fetch_limit(spark, d):
    return search.fetch(events(spark, d), CLICK, 100).select(F.col("id").alias("event_id"), "score")


def fetch_scan(spark, d):
    return search.fetch(events(spark, d), CLICK).select(F.col("id").alias("event_id"), "created_at_ns", "event_type", "foreign_id")


def aggregate_sample(spark, d):
    return facets.sample(events(spark, d).where(predicate(CLICK)), 20).select(F.col("id").alias("event_id"), "created_at_ns")


def aggregate_total(spark, d):
    return search.total(events(spark, d), CLICK)


def facet_search(spark, d):
    return facets.facet(events(spark, d).where(predicate(CLICK)), "search", ["k"])


def facet_count(spark, d):
    return facets.facets(events(spark, d), {"bucket": False}).where("section = 'count'").select("key", "value", "n")


def facet_event_type(spark, d):
    return facets.event_types(events(spark, d))


def facet_foreign_id(spark, d):
    return facets.foreign_ids(events(spark, d))


def facet_possible(spark, d):
    return facets.possible(events(spark, d))


def facets_one_pass(spark, d):
    return facets.facets(events(spark, d).where(predicate(CLICK)), {"k": True, "bucket": False, "event_type": True, "foreign_id": True})


def chart_count(spark, d):
    return facets.chart(events(spark, d), 300, unique=False)


def chart_unique(spark, d):
    return facets.chart(events(spark, d), 3600)


def chart_bounds(spark, d):
    s = event_envelopes(spark, d).agg(F.min(E.seconds(F.col("created_at_ns"))), F.max(E.seconds(F.col("created_at_ns")))).head()
    return spark.createDataFrame([facets.chart_bounds(s[0], s[1], 300)], "time_start long, time_end long")


def ignore_type(spark, d):
    return events(spark, d, ignore_types=["error", "view"]).select(F.col("id").alias("event_id"))


def whitelist_search(spark, d):
    found = events(spark, d, whitelist=["bucket"])
    return found.where(predicate(any_of(SEVEN, CLICK, term("user", "8")))).select(F.col("id").alias("event_id"))


def validate_envelopes(spark, d):
    user = F.col("user_id") % 10
    broken = read(spark, d, "events").select("event_id", F.when(user == 0, "").otherwise("u").alias("fid"), F.when(user == 1, "").otherwise("t").alias("type"))
    return broken.select("event_id", E.validation_error(F.col("fid"), F.lit("user"), F.col("type")).alias("error"))


def ingest_envelope_json(spark, d):
    e = event_envelopes(spark, d)
    lines = e.select(envelopes.to_envelope_json(e).alias("line"))
    return envelopes.from_envelope_json(lines, "line").select(F.col("id").alias("event_id"), "event_type", "foreign_type", "foreign_id")


def lookup_segment(spark, d):
    return search.lookup_segment(events(spark, d), FROM * 1_000_000_000).select(F.col("id").alias("event_id"))


def parse_pixel_path(spark, d):
    path = F.concat(F.lit("/png/view/customer/"), F.col("c_custkey").cast("string"), F.lit("/segment:"), "c_mktsegment")
    parsed = read(spark, d, "customer").select("c_custkey", envelopes.parse_pixel_path(path).alias("e"))
    return parsed.select("c_custkey", F.explode("e.search").alias("p")).select("c_custkey", "p.key", "p.value")


def cleanup_vw(spark, d):
    return read(spark, d, "part").select("p_partkey", text.cleanup_words(F.col("p_name")).alias("cleaned"))


def postings_search(spark, d):
    table = search.postings(events(spark, d))
    return search.search_postings(table, all_of(CLICK, SEVEN)).select(F.col("doc_seq").alias("event_id"))


def user_agent(spark, d):
    agent = F.when(F.col("event_id") % 2 == 0, "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36").otherwise("curl/8.0")
    return read(spark, d, "events").select("event_id", F.explode(enrich.user_agent_tags(agent)).alias("p")).select("event_id", "p.key", "p.value")


def geohash_points(spark, d):
    return read(spark, d, "events").select("event_id", text.geohash((F.col("event_id") % 180 - 90).cast("double"), (F.col("user_id") % 360 - 180).cast("double"), 6).alias("gh6"))


def chart_unique_approx(spark, d):
    """How far the estimate is from the exact count: within 15 %, three times its standard error, or not."""
    exact, rough = (facets.chart(events(spark, d), 86400, approximate=a).withColumnRenamed("n_unique", name) for a, name in ((False, "exact"), (True, "rough")))
    both = exact.join(rough.drop("n"), ["bucket", "event_type"])
    return both.select("bucket", "event_type", "n", (F.abs(F.col("rough") - F.col("exact")) <= 0.15 * F.col("exact") + 1).alias("close"))


def flatten_json(spark, d):
    nested = F.format_string('{"order":{"id":%d,"tags":["a",{"status":"%s"}],"none":[]},"paid":true}', "o_orderkey", "o_orderstatus")
    return read(spark, d, "orders").select("o_orderkey", flatten_to_json(nested).alias("flat"))


def flatten_styles(spark, d):
    nested = F.format_string('{"a":{"b":["%s"]}}', "o_orderstatus")
    rows = read(spark, d, "orders").select("o_orderkey", nested.alias("json"))
    parts = [flatten_rows(rows, "json", style=s, prefix="p:").withColumn("style", F.lit(s)) for s in ("dot", "path", "rails", "underscore")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def stringify_values(spark, d):
    nested = F.format_string('{"half":%d.5,"yes":true,"no":null,"text":"%s"}', "o_orderkey", "o_orderstatus")
    return flatten_rows(read(spark, d, "orders").select("o_orderkey", nested.alias("json")), "json")


def ingest_free_json(spark, d):
    frame = F.format_string('{"search":{"customer_id":{"%d":true},"status":"%s"},"created_at_ns":%d,"foreign_id":"%d","foreign_type":"%s","event_type":"order","payload":{"a":1}}', "o_custkey", "o_orderstatus", F.lit(NOW_NS), "o_orderkey", F.when(F.col("o_custkey") % 10 == 0, "").otherwise("basket"))
    return _pushable(spark, d, frame)


def _pushable(spark, d, frame):
    frames = envelopes.from_free_json(read(spark, d, "orders").select(frame.alias("json")), "json", NOW_NS)
    done = prepare(frames.where("error = ''"), NOW_NS)
    return done.select(F.col("foreign_id").cast("long").alias("o_orderkey"), "foreign_type", _tag("customer_id"), _tag("status"), _tag("year-month-day"), F.decode("payload", "UTF-8").alias("payload"))


def free_json_errors(spark, d):
    frame = F.when(F.col("o_orderkey") % 3 == 0, "{broken").when(F.col("o_orderkey") % 3 == 1, '{"foreign_id":"1","foreign_type":"t"}').otherwise('{"foreign_id":"1","foreign_type":"t","event_type":"e"}')
    return envelopes.from_free_json(read(spark, d, "orders").select("o_orderkey", frame.alias("json")), "json", NOW_NS).select("o_orderkey", "error")


def validate_envelope_json(spark, d):
    line = F.when(F.col("o_orderkey") % 4 == 0, '{"payload":"aGk="}').when(F.col("o_orderkey") % 4 == 1, '{"metadata":{"search":[]}}').when(F.col("o_orderkey") % 4 == 2, '{"metadata":{"foreign_id":"1"}}').otherwise('{"metadata":{"foreign_id":"1","foreign_type":"t","event_type":"e"}}')
    return validate(envelopes.from_envelope_json(read(spark, d, "orders").select("o_orderkey", line.alias("line")), "line")).select("o_orderkey", "error")


def ingest_envelope_protobuf(spark, d):
    """Messages with an owner, a type and a time, put together byte by byte."""
    varint = lambda c: F.to_binary(F.concat(F.lpad(F.hex(c.bitwiseAND(F.lit(127)).bitwiseOR(F.lit(128))), 2, "0"), F.lpad(F.hex(F.shiftright(c, 7)), 2, "0")), F.lit("hex"))  # noqa: E731  of two bytes
    text_field = lambda number, c: F.concat(F.lit(bytes([number << 3 | 2])), F.unhex(F.lpad(F.hex(F.octet_length(c)), 2, "0")), c.cast("binary"))
    own = F.col("o_custkey").cast("string")
    metadata = F.concat(F.lit(bytes([5 << 3])), varint(F.col("o_custkey") % 16000), text_field(7, F.lit("order")), text_field(9, own), text_field(10, F.lit("customer")))
    message = F.concat(F.lit(b"\x0a"), F.unhex(F.lpad(F.hex(F.octet_length(metadata)), 2, "0")), metadata, F.lit(b"\x12\x02hi"))
    parsed = envelopes.from_envelope_protobuf(read(spark, d, "orders").select("o_orderkey", message.alias("raw")), "raw")
    return parsed.select("o_orderkey", "created_at_ns", "event_type", "foreign_type", "foreign_id", F.decode("payload", "UTF-8").alias("payload"), "metadata_missing")


def hit_json(spark, d):
    hits = search.fetch(events(spark, d), all_of(CLICK, SEVEN))
    return hits.select(F.col("id").alias("event_id"), envelopes.to_hit_json(hits).alias("hit"))


def value_to_text(spark, d):
    return read(spark, d, "orders").select("o_orderkey", text.to_text(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey"))).alias("shown"))


def fill_empty(spark, d):
    pairs = F.array(E.kv("status", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("")))
    return read(spark, d, "orders").select("o_orderkey", E.filled(pairs)[0]["value"].alias("value"))


def cleanup_names(spark, d):
    name = F.concat(F.col("p_name"), F.lit(" (é.日) "), F.repeat(F.col("p_brand"), 8))
    return read(spark, d, "part").select("p_partkey", text.cleanup(name).alias("cleaned"), text.cleanup(name, True).alias("with_dots"))


def hash_text(spark, d):
    """A hash is of the text alone, and different texts have different ones."""
    names = read(spark, d, "part").select(F.col("p_name").alias("name"), text.hash_of(F.col("p_name")).alias("hash"))
    return names.agg(F.count_distinct("name").alias("names"), F.count_distinct("hash").alias("hashes"), F.count_distinct("name", "hash").alias("pairs"))


def pairs_parse(spark, d):
    listed = F.format_string("key:%d,,status:%s,", "o_orderkey", "o_orderstatus")
    return read(spark, d, "orders").select("o_orderkey", F.explode(text.pairs_of(listed)).alias("p")).select("o_orderkey", "p.key", "p.value")


def digits_check(spark, d):
    given = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise(""))
    return read(spark, d, "orders").select("o_orderkey", text.is_digits(given).alias("digits"))


def dump_json(spark, d):
    return read(spark, d, "part").select("p_partkey", text.dump(F.struct("p_partkey", "p_name", "p_size")).alias("dump"), F.size(F.split(text.dump(F.struct("p_partkey", "p_name"), True), "\n")).alias("pretty_lines"))


def shuffle_values(spark, d):
    """The values after a shuffle, sorted again."""
    values = F.array("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(F.array_sort(text.shuffled(values)), "|").alias("sorted"))


def _address():
    return F.concat(F.lit("10."), (F.col("event_id") % 300).cast("string"), F.lit("."), (F.col("user_id") % 200).cast("string"), F.lit(".7"))


def enrich_ip(spark, d):
    given = F.when(F.col("event_id") % 5 == 0, F.array(E.kv("ip", "8.8.8.8"))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    e = read(spark, d, "events").withColumn("own", given)
    first, instead = (F.filter(enrich.with_ip(F.col("own"), _address(), i), lambda p: p["key"] == "ip")[0]["value"] for i in (False, True))
    return e.select("event_id", first.alias("ip"), instead.alias("replaced"))


def enrich_place(spark, d):
    start = (F.lit(10) * (1 << 24) + F.col("id") * (1 << 17)).cast("long")
    ranges = spark.range(100).select(start.alias("start"), (start + (1 << 16) - 1).alias("end"), F.concat(F.lit("city"), F.col("id").cast("string")).alias("city"), F.lit("land").alias("country"))
    e = read(spark, d, "events").select("event_id", _address().alias("address"), F.array().cast("array<struct<key:string,value:string>>").alias("search"))
    return enrich.with_place(e, ranges, "address").select("event_id", _tag("geoip_city"), _tag("geoip_country"))


def hit_ids(spark, d):
    return read(spark, d, "events").select("event_id", E.hit_id(F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(0), F.col("event_id") * 10).alias("hit_id"))


def stream_ids(spark, d):
    return read(spark, d, "events").select("event_id", E.stream_id(F.col("user_id") % 100, F.col("event_id")).alias("stream_id"))


def bad_range(spark, d):
    try:
        facets.checked_range(TO, FROM)
        said = ""
    except ValueError as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "error string")


def stream_live_chart(spark, d):
    """Owners by day and type of a stream's closed days."""
    inbox, out = scratch.path(spark, "inbox"), scratch.path(spark, "chart")
    event_envelopes(spark, d).drop("doc_seq").write.parquet(inbox)
    chart = pipeline.live_chart(pipeline.read_files(spark, inbox), 86400, "1 hour").select(F.unix_seconds("window.start").alias("bucket"), "event_type", "n_unique")
    chart.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.path(spark, "offsets")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(chart.schema).parquet(out)


def kafka_records(spark, d):
    """Events to the records of a topic of four partitions and back; every seventh record is broken."""
    sent = pipeline.to_records(event_envelopes(spark, d)).withColumn("n", F.get_json_object("value", "$.metadata.id").cast("long"))
    value = F.when(F.col("n") % 7 == 0, F.substring("value", 1, 20)).otherwise(F.col("value")).cast("binary")
    records = sent.select(value.alias("value"), (F.col("key").cast("int") % 4).alias("partition"), F.col("n").alias("offset"))
    return pipeline.from_records(records).select("id", "created_at_ns", "event_type", "foreign_id")


_stores: dict[tuple, EventStore] = {}


def _store(spark, d, **options) -> EventStore:
    """The events of a folder written to a store, once for each session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stores:
        _stores[key] = EventStore(spark, scratch.path(spark, "store"), postings=True)
        _stores[key].push(event_envelopes(spark, d).drop("doc_seq"), NOW_NS)
    return EventStore(spark, _stores[key].path, **options) if options else _stores[key]


def _asked(query: Query, **more) -> search.Request:
    return search.Request(query, 1704067200, 1706745599, **more)


def store_scan(spark, d):
    return search.matches(_store(spark, d).events(), search.Request(match_all(), FROM, TO)).select(F.col("id").alias("event_id"), "segment")


def store_cached_scan(spark, d):
    return search.matches(_store(spark, d, cache=True).events(), search.Request(CLICK, FROM, TO)).select(F.col("id").alias("event_id"))


def store_term_search(spark, d):
    return search.matches(_store(spark, d).events(), _asked(SEVEN)).select(F.col("id").alias("event_id"))


def store_postings_search(spark, d):
    store = _store(spark, d)
    found = store.search_postings(_asked(all_of(CLICK, SEVEN)))
    return found.join(store.events().select("segment", "doc_seq", F.col("id").alias("event_id")), ["segment", "doc_seq"]).select("event_id")


def store_search(spark, d):
    found = _store(spark, d).search(_asked(any_of(term("event_type", "click", 2.0), SEVEN), limit=10))
    return spark.createDataFrame([(h["hit_id"], h["score"], found["total"]) for h in found["hits"]], "event_id long, score double, total long")


def store_fetch(spark, d):
    return spark.createDataFrame([(h["id"],) for h in _store(spark, d).fetch(_asked(CLICK, limit=100))], "event_id long")


def store_list_segments(spark, d):
    return spark.createDataFrame([(s,) for s in _store(spark, d).list_segments()], "segment_start_ns long")


def store_lookup_segment(spark, d):
    """The segments that an instant's neighbours at both ends of an hour are in."""
    at = FROM * 1_000_000_000 // (3600 * 10**9) * 3600 * 10**9
    store = _store(spark, d)
    parts = [store.lookup_segment(ns).select(F.col("id").alias("event_id"), F.lit(name).alias("edge")) for name, ns in (("before", at - 1), ("first", at), ("last", at + 3600 * 10**9 - 1))]
    return parts[0].union(parts[1]).union(parts[2])


def _aggregated(spark, d):
    request = {"query": {"query": {"field": "event_type", "value": "click"}, "from_second": 1704067200, "to_second": 1706745599}, "fields": {"k": True, "event_type": True}, "time_bucket_sec": 86400, "sample_limit": 20}
    return _store(spark, d).aggregate(request)


def store_aggregate(spark, d):
    out = _aggregated(spark, d)
    none, zero = F.lit(""), F.lit(0).cast("long")
    rows = [
        out["total"].select(F.lit("total").alias("part"), none.alias("key"), none.alias("value"), F.col("total").alias("n"), zero.alias("n_unique")),
        out["facets"].select(F.lit("facet"), "key", "value", "n", zero),
        out["possible"].select(F.lit("possible"), "key", none, "n", zero),
        out["chart"].select(F.lit("chart"), F.col("bucket").cast("string"), "event_type", "n", "n_unique"),
    ]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


def store_aggregate_sample(spark, d):
    return _aggregated(spark, d)["sample"].select(F.col("id").alias("event_id"), "created_at_ns")


def stream_ingest(spark, d):
    """Events that arrive as files, taken into a store by a stream."""
    inbox, store = scratch.path(spark, "inbox"), EventStore(spark, scratch.path(spark, "streamed"))
    event_envelopes(spark, d).drop("doc_seq").write.parquet(inbox)
    pipeline.ingest(pipeline.read_files(spark, inbox), store, scratch.path(spark, "offsets"), now_ns=NOW_NS).awaitTermination()
    return store.events().select(F.col("id").alias("event_id"), "created_at_ns", "event_type", "foreign_type", "foreign_id")


_NAMED = (
    segment_assign, ingest_prepare, ingest_prepare_old_dates, flatten_kv, flatten_expand_id, list_segments, scan_match_all, scan_time_range, search_topk, search_total, fetch_limit, fetch_scan,
    aggregate_sample, aggregate_total, facet_search, facet_count, facet_event_type, facet_foreign_id, facet_possible, facets_one_pass, chart_count, chart_unique, chart_bounds, ignore_type, whitelist_search,
    validate_envelopes, ingest_envelope_json, lookup_segment, parse_pixel_path, cleanup_vw, postings_search, user_agent, geohash_points, chart_unique_approx,
    flatten_json, flatten_styles, stringify_values, ingest_free_json, free_json_errors, validate_envelope_json, ingest_envelope_protobuf, hit_json, value_to_text, fill_empty, cleanup_names, hash_text,
    pairs_parse, digits_check, dump_json, shuffle_values, enrich_ip, enrich_place, hit_ids, stream_ids, bad_range, store_scan, store_cached_scan, store_term_search, store_postings_search, store_search,
    store_fetch, store_list_segments, store_lookup_segment, store_aggregate, store_aggregate_sample, stream_ingest, stream_live_chart, kafka_records,
)

_BY_QUERY = {
    "term_search": _ids(SEVEN),
    "term_event_type": _ids(term("event_type", "purchase")),
    "term_foreign_id": _ids(term("user", "8")),
    "term_date_tag": _ids(term("year-month-day", "2024-01-05")),
    "term_empty": _ids(term("k", "")),
    "term_unknown": _ids(term("event_type", "not_existing")),
    "and_search": _ids(all_of(CLICK, SEVEN)),
    "or_search": _ids(any_of(CLICK, SEVEN)),
    "and_not_search": _ids(all_of(CLICK, not_=SEVEN)),
    "nested_bool_search": _ids(all_of(any_of(CLICK, term("event_type", "view")), not_=any_of(term("user", "8"), SEVEN))),
    "boost_search": _scores(any_of(term("event_type", "click", 2.0), SEVEN)),
    "dismax_search": _scores(best_of(term("event_type", "click", 2.0), SEVEN, tiebreaker=0.5)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMED} | _BY_QUERY


_ADDRESS = "'10.'||(event_id%300)||'.'||(user_id%200)||'.7'"
_USER_AGENT = """
SELECT event_id, v.key, CASE WHEN event_id%2=0 THEN v.browser ELSE v.tool END AS value FROM events, (VALUES
  ('ua_is_bot','false','true'),('ua_is_mobile','false','false'),('ua_platform','X11',''),('ua_os','Linux',''),('ua_engine_name','AppleWebKit',''),('ua_engine_version','537.36',''),
  ('ua_browser_name','Chrome',''),('ua_browser_version','120.0.0.0','')) v(key, browser, tool)
"""
_GEOHASH = """
WITH p AS (SELECT event_id, least(CAST(floor((user_id%360-180+180.0)/360*32768) AS BIGINT),32767) AS x, least(CAST(floor((event_id%180-90+90.0)/180*32768) AS BIGINT),32767) AS y FROM events),
b AS (SELECT event_id, i, CASE WHEN i%2=0 THEN (x>>(14-i//2))&1 ELSE (y>>(14-i//2))&1 END AS bit FROM p, (SELECT unnest(generate_series(0,29)) AS i)),
l AS (SELECT event_id, i//5 AS l, sum(bit<<(4-i%5)) AS v FROM b GROUP BY 1,2)
SELECT event_id, string_agg(substr('0123456789bcdefghjkmnpqrstuvwxyz',CAST(v+1 AS BIGINT),1),'' ORDER BY l) AS gh6 FROM l GROUP BY 1
"""
_HIT = """
SELECT event_id, '{"id":"'||event_id||'","score":0.0,"metadata":{"search":[{"key":"k","value":"7"},{"key":"year","value":"'||strftime(ts,'%Y')||'"},{"key":"year-month","value":"'||strftime(ts,'%Y-%m')||'"},{"key":"year-month-day","value":"'||strftime(ts,'%Y-%m-%d')
  ||'"},{"key":"year-month-day-hour","value":"'||strftime(ts,'%Y-%m-%d-%H')||'"}],"count":[{"key":"bucket","value":"'||CAST(CAST(round_even(value,0) AS BIGINT) AS VARCHAR)||'"}],"properties":[],"created_at_ns":"'||(epoch_us(ts)*1000)
  ||'","event_type":"click","foreign_id":"'||user_id||'","foreign_type":"user","track":{},"id":"'||event_id||'"}}' AS hit FROM events WHERE event_type='click' AND json_extract_string(props,'$.k')='7'
"""
_K = "json_extract_string(props,'$.k')"
_SEG = "(epoch_us(ts)//1000000)//3600"


def oracle_sql() -> dict[str, str]:
    either = f"event_type='click' OR {_K}='7'"
    scored = f"CAST((event_type='click')::INT*2.0+({_K}='7')::INT AS DOUBLE)"
    rounded = "CAST(CAST(round_even(value,0) AS BIGINT) AS VARCHAR)"
    owner = "CAST(user_id AS VARCHAR)"
    select = "SELECT event_id FROM events WHERE "
    tags = ", ".join(f"strftime(ts,'{f}') AS {n}" for n, f in (("year", "%Y"), ("year_month", "%Y-%m"), ("year_month_day", "%Y-%m-%d"), ("year_month_day_hour", "%Y-%m-%d-%H")))
    clicks = "FROM events WHERE event_type='click' GROUP BY ALL"
    return {
        "segment_assign": f"SELECT event_id, {_SEG} AS segment FROM events",
        "ingest_prepare": f"SELECT event_id, epoch_us(ts)*1000 AS created_at_ns, event_type, 'user' AS foreign_type, {owner} AS foreign_id, {tags} FROM events",
        "ingest_prepare_old_dates": "SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 2010 AND 2037 THEN strftime(o_orderdate,'%Y') ELSE '' END AS year FROM orders",
        "flatten_kv": f"SELECT event_id, 'k' AS key, CAST(CAST(round_even(CAST({_K} AS DOUBLE),0) AS BIGINT) AS VARCHAR) AS value FROM events",
        "flatten_expand_id": "SELECT o_orderkey, 'order.customer_id' AS key, CAST(o_custkey AS VARCHAR)||'.seen' AS value FROM orders",
        "list_segments": f"SELECT DISTINCT {_SEG}*3600*1000000000 AS segment_start_ns FROM events",
        "scan_match_all": "SELECT count(*) AS total FROM events",
        "scan_time_range": f"{select} {_SEG} BETWEEN {FROM}//3600 AND {TO}//3600",
        "term_search": f"{select} {_K}='7'",
        "term_event_type": f"{select} event_type='purchase'",
        "term_foreign_id": f"{select} user_id=8",
        "term_date_tag": f"{select} strftime(ts,'%Y-%m-%d')='2024-01-05'",
        "term_empty": f"{select} false",
        "term_unknown": f"{select} event_type='not_existing'",
        "and_search": f"{select} event_type='click' AND {_K}='7'",
        "or_search": f"{select} {either}",
        "and_not_search": f"{select} event_type='click' AND NOT {_K}='7'",
        "nested_bool_search": f"{select} (event_type='click' OR event_type='view') AND NOT (user_id=8 OR {_K}='7')",
        "boost_search": f"SELECT event_id, {scored} AS score FROM events WHERE {either}",
        "dismax_search": f"WITH s AS (SELECT event_id,(event_type='click')::INT*2.0::DOUBLE a,({_K}='7')::INT*1.0::DOUBLE b FROM events) SELECT event_id, greatest(a,b)+0.5*(a+b-greatest(a,b)) AS score FROM s WHERE a>0 OR b>0",
        "search_topk": f"WITH s AS (SELECT event_id,{_SEG} seg, {scored} score FROM events) SELECT event_id, score FROM s WHERE score>0 ORDER BY score DESC, seg, event_id LIMIT 10",
        "search_total": f"SELECT count(*) AS total FROM events WHERE {either}",
        "fetch_limit": f"SELECT event_id, CAST(0 AS DOUBLE) AS score FROM events WHERE event_type='click' ORDER BY {_SEG}, event_id LIMIT 100",
        "fetch_scan": f"SELECT event_id, epoch_us(ts)*1000 AS created_at_ns, event_type, {owner} AS foreign_id FROM events WHERE event_type='click'",
        "aggregate_sample": f"SELECT event_id, epoch_us(ts)*1000 AS created_at_ns FROM events WHERE event_type='click' ORDER BY {_SEG}, event_id LIMIT 20",
        "aggregate_total": "SELECT count(*) AS total FROM events WHERE event_type='click'",
        "facet_search": f"SELECT 'k' AS key, {_K} AS value, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM events WHERE event_type='click' GROUP BY 2",
        "facet_count": f"SELECT 'bucket' AS key, {rounded} AS value, count(*) AS n FROM events GROUP BY 2",
        "facet_event_type": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
        "facet_foreign_id": f"SELECT 'user' AS foreign_type, {owner} AS foreign_id, count(*) AS n FROM events GROUP BY 2",
        "facet_possible": "SELECT key, count(*) AS n FROM events, (VALUES ('k'),('bucket'),('year'),('year-month'),('year-month-day'),('year-month-day-hour'),('event_type'),('foreign_id')) v(key) GROUP BY 1",
        "facets_one_pass": f"SELECT 'search' AS section, 'k' AS key, {_K} AS value, count(*) AS n {clicks} UNION ALL SELECT 'count', 'bucket', {rounded}, count(*) {clicks} UNION ALL SELECT 'event_type', 'event_type', event_type, count(*) {clicks} UNION ALL SELECT 'foreign_id', 'user', {owner}, count(*) {clicks}",
        "chart_count": "SELECT (epoch_us(ts)//1000000)//300*300 AS bucket, event_type, count(*) AS n FROM events GROUP BY 1,2",
        "chart_unique": "SELECT (epoch_us(ts)//1000000)//3600*3600 AS bucket, event_type, count(*) AS n, count(DISTINCT user_id) AS n_unique FROM events GROUP BY 1,2",
        "chart_bounds": "SELECT (min(epoch_us(ts)//1000000)//3600*3600)//300*300 AS time_start, (max(epoch_us(ts)//1000000)//3600*3600+86400)//300*300 AS time_end FROM events",
        "ignore_type": f"{select} event_type NOT IN ('error','view')",
        "whitelist_search": f"{select} event_type='click' OR user_id=8",
        "validate_envelopes": "SELECT event_id, CASE WHEN user_id%10=0 THEN 'missing foreign_id' WHEN user_id%10=1 THEN 'missing event_type' ELSE '' END AS error FROM events",
        "ingest_envelope_json": f"SELECT event_id, event_type, 'user' AS foreign_type, {owner} AS foreign_id FROM events",
        "lookup_segment": f"{select} {_SEG} = {FROM}//3600",
        "parse_pixel_path": "SELECT c_custkey, 'segment' AS key, c_mktsegment AS value FROM customer WHERE c_mktsegment<>''",
        "cleanup_vw": "SELECT p_partkey, regexp_replace(p_name,'[^0-9A-Za-z]','_','g') AS cleaned FROM part",
        "postings_search": f"{select} event_type='click' AND {_K}='7'",
        "user_agent": _USER_AGENT,
        "geohash_points": _GEOHASH,
        "chart_unique_approx": "SELECT (epoch_us(ts)//1000000)//86400*86400 AS bucket, event_type, count(*) AS n, true AS close FROM events GROUP BY 1,2",
        "flatten_json": """SELECT o_orderkey, '{"order.id":"'||o_orderkey||'","order.tags.0":"a","order.tags.1.status":"'||o_orderstatus||'","paid":"true"}' AS flat FROM orders""",
        "flatten_styles": "SELECT o_orderkey, 'p:'||s.key AS key, o_orderstatus AS value, s.style FROM orders, (VALUES ('dot','a.b.0'),('path','a/b/0'),('rails','a[b][0]'),('underscore','a_b_0')) s(style,key)",
        "stringify_values": "SELECT o_orderkey, v.key, CASE v.key WHEN 'half' THEN CAST(CAST(round_even(o_orderkey+0.5,0) AS BIGINT) AS VARCHAR) WHEN 'yes' THEN 'true' WHEN 'no' THEN '<nil>' ELSE o_orderstatus END AS value FROM orders, (VALUES ('half'),('yes'),('no'),('text')) v(key)",
        "ingest_free_json": """SELECT o_orderkey, 'basket' AS foreign_type, CAST(o_custkey AS VARCHAR) AS customer_id, o_orderstatus AS status, '2024-02-01' AS year_month_day, '{"a":1}' AS payload FROM orders WHERE o_custkey%10<>0""",
        "free_json_errors": "SELECT o_orderkey, CASE o_orderkey%3 WHEN 0 THEN 'bad json' WHEN 1 THEN 'missing event_type' ELSE '' END AS error FROM orders",
        "validate_envelope_json": "SELECT o_orderkey, CASE o_orderkey%4 WHEN 0 THEN 'missing metadata' WHEN 1 THEN 'missing foreign_id' WHEN 2 THEN 'missing foreign_type' ELSE '' END AS error FROM orders",
        "ingest_envelope_protobuf": "SELECT o_orderkey, o_custkey%16000 AS created_at_ns, 'order' AS event_type, 'customer' AS foreign_type, CAST(o_custkey AS VARCHAR) AS foreign_id, 'hi' AS payload, false AS metadata_missing FROM orders",
        "hit_json": _HIT,
        "value_to_text": "SELECT o_orderkey, CASE WHEN o_orderkey%2=0 THEN CAST(o_custkey AS VARCHAR) ELSE 'nil' END AS shown FROM orders",
        "fill_empty": "SELECT o_orderkey, CASE WHEN o_orderkey%2=0 THEN o_orderstatus ELSE '__empty' END AS value FROM orders",
        "cleanup_names": "WITH n AS (SELECT p_partkey, regexp_replace(p_name||' (é.日) '||repeat(p_brand,8),'日','','g') AS s FROM part) SELECT p_partkey, left(regexp_replace(s,'[^0-9A-Za-z:_-]','_','g'),64) AS cleaned, left(regexp_replace(s,'[^0-9A-Za-z:_.-]','_','g'),64) AS with_dots FROM n",
        "hash_text": "SELECT count(DISTINCT p_name) AS names, count(DISTINCT p_name) AS hashes, count(DISTINCT p_name) AS pairs FROM part",
        "pairs_parse": "SELECT o_orderkey, v.key, CASE v.key WHEN 'key' THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderstatus END AS value FROM orders, (VALUES ('key'),('status')) v(key)",
        "digits_check": "SELECT o_orderkey, o_orderkey%3<>0 AS digits FROM orders",
        "dump_json": "SELECT p_partkey, CAST(to_json({'p_partkey':p_partkey,'p_name':p_name,'p_size':p_size}) AS VARCHAR) AS dump, 4 AS pretty_lines FROM part",
        "shuffle_values": "SELECT o_orderkey, array_to_string(list_sort([o_orderstatus,o_orderpriority,CAST(o_custkey AS VARCHAR)]),'|') AS sorted FROM orders",
        "enrich_ip": f"WITH a AS (SELECT event_id, CASE WHEN event_id%300<256 THEN {_ADDRESS} ELSE '<nil>' END AS own FROM events) SELECT event_id, CASE WHEN event_id%5=0 THEN '8.8.8.8' ELSE own END AS ip, own AS replaced FROM a",
        "enrich_place": "WITH a AS (SELECT event_id, event_id%300 AS b FROM events) SELECT event_id, CASE WHEN b<200 AND b%2=0 THEN 'city'||(b//2) END AS geoip_city, CASE WHEN b<200 AND b%2=0 THEN 'land' END AS geoip_country FROM a",
        "hit_ids": "SELECT event_id, CASE WHEN event_id%2=0 AND event_id<>0 THEN event_id ELSE event_id*10+1 END AS hit_id FROM events",
        "stream_ids": "SELECT event_id, ((user_id%100)<<56)|event_id AS stream_id FROM events",
        "bad_range": "SELECT 'bad date range, to_second must be older than from_second' AS error",
        "store_scan": f"SELECT event_id, {_SEG} AS segment FROM events WHERE {_SEG} BETWEEN {FROM}//3600 AND {TO}//3600",
        "store_cached_scan": f"{select} event_type='click' AND {_SEG} BETWEEN {FROM}//3600 AND {TO}//3600",
        "store_term_search": f"{select} {_K}='7'",
        "store_postings_search": f"{select} event_type='click' AND {_K}='7'",
        "store_search": f"WITH s AS (SELECT event_id,{_SEG} seg, {scored} score, count(*) OVER () AS total FROM events WHERE {either}) SELECT CASE WHEN event_id=0 THEN 1 ELSE event_id END AS event_id, score, total FROM s ORDER BY score DESC, seg, event_id LIMIT 10",
        "store_fetch": f"SELECT event_id FROM events WHERE event_type='click' ORDER BY {_SEG}, event_id LIMIT 100",
        "store_list_segments": f"SELECT DISTINCT {_SEG}*3600*1000000000 AS segment_start_ns FROM events",
        "store_lookup_segment": f"SELECT event_id, v.edge FROM events, (VALUES ('before',-1),('first',0),('last',0)) v(edge,s) WHERE {_SEG}={FROM}//3600+v.s",
        "store_aggregate": f"WITH c AS (SELECT *, (epoch_us(ts)//1000000)//86400*86400 AS bucket FROM events WHERE event_type='click') SELECT 'total' AS part, '' AS key, '' AS value, count(*) AS n, 0::BIGINT AS n_unique FROM c UNION ALL SELECT 'facet', 'k', {_K}, count(*), 0 FROM c GROUP BY 3 UNION ALL SELECT 'facet', 'event_type', 'click', count(*), 0 FROM c UNION ALL SELECT 'possible', v.key, '', count(*), 0 FROM c, (VALUES ('k'),('bucket'),('year'),('year-month'),('year-month-day'),('year-month-day-hour'),('event_type'),('foreign_id')) v(key) GROUP BY 2 UNION ALL SELECT 'chart', CAST(bucket AS VARCHAR), event_type, count(*), count(DISTINCT user_id) FROM c GROUP BY 2,3",
        "store_aggregate_sample": f"SELECT event_id, epoch_us(ts)*1000 AS created_at_ns FROM events WHERE event_type='click' ORDER BY {_SEG}, event_id LIMIT 20",
        "stream_live_chart": "SELECT * FROM (SELECT (epoch_us(ts)//1000000)//86400*86400 AS bucket, event_type, count(DISTINCT user_id) AS n_unique FROM events GROUP BY 1,2) WHERE (bucket+86400)*1000000 <= (SELECT max(epoch_us(ts))-3600000000 FROM events)",
        "kafka_records": f"SELECT ((user_id%4)<<56)|event_id AS id, epoch_us(ts)*1000 AS created_at_ns, event_type, {owner} AS foreign_id FROM events WHERE event_id%7<>0",
        "stream_ingest": f"SELECT event_id, epoch_us(ts)*1000 AS created_at_ns, event_type, 'user' AS foreign_type, {owner} AS foreign_id FROM events",
    }

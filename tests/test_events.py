"""Ingest, query tree, flattening, store, enrichment and streaming on small fixtures."""

import json
import threading

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.functions import text
from tidemark.functions.flatten import expand_pair, flatten_column, flatten_rows, flatten_value
from tidemark.operators import enrich, facets, search
from tidemark.operators.ingest import prepare, validate
from tidemark.plans.query import Query, all_of, any_of, best_of, evaluate, match_all, predicate, score, term
from tidemark.schema import EVENT_SCHEMA
from tidemark.sources import envelopes
from tidemark.sources.store import EventStore
from tidemark.streaming import pipeline

HOUR = 3600 * 10**9


def event(i, ns=1, kind="click", owner=("user", "1"), search_=(), count=()):
    return (i, ns, kind, owner[0], owner[1], list(search_), list(count), [], None, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def test_validation_order(spark):
    rows = [event(1, owner=("", "")), event(2, owner=("", "x"), kind=""), event(3, kind=""), event(4)]
    assert [r["error"] for r in validate(frame(spark, rows)).orderBy("id").collect()] == ["missing foreign_id", "missing foreign_type", "missing event_type", ""]


def test_tokens_and_empty_values(spark):
    rows = [event(1, search_=[("a", ""), ("", "x"), ("b", "1"), ("b", "1"), ("event_type", "fake"), ("user", "fake")])]
    got = set(prepare(frame(spark, rows), 1).head()["tokens"])
    assert got == {"a\u0001__empty", "b\u00011", "user\u00011", "event_type\u0001click", "tidemark\u0001match_all"}


def test_date_tags_have_bounds(spark):
    ns = [2**31 * 10**9, (2**31 - 1) * 10**9, 1262304000 * 10**9 - 1]
    rows = prepare(frame(spark, [event(i, n) for i, n in enumerate(ns)]), 1).orderBy("id").collect()
    assert [[p["value"] for p in r["search"]][:1] for r in rows] == [[""], ["2038"], [""]]


def test_missing_time_is_now(spark):
    assert prepare(frame(spark, [event(1, 0), event(2, None)]), 77).select("created_at_ns").distinct().collect()[0][0] == 77


terms = st.builds(term, st.sampled_from(["a", "b", "event_type", ""]), st.sampled_from(["1", "2", "click", ""]))
trees = st.recursive(
    terms,
    lambda inner: st.builds(
        lambda t, qs, n: Query(t, queries=tuple(qs), not_=n), st.sampled_from(["AND", "OR", "DISMAX"]), st.lists(inner, min_size=1, max_size=4), st.one_of(st.none(), inner)
    ),
    max_leaves=8,
)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tree=trees)
def test_predicate_is_the_evaluator(spark, tree):
    sets = [("click", [("a", "1")]), ("view", [("a", "2"), ("b", "1")]), ("click", [("b", "2"), ("a", "1")]), ("2", [])]
    df = prepare(frame(spark, [event(i, kind=k, search_=s) for i, (k, s) in enumerate(sets)]), 1)
    got = {r["id"] for r in df.where(predicate(tree)).select("id").collect()}
    assert got == {i for i, (k, s) in enumerate(sets) if evaluate(tree, {*s, ("event_type", k)})}


def test_scores_and_bad_trees(spark):
    df = prepare(frame(spark, [event(1, search_=[("a", "1"), ("b", "1")]), event(2, search_=[("a", "1")])]), 1)
    q = best_of(term("a", "1", 2.0), term("b", "1"), tiebreaker=0.5, boost=2.0)
    assert [r[0] for r in df.orderBy("id").select(score(q)).collect()] == [5.0, 4.0]
    for bad in ({"type": "AND"}, {"queries": [{"field": "a"}]}, {"type": "NEAR"}):
        with pytest.raises(ValueError):
            Query.from_dict(bad)
    with pytest.raises(ValueError, match="missing Query"):
        search.Request.from_dict({})


def test_range_is_by_segment_and_limits_are_global(spark):
    rows = [event(1, 1), event(2, HOUR - 1), event(3, HOUR), event(4, 3 * HOUR)]
    df = prepare(frame(spark, rows), 1).withColumn("doc_seq", F.col("id"))
    got = search.matches(df, search.Request(match_all(), 1, 7200))
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3]
    assert [r["id"] for r in search.fetch(df, match_all(), 3).collect()] == [1, 2, 3]
    assert search.matches(df, search.Request(match_all(), 9000, 1)).count() == 0
    with pytest.raises(ValueError, match="bad date range"):
        facets.checked_range(9000, 1)
    assert search.segment_range(0, 0, now=100_000) == (3, 27)


def test_possible_is_there_without_events(spark):
    got = {(r["key"], r["n"]) for r in facets.possible(prepare(frame(spark, []), 1)).collect()}
    assert got == {("event_type", 0), ("foreign_id", 0)}


CASES = [
    ('{"colour":"green"}', {("colour", "green")}),
    ('{"ship":{"deck":{"mast":"tall"}}}', {("ship.deck.mast", "tall")}),
    ('{"crew_id":12,"port_id":7,"sailing":"true"}', {("crew_id", "12"), ("port_id", "7"), ("sailing", "true")}),
    ('{"cargo_id":{"c77":true}}', {("cargo_id", "c77")}),
    ('{"log":{"berth_id":{"b1":{"moored":true}}}}', {("log.berth_id", "b1.moored")}),
    ('{"log":{"berth_id":{"b1":{"moored":false}}}}', {("log.berth_id.b1.moored", "false")}),
    ('{"log":{"berth_ids":{"b1":{"dock_id":{"d":true}}}}}', {("log.berth_ids", "b1.dock_id.d")}),
    ('{"knots":[3,{"wind":"west"}],"empty":{},"none":[]}', {("knots.0", "3"), ("knots.1.wind", "west")}),
    ('{"low":7.25,"even":4.5,"odd":5.5,"yes":true,"nothing":null}', {("low", "7"), ("even", "4"), ("odd", "6"), ("yes", "true"), ("nothing", "<nil>")}),
    ('{"flag_code":{"se":"true"}}', {("flag_code", "se")}),
    ('{"berth_id":true}', {("berth_id", "true")}),
]


def test_flatten_both_ways(spark):
    df = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(CASES)] + [(99, "{bad")], "i int, j string")
    rows: dict[int, set] = {}
    for r in flatten_rows(df, "j", max_depth=5, expand=True).collect():
        rows.setdefault(r["i"], set()).add((r["key"], r["value"]))
    assert rows == {i: want for i, (_, want) in enumerate(CASES)}
    column = {r["i"]: r["kv"] for r in df.select("i", flatten_column(F.col("j"), expand=True).alias("kv")).collect()}
    assert column.pop(99) is None
    assert {i: {(p["key"], p["value"]) for p in kv} for i, kv in column.items()} == rows


def test_flatten_styles():
    nested = {"a": {"b": [1]}}
    assert [flatten_value(nested, "p:", s)[0][0] for s in ("dot", "path", "rails", "underscore")] == ["p:a.b.0", "p:a/b/0", "p:a[b][0]", "p:a_b_0"]
    assert expand_pair("a_id.x", "false") == ("a_id.x", "false")


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).head()[0]
    assert get(text.cleanup(F.lit("a b.cé日:-_"))) == "a_b_c_:-_"
    assert get(text.cleanup(F.lit("a.b"), True)) == "a.b"
    assert len(get(text.cleanup(F.lit("x" * 99)))) == 64
    assert get(text.cleanup_words(F.lit("a-b日"))) == "a_b"
    assert [get(text.is_digits(F.lit(s))) for s in ("", "12٣", "1a")] == [True, True, False]
    assert [tuple(p) for p in get(text.pairs_of(F.lit("a:b,,c:d")))] == [("a", "b"), ("c", "d")]
    assert [get(text.rounded(F.lit(x))) for x in (2.5, 3.5, -1.2)] == ["2", "4", "-1"]
    assert get(text.geohash(F.lit(57.64911), F.lit(10.40744), 7)) == "u4pruyd"


def test_ip_of_both_kinds_given_and_replaced(spark):
    kvs = "array<struct<key:string,value:string>>"
    df = spark.createDataFrame([(a, [("ip", "8.8.8.8"), ("k", "v")]) for a in ("2001:db8::1", "256.1.1.1", "1.2.3")], f"addr string, search {kvs}")
    given = [[tuple(p) for p in r[0]] for r in df.select(enrich.with_ip(F.col("search"), F.col("addr"))).collect()]
    assert given == [[("ip", "8.8.8.8"), ("k", "v")]] * 3
    own = [[tuple(p) for p in r[0]] for r in df.select(enrich.with_ip(F.col("search"), F.col("addr"), replace_given=True)).collect()]
    assert own == [[("k", "v"), ("ip", a)] for a in ("2001:db8::1", "<nil>", "<nil>")]


def test_user_agents(spark):
    agents = {
        "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Mobile/15E148 Safari/604.1": ("false", "true", "iPhone", "iOS", "AppleWebKit", "605.1.15", "Safari", "17.0"),
        "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:121.0) Gecko/20100101 Firefox/121.0": ("false", "false", "Windows NT 10.0", "Windows", "Gecko", "121.0", "Firefox", "121.0"),
        "Mozilla/5.0 (compatible; Googlebot/2.1)": ("true", "false", "compatible", "", "", "", "", ""),
        "": ("false", "false", "", "", "", "", "", ""),
    }
    df = spark.createDataFrame([(a,) for a in agents], "a string")
    assert {r["a"]: tuple(p["value"] for p in r["t"]) for r in df.select("a", enrich.user_agent_tags(F.col("a")).alias("t")).collect()} == agents


def test_places_of_overlapping_and_wide_ranges(spark):
    df = spark.createDataFrame([("1.2.3.4", []), ("9.9.9.9", []), ("nothing", [])], "addr string, search array<struct<key:string,value:string>>")
    ranges = spark.createDataFrame([(0, 2**32 - 1, "all", "world"), (16909056, 16909311, "Delft", "Netherlands")], "start long, end long, city string, country string")
    got = sorted((r["addr"], r["search"][0]["value"] if r["search"] else "") for r in enrich.with_place(df, ranges, "addr", 8).collect())
    assert got == [("1.2.3.4", "Delft"), ("1.2.3.4", "all"), ("9.9.9.9", "all"), ("nothing", "")]


def test_enrichment(spark):
    kvs = "array<struct<key:string,value:string>>"
    df = spark.createDataFrame([("1.2.3.4", []), ("9.9.9.9", [("ip", "8.8.8.8")]), ("bad", [])], f"addr string, search {kvs}")
    got = [[tuple(p) for p in r[0]] for r in df.select(enrich.with_ip(F.col("search"), F.col("addr"))).collect()]
    assert got == [[("ip", "1.2.3.4")], [("ip", "8.8.8.8")], [("ip", "<nil>")]]
    ranges = spark.createDataFrame([(16909056, 16909311, "Delft", "Netherlands")], "start long, end long, city string, country string")
    placed = [[tuple(p) for p in r["search"]] for r in enrich.with_place(df.where("addr = '1.2.3.4'"), ranges, "addr").collect()]
    assert placed == [[("geoip_city", "Delft"), ("geoip_country", "Netherlands")]]


def test_store_round_trip(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    store.push(frame(spark, [event(i, 1 + (i % 3) * HOUR, search_=[("k", str(i % 2))]) for i in range(1, 31)]))
    store.push(frame(spark, [event(31, 1), event(32, 1, kind="")]))
    r = {"query": {"field": "tidemark", "value": "match_all"}, "from_second": 1, "to_second": 10000, "limit": 2}
    found = store.search(r)
    assert found["total"] == 31 and [h["hit_id"] for h in found["hits"]] == [3, 6]
    assert [x["id"] for x in store.fetch(r)] == [3, 6]
    assert store.list_segments() == [0, HOUR, 2 * HOUR]
    out = store.aggregate({"query": r, "fields": {"k": True, "event_type": True}, "time_bucket_sec": 3600, "sample_limit": 5})
    assert out["total"].head()[0] == 31 and out["chart_bounds"] == (0, 7200 + 86400) and out["sample"].count() == 5
    assert {(x["section"], x["value"]): x["n"] for x in out["facets"].collect()}[("search", "0")] == 15
    with pytest.raises(ValueError, match="missing event_type"):
        store.push(frame(spark, [event(1, kind="")]), strict=True)


def test_store_keeps_events_without_an_id_apart(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"), postings=True)
    store.push(frame(spark, [event(0, 5, search_=[("a", "1")]), event(None, 5, search_=[("b", "1")]), event(0, 5, search_=[("a", "1"), ("b", "1")])]))
    r = {"query": {"type": "AND", "queries": [{"field": "a", "value": "1"}, {"field": "b", "value": "1"}]}, "from_second": 0, "to_second": 10, "limit": 5}
    r["from_second"] = 1
    found = store.search(r)
    assert found["total"] == 1 and [(x["segment"], x["doc_seq"]) for x in store.search_postings(r).collect()] == [(0, found["hits"][0]["doc_seq"])]
    every = store.search({**r, "query": {"field": "tidemark", "value": "match_all"}})
    assert len({h["hit_id"] for h in every["hits"]}) == 3 == every["total"]
    store.push(frame(spark, [event(0, 5)]))
    last = store.search({**r, "query": {"field": "tidemark", "value": "match_all"}})["hits"][-1]
    assert last["doc_seq"] > max(h["doc_seq"] for h in every["hits"]) and last["hit_id"] == last["doc_seq"] + 1
    assert store.search({**r, "query": {"field": "no", "value": "such"}}) == {"total": 0, "hits": []}


def test_lookup_segment_at_both_ends(spark, tmp_path):
    first, last = 1704150000 * 10**9, 1704150000 * 10**9 + HOUR - 1
    store = EventStore(spark, str(tmp_path / "s"))
    store.push(frame(spark, [event(1, first - 1), event(2, first), event(3, last), event(4, last + 1)]))
    for ns, ids in ((first - 1, [1]), (first, [2, 3]), (last, [2, 3]), (last + 1, [4])):
        assert sorted(r["id"] for r in store.lookup_segment(ns).collect()) == ids
        assert sorted(r["id"] for r in search.lookup_segment(store.events().drop("day"), ns).collect()) == ids


def test_store_under_concurrent_writers_and_readers(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    store.push(frame(spark, [event(i) for i in range(1, 51)]))
    every = search.Request(match_all(), 1, 7200)
    seen, failed = [], []

    def write(n):
        try:
            EventStore(spark, store.path).push(frame(spark, [event(1000 * n + i, 1 + HOUR * (i % 2)) for i in range(10)]))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    def read():
        for _ in range(4):
            try:
                seen.append(EventStore(spark, store.path).search(every)["total"])
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(1, 7)] + [threading.Thread(target=read) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed, str(failed[0])[:600]
    assert all(50 <= n <= 110 for n in seen)
    rows = store.events().select("id", "doc_seq").collect()
    assert len(rows) == 110 == len({r["doc_seq"] for r in rows})


def test_empty_store(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"), postings=True)
    r = {"query": {"field": "tidemark", "value": "match_all"}, "from_second": 1, "to_second": 7200, "limit": 3}
    assert store.search(r) == {"total": 0, "hits": []} and store.list_segments() == [] and store.search_postings(r).count() == 0
    store.push(frame(spark, [event(1, kind="")]))
    assert store.search(r)["total"] == 0 and list(store.fetch(r)) == []
    store.push(frame(spark, [event(1)]))
    assert store.search(r)["total"] == 1 and store.search_postings(r).count() == 1


def test_cached_store_reads_its_own_writes(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"), cache=True)
    store.push(frame(spark, [event(1)]))
    snapshot = store.events()
    assert snapshot.count() == 1 and store.events() is snapshot and snapshot.is_cached
    store.push(frame(spark, [event(2)]))
    assert store.events().count() == 2 and not snapshot.is_cached


def test_free_json_can_be_pushed(spark, tmp_path):
    lines = ['{"search":{"book_id":{"7":true}},"count":{"n":[1.5]},"foreign_id":"1","foreign_type":"u","event_type":"read","payload":{"x":[1]}}', '{"foreign_id":"1"}', "nonsense"]
    frames = envelopes.from_free_json(spark.createDataFrame([(x,) for x in lines], "j string"), "j", 5)
    assert [r["error"] for r in frames.select("error").collect()] == ["", "missing foreign_type", "bad json"]
    store = EventStore(spark, str(tmp_path / "s"))
    store.push(frames, 5)
    found = store.search({"query": {"field": "book_id", "value": "7"}, "from_second": 0, "to_second": 1, "limit": 1}, now=1)
    assert found["total"] == 1 and bytes(found["hits"][0]["payload"]) == b'{"x":[1]}' and [tuple(p) for p in found["hits"][0]["count"]] == [("n.0", "2")]


def test_missing_metadata_comes_first(spark):
    lines = ['{"payload":"aGk="}', '{"metadata":{}}', '{"metadata":{"foreign_id":"1","foreign_type":"t","event_type":"e"},"payload":"aGk="}', "broken"]
    parsed = envelopes.from_envelope_json(spark.createDataFrame([(x,) for x in lines], "j string"), "j")
    assert [r["error"] for r in validate(parsed).collect()] == ["missing metadata", "missing foreign_id", "", "missing metadata"]


def test_protobuf_envelopes(spark):
    def size(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7])

    def block(number, raw):
        return bytes([number << 3 | 2]) + size(len(raw)) + raw

    pair = lambda k, v: block(1, k) + block(2, v)
    metadata = block(1, pair(b"a", b"1")) + block(1, block(1, b"only key")) + block(3, pair(b"p", "é".encode() * 70)) + b"\x28\x80\x01" + block(7, b"click") + block(9, b"5") + block(10, b"user") + block(11, block(1, b"t") + b"\x10\x07") + b"\x61" + (2**64 - 1).to_bytes(8, "little") + b"\x7d\x00\x00\x00\x00"
    rows = [block(1, metadata) + block(2, b"hi"), b"", block(2, b"hi"), b"\x0a\xff", b"\xff" * 20, None]
    got = envelopes.from_envelope_protobuf(spark.createDataFrame([(i, bytearray(r) if r is not None else None) for i, r in enumerate(rows)], "i int, raw binary"), "raw").orderBy("i").collect()
    first = got[0]
    assert [tuple(p) for p in first["search"]] == [("a", "1"), ("only key", "")] and first["properties"][0]["value"] == "é" * 70 and first["track"] == {"t": 7}
    assert (first["created_at_ns"], first["event_type"], first["foreign_id"], first["foreign_type"], first["id"], bytes(first["payload"])) == (128, "click", "5", "user", -1, b"hi")
    assert [r["metadata_missing"] for r in got] == [False, True, True, True, True, True]


def test_json_forms_hold_everything(spark):
    row = (7, 9, "e", "t", "1", [("a", "1")], [], None, {"x": 3}, bytearray(b"hi"))
    df = frame(spark, [row]).withColumn("score", F.lit(1.5)).withColumn("doc_seq", F.lit(4))
    line, hit = df.select(envelopes.to_envelope_json(df), envelopes.to_hit_json(df)).head()
    metadata = {"search": [{"key": "a", "value": "1"}], "count": [], "properties": [], "created_at_ns": "9", "event_type": "e", "foreign_id": "1", "foreign_type": "t", "track": {"x": 3}, "id": "7"}
    assert json.loads(line) == {"metadata": metadata, "payload": "aGk="} and json.loads(hit) == {"id": "7", "score": 1.5, "metadata": metadata}
    again = envelopes.from_envelope_json(spark.createDataFrame([(line,)], "j string"), "j").head()
    assert (again["id"], again["created_at_ns"], again["track"], bytes(again["payload"])) == (7, 9, {"x": 3}, b"hi")


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    made = scratch.materialise(spark.range(3), "t")
    assert made.count() == 3
    scratch.remove(spark)
    with pytest.raises(Exception, match="(?i)not exist|FileNotFound|FILE_NOT_EXIST"):
        made.count()

    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        scratch.folder(Session())


def test_streaming_restarts(spark, tmp_path):
    inbox, store = str(tmp_path / "in"), EventStore(spark, str(tmp_path / "s"))
    for part in ([event(i) for i in range(5)], [event(9, 5 * HOUR)]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(inbox)
        pipeline.ingest(pipeline.read_files(spark, inbox), store, str(tmp_path / "c"), now_ns=1).awaitTermination()
    assert store.events().count() == 6
    pipeline.ingest(pipeline.read_files(spark, inbox), store, str(tmp_path / "c"), now_ns=1).awaitTermination()
    assert store.events().count() == 6


def test_live_chart(spark, tmp_path):
    inbox = str(tmp_path / "in")
    frame(spark, [event(1, 1, owner=("u", "1")), event(2, 2, owner=("u", "1")), event(3, 3, owner=("u", "2")), event(4, 9 * HOUR)]).coalesce(1).write.parquet(inbox)
    q = pipeline.live_chart(pipeline.read_files(spark, inbox), 3600, "1 hour").writeStream.format("memory").queryName("live").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["n_unique"] for r in spark.table("live").collect()] == [2]


def test_or_of_many_terms_and_postings(spark):
    df = prepare(frame(spark, [event(i, search_=[("k", str(i))]) for i in range(6)]), 1).withColumn("doc_seq", F.col("id"))
    q = any_of(*(term("k", str(i)) for i in (1, 2, 3)), not_=term("k", "2"))
    assert sorted(r["id"] for r in df.where(predicate(q)).collect()) == [1, 3]
    assert sorted(r["doc_seq"] for r in search.search_postings(search.postings(df), all_of(q, term("event_type", "click"))).collect()) == [1, 3]

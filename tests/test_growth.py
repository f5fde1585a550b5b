"""What must not be done twice an event, nor grow for one task with the number of events."""

from netquarry import queries
from netquarry.functions import access, net
from netquarry.operators import fold, handlers, snapshot
from netquarry.sources import events
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_record_is_parsed_once(lines):
    raw = events.records(lines({"event_type": "tls", "src_ip": "10.0.0.1"}, "{} x", "[1]", "null", " \t", "  {}\t", '{"event_type":"dns"}, {}'))
    found = events.events(raw)
    assert plan(found).count('{"x":[') == plan(raw).count('{"x":[') > 0
    assert [r["event_type"] for r in found.orderBy("seq").collect()] == ["tls", "", ""]


def test_a_line_is_parsed_once_for_size_and_item(lines):
    raw = events.records(lines({"event_type": "tls"}, ' {"event_type":"dns"} ', "{}, {}", "null"))
    assert plan(raw).count('{"x":[') == 1
    assert [r["record"] is None for r in raw.orderBy("seq").select(F.to_json("record").alias("record")).collect()] == [False, False, True, False]


def test_texts_are_read_without_their_types(lines):
    found = events.events(events.records(lines({"event_type": "tls", "tls": {"sni": 5, "ja4": {"hash": "x"}, "ja3": {"hash": "y"}, "version": ["z"]}}, {"event_type": 7, "src_ip": True})))
    head = found.select("event_type", "src_ip", "tls.sni", "tls.ja3", "tls.version")
    assert "schemaofvariant" not in plan(head).lower().replace("_", "")
    assert [tuple(r) for r in found.orderBy("seq").select("event_type", "src_ip", "tls.sni", "tls.ja4", "tls.ja3", "tls.version").collect()] == [("tls", "", "", "x", "y", ""), ("", "", None, None, None, None)]


def test_lines_are_dealt_before_they_are_made(spark, monkeypatch):
    made = []
    keep = queries.landed
    monkeypatch.setattr(queries, "landed", lambda df, name: (made.append(plan(df)), keep(df, name))[1])
    monkeypatch.setattr(queries, "_HELD", {})
    queries.inventory(spark, DATA)
    assert 0 <= made[0].find("StructsToJson") < made[0].find("Repartition")


def test_a_comparison_folds_each_half_once_and_lands_what_it_reads(spark, monkeypatch):
    folds = []
    keep = fold.fold
    monkeypatch.setattr(fold, "fold", lambda facts: (folds.append(1), keep(facts))[1])
    monkeypatch.setattr(queries, "_HELD", {})
    first, both = queries.halves(spark, DATA)
    assert len(folds) == 1
    assert both.devices.columns == list(snapshot.COMPARED)


def test_facts_are_made_once(lines):
    found = handlers.shared_facts(events.events(events.records(lines({"event_type": "doh2", "src_ip": "10.0.0.1"}, {"event_type": "doh2", "src_ip": "8.8.8.8"}))))
    assert plan(found).count("size(concat(") == 0
    assert [(r["ip"], r["fact"]) for r in found.collect()] == [("10.0.0.1", "seen")]


def test_parts_grow_with_the_events(spark, monkeypatch):
    monkeypatch.setattr(queries, "PART_EVENTS", 100)
    monkeypatch.setattr(queries, "_HELD", {})
    found = queries.inventory(spark, DATA)
    assert len(found.lines.inputFiles()) == max(spark.sparkContext.defaultParallelism, -(-queries.table(spark, DATA, "events").count() // 100))


def test_a_query_lands_only_what_it_reads(spark, monkeypatch):
    names = []
    keep = queries.landed
    monkeypatch.setattr(queries, "landed", lambda df, name: (names.append(name), keep(df, name))[1])
    monkeypatch.setattr(queries, "_HELD", {})
    for query, more in (("a01_event_counts", ["lines", "events"]), ("a08_activity", ["facts", "folded"]), ("d05_fixed_findings", ["folded", "folded", "findings", "findings"])):
        queries.FOUND[query](spark, DATA)
        assert names == more
        names.clear()


def test_times_and_addresses_by_place(spark):
    times = {"2024-01-02T03:04:05.5Z": "03:04:05.500000", "2024-01-02T03:04:05,1234567-0130": "04:34:05.123456", "2024-01-02T03:04:05+05:30": "21:34:05.000000", "2024-01-02T03:04:05Z\n": None}
    rows = spark.createDataFrame(list(times.items()), "text string, wanted string").select("wanted", F.date_format(access.timestamp(F.col("text")), "HH:mm:ss.SSSSSS").alias("found")).collect()
    assert [r["found"] for r in rows] == [r["wanted"] for r in rows]
    inside = {"10.1.255.255": True, "10.1.256.0": False, "::ffff:10.0.0.1": True, "::ffff:8.8.8.8": False, "fe80::1": True, "": False}
    rows = spark.createDataFrame(list(inside.items()), "ip string, wanted boolean").select("wanted", net.is_private(F.col("ip")).alias("found")).collect()
    assert [r["found"] for r in rows] == [r["wanted"] for r in rows]

"""Every operator as a query over the test tables, by the ids of the operator inventory; their SQL is in oracle_sql()."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry import oracle
from netquarry.functions import access, ja4, names, net
from netquarry.operators import devices, evidence, findings, fold, handlers, ordering, reports, segmentation, snapshot
from netquarry.plans.scan import Inventory
from netquarry.sources import adapter, events, registry, rules
from netquarry.sources.landing import landed

NOW = dt.datetime(2025, 6, 1, 12, tzinfo=dt.UTC)
SINCE, UNTIL = dt.datetime(2024, 1, 10, tzinfo=dt.UTC), dt.datetime(2024, 1, 12, 6, 30, tzinfo=dt.UTC)
#: Events of a part of the landed lines, at most about.
PART_EVENTS = 100_000
_HELD: dict[tuple[str, ...], Inventory] = {}
#: Query and its SQL by name; filled by the functions below.
FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.lines(table(spark, sf_dir, "events"))


def _held(spark: SparkSession, sf_dir: str, part: str, make: Callable[[], Inventory]) -> Inventory:
    """What was landed before in this session of the same file."""
    changed = table(spark, sf_dir, "events").select(F.max("_metadata.file_modification_time")).first()[0]
    at = (spark.sparkContext.applicationId, sf_dir, str(changed), part)
    if at not in _HELD:
        _HELD[at] = make()
    return _HELD[at]


class Landed(Inventory):
    """Its steps are landed when first asked for: a query waits only for those that it reads."""

    @cached_property
    def events(self) -> DataFrame:
        return landed(Inventory.events.func(self), "events")

    @cached_property
    def facts(self) -> DataFrame:
        return landed(Inventory.facts.func(self), "facts")

    @cached_property
    def folded(self) -> DataFrame:
        return landed(Inventory.folded.func(self), "folded")


class Compared(Landed):
    """What a comparison reads of it, of devices and of findings, is landed too."""

    @cached_property
    def devices(self) -> DataFrame:
        return landed(Inventory.devices.func(self).select(*snapshot.COMPARED), "devices")

    @cached_property
    def findings(self) -> DataFrame:
        return landed(Inventory.findings.func(self), "findings")


def inventory(spark: SparkSession, sf_dir: str) -> Inventory:
    """Typed events, facts and folded facts of the ``events`` table, landed once a session: each gold table then is one job over the folded facts."""

    def make() -> Inventory:
        # parts of a number of events: the table is one file, whose parts are few and uneven; its rows are shorter than the lines made of them
        rows = table(spark, sf_dir, "events")
        count = -(-rows.count() // PART_EVENTS)
        dealt = rows.select("event_id", "ts", "user_id", "props").repartition(max(spark.sparkContext.defaultParallelism, count), "event_id")
        return Landed(landed(adapter.lines(dealt), "lines"), NOW, policy=segmentation.parse_policy(oracle.ZONES))

    return _held(spark, sf_dir, "whole", make)


def halves(spark: SparkSession, sf_dir: str) -> tuple[Inventory, Inventory]:
    """The inventory of the first half of the events (by id), and that of all of them: the first half's folded facts merged with the second's.

    What a comparison reads of both is landed once a session.
    """
    whole = inventory(spark, sf_dir)

    def part(name: str, make: Callable[[], tuple[DataFrame, DataFrame]]) -> Inventory:
        def landed_part() -> Inventory:
            found = Compared(whole.lines, NOW, policy=whole.policy)
            found.events, found.folded = make()
            return found

        return _held(spark, sf_dir, name, landed_part)

    middle = table(spark, sf_dir, "events").agg(F.floor(F.max("event_id") / 2)).first()[0] or 0
    early = F.col("seq") <= middle
    first = part("first half", lambda: (whole.events.where(early), landed(fold.fold(whole.facts.where(early)), "folded")))
    both = part("both halves", lambda: (whole.events, landed(fold.merged(first.folded.unionByName(fold.counted(whole.facts.where(~early)))), "folded")))
    return first, both


def query(name: str, sql: str | None = None):
    def add(fn):
        FOUND[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def text(values: Column) -> Column:
    """A sorted list as one text."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


def moment(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_moment(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"


def rounded(weight: str) -> Column:
    return F.round(weight, 6)


FACT = ["seq", "ip", "fact", "key", "value", "conclusion", "weight", "spec"]
KINDS = {"e04_dns": ("dns",), "e06_http": ("http", "http2"), "e23_ike": ("ike", "ikev2"), "e24_ftp": ("ftp", "ftp_data"), "e26_fileinfo": ("fileinfo", "files"), "e31_bittorrent": ("bittorrent-dht",), "e32_flow": ("flow", "netflow")}
for _name in oracle.ROWS:
    if _name not in ("e00_every_event", "e01_app_proto", "e27_industrial"):
        query(_name, oracle.handler_sql(_name))(lambda spark, d, kinds=KINDS.get(_name, (_name.partition("_")[2],)): handlers.facts_of(inventory(spark, d).events, *kinds).select(*FACT))


@query("e00_every_event", oracle.handler_sql("e00_every_event"))
def _(spark, d):
    return handlers.shared_facts(inventory(spark, d).events).where("fact IN ('seen', 'vlan')").select(*FACT)


@query("e01_app_proto", oracle.handler_sql("e01_app_proto"))
def _(spark, d):
    return handlers.shared_facts(inventory(spark, d).events, tags_too=False).where("fact <> 'seen'").select(*FACT)


@query("e27_industrial", oracle.handler_sql("e27_industrial"))
def _(spark, d):
    return handlers.industrial_facts(inventory(spark, d).events).select(*FACT)


BASE = f"WITH {adapter.sql_base()}"


@query("e33_stats", f"{BASE}, {oracle.STATS} SELECT seq, up AS uptime, captured, dropped FROM st")
def _(spark, d):
    return findings.sensor_counters(inventory(spark, d).events).drop("ts")


@query("sc01_records", f"{BASE} SELECT seq, t AS event_type, {sql_moment('ts')} AS ts, src AS src_ip, dest AS dest_ip, port::BIGINT AS dest_port, lower(proto) AS proto, app AS app_proto, here AS src_private, there AS dest_private, CASE WHEN k % 4 = 0 AND k % 5 > 0 THEN (k % 5 * 10)::VARCHAR ELSE '' END AS vlans FROM e")
def _(spark, d):
    rows = events.events(events.records(lines_of(spark, d)))
    return rows.select("seq", "event_type", moment(F.col("ts")).alias("ts"), "src_ip", "dest_ip", "dest_port", "proto", "app_proto", "src_private", "dest_private", text(F.col("vlans")).alias("vlans"))


def broken(lines: DataFrame) -> DataFrame:
    """Lines of which some are cut off, followed by more text, lists, null or blank."""
    kind, line = F.col("seq") % 8, F.col("line")
    bad = F.when(kind == 1, F.substring(line, 1, 25)).when(kind == 2, F.concat(line, F.lit(" x"))).when(kind == 3, F.concat(F.lit("["), line, F.lit("]"))).when(kind == 4, F.lit("null")).when(kind == 5, F.lit(" \t")).when(kind == 6, F.concat(line, F.lit("}")))
    return lines.select(F.coalesce(bad, line).alias("line"), "seq")


@query("sc02_parse_line", f"{BASE} SELECT seq, CASE seq % 8 WHEN 0 THEN t WHEN 7 THEN t WHEN 4 THEN '' END AS event_type FROM e WHERE seq % 8 <> 5")
def _(spark, d):
    rows = events.records(broken(landed(lines_of(spark, d), "lines")))
    return rows.select("seq", F.when(F.col("record").isNotNull(), access.text(F.col("record"), "event_type")).alias("event_type"))


@query("sc03_line_counts", "SELECT count(*) FILTER (WHERE event_id % 8 <> 5) AS total, count(*) FILTER (WHERE event_id % 8 IN (1, 2, 3, 6)) AS skipped FROM events")
def _(spark, d):
    return events.line_counts(events.records(broken(landed(lines_of(spark, d), "lines"))))


@query("p01_time_window", f"{BASE} SELECT t AS event_type, count(*) AS n FROM e WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 06:30:00' GROUP BY t")
def _(spark, d):
    return devices.event_counts(events.in_window(inventory(spark, d).events, SINCE, UNTIL))


@query("p04_private_addresses", f"{BASE} SELECT ip, ip LIKE '10.%' AS private, count(*) AS n FROM (SELECT src AS ip FROM e UNION ALL SELECT dest FROM e) GROUP BY ip")
def _(spark, d):
    rows = inventory(spark, d).events
    return rows.select("src_ip").unionAll(rows.select("dest_ip")).groupBy(F.col("src_ip").alias("ip")).agg(F.first(net.is_private(F.col("src_ip"))).alias("private"), F.count(F.lit(1)).alias("n"))


@query("p05_random_macs", oracle.gold(f"SELECT DISTINCT value AS mac, upper(replace(value, ':', '')) AS digits, {oracle.RANDOM} AS random FROM f WHERE fact = 'mac'"))
def _(spark, d):
    mac = F.col("value")
    return inventory(spark, d).facts.where("fact = 'mac'").select(mac.alias("mac"), net.mac_digits(mac).alias("digits"), net.is_random_mac(mac).alias("random")).distinct()


@query("p08_active_between", oracle.gold("SELECT ip FROM f WHERE fact = 'seen' GROUP BY ip HAVING max(ts) >= TIMESTAMP '2024-01-10' AND min(ts) <= TIMESTAMP '2024-01-12 06:30:00'"))
def _(spark, d):
    return reports.active_between(inventory(spark, d).devices, SINCE, UNTIL).select("ip")


@query("j01_port_rules", oracle.gold("SELECT ip, value, conclusion, weight FROM ev WHERE signal = 'service.port'"))
def _(spark, d):
    return inventory(spark, d).evidence.where("signal = 'service.port'").select("ip", "value", "conclusion", "weight")


@query("j02_app_proto_rules", oracle.gold("SELECT ip, value, conclusion, weight FROM ev WHERE signal = 'app_proto'"))
def _(spark, d):
    return inventory(spark, d).evidence.where("signal = 'app_proto'").select("ip", "value", "conclusion", "weight")


@query("j03_text_rules", f"WITH {oracle._rule_ctes()} SELECT rule_table, rule, match, count(DISTINCT p_name || '/' || p_type) AS n FROM part JOIN rt ON contains(lower(p_name || ' ' || p_type || ' cisco printer'), match) GROUP BY ALL")
def _(spark, d):
    """Every rule against every distinct text of ``part``, found anywhere in it in any case."""
    value = F.concat_ws(" ", "p_name", "p_type", F.lit("cisco printer"))
    parts = table(spark, d, "part").select(F.lower(value).alias("lower"), F.concat_ws("/", "p_name", "p_type").alias("value")).distinct()
    every = rules.text_rules(spark)
    hits = evidence.containing(parts.join(every.select("rule_table").distinct()), every, ["value", "lower", "rule_table"])
    return hits.groupBy("rule_table", "rule", "match").agg(F.count(F.lit(1)).alias("n"))


@query("j03_text_evidence", oracle.gold("SELECT ip, signal, value, conclusion, weight, spec FROM ev WHERE signal NOT IN ('service.port', 'app_proto', 'mac.oui')"))
def _(spark, d):
    return inventory(spark, d).evidence.where("signal NOT IN ('service.port', 'app_proto', 'mac.oui')")


JA4_RULES = "t13d\tclass=workstation\t0.3\t1\nt10\tclass=iot\t0.5\t2\nt13d1516\tos=Windows\t0.4\t2\n"


@query("j04_ja4_rules", oracle.gold("SELECT DISTINCT ip, value, r.c AS conclusion, r.w AS weight FROM f JOIN (VALUES ('t13d', 'class=workstation', 0.3::DOUBLE), ('t10', 'class=iot', 0.5::DOUBLE), ('t13d1516', 'os=Windows', 0.4::DOUBLE)) r(m, c, w) ON starts_with(value, m) WHERE fact = 'ja4'"))
def _(spark, d):
    texts = inventory(spark, d).facts.where("fact = 'text' AND conclusion = 'ja4'")
    return evidence.match_texts(texts, rules.text_rules(spark), rules.ja4_rules(spark, JA4_RULES)).select("ip", "value", "conclusion", "weight")


@query("j05_vendor_by_mac", oracle.gold("SELECT DISTINCT mac, vendor FROM mo"))
def _(spark, d):
    found = inventory(spark, d)
    return evidence.vendors(found.facts.where("fact = 'mac'"), found.rules["registry"], found.rules["curated"])


REGISTRY = [("00005E", "Nine"), ("00005E0", "Short"), ("00005E001", "Long"), ("00155D", "Not used"), ("FFFFFF", "Nobody")]


@query("j05_registry_prefixes", "WITH m AS (SELECT DISTINCT '00005E' || lpad(format('{:X}', c_custkey % 4096), 6, '0') AS mac FROM customer), r(p, v) AS (VALUES ('00005E', 'Nine'), ('00005E0', 'Short'), ('00005E001', 'Long')) SELECT mac, arg_max(v, length(p)) AS vendor FROM m JOIN r ON starts_with(mac, p) GROUP BY mac")
def _(spark, d):
    macs = table(spark, d, "customer").select(F.concat(F.lit("00005E"), F.lpad(F.hex(F.col("c_custkey") % 4096), 6, "0")).alias("value"))
    return evidence.vendors(macs, spark.createDataFrame(REGISTRY, rules.PREFIXES), rules.curated_prefixes(spark))


@query("j06_zone_of_address", oracle.gold("SELECT * FROM zn WHERE ip LIKE '10.%'", oracle.ZONE_SQL))
def _(spark, d):
    found = inventory(spark, d)
    rows = found.facts.where("fact = 'crossing'")
    return segmentation.zone_of(rows.select("ip").unionByName(rows.select(F.col("value").alias("ip"))), segmentation.zone_ranges(spark, found.policy))


@query("j07_segmentation", oracle.gold("SELECT seq, ip, key, value FROM vi", oracle.ZONE_SQL))
def _(spark, d):
    found = inventory(spark, d)
    return segmentation.violations(found.facts, found.policy).select("seq", "ip", "key", "value")


FI = lambda select: oracle.gold(select, oracle.FINDINGS)
RANK = "array_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity)"


@query("j10_worst_finding", FI(f"SELECT device, arg_max(severity, {RANK}) AS worst FROM fi GROUP BY device"))
def _(spark, d):
    return findings.worst(inventory(spark, d).findings)


@query("j11_findings_shown", FI("SELECT device, kind, count FROM fi WHERE device = 'sensor' OR device IN (SELECT ip FROM f WHERE fact = 'seen' GROUP BY ip HAVING max(ts) >= TIMESTAMP '2024-01-10' AND min(ts) <= TIMESTAMP '2024-01-12 06:30:00')"))
def _(spark, d):
    found = inventory(spark, d)
    return reports.findings_shown(found.findings, reports.active_between(found.devices, SINCE, UNTIL).select("ip")).select("device", "kind", "count")


@query("j13_coverage", f"{BASE}, c AS (SELECT t AS event_type, count(*) AS n FROM e GROUP BY t) SELECT w.place, w.event_type, coalesce(n, 0) AS n, n IS NOT NULL AS present FROM (SELECT i - 1 AS place, ['dhcp', 'arp', 'dns', 'tls', 'http', 'flow', 'smb', 'krb5', 'ssh', 'snmp'][i] AS event_type FROM (SELECT unnest(range(1, 11))::INT AS i)) w LEFT JOIN c USING (event_type)")
def _(spark, d):
    return reports.coverage(inventory(spark, d).event_counts)


@query("j13_coverage_short", f"{BASE}, c AS (SELECT t AS event_type, count(*) AS n FROM e GROUP BY t) SELECT w.place, w.event_type, coalesce(n, 0) AS n, n IS NOT NULL AS present FROM (SELECT i - 1 AS place, ['dhcp', 'dns', 'tls', 'http', 'flow', 'smb', 'krb5', 'ssh'][i] AS event_type FROM (SELECT unnest(range(1, 9))::INT AS i)) w LEFT JOIN c USING (event_type)")
def _(spark, d):
    return reports.coverage(inventory(spark, d).event_counts, reports.WANTED_SHORT)


@query("a01_event_counts", f"{BASE} SELECT t AS event_type, count(*) AS n FROM e GROUP BY t")
def _(spark, d):
    return inventory(spark, d).event_counts


@query("a02_evidence", oracle.gold("SELECT ip, signal, value, conclusion, weight, spec FROM ev"))
def _(spark, d):
    return inventory(spark, d).evidence


@query("a03_conclusions", oracle.gold("SELECT ip, conclusion, round(weight, 6) AS weight, spec FROM co"))
def _(spark, d):
    return inventory(spark, d).conclusions.select("ip", "conclusion", rounded("weight").alias("weight"), "spec")


@query("a05_winners", oracle.gold("SELECT ip, class, round(confidence, 6) AS confidence, os, vendor FROM wi"))
def _(spark, d):
    return inventory(spark, d).winners.withColumn("confidence", rounded("confidence"))


@query("a05_places", oracle.gold("SELECT ip, conclusion, place FROM pl"))
def _(spark, d):
    return evidence.ranked(inventory(spark, d).conclusions).select("ip", "conclusion", F.col("place").cast("long").alias("place"))


@query("a07_first_last_seen", oracle.gold(f"SELECT ip, {sql_moment('min(ts)')} AS first_seen, {sql_moment('max(ts)')} AS last_seen FROM f WHERE fact = 'seen' GROUP BY ip"))
def _(spark, d):
    return inventory(spark, d).devices.where("first_seen IS NOT NULL").select("ip", moment(F.col("first_seen")).alias("first_seen"), moment(F.col("last_seen")).alias("last_seen"))


@query("a08_activity", oracle.gold("SELECT ip, floor(epoch(ts) / 3600)::BIGINT AS hour, count(*) AS n FROM f WHERE fact = 'seen' GROUP BY ALL"))
def _(spark, d):
    return devices.activity(inventory(spark, d).folded)


GOOD = "conclusion NOT IN ('', 'failed', 'unknown')"


@query("a09_services", oracle.gold(f"SELECT ip, key::INT AS port, arg_min(value, seq) AS proto, coalesce(arg_max(conclusion, seq) FILTER (WHERE {GOOD}), '') AS app_proto, count(*) AS hits FROM f WHERE fact = 'service' GROUP BY ip, key"))
def _(spark, d):
    return devices.services(inventory(spark, d).folded)


SETS = oracle.sets("user:users", "ot:ot_identifiers", "ja3:ja3", "ja4:ja4", "protocol:protocols", "share:shares", "external:external_dsts")


@query("a10_sets", oracle.gold(f"SELECT f.ip, {SETS}, coalesce(any_value(hostnames), '') AS hostnames, coalesce(any_value(h.hostname), '') AS hostname, coalesce((SELECT string_agg(v::VARCHAR, ',' ORDER BY v) FROM (SELECT DISTINCT value::INT AS v FROM f g WHERE g.fact = 'vlan' AND g.ip = f.ip)), '') AS vlans FROM f LEFT JOIN h USING (ip) WHERE fact NOT IN ('finding', 'crossing') GROUP BY f.ip", oracle.HOSTS))
def _(spark, d):
    lists, found = ("users", "ot_identifiers", "ja3", "ja4", "protocols", "shares", "hostnames", "vlans"), inventory(spark, d)
    outside = devices.values(found.folded, "external").groupBy("ip").agg(text(F.array_sort(F.collect_list("value"))).alias("external_dsts"))
    rows = found.devices.select("ip", "hostname", *[text(F.col(c)).alias(c) for c in lists])
    return rows.join(outside, "ip", "left").fillna("", ["external_dsts"])


@query("a11_latest_values", oracle.gold("SELECT ip, " + ", ".join(oracle.LATEST.format(k) for k in ("mac", "model", "firmware", "serial")) + " FROM f WHERE fact NOT IN ('finding', 'crossing') GROUP BY ip"))
def _(spark, d):
    return inventory(spark, d).devices.select("ip", "mac", "model", "firmware", "serial")


@query("a12_counters", oracle.gold("SELECT ip, " + ", ".join(f"count(*) FILTER (WHERE fact = '{k}') AS {k}s" for k in ("file", "alert", "drop")) + ", count(*) FILTER (WHERE fact = 'anomaly') AS anomalies, count(*) FILTER (WHERE fact = 'cert') AS certs FROM f WHERE fact NOT IN ('finding', 'crossing') GROUP BY ip"))
def _(spark, d):
    return inventory(spark, d).devices.select("ip", "files", "alerts", "drops", "anomalies", F.col("cert_sightings").alias("certs"))


@query("a13_findings", FI("SELECT device, kind, severity, count, first_seq FROM fi"))
def _(spark, d):
    return inventory(spark, d).findings.select("device", "kind", "severity", "count", "first_seq")


@query("a14_identities", oracle.gold("SELECT value AS \"user\", string_agg(DISTINCT ip, ',' ORDER BY ip) AS devices, count(DISTINCT ip)::INT AS n FROM f WHERE fact = 'user' GROUP BY value"))
def _(spark, d):
    return inventory(spark, d).identities.select("user", text(F.array_sort("devices")).alias("devices"), "n")


@query("a15_extent", f"SELECT {sql_moment('min(ts)')} AS first_event, {sql_moment('max(ts)')} AS last_event, count(*) AS events FROM events")
def _(spark, d):
    return inventory(spark, d).extent.select(moment(F.col("first_event")).alias("first_event"), moment(F.col("last_event")).alias("last_event"), "events")


@query("a16_sensor_health", f"{BASE}, {oracle.STATS} SELECT coalesce(arg_max(up, seq), 0) AS uptime, coalesce(arg_max(captured, seq), 0) AS captured, coalesce(arg_max(dropped, seq), 0) AS dropped, count(*) > 0 AS reported, round(coalesce(100.0::DOUBLE * arg_max(dropped, seq) / nullif(arg_max(captured, seq), 0), 0), 6) AS loss FROM st")
def _(spark, d):
    return inventory(spark, d).sensor_health.withColumn("loss", rounded("loss"))


DEVICE_SQL = f"""dv AS (
  SELECT f.ip, {', '.join(oracle.LATEST.format(k) for k in ('mac', 'model', 'firmware', 'serial'))}, {SETS},
    coalesce(any_value(h.hostname), '') AS hostname, min(ts) FILTER (WHERE fact = 'seen') AS first_seen, max(ts) FILTER (WHERE fact = 'seen') AS last_seen,
    coalesce((SELECT string_agg(v::VARCHAR, ', ' ORDER BY v) FROM (SELECT DISTINCT value::INT AS v FROM f g WHERE g.fact = 'vlan' AND g.ip = f.ip)), '') AS vlans,
    coalesce((SELECT string_agg(v::VARCHAR, ', ' ORDER BY v) FROM (SELECT DISTINCT key::INT AS v FROM f g WHERE g.fact = 'service' AND g.ip = f.ip)), '') AS ports
  FROM f LEFT JOIN h USING (ip) WHERE fact NOT IN ('finding', 'crossing') GROUP BY f.ip
), dw AS (
  SELECT dv.*, coalesce(class, '') AS class, round(coalesce(confidence, 0), 12) AS confidence, coalesce(os, '') AS os, coalesce(vendor, '') AS vendor,
    mac <> '' AND coalesce((('0x' || substr(nullif(mac, ''), 1, 2))::INT & 2) <> 0, false) AS random
  FROM dv LEFT JOIN wi USING (ip)
), dx AS (
  SELECT *, CASE WHEN mac <> '' AND NOT random THEN 'mac:' || mac ELSE 'ip:' || ip END AS key,
    CASE WHEN hostname <> '' THEN hostname WHEN vendor <> '' AND class <> '' THEN vendor || ' ' || class WHEN vendor <> '' THEN vendor WHEN class <> '' THEN class ELSE ip END AS label,
    concat_ws('  ', ip, nullif(mac, ''), nullif(vendor, ''), nullif(os, ''), 'ports ' || nullif(ports, '')) AS detail,
    list_transform(string_split(ip, '.'), lambda x: x::INT) AS ipn
  FROM dw
)"""


def devices_sql(select: str, where: str = "true") -> str:
    return oracle.gold(select, f"{oracle.HOSTS}, {DEVICE_SQL}").replace("FROM events)", f"FROM events WHERE {where})")


KNOWN = "class <> '' OR vendor <> '' OR os <> '' OR model <> ''"


@query("a17_class_shares", devices_sql(f"SELECT class, n, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS percent FROM (SELECT CASE WHEN {KNOWN} THEN class ELSE 'unknown' END AS class, count(*) AS n FROM dx GROUP BY 1)"))
def _(spark, d):
    return reports.class_counts(inventory(spark, d).devices).withColumn("percent", rounded("percent"))


@query("a18_summary", devices_sql(f"SELECT count(*) AS devices, count(*) FILTER (WHERE {KNOWN}) AS identified, count(*) FILTER (WHERE hostname <> '') AS named, count(*) FILTER (WHERE users <> '') AS with_users FROM dx"))
def _(spark, d):
    return reports.summary(inventory(spark, d).devices)


HOURS = """ac AS (SELECT ip, floor(epoch(ts) / 3600)::BIGINT AS hour, count(*) AS n FROM f WHERE fact = 'seen' GROUP BY ALL),
ex AS (SELECT floor(epoch(min(ts)) / 3600)::BIGINT AS low, floor(epoch(max(ts)) / 3600)::BIGINT AS high FROM e),
sc AS (SELECT low, high, min(s) AS step FROM ex, (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024]) AS s) WHERE (high - low + 1) // s <= 90 GROUP BY ALL),
sz AS (SELECT *, (high - low + 1 + step - 1) // step AS bars FROM sc)"""


@query("a19_timeline", oracle.gold("SELECT bar, hour, n, round(CASE WHEN max(n) OVER () > 0 THEN sqrt(n / max(n) OVER ()) * 100 ELSE 0 END, 6) AS height FROM (SELECT i AS bar, low + i * step AS hour, coalesce((SELECT sum(n) FROM ac WHERE (hour - low) // step = i), 0)::BIGINT AS n FROM (SELECT *, unnest(range(0, bars)) AS i FROM sz))", HOURS))
def _(spark, d):
    found = inventory(spark, d)
    return reports.timeline(devices.activity(found.folded), found.extent).select("bar", "hour", "n", rounded("height").alias("height"))


BUCKETS = """bk AS (SELECT ip, bars, (hour - low) // step AS bar, sum(n) AS n FROM ac, sz GROUP BY ALL),
bs AS (
  SELECT p.ip, string_agg(CASE WHEN b.n IS NULL THEN '0' WHEN peak <= 1 THEN '9' ELSE (1 + floor((b.n - 1) / peak * 8))::INT::VARCHAR END, '' ORDER BY i) AS buckets
  FROM (SELECT ip, peak, unnest(range(0, bars)) AS i FROM (SELECT ip, bars, max(n) AS peak FROM bk GROUP BY ALL)) p LEFT JOIN bk b ON b.ip = p.ip AND b.bar = i GROUP BY p.ip
)"""


@query("a20_bucket_strings", oracle.gold("SELECT * FROM bs", f"{HOURS}, {BUCKETS}"))
def _(spark, d):
    found = inventory(spark, d)
    return reports.bucket_strings(devices.activity(found.folded), found.extent)


@query("a21_sparklines", oracle.gold("""SELECT p.ip, string_agg(format('{:.2f}', i * (100.0::DOUBLE / (p.points - 1))) || ',' || format('{:.2f}', 19 - sqrt(coalesce(b.n, 0) / peak) * 18), ' ' ORDER BY i) AS spark
  FROM (SELECT *, unnest(range(0, points)) AS i FROM (SELECT ip, points, max(n)::DOUBLE AS peak FROM sp GROUP BY ALL)) p LEFT JOIN sp b ON b.ip = p.ip AND b.point = i GROUP BY p.ip""", f"""{HOURS}, sw AS (SELECT low, least(60, high - low + 1) AS points, greatest(1, (high - low + 1) // least(60, high - low + 1)) AS wide FROM ex),
sp AS (SELECT ip, points, (hour - low) // wide AS point, sum(n)::DOUBLE AS n FROM ac, sw WHERE (hour - low) // wide < points GROUP BY ALL)"""))
def _(spark, d):
    found = inventory(spark, d)
    return reports.sparklines(devices.activity(found.folded), found.extent)


@query("a22_external_counts", oracle.gold("SELECT ip, count(DISTINCT value)::INT AS n FROM f WHERE fact = 'external' GROUP BY ip"))
def _(spark, d):
    return devices.external_counts(inventory(spark, d).folded).select("ip", F.col("n").cast("int").alias("n"))


SHOWN = f"""{HOURS}, {BUCKETS}, sh AS (
  SELECT ip, buckets, list_sum(list_transform(string_split(buckets[11:31], ''), lambda c: c::INT)) AS shown, list_sum(list_transform(string_split(buckets, ''), lambda c: c::INT)) AS whole FROM bs
), vs AS (SELECT sh.*, tot FROM sh JOIN (SELECT ip, sum(n) AS tot FROM ac GROUP BY ip) USING (ip) WHERE shown > 0)"""


def shown(spark: SparkSession, d: str) -> DataFrame:
    found = inventory(spark, d)
    return reports.visible(found.devices, reports.bucket_strings(devices.activity(found.folded), found.extent), 10, 30)


@query("a23_talkers", oracle.gold("SELECT ip, CASE WHEN shown = whole THEN tot ELSE floor(tot * shown / whole + 0.5) END::BIGINT AS volume FROM vs ORDER BY volume DESC, list_transform(string_split(ip, '.'), lambda x: x::INT) LIMIT 6", SHOWN))
def _(spark, d):
    return reports.talkers(shown(spark, d))


@query("w03_protocols_shown", oracle.gold("SELECT value, count(DISTINCT f.ip) AS n FROM f JOIN vs USING (ip) WHERE fact = 'protocol' GROUP BY value ORDER BY n DESC, value LIMIT 6", SHOWN))
def _(spark, d):
    return reports.most_common(shown(spark, d), "protocols")


@query("w03_users_shown", oracle.gold("SELECT value, count(DISTINCT f.ip) AS n FROM f JOIN vs USING (ip) WHERE fact = 'user' GROUP BY value ORDER BY n DESC, value LIMIT 6", SHOWN))
def _(spark, d):
    return reports.most_common(shown(spark, d), "users")


@query("w01_visible_devices", oracle.gold("SELECT ip, shown::INT AS shown, whole::INT AS whole FROM vs", SHOWN))
def _(spark, d):
    return shown(spark, d).select("ip", "shown", "whole")


@query("w02_visible_summary", oracle.gold(f"SELECT count(*) AS devices, count(*) FILTER (WHERE {KNOWN}) AS identified, count(*) FILTER (WHERE hostname <> '') AS named, count(*) FILTER (WHERE users <> '') AS with_users FROM dx JOIN vs USING (ip)", f"{oracle.HOSTS}, {DEVICE_SQL}, {SHOWN}"))
def _(spark, d):
    return reports.summary(shown(spark, d))


@query("w05_findings_held", oracle.gold("SELECT severity, count(*) AS n FROM fi WHERE device = 'sensor' OR device IN (SELECT ip FROM vs) GROUP BY severity", f"{oracle.FINDINGS}, {SHOWN}"))
def _(spark, d):
    return reports.findings_shown(inventory(spark, d).findings, shown(spark, d).select("ip")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("w03_severities_shown", oracle.gold("SELECT severity, count(*) AS n FROM (SELECT device, arg_min(severity, list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'], severity)) AS severity FROM fi WHERE device IN (SELECT ip FROM vs) GROUP BY device) GROUP BY severity", f"{oracle.FINDINGS}, {SHOWN}"))
def _(spark, d):
    return reports.severities(shown(spark, d), inventory(spark, d).findings)


@query("w03_classes_shown", oracle.gold(f"SELECT CASE WHEN {KNOWN} THEN class ELSE 'unknown' END AS class, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM dx JOIN vs USING (ip) GROUP BY 1", f"{oracle.HOSTS}, {DEVICE_SQL}, {SHOWN}"))
def _(spark, d):
    return reports.class_counts(shown(spark, d)).withColumn("percent", rounded("percent"))


@query("w05_held_critical", oracle.gold("SELECT count(*) AS held, count(*) FILTER (WHERE severity = 'CRITICAL') AS held_critical FROM fi WHERE device <> 'sensor' AND device NOT IN (SELECT ip FROM vs)", f"{oracle.FINDINGS}, {SHOWN}"))
def _(spark, d):
    return reports.findings_held(inventory(spark, d).findings, shown(spark, d).select("ip"))


@query("w06_presets", f"WITH h AS (SELECT floor(epoch(max(ts)) / 3600)::BIGINT - floor(epoch(min(ts)) / 3600)::BIGINT + 1 AS n FROM events) SELECT p::INT AS hours, coalesce(lag(p) OVER (ORDER BY p) < n, true) AS offered FROM h, (SELECT unnest([24, 72, 168, 336, 720]) AS p)")
def _(spark, d):
    return reports.presets(inventory(spark, d).extent)


@query("j12_findings_alive", FI("SELECT device, kind, count FROM fi WHERE device = 'sensor' OR device IN (SELECT ip FROM f WHERE fact = 'seen' GROUP BY ip HAVING max(ts) >= TIMESTAMP '2024-01-12 06:30:00')"))
def _(spark, d):
    found = inventory(spark, d)
    return reports.findings_alive(found.findings, found.devices, UNTIL).select("device", "kind", "count")


@query("p02_last_span", f"{BASE} SELECT t AS event_type, count(*) AS n FROM e WHERE ts BETWEEN TIMESTAMP '2024-01-10 18:30:00' AND TIMESTAMP '2024-01-12 06:30:00' GROUP BY t")
def _(spark, d):
    return devices.event_counts(events.in_window(inventory(spark, d).events, *events.window(UNTIL, last="36h")))


@query("p02_since_until", f"{BASE} SELECT t AS event_type, count(*) AS n FROM e WHERE ts >= TIMESTAMP '2024-01-10 09:00:00' AND ts < TIMESTAMP '2024-01-13' GROUP BY t")
def _(spark, d):
    return devices.event_counts(events.in_window(inventory(spark, d).events, *events.window(NOW, since="2024-01-10T09:00", until="2024-01-12")))


@query("o03_snapshot_in_order", devices_sql("SELECT row_number() OVER (ORDER BY ipn) AS place, ip FROM dx"))
def _(spark, d):
    return ordering.with_place(snapshot.exported(inventory(spark, d).devices).select("ip"), net.ip_key(F.col("ip")))


@query("o05_identities_in_order", oracle.gold("SELECT row_number() OVER (ORDER BY count(DISTINCT ip) DESC, value) AS place, value AS \"user\" FROM f WHERE fact = 'user' GROUP BY value"))
def _(spark, d):
    return ordering.with_place(inventory(spark, d).identities, F.desc("n"), F.col("user")).select("place", "user")


@query("o07_classes_in_order", devices_sql(f"SELECT row_number() OVER (ORDER BY count(*) DESC, CASE WHEN {KNOWN} THEN class ELSE 'unknown' END) AS place, CASE WHEN {KNOWN} THEN class ELSE 'unknown' END AS class FROM dx GROUP BY 2"))
def _(spark, d):
    return ordering.with_place(reports.class_counts(inventory(spark, d).devices), F.desc("n"), F.col("class")).select("place", "class")


@query("r25_service_lists", oracle.gold("""SELECT ip, array_to_string(list_transform(s[1:8], lambda x: x.port || CASE WHEN x.app <> '' THEN '/' || x.app ELSE '' END), ', ') || CASE WHEN len(s) > 8 THEN ' +' || (len(s) - 8) || ' more' ELSE '' END AS services
FROM (SELECT ip, list({'port': port, 'app': app} ORDER BY port) AS s FROM (
  SELECT ip, key::INT AS port, coalesce(arg_max(conclusion, seq) FILTER (WHERE conclusion NOT IN ('', 'failed', 'unknown')), '') AS app FROM f WHERE fact = 'service' GROUP BY ALL) GROUP BY ip)"""))
def _(spark, d):
    return inventory(spark, d).devices.where(F.size("services") > 0).select("ip", snapshot.services(F.col("services")).alias("services"))


@query("p10_search", devices_sql("SELECT ip FROM dx WHERE contains(lower(concat_ws(' ', ip, hostname, vendor, os, class, model, firmware, serial, replace(ot_identifiers, ',', ' '), replace(users, ',', ' '))), 'siemens')"))
def _(spark, d):
    return reports.search(inventory(spark, d).devices, "Siemens").select("ip")


@query("p07_confident_devices", devices_sql("SELECT ip, round(confidence, 6) AS confidence FROM dx WHERE confidence >= 0.9"))
def _(spark, d):
    return inventory(spark, d).devices.where("confidence >= 0.9").select("ip", rounded("confidence").alias("confidence"))


@query("o01_devices_in_order", devices_sql("SELECT row_number() OVER (ORDER BY round(confidence, 6) DESC, ipn) AS place, ip FROM dx"))
def _(spark, d):
    rows = inventory(spark, d).devices.withColumn("confidence", rounded("confidence"))
    return ordering.with_place(rows.select("ip", "confidence"), F.desc("confidence"), net.ip_key(F.col("ip"))).select("place", "ip")


@query("o02_findings_in_order", FI(f"SELECT row_number() OVER (ORDER BY {RANK} DESC, device = 'sensor', CASE WHEN device <> 'sensor' THEN list_transform(string_split(device, '.'), lambda x: x::INT) END, first_seq, kind) AS place, device, kind FROM fi"))
def _(spark, d):
    return ordering.with_place(inventory(spark, d).findings, F.desc("severity_rank"), net.ip_key(F.col("device")), F.col("first_seq"), F.col("kind")).select("place", "device", "kind")


@query("sk02_snapshot_devices", devices_sql(f"SELECT ip, mac, random AS random_mac, hostname, class, floor(confidence * 1000 + 0.5) / 1000 AS confidence, vendor, os, model, firmware, serial, ports, replace(protocols, ',', ', ') AS protocols, replace(users, ',', ', ') AS users, {sql_moment('first_seen')} AS first_seen FROM dx"))
def _(spark, d):
    rows = snapshot.exported(inventory(spark, d).devices)
    joined = lambda c: F.array_join(c, ", ")
    ports = joined(F.transform("services", lambda s: s["port"].cast("string")))
    return rows.select("ip", "mac", "random_mac", "hostname", "class", "confidence", "vendor", "os", "model", "firmware", "serial", ports.alias("ports"), joined("protocols").alias("protocols"), joined("users").alias("users"), moment(F.col("first_seen")).alias("first_seen"))


NAMED = "concat_ws(' · ', nullif(vendor, ''), nullif(model, ''), nullif(class, ''), nullif(os, ''))"


@query("sk03_netbox", devices_sql(f"SELECT ip || '/32' AS address, 'active' AS status, regexp_replace(regexp_replace(lower(trim(hostname)), '[^a-z0-9._-]', '', 'g'), '^[.-]+|[.-]+$', '', 'g') AS dns_name, CASE WHEN {NAMED} = '' THEN 'unidentified device' ELSE {NAMED} END || ' (passive inventory, ' || floor(confidence * 100)::INT || '% confidence)' AS description FROM dx"))
def _(spark, d):
    return snapshot.netbox(inventory(spark, d).devices).drop("comments")


COMMENTS = """'Found by listening to the network; not checked by a scan.' || chr(10) || chr(10) || concat_ws(chr(10),
  CASE WHEN mac <> '' THEN '- MAC: `' || mac || '`' || CASE WHEN random THEN ' (random, no lasting identity)' ELSE '' END END,
  '- Firmware: ' || nullif(firmware, ''), '- Serial: ' || nullif(serial, ''), '- VLANs: ' || nullif(vlans, ''), '- Open ports: ' || nullif(ports, ''),
  '- Protocols: ' || nullif(replace(protocols, ',', ', '), ''), '- OT identifiers: ' || nullif(replace(ot_identifiers, ',', ', '), ''),
  '- First seen: ' || strftime(first_seen, '%Y-%m-%d %H:%M') || ' UTC', '- Last seen: ' || strftime(last_seen, '%Y-%m-%d %H:%M') || ' UTC')"""


@query("r23_netbox_comments", devices_sql(f"SELECT ip || '/32' AS address, {COMMENTS} AS comments FROM dx"))
def _(spark, d):
    return snapshot.netbox(inventory(spark, d).devices).select("address", "comments")


HALF = "event_id <= (SELECT max(event_id) // 2 FROM events)"
OLD = f"({devices_sql('SELECT * FROM dx', HALF.replace('FROM events)', 'FROM events )'))})"
NEW = f"({devices_sql('SELECT * FROM dx')})"
KEYED = "SELECT key, arg_max(x, x.ipn) AS x FROM (SELECT x.key AS key, x FROM {} x) GROUP BY key"


@query("d01_appeared", f"SELECT n.key, n.ip, n.label, n.detail FROM {NEW} n WHERE n.key NOT IN (SELECT key FROM {OLD} o)")
def _(spark, d):
    first, whole = halves(spark, d)
    return snapshot.appeared(first.devices, whole.devices)


@query("d01_disappeared", f"SELECT o.key, o.ip, o.label, o.detail FROM {OLD} o WHERE o.key NOT IN (SELECT key FROM {NEW} n)")
def _(spark, d):
    first, whole = halves(spark, d)
    return snapshot.appeared(whole.devices, first.devices)


PAIRS = f"WITH a AS ({KEYED.format(OLD)}), b AS ({KEYED.format(NEW)}), ab AS (SELECT key, a.x AS o, b.x AS n FROM a JOIN b USING (key))"
CHANGES = " UNION ALL ".join(
    [f"SELECT key, '{c}' AS field, o.{c} AS \"from\", n.{c} AS \"to\" FROM ab WHERE o.{c} <> n.{c}" for c in snapshot.SCALARS]
    + [f"SELECT key, '{name}', {a}, {b} FROM (SELECT key, coalesce(array_to_string(list_sort(list_filter(string_split({x}.{c}, '{sep}'), lambda v: v <> '' AND NOT list_contains(string_split({y}.{c}, '{sep}'), v)){cast}), ', '), '') AS m FROM ab) WHERE m <> ''"
       for name, c, sep, x, y, a, b, cast in (
           ("new services", "ports", ", ", "n", "o", "''", "m", "::INT[]"), ("services gone", "ports", ", ", "o", "n", "m", "''", "::INT[]"), ("new VLANs", "vlans", ", ", "n", "o", "''", "m", "::INT[]"),
           ("new protocols", "protocols", ",", "n", "o", "''", "m", ""), ("new users", "users", ",", "n", "o", "''", "m", ""), ("new shares", "shares", ",", "n", "o", "''", "m", ""), ("new OT identifiers", "ot_identifiers", ",", "n", "o", "''", "m", ""),
       )]
)


@query("d02_changed_fields", f"{PAIRS} {CHANGES}")
def _(spark, d):
    first, whole = halves(spark, d)
    rows = snapshot.changed(first.devices, whole.devices).select("key", F.explode("fields").alias("f"))
    return rows.select("key", "f.field", F.col("f.from").alias("from"), F.col("f.to").alias("to"))


OLD_FINDINGS = FI("SELECT device, kind FROM fi").replace("FROM events)", f"FROM events WHERE {HALF})")


@query("d05_new_findings", f"SELECT device, kind FROM ({FI('SELECT device, kind FROM fi')}) EXCEPT SELECT device, kind FROM ({OLD_FINDINGS})")
def _(spark, d):
    first, whole = halves(spark, d)
    return snapshot.findings_only_in(whole.findings, first.findings).select("device", "kind")


@query("d05_fixed_findings", f"SELECT device, kind FROM ({OLD_FINDINGS}) EXCEPT SELECT device, kind FROM ({FI('SELECT device, kind FROM fi')})")
def _(spark, d):
    first, whole = halves(spark, d)
    return snapshot.findings_only_in(first.findings, whole.findings).select("device", "kind")


@query("o06_appeared_in_order", f"SELECT row_number() OVER (ORDER BY ipn, key) AS place, ip, label FROM (SELECT n.ipn, n.key, n.ip, n.label FROM {NEW} n WHERE n.key NOT IN (SELECT key FROM {OLD} o))")
def _(spark, d):
    first, whole = halves(spark, d)
    return ordering.with_place(snapshot.appeared(first.devices, whole.devices), net.ip_key(F.col("ip")), F.col("key")).select("place", "ip", "label")


TOTALS = f"""WITH o AS MATERIALIZED {OLD}, n AS MATERIALIZED {NEW}, fo AS MATERIALIZED ({OLD_FINDINGS}), fn AS MATERIALIZED ({FI('SELECT device, kind FROM fi')}),
a AS ({KEYED.format('o')}), b AS ({KEYED.format('n')}), ab AS MATERIALIZED (SELECT key, a.x AS o, b.x AS n FROM a JOIN b USING (key)),
t AS (SELECT (SELECT count(*) FROM n WHERE key NOT IN (SELECT key FROM o)) AS appeared, (SELECT count(*) FROM o WHERE key NOT IN (SELECT key FROM n)) AS disappeared,
  (SELECT count(DISTINCT key) FROM ({CHANGES})) AS changed, (SELECT count(*) FROM (SELECT * FROM fn EXCEPT SELECT * FROM fo)) AS new_findings, (SELECT count(*) FROM (SELECT * FROM fo EXCEPT SELECT * FROM fn)) AS fixed_findings)
SELECT *, appeared + disappeared + changed + new_findings + fixed_findings AS total FROM t"""


@query("d06_totals", TOTALS)
def _(spark, d):
    first, whole = halves(spark, d)
    return snapshot.totals(first.devices, whole.devices, first.findings, whole.findings)


@query("r13_hostnames", r"SELECT page_id, CASE WHEN n NOT IN ('', '*') AND NOT regexp_matches(n, '[ \t]') THEN lower(n) END AS hostname FROM (SELECT page_id, regexp_replace('.' || regexp_extract(url, '://([^/]*)', 1) || CASE WHEN page_id % 5 = 0 THEN ' x. ' ELSE '. ' END, '^[. ]+|[. ]+$', '', 'g') AS n FROM pages)")
def _(spark, d):
    host = F.concat(F.lit("."), F.regexp_extract("url", "://([^/]*)", 1), F.when(F.col("page_id") % 5 == 0, F.lit(" x. ")).otherwise(F.lit(". ")))
    return table(spark, d, "pages").select("page_id", names.hostname(host).alias("hostname"))


@query("r15_common_names", "SELECT c_custkey, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, '' FROM customer WHERE c_custkey % 2 = 1")
def _(spark, d):
    subject = F.concat(F.lit("O=x, "), F.when(F.col("c_custkey") % 2 == 0, F.lit("cn=")).otherwise(F.lit("ou=")), "c_name")
    return table(spark, d, "customer").select("c_custkey", names.common_name(subject).alias("name"))


@query("r16_first_words", r"SELECT p_partkey, regexp_extract(p_name, '^([^ \t,;]*)', 1) AS word FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", names.first_word(F.col("p_name")).alias("word"))


def _print(sql: bool) -> str:
    """A made-up fingerprint of each row of lineitem, some of them malformed."""
    return "['t', 'q', 'd', 'x'][(l_linenumber % 4 + 1)::INT] || ['13', '12', '10', 's3', 'd1', '99'][(l_partkey % 6 + 1)::INT] || ['d', 'i', 'z'][(l_suppkey % 3 + 1)::INT] || lpad((l_quantity::INT)::VARCHAR, 2, '0') || lpad((l_orderkey % 100)::VARCHAR, 2, '0') || ['h2', 'dt', '00', 'zz'][(l_orderkey % 4 + 1)::INT] || '_a_b'"


@query("r18_ja4_fields", f"WITH l AS (SELECT l_orderkey, l_linenumber, {_print(True)} AS j FROM lineitem), o AS (SELECT *, j[1] <> 'x' AND j[2:3] <> '99' AND j[4] <> 'z' AS ok FROM l) SELECT l_orderkey, l_linenumber, ok, CASE WHEN NOT ok THEN '' ELSE map {{'t': 'TCP', 'q': 'QUIC', 'd': 'DTLS'}}[j[1]] END AS transport, ok AND j[2:3] IN ('10', 's3', 'd1') AS obsolete, ok AND j[4] = 'd' AS sni, CASE WHEN ok THEN j[5:6]::INT ELSE 0 END AS ciphers, CASE WHEN ok THEN j[7:8]::INT ELSE 0 END AS extensions, CASE WHEN NOT ok THEN '' ELSE coalesce(map {{'h2': 'HTTP/2', 'dt': 'DNS-over-TLS', '00': ''}}[j[9:10]], j[9:10]) END AS alpn FROM o")
def _(spark, d):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    print_ = F.concat(pick("tqdx", F.col("l_linenumber") % 4), pick(("13", "12", "10", "s3", "d1", "99"), F.col("l_partkey") % 6), pick("diz", F.col("l_suppkey") % 3), two(F.col("l_quantity")), two(F.col("l_orderkey") % 100), pick(("h2", "dt", "00", "zz"), F.col("l_orderkey") % 4), F.lit("_a_b"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ja4.decode(print_).alias("j"))
    return rows.select("l_orderkey", "l_linenumber", *[F.col(f"j.{c}").alias(c) for c in ("ok", "transport", "obsolete", "sni", "ciphers", "extensions", "alpn")])


@query("r20_certificate_ends", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' WHEN 1 THEN strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS ends FROM orders")
def _(spark, d):
    kind, day = F.col("o_orderkey") % 5, F.col("o_orderdate")
    said = F.when(kind == 4, F.lit("soon")).when(kind == 3, F.date_format(day, "yyyy-MM-dd")).when(kind == 2, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(kind == 1, F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(findings.certificate_end(said), "yyyy-MM-dd HH:mm:ss").alias("ends"))


@query("r17_addresses_in_order", devices_sql("SELECT row_number() OVER (ORDER BY ipn) AS place, ip FROM dx"))
def _(spark, d):
    return ordering.with_place(inventory(spark, d).devices.select("ip"), net.ip_key(F.col("ip")))


@query("r21_keys_and_labels", devices_sql("SELECT ip, key, label, detail FROM dx"))
def _(spark, d):
    rows = inventory(spark, d).devices
    return rows.select("ip", snapshot.key(F.col("mac"), F.col("random_mac"), F.col("ip")).alias("key"), snapshot.label().alias("label"), snapshot.describe().alias("detail"))


@query("f_certificates", oracle.gold("SELECT * FROM cf", oracle.CERT_FINDINGS))
def _(spark, d):
    return findings.certificate_findings(inventory(spark, d).facts, NOW).select("seq", "ip", "key", "value", "conclusion")


@query("f22_sensor_loss", f"{BASE}, {oracle.STATS} SELECT seq FROM st WHERE captured > 0 AND 100.0 * dropped / captured > 1")
def _(spark, d):
    return findings.sensor_findings(inventory(spark, d).events).select("seq")


#: Kinds of findings by the inventory's numbers.
FINDING_KINDS = (
    "end-of-life-os", "obsolete-ssl", "weak-tls", "self-signed-cert", "cert-expired", "cert-expiring", "client-obsolete-tls", "segmentation-", "dns-over-https", "ssh-v1", "default-snmp-community",
    "snmp-v1v2", "vnc-no-auth", "smbv1", "weak-kerberos", "cleartext-credentials", "tftp-in-use", "executable-transfer", "ot-exposed", "high-severity-alert", "p2p", "sensor-packet-loss",
)
for _n, _kind in enumerate(FINDING_KINDS, 1):
    query(f"f{_n:02d}_{_kind.strip('-').replace('-', '_')}", FI(f"SELECT device, kind, severity, seen, count FROM fi WHERE starts_with(kind, '{_kind}')"))(
        lambda spark, d, kind=_kind: findings.grouped(inventory(spark, d).raw_findings.where(F.col("key").startswith(kind))).select("device", "kind", F.col("f.conclusion").alias("severity"), F.col("f.value").alias("seen"), "count")
    )
RULE_TABLES = ("vendor_class", "dhcp_vendor_class", "dhcp_vendor_class_secondary", "user_agent", "user_agent_class", "ssh_banner", "server_banner", "hostname_prefix")


def rule_hits(spark: SparkSession, d: str, name: str) -> DataFrame:
    """How many of the pages each rule of a table is found in."""
    pages = table(spark, d, "pages").select("page_id", F.lower("html").alias("lower"), F.lit(name).alias("rule_table"))
    hits = evidence.containing(pages, rules.text_rules(spark).where(F.col("rule_table") == name), ["page_id"])
    return hits.groupBy("rule", "match", "conclusion").agg(F.count(F.lit(1)).alias("n"))


for _n, _table in enumerate(RULE_TABLES, 1):
    query(f"r{_n:02d}_{_table}", f"WITH {oracle._rule_ctes()} SELECT rule, match, concluded AS conclusion, count(*) AS n FROM pages JOIN rt ON contains(lower(html), match) WHERE rule_table = '{_table}' GROUP BY ALL")(lambda spark, d, name=_table: rule_hits(spark, d, name))


@query("st03_retained_facts", oracle.gold("SELECT f.ip, fact, count(*) AS n FROM f JOIN (SELECT ip FROM f WHERE fact = 'seen' GROUP BY ip HAVING max(ts) >= TIMESTAMP '2024-01-30') USING (ip) WHERE NOT (fact = 'seen' AND ts < TIMESTAMP '2024-01-30') GROUP BY f.ip, fact"))
def _(spark, d):
    kept = fold.retained(inventory(spark, d).folded, dt.datetime(2024, 1, 30, tzinfo=dt.UTC)).where("fact <> 'since'")
    return kept.groupBy("ip", "fact").agg(F.sum("n").alias("n"))


FORMS = "[' Co., Ltd.', ' Inc.', ' GmbH', ', LLC', '', ' Corporation Ltd', ' Private']"


@query("x02_vendor_names", f"SELECT s_suppkey, regexp_replace(s_name || {FORMS}[(s_suppkey % 6 + 1)::INT], '( Co., Ltd.| Inc.| GmbH|, LLC| Corporation Ltd)$', '') AS vendor FROM supplier")
def _(spark, d):
    forms = (" Co., Ltd.", " Inc.", " GmbH", ", LLC", "", " Corporation Ltd")
    name = F.concat("s_name", F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("s_suppkey") % 6 + 1).cast("int")))
    return table(spark, d, "supplier").select("s_suppkey", names.clean_vendor(name).alias("vendor"))


@query("x01_registry_merge", "SELECT prefix, arg_max(vendor, o) AS vendor FROM (SELECT lpad(format('{:X}', s_suppkey % 37), 6, '0') AS prefix, s_name AS vendor, s_suppkey AS o FROM supplier) GROUP BY prefix")
def _(spark, d):
    rows = table(spark, d, "supplier").select(F.lpad(F.hex(F.col("s_suppkey") % 37), 6, "0").alias("assignment"), F.concat("s_name", F.lit(" Inc.")).alias("organization"), F.col("s_suppkey").alias("order"))
    authority = rows.withColumns({"organization": F.lit("IEEE Registration Authority"), "order": F.lit(10**9).cast("long")})
    return registry.prefixes(rows.unionByName(authority))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""The device table: one row an address, every attribute a mergeable aggregate of its facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions import names, net
from netquarry.operators.fold import COMMON, counted

#: Facts that don't make an address a device.
OTHERS = ("finding", "crossing", *COMMON)
CERT = "subject string, issuer string, not_after string, version string"


def _set(kind: str, value: Column | None = None) -> Column:
    return F.array_sort(F.collect_set(F.when(F.col("fact") == kind, F.col("value") if value is None else value)))


def _latest(kind: str) -> Column:
    """The newest value: by time, then arrival; values without a time only count if no other has one."""
    is_it = F.col("fact") == kind
    return F.coalesce(F.max_by(F.when(is_it, F.col("value")), F.when(is_it, F.col("last"))), F.lit(""))


def _number(kind: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("fact") == kind, F.col("n"))), F.lit(0))


def services(facts: DataFrame) -> DataFrame:
    """ip, port, proto (the first to arrive), app_proto (the last good one to arrive), hits."""
    rows = counted(facts).where("fact = 'service'").select("ip", "first_seq", "last_seq", "n", F.col("key").cast("int").alias("port"), F.col("value").alias("proto"), F.col("conclusion").alias("app"))
    good = ~F.col("app").isin("", "failed", "unknown")
    return rows.groupBy("ip", "port").agg(F.min_by("proto", "first_seq").alias("proto"), F.coalesce(F.max_by(F.when(good, F.col("app")), F.when(good, F.col("last_seq"))), F.lit("")).alias("app_proto"), F.sum("n").alias("hits"))


def activity(facts: DataFrame) -> DataFrame:
    """ip, hour (since 1970), n: how often the device took part in each hour."""
    return counted(facts).where("fact = 'seen' AND hour IS NOT NULL").groupBy("ip", "hour").agg(F.sum("n").alias("n"))


def values(facts: DataFrame, *kinds: str) -> DataFrame:
    """ip, fact, value, n of facts of these kinds: what a device's sets hold, a row each, however many there are."""
    return counted(facts).where(F.col("fact").isin(*kinds)).groupBy("ip", "fact", "value").agg(F.sum("n").alias("n"))


def external_counts(facts: DataFrame) -> DataFrame:
    """ip, n: how many external destinations a device has; they are counted as rows, never gathered in one."""
    return values(facts, "external").groupBy("ip").agg(F.count(F.lit(1)).alias("n"))


def attributes(facts: DataFrame) -> DataFrame:
    """Everything of a device that is a plain aggregate of its facts."""
    seen = lambda c: F.when(F.col("fact").isin("seen", "since"), F.col(c))
    clean = names.hostname(F.col("value"))
    # as sets: a certificate is seen as often as there is traffic
    certs = F.array_sort(F.collect_set(F.when(F.col("fact") == "cert", F.col("value"))))
    return counted(facts).where(~F.col("fact").isin(*OTHERS, "external")).groupBy("ip").agg(
        _latest("mac").alias("mac"),
        _set("hostname", clean).alias("hostnames"),
        _set("user").alias("users"),
        _latest("model").alias("model"),
        _latest("firmware").alias("firmware"),
        _latest("serial").alias("serial"),
        _set("ot").alias("ot_identifiers"),
        _set("ja3").alias("ja3"),
        _set("ja4").alias("ja4"),
        _set("vlan", F.col("value").cast("int")).alias("vlans"),
        _set("protocol").alias("protocols"),
        F.transform(certs, lambda c: F.from_json(c, CERT)).alias("certs"),
        _number("cert").alias("cert_sightings"),
        _set("share").alias("shares"),
        _number("file").alias("files"),
        F.min(seen("first_ts")).alias("first_seen"),
        F.max(seen("last_ts")).alias("last_seen"),
        _number("alert").alias("alerts"),
        _number("drop").alias("drops"),
        _number("anomaly").alias("anomalies"),
    )


def devices(facts: DataFrame, evidence: DataFrame, winners: DataFrame) -> DataFrame:
    """The gold table; see attributes(), services(), activity() and operators.evidence for its columns."""
    served = services(facts).groupBy("ip").agg(F.array_sort(F.collect_list(F.struct("port", "proto", "app_proto", "hits"))).alias("services"))
    hours = activity(facts).groupBy("ip").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("hour", "n")))).alias("activity"))
    outside = external_counts(facts).withColumnRenamed("n", "external_dsts")
    proof = evidence.groupBy("ip").agg(F.array_sort(F.collect_list(F.struct("signal", "value", "conclusion", "weight"))).alias("evidence"))
    rows = attributes(facts).join(winners, "ip", "left").join(served, "ip", "left").join(hours, "ip", "left").join(outside, "ip", "left").join(proof, "ip", "left")
    empty = lambda kind: F.array().cast(kind)
    return rows.select(
        "ip", "mac", net.is_random_mac(F.col("mac")).alias("random_mac"), names.best_hostname(F.col("hostnames")).alias("hostname"), "hostnames", "users",
        F.coalesce("services", empty("array<struct<port:int,proto:string,app_proto:string,hits:bigint>>")).alias("services"),
        F.coalesce("vendor", F.lit("")).alias("vendor"), F.coalesce("class", F.lit("")).alias("class"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("os", F.lit("")).alias("os"),
        "model", "firmware", "serial", "ot_identifiers", "ja3", "ja4", "vlans", "protocols", "certs", "cert_sightings", "shares", "files", "first_seen", "last_seen",
        F.coalesce("activity", F.create_map().cast("map<bigint,bigint>")).alias("activity"), "alerts", "drops", "anomalies", F.coalesce("external_dsts", F.lit(0)).alias("external_dsts"),
        F.coalesce("evidence", empty("array<struct<signal:string,value:string,conclusion:string,weight:double>>")).alias("evidence"),
    )


def ordered(devices_: DataFrame) -> DataFrame:
    """Surest first, then by address."""
    return devices_.orderBy(F.desc("confidence"), net.ip_key(F.col("ip")))


def identities(facts: DataFrame) -> DataFrame:
    """user, devices (sorted), n of each account seen; most devices first when ordered by identities_ordered()."""
    rows = facts.where("fact = 'user'").select(F.col("value").alias("user"), net.ip_key(F.col("ip")).alias("k")).distinct()
    return rows.groupBy("user").agg(F.transform(F.array_sort(F.collect_list("k")), lambda k: k["text"]).alias("devices")).withColumn("n", F.size("devices"))


def identities_ordered(identities_: DataFrame) -> DataFrame:
    return identities_.orderBy(F.desc("n"), "user")


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def extent(events: DataFrame) -> DataFrame:
    """First and last time, and number, of the events."""
    return events.agg(F.min("ts").alias("first_event"), F.max("ts").alias("last_event"), F.count(F.lit(1)).alias("events"))

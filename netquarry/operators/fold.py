"""Facts folded by what they say: one row for all facts that say the same, which merges with others of its kind.

A folded row has how often the fact was seen, and its first and last place and time. Sums,
minima and maxima merge in any order and any grouping, so folded tables of parts of a log
are merged to that of the whole, and every gold table can be made of them. Facts of presence
are folded by the hour. A table grows with what is distinct, not with traffic.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["ip", "fact", "key", "value", "conclusion", "weight", "spec", "hour"]
#: Facts of which a device shows the newest.
LATEST = ("mac", "model", "firmware", "serial")
#: Facts that are no one device's: what events there were, and the sensor's counters.
COMMON = ("event", "stats")
STATS = "uptime bigint, captured bigint, dropped bigint"


def counted(facts: DataFrame) -> DataFrame:
    """Facts as folded rows, each by itself; folded ones as they are."""
    if "n" in facts.columns:
        return facts
    hour = F.when(F.col("fact") == "seen", F.floor(F.unix_timestamp("ts") / 3600)).alias("hour")
    last = F.when(F.col("fact").isin(*LATEST), F.struct("ts", "seq", "ord")).alias("last")
    return facts.select(*KEYS[:-1], hour, "ord", F.lit(1).cast("bigint").alias("n"), F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"), F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"), last)


def merged(rows: DataFrame) -> DataFrame:
    """Folded rows of any parts, as one row each; parts are combined before the shuffle."""
    plain = [F.min("ord").alias("ord"), F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")]
    newest, none = F.col("fact").isin(*LATEST), F.lit(None).cast(rows.schema["last"].dataType)
    # the order of the newest is a struct, whose maximum needs sorted rows: only those few facts are sorted
    return rows.where(~newest).groupBy(*KEYS).agg(*plain, none.alias("last")).unionByName(rows.where(newest).groupBy(*KEYS).agg(*plain, F.max("last").alias("last")))


def fold(facts: DataFrame) -> DataFrame:
    return merged(counted(facts))


def common(events: DataFrame) -> DataFrame:
    """Facts of COMMON: an event's type, and the counters of the sensor's own events."""
    fact = lambda kind, key, value: [F.lit("").alias("ip"), F.lit(kind).alias("fact"), key.alias("key"), value.alias("value"), F.lit("").alias("conclusion"), F.lit(0.0).alias("weight"), F.lit(1).alias("spec"), F.lit(0).alias("ord")]
    counters = F.to_json(F.struct(*[F.col(f"stats.{n}").alias(n) for n in ("uptime", "captured", "dropped")]))
    stats = events.where("event_type = 'stats'").select("seq", "ts", *fact("stats", F.col("seq").cast("string"), counters))
    return events.select("seq", "ts", *fact("event", F.coalesce("event_type", F.lit("")), F.lit(""))).unionByName(stats)


def event_counts(folded: DataFrame) -> DataFrame:
    return folded.where("fact = 'event'").groupBy(F.col("key").alias("event_type")).agg(F.sum("n").alias("n"))


def extent(folded: DataFrame) -> DataFrame:
    return folded.where("fact = 'event'").agg(F.min("first_ts").alias("first_event"), F.max("last_ts").alias("last_event"), F.coalesce(F.sum("n"), F.lit(0)).alias("events"))


def stats_events(folded: DataFrame) -> DataFrame:
    """The sensor's events as they came: seq, ts, event_type, stats."""
    return folded.where("fact = 'stats'").select(F.col("first_seq").alias("seq"), F.col("first_ts").alias("ts"), F.lit("stats").alias("event_type"), F.from_json("value", STATS).alias("stats"))


def alive(folded: DataFrame, before: dt.datetime) -> DataFrame:
    """ip of the devices seen since ``before``; one that was never seen isn't."""
    return folded.where("fact = 'seen'").groupBy("ip").agg(F.max("last_ts").alias("last")).where(F.col("last") >= F.lit(before)).select("ip")


def hour_of(before: dt.datetime) -> int:
    return int(before.timestamp() // 3600)


def retained(folded: DataFrame, before: dt.datetime) -> DataFrame:
    """What is kept of devices seen since ``before``, without their hours before that hour; their first time stays.

    Facts that are no device's stay. Findings go with their device.
    """
    of_device = F.col("ip") != ""
    rows = folded.where(of_device).join(alive(folded, before), "ip", "left_semi").unionByName(folded.where(~of_device))
    return since(rows, before)


def since(rows: DataFrame, before: dt.datetime) -> DataFrame:
    """Hours before that of ``before`` as one row a device, which has its first time."""
    old = (F.col("fact") == "seen") & (F.coalesce("hour", F.lit(0).cast("bigint")) < hour_of(before))
    first = rows.where(old).withColumns({"fact": F.lit("since"), "hour": F.lit(None).cast("bigint")})
    return rows.where(~old & (F.col("fact") != "since")).unionByName(merged(first.unionByName(rows.where("fact = 'since'"))))

"""What reports show: coverage, classes, timelines and the panels of a chosen time range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions import net
from netquarry.operators.findings import worst

#: Event types that a full report and a short one look for.
WANTED = ("dhcp", "arp", "dns", "tls", "http", "flow", "smb", "krb5", "ssh", "snmp")
WANTED_SHORT = ("dhcp", "dns", "tls", "http", "flow", "smb", "krb5", "ssh")
BARS, POINTS = 90, 60
#: Hours back from the end of a capture that can be chosen.
RANGES = (24, 72, 168, 336, 720)
#: What a search looks at, beside identifiers and accounts.
SEARCHED = ("ip", "hostname", "vendor", "os", "class", "model", "firmware", "serial")


def coverage(event_counts: DataFrame, wanted: tuple[str, ...] = WANTED) -> DataFrame:
    """event_type, n, present for each wanted type."""
    rows = event_counts.sparkSession.createDataFrame([(k, t) for k, t in enumerate(wanted)], "place int, event_type string")
    return rows.join(event_counts, "event_type", "left").select("place", "event_type", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("present"))


def class_counts(devices: DataFrame) -> DataFrame:
    """class (unknown if nothing is known), n, percent."""
    known = (F.col("class") != "") | (F.col("vendor") != "") | (F.col("os") != "") | (F.col("model") != "")
    rows = devices.groupBy(F.when(known, F.col("class")).otherwise(F.lit("unknown")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def summary(devices: DataFrame) -> DataFrame:
    """One row: devices, identified, named, with users."""
    known = (F.col("class") != "") | (F.col("vendor") != "") | (F.col("os") != "") | (F.col("model") != "")
    return devices.agg(F.count(F.lit(1)).alias("devices"), F.count_if(known).alias("identified"), F.count_if(F.col("hostname") != "").alias("named"), F.count_if(F.size("users") > 0).alias("with_users"))


def worst_marked(devices: DataFrame, worst: DataFrame) -> DataFrame:
    """Devices with the severity of their worst finding, '' for none."""
    return devices.join(worst.withColumnRenamed("device", "ip"), "ip", "left").withColumn("worst", F.coalesce("worst", F.lit("")))


def scale(extent: DataFrame) -> DataFrame:
    """One row: low and high hour, step (hours a bar, doubled until there are at most 90 bars or so) and bars; none without a span."""
    rows = extent.where("last_event > first_event").select(F.floor(F.unix_timestamp("first_event") / 3600).alias("low"), F.floor(F.unix_timestamp("last_event") / 3600).alias("high"))
    span = F.col("high") - F.col("low") + 1
    doublings = F.greatest(F.lit(0), F.ceil(F.log2(F.floor(span / (BARS + 1)) + 1)))
    step = F.pow(F.lit(2), doublings)
    # floor(span / step) may still be over the limit by rounding, or half of it may do
    step = F.when(F.floor(span / step) > BARS, step * 2).when((step > 1) & (F.floor(span / (step / 2)) <= BARS), step / 2).otherwise(step).cast("long")
    return rows.withColumn("step", step).withColumn("bars", F.floor((span + F.col("step") - 1) / F.col("step")))


def timeline(activity: DataFrame, extent: DataFrame) -> DataFrame:
    """bar, hour, n, height (square root of the share of the highest, in percent) of all devices together."""
    size = scale(extent)
    bars = size.select("low", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bars") - 1)).alias("bar"))
    counts = activity.join(F.broadcast(size), activity["hour"].between(size["low"], size["high"])).groupBy(F.floor((F.col("hour") - F.col("low")) / F.col("step")).alias("bar")).agg(F.sum("n").alias("n"))
    rows = bars.join(counts, "bar", "left").select("bar", (F.col("low") + F.col("bar") * F.col("step")).alias("hour"), F.coalesce("n", F.lit(0)).alias("n"))
    peak = F.max("n").over(Window.partitionBy(F.lit(0)))  # 90 rows or so
    return rows.withColumn("height", F.when(peak > 0, F.sqrt(F.col("n") / peak) * 100).otherwise(F.lit(0.0)))


def _dense(counts: Column, size: Column) -> Column:
    """Counts by place (a map) as an array of that size."""
    return F.transform(F.sequence(F.lit(0).cast("long"), size - 1), lambda i: F.coalesce(F.try_element_at(counts, i), F.lit(0).cast("long")))


def bucket_strings(activity: DataFrame, extent: DataFrame) -> DataFrame:
    """ip and one digit a bar: 0 for silence, 1 to 9 up to the device's own peak."""
    rows = activity.join(F.broadcast(scale(extent))).withColumn("bar", F.floor((F.col("hour") - F.col("low")) / F.col("step"))).where("bar >= 0 AND bar < bars")
    per = rows.groupBy("ip", "bars", "bar").agg(F.sum("n").alias("n")).groupBy("ip", "bars").agg(F.map_from_entries(F.collect_list(F.struct("bar", "n"))).alias("counts"), F.max("n").alias("peak"))
    digit = lambda v: F.when(v == 0, F.lit("0")).when(F.col("peak") <= 1, F.lit("9")).otherwise((1 + F.floor((v - 1) / F.col("peak") * 8)).cast("string"))
    return per.select("ip", F.array_join(F.transform(_dense(F.col("counts"), F.col("bars")), digit), "").alias("buckets"))


def sparklines(activity: DataFrame, extent: DataFrame) -> DataFrame:
    """ip and the points x,y of its activity on a field of 100 by 20; none for a span of one hour."""
    size = scale(extent).where("high > low").withColumn("points", F.least(F.lit(POINTS), F.col("high") - F.col("low") + 1)).withColumn("wide", F.greatest(F.lit(1).cast("long"), F.floor((F.col("high") - F.col("low") + 1) / F.col("points"))))
    rows = activity.join(F.broadcast(size)).withColumn("point", F.floor((F.col("hour") - F.col("low")) / F.col("wide"))).where("point >= 0 AND point < points")
    per = rows.groupBy("ip", "points", "point").agg(F.sum("n").alias("n")).groupBy("ip", "points").agg(F.map_from_entries(F.collect_list(F.struct("point", "n"))).alias("counts"), F.max("n").alias("peak"))
    place = lambda i: F.format_number(i * (100.0 / (F.col("points") - 1)), 2)
    dot = lambda v, i: F.concat(place(i), F.lit(","), F.format_number(19.0 - F.sqrt(v / F.col("peak")) * 18, 2))
    return per.select("ip", F.array_join(F.transform(_dense(F.col("counts"), F.col("points")), dot), " ").alias("spark"))


def active_between(devices: DataFrame, since=None, until=None) -> DataFrame:
    """Devices seen in the window; an open end is None."""
    keep = F.lit(True)
    if since is not None:
        keep = keep & (F.col("last_seen") >= F.lit(since))
    if until is not None:
        keep = keep & (F.col("first_seen") <= F.lit(until))
    return devices.where(F.coalesce(keep, F.lit(True)))


def search(devices: DataFrame, text: str) -> DataFrame:
    """Devices with the text in what names them, in any case."""
    return devices.where(F.lower(F.concat_ws(" ", *SEARCHED, F.array_join("ot_identifiers", " "), F.array_join("users", " "))).contains(text.lower()))


def visible(devices: DataFrame, buckets: DataFrame, low: int, high: int) -> DataFrame:
    """Devices active in bars low to high, with their digits in them (shown) and in all (whole)."""
    digits = F.transform(F.filter(F.split("buckets", ""), lambda c: c != ""), lambda c: c.cast("int"))
    add = lambda a, x: a + x
    rows = devices.join(buckets, "ip").withColumn("digits", digits)
    rows = rows.withColumn("shown", F.aggregate(F.slice("digits", low + 1, high - low + 1), F.lit(0), add)).withColumn("whole", F.aggregate("digits", F.lit(0), add))
    return rows.where("shown > 0").drop("digits")


def talkers(shown: DataFrame, n: int = 6) -> DataFrame:
    """The devices with the most events, shared out by the digits of the chosen bars."""
    events = F.aggregate(F.map_values("activity"), F.lit(0).cast("long"), lambda a, x: a + x)
    volume = F.when(F.col("shown") == F.col("whole"), events).otherwise(F.floor(events * F.col("shown") / F.col("whole") + 0.5))
    return shown.select("ip", volume.cast("long").alias("volume")).where("volume > 0").orderBy(F.desc("volume"), net.ip_key(F.col("ip"))).limit(n)


def most_common(shown: DataFrame, column: str, n: int = 6) -> DataFrame:
    """The values of an array column that most devices have."""
    return shown.select("ip", F.explode(F.array_distinct(column)).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def severities(shown: DataFrame, findings: DataFrame) -> DataFrame:
    """severity, n: the devices shown by their worst finding."""
    return shown.select("ip").join(worst(findings).withColumnRenamed("device", "ip"), "ip").groupBy(F.col("worst").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def findings_shown(findings: DataFrame, shown: DataFrame) -> DataFrame:
    """Findings of the devices shown, and the sensor's."""
    return findings.join(shown.select(F.col("ip").alias("device")).unionByName(shown.sparkSession.createDataFrame([("sensor",)], "device string")).distinct(), "device", "left_semi")


def findings_held(findings: DataFrame, shown: DataFrame) -> DataFrame:
    """One row: findings that the chosen range doesn't show, and how many of them are critical."""
    held = findings.where("device <> 'sensor'").join(shown.select(F.col("ip").alias("device")), "device", "left_anti")
    return held.agg(F.count(F.lit(1)).alias("held"), F.count_if(F.col("severity") == "CRITICAL").alias("held_critical"))


def findings_alive(findings: DataFrame, devices: DataFrame, before) -> DataFrame:
    """Findings of devices seen since ``before``, and the sensor's."""
    return findings_shown(findings, devices.where(F.col("last_seen") >= F.lit(before)).select("ip"))


def presets(extent: DataFrame) -> DataFrame:
    """hours, offered: the ranges for a capture, and whether each can be chosen; the first that holds it all is the last. Without a span, only the first."""
    hours = F.coalesce(F.floor(F.unix_timestamp("last_event") / 3600) - F.floor(F.unix_timestamp("first_event") / 3600) + 1, F.lit(0))
    choices = [F.struct(F.lit(p).alias("hours"), (F.lit(before) < hours if before else F.lit(True)).alias("offered")) for before, p in zip((0, *RANGES), RANGES, strict=False)]
    return extent.select(F.explode(F.array(*choices)).alias("p")).select("p.*")

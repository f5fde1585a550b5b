"""Findings: what is wrong with a device, once a device and kind."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions import access, net
from netquarry.operators import ordering
from netquarry.operators.fold import counted

SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
#: Kind: title, detail and advice; {} is what was seen.
TEXTS = {
    "end-of-life-os": ("{} still runs here", "{} gets no security updates any more.", "Replace or upgrade it; what can't be upgraded belongs in a network of its own."),
    "obsolete-ssl": ("Serves {}", "This version of SSL protects nothing.", "Allow TLS 1.2 and later only."),
    "weak-tls": ("Serves the outdated {}", "Audits reject this version of TLS.", "Allow TLS 1.2 and later only, or put a proxy in front."),
    "self-signed-cert": ("Certificate signed by itself", "Clients can't tell this service from an impostor.", "Use a certificate of a trusted authority where others connect."),
    "cert-expired": ("Certificate has run out", "It ended on {}.", "Renew it."),
    "cert-expiring": ("Certificate runs out soon", "It ends on {}.", "Renew it before that day."),
    "client-obsolete-tls": ("Connects with {}", "The client itself offers an outdated protocol.", "Update its firmware, or limit where it may connect."),
    "dns-over-https": ("Resolves names over HTTPS", "Local name filters don't see these lookups.", "Turn it off by policy if you filter names."),
    "ssh-v1": ("Speaks SSH version 1", "Version 1 can be decrypted.", "Allow version 2 only."),
    "default-snmp-community": ("Default SNMP community {}", "Anyone who knows the default can read the device's configuration.", "Set another community, or turn SNMP off."),
    "snmp-v1v2": ("SNMP version {}", "Its password crosses the network in the clear.", "Use version 3."),
    "vnc-no-auth": ("Remote screen without a password", "Anyone who reaches it controls the machine.", "Set a password or stop the service today."),
    "smbv1": ("Shares files over SMB 1", "Worms spread through this version.", "Turn SMB 1 off."),
    "weak-kerberos": ("Weak ticket encryption {}", "Such tickets can be cracked offline.", "Allow AES only."),
    "cleartext-credentials": ("FTP login in the clear", "Name and password could be read on the way.", "Change the password and move to SFTP or FTPS."),
    "tftp-in-use": ("TFTP in use", "It has neither password nor encryption.", "Limit it to the management network."),
    "executable-transfer": ("A program was transferred", "Seen: {}.", "Ask whether it was expected."),
    "ot-exposed": ("Controller reached from outside", "Industrial traffic came from {}.", "Block it at the firewall now."),
    "high-severity-alert": ("Threat: {}", "A rule of the highest severity matched.", "Look at what else the device does, and isolate it if in doubt."),
    "p2p": ("Peer-to-peer file sharing", "BitTorrent traffic.", "Block it if it isn't allowed."),
    "sensor-packet-loss": ("The sensor loses packets", "The inventory has gaps.", "Give the sensor more capacity, or less traffic."),
    "segmentation": ("Traffic from {}", "The policy has no such route.", "Check the firewall, or allow it in the policy."),
}


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int") - 1


def certificate_end(text: Column) -> Column:
    """The end of a certificate in one of the four forms that sensors write; null for all else."""
    forms = ((r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$", "yyyy-MM-dd'T'HH:mm:ss"), (r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", "yyyy-MM-dd HH:mm:ss"), (r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd"))
    plain = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form))) for shape, form in forms]
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:\d\d)$"), access.timestamp(text))
    return F.coalesce(*plain, zoned)


def certificate_findings(facts: DataFrame, now: dt.datetime) -> DataFrame:
    """Findings on certificates that have run out a day ago or earlier, or will in 30 days; whole days count, cut towards 0."""
    end = certificate_end(F.from_json("value", "not_after string")["not_after"])
    days = ((end.cast("double") - F.lit(now).cast("timestamp").cast("double")) / 86400).cast("int")
    rows = counted(facts).where("fact = 'cert'").select(F.col("first_seq").alias("seq"), "n", "ip", end.alias("end"), days.alias("days")).where(F.col("end").isNotNull() & (F.col("days") <= 30))
    late = F.col("days") < 0
    return rows.select("seq", "n", "ip", F.lit("finding").alias("fact"), F.when(late, F.lit("cert-expired")).otherwise(F.lit("cert-expiring")).alias("key"), F.date_format("end", "yyyy-MM-dd").alias("value"), F.when(late, F.lit("HIGH")).otherwise(F.lit("MEDIUM")).alias("conclusion"))


def sensor_counters(events: DataFrame) -> DataFrame:
    """seq, uptime, captured, dropped of each stats event, each counter the last one over 0 so far."""
    stats = events.where("event_type = 'stats'")
    rows = stats.select("seq", "ts", *[F.when(F.col(f"stats.{n}") > 0, F.col(f"stats.{n}")).alias(n) for n in ("uptime", "captured", "dropped")])
    counters = ordering.carried(rows, F.col("seq"), "uptime", "captured", "dropped")
    return counters.select("seq", "ts", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("uptime", "captured", "dropped")])


def sensor_health(events: DataFrame) -> DataFrame:
    """One row: uptime, captured, dropped as last reported, loss in percent, reported."""
    last = lambda c: F.coalesce(F.max_by(c, "seq"), F.lit(0))
    rows = sensor_counters(events).agg(last("uptime").alias("uptime"), last("captured").alias("captured"), last("dropped").alias("dropped"), (F.count(F.lit(1)) > 0).alias("reported"))
    return rows.withColumn("loss", F.when(F.col("captured") > 0, 100.0 * F.col("dropped") / F.col("captured")).otherwise(F.lit(0.0)))


def sensor_findings(events: DataFrame) -> DataFrame:
    """A finding for each stats event at which over 1 % of the packets were lost."""
    rows = sensor_counters(events).where("captured > 0 AND 100.0D * dropped / captured > 1")
    return rows.select("seq", F.lit(1).cast("bigint").alias("n"), F.lit("sensor").alias("ip"), F.lit("finding").alias("fact"), F.lit("sensor-packet-loss").alias("key"), F.lit("").alias("value"), F.lit("MEDIUM").alias("conclusion"))


def grouped(raw: DataFrame) -> DataFrame:
    """device, kind, f (conclusion and value of the first sighting), count, first_seq of finding facts (n each)."""
    rows = raw.where("fact = 'finding' AND ip <> ''").groupBy(F.col("ip").alias("device"), F.col("key").alias("kind"))
    return rows.agg(F.min_by(F.struct("conclusion", "value"), "seq").alias("f"), F.sum("n").alias("count"), F.min("seq").alias("first_seq"))


def findings(raw: DataFrame) -> DataFrame:
    """severity, kind, device, title, detail, fix, count, first_seq: the first sighting's text and the number of sightings.

    raw: finding facts of all sources.
    """
    rows = grouped(raw)
    base = F.when(F.col("kind").startswith("segmentation-"), F.lit("segmentation")).otherwise(F.col("kind"))
    text = lambda k: F.replace(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for n, t in TEXTS.items() for x in (n, t[k])]), base), F.col("kind")), F.lit("{}"), F.col("f.value"))
    return rows.select(F.col("f.conclusion").alias("severity"), rank(F.col("f.conclusion")).alias("severity_rank"), "kind", "device", text(0).alias("title"), text(1).alias("detail"), text(2).alias("fix"), "count", "first_seq")


def ordered(findings_: DataFrame) -> DataFrame:
    """Worst first, then by address and arrival."""
    return findings_.orderBy(F.desc("severity_rank"), net.ip_key(F.col("device")), "first_seq")


def worst(findings_: DataFrame) -> DataFrame:
    """device and the severity of its worst finding."""
    return findings_.groupBy("device").agg(F.max_by("severity", "severity_rank").alias("worst"))

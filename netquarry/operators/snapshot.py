"""Snapshots of an inventory, and what changed between two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions import net

SCHEMA_VERSION = 1
SCALARS = ("ip", "hostname", "os", "class", "vendor", "model", "firmware", "mac")
ADDED = {"new protocols": "protocols", "new users": "users", "new shares": "shares", "new VLANs": "vlans", "new OT identifiers": "ot_identifiers"}
#: All that a comparison reads of a device.
COMPARED = (*SCALARS, "random_mac", "services", *ADDED.values())


def round3(value: Column) -> Column:
    return F.floor(value * 1000 + 0.5) / 1000


def exported(devices: DataFrame) -> DataFrame:
    """The stable shape of a device in a snapshot."""
    return devices.select(
        "ip", "mac", "random_mac", "hostname", "hostnames", "class", round3(F.col("confidence")).alias("confidence"), "vendor", "os", "model", "firmware", "serial",
        F.transform("services", lambda s: F.struct(s["port"].alias("port"), s["proto"].alias("proto"), s["app_proto"].alias("app_proto"))).alias("services"),
        "protocols", "users", "shares", "vlans", "ot_identifiers", "ja4", "first_seen", "last_seen", "alerts", "anomalies", "evidence",
    )


def key(mac: Column, random_mac: Column, ip: Column) -> Column:
    """What a device is followed by: its hardware address unless that is random, else its address."""
    return F.when((mac != "") & ~random_mac, F.concat(F.lit("mac:"), mac)).otherwise(F.concat(F.lit("ip:"), ip))


def label(row: str = "") -> Column:
    """A device's name for people."""
    c = lambda n: F.col(f"{row}{n}")
    return (
        F.when(c("hostname") != "", c("hostname"))
        .when((c("vendor") != "") & (c("class") != ""), F.concat_ws(" ", c("vendor"), c("class")))
        .when(c("vendor") != "", c("vendor"))
        .when(c("class") != "", c("class"))
        .otherwise(c("ip"))
    )


def _joined(values: Column) -> Column:
    return F.array_join(values, ", ")


def _ports(row: str) -> Column:
    return F.transform(F.col(f"{row}services"), lambda s: s["port"])


def describe() -> Column:
    """One line on a device."""
    ports = F.when(F.size("services") > 0, F.concat(F.lit("ports "), _joined(_ports(""))))
    some = lambda n: F.when(F.col(n) != "", F.col(n))
    return F.concat_ws("  ", "ip", some("mac"), some("vendor"), some("os"), ports)


def keyed(devices: DataFrame) -> DataFrame:
    """One device a key: of two with one hardware address, the last by address."""
    rows = devices.withColumn("key", key(F.col("mac"), F.col("random_mac"), F.col("ip")))
    names = [c for c in rows.columns if c != "key"]
    return rows.groupBy("key").agg(F.max_by(F.struct(*names), net.ip_key(F.col("ip"))).alias("d")).select("key", "d.*")


def appeared(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, ip, label, detail of devices that only ``after`` has; swap the two for those that disappeared."""
    new = after.withColumn("key", key(F.col("mac"), F.col("random_mac"), F.col("ip"))).join(keyed(before).select("key"), "key", "left_anti")
    return new.select("key", "ip", label().alias("label"), describe().alias("detail"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, ip, label, fields (field, from, to, list) of devices that both have and that differ."""
    old, new = keyed(before.select(*COMPARED)), keyed(after.select(*COMPARED))
    rows = old.select("key", F.struct(*[c for c in old.columns if c != "key"]).alias("a")).join(new.select("key", F.struct(*[c for c in new.columns if c != "key"]).alias("b")), "key")

    def change(field: str, start: Column, end: Column, when: Column, is_list: bool) -> Column:
        return F.when(when, F.struct(F.lit(field).alias("field"), start.alias("from"), end.alias("to"), F.lit(is_list).alias("list")))

    none = F.lit("")
    parts = [change(f, F.col(f"a.{f}"), F.col(f"b.{f}"), ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), False) for f in SCALARS]
    opened, closed = F.array_sort(F.array_except(_ports("b."), _ports("a."))), F.array_sort(F.array_except(_ports("a."), _ports("b.")))
    parts += [change("new services", none, _joined(opened), F.size(opened) > 0, True), change("services gone", _joined(closed), none, F.size(closed) > 0, True)]
    for field, column in ADDED.items():
        more = F.array_sort(F.array_except(F.col(f"b.{column}"), F.col(f"a.{column}")))
        parts.append(change(field, none, _joined(more), F.size(more) > 0, True))
    fields = F.filter(F.array(*parts), lambda p: p.isNotNull())
    return rows.select("key", F.col("b.ip").alias("ip"), label("b.").alias("label"), fields.alias("fields")).where(F.size("fields") > 0)


def findings_only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Findings of ``a`` on a device and of a kind that ``b`` doesn't have."""
    return a.join(b.select("device", "kind").distinct(), ["device", "kind"], "left_anti")


def totals(before: DataFrame, after: DataFrame, found_before: DataFrame, found_after: DataFrame) -> DataFrame:
    """One row: how much of each there is in the difference, and their sum."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [count(appeared(before, after), "appeared"), count(appeared(after, before), "disappeared"), count(changed(before, after), "changed")]
    parts += [count(findings_only_in(found_after, found_before), "new_findings"), count(findings_only_in(found_before, found_after), "fixed_findings")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # one row each
    return out.withColumn("total", sum((F.col(c) for c in ("disappeared", "changed", "new_findings", "fixed_findings")), F.col("appeared")))


def services(ports: Column, most: int = 8) -> Column:
    """Port and application protocol of the first services, and how many more there are."""
    shown = F.transform(F.slice(ports, 1, most), lambda s: F.concat(s["port"].cast("string"), F.when(s["app_proto"] != "", F.concat(F.lit("/"), s["app_proto"])).otherwise(F.lit(""))))
    more = F.when(F.size(ports) > most, F.concat(F.lit(" +"), (F.size(ports) - most).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return F.concat(F.array_join(shown, ", "), more)


def netbox(devices: DataFrame) -> DataFrame:
    """Rows for an address import: address, status, dns_name, description, comments."""
    dns = F.regexp_replace(F.regexp_replace(F.lower(F.trim("hostname")), "[^a-z0-9._-]", ""), r"^[.-]+|[.-]+$", "")
    named = F.concat_ws(" · ", *[F.when(F.col(c) != "", F.col(c)) for c in ("vendor", "model", "class", "os")])
    percent = F.floor(F.col("confidence") * 100).cast("int").cast("string")
    line = F.concat(F.when(named == "", F.lit("unidentified device")).otherwise(named), F.lit(" (passive inventory, "), percent, F.lit("% confidence)"))
    # at most 200 bytes of whole characters: what a cut leaves of the last one goes
    cut = F.when(F.octet_length(line) <= 200, line).otherwise(F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(line, "UTF-8"), 1, 200).cast("string")), "\uFFFD+$", ""))
    items = [
        F.when(F.col("mac") != "", F.concat(F.lit("- MAC: `"), "mac", F.lit("`"), F.when(F.col("random_mac"), F.lit(" (random, no lasting identity)")).otherwise(F.lit("")))),
        F.when(F.col("firmware") != "", F.concat(F.lit("- Firmware: "), "firmware")),
        F.when(F.col("serial") != "", F.concat(F.lit("- Serial: "), "serial")),
        F.when(F.size("vlans") > 0, F.concat(F.lit("- VLANs: "), _joined(F.col("vlans")))),
        F.when(F.size("services") > 0, F.concat(F.lit("- Open ports: "), _joined(_ports("")))),
        F.when(F.size("protocols") > 0, F.concat(F.lit("- Protocols: "), _joined(F.col("protocols")))),
        F.when(F.size("ot_identifiers") > 0, F.concat(F.lit("- OT identifiers: "), _joined(F.col("ot_identifiers")))),
        F.when(F.col("first_seen").isNotNull(), F.concat(F.lit("- First seen: "), F.date_format("first_seen", "yyyy-MM-dd HH:mm"), F.lit(" UTC"))),
        F.when(F.col("last_seen").isNotNull(), F.concat(F.lit("- Last seen: "), F.date_format("last_seen", "yyyy-MM-dd HH:mm"), F.lit(" UTC"))),
    ]
    comments = F.concat(F.lit("Found by listening to the network; not checked by a scan.\n\n"), F.concat_ws("\n", *items))
    return devices.select(F.concat("ip", F.lit("/32")).alias("address"), F.lit("active").alias("status"), F.substring(dns, 1, 255).alias("dns_name"), cut.alias("description"), comments.alias("comments"))

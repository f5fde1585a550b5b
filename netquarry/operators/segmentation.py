"""Checking conversations against a declared segmentation policy."""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions import net
from netquarry.operators.evidence import small
from netquarry.operators.fold import counted


class PolicyError(ValueError):
    """A policy that can't be used; the message says which line and why."""


@dataclass
class Policy:
    zones: list[tuple[str, str]] = field(default_factory=list)  # name and network, as declared
    allowed: set[tuple[str, str]] = field(default_factory=set)

    def names(self) -> list[str]:
        return sorted({name for name, _ in self.zones})


def parse_policy(text: str) -> Policy:
    """``zone NAME NETWORK...``, ``allow A -> B`` and ``allow A <-> B`` lines; # starts a comment."""
    policy = Policy()
    for number, line in enumerate(text.splitlines(), 1):
        words = line.split("#")[0].split()
        if not words:
            continue
        if words[0].lower() == "zone":
            if len(words) < 3:
                raise PolicyError(f"line {number}: a zone needs a name and a network")
            for part in words[2:]:
                try:
                    if "/" not in part:
                        raise ValueError(part)
                    policy.zones.append((words[1], str(ipaddress.ip_network(part, strict=False))))
                except ValueError:
                    raise PolicyError(f"line {number}: {part!r} is no network such as 10.0.1.0/24") from None
        elif words[0].lower() == "allow":
            if len(words) != 4:
                raise PolicyError(f"line {number}: allow needs two zones and an arrow between them")
            if words[2] not in ("->", "<->"):
                raise PolicyError(f"line {number}: {words[2]!r} is neither -> nor <->")
            policy.allowed.add((words[1], words[3]))
            if words[2] == "<->":
                policy.allowed.add((words[3], words[1]))
        else:
            raise PolicyError(f"line {number}: {words[0]!r} is neither zone nor allow")
    if not policy.zones:
        raise PolicyError("a policy without zones checks nothing")
    known = set(policy.names())
    for pair in sorted(policy.allowed):
        for name in pair:
            if name not in known:
                raise PolicyError(f"allow names zone {name!r}, which isn't declared")
    return policy


def zone_ranges(spark: SparkSession, policy: Policy) -> DataFrame:
    """zone, low, high, bits, ord of each network; IPv6 ones as sortable hex text (family 6)."""
    rows = []
    for k, (name, text) in enumerate(policy.zones):
        n = ipaddress.ip_network(text)
        rows.append((name, n.version, f"{int(n[0]):032x}", f"{int(n[-1]):032x}", n.prefixlen, k))
    return spark.createDataFrame(rows, "zone string, family int, low string, high string, bits int, ord int")


def _key(ip):
    """IPv4 as 32 hex digits, so that ranges compare as text; IPv6 written in full the same way."""
    four = F.lpad(F.lower(F.conv(net.v4_number(ip).cast("string"), 10, 16)), 32, "0")
    halves = F.split(F.lower(ip), "::")
    groups = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    six = F.array_join(F.transform(F.concat(left, F.when(F.contains(ip, F.lit("::")), gap).otherwise(F.array().cast("array<string>")), right), lambda g: F.lpad(g, 4, "0")), "")
    return F.when(net.v4_number(ip).isNotNull(), four).when(ip.rlike(net.V6) & ~ip.contains("."), six)


HEX = "0123456789abcdef"


def _network(at: Column, family: int, bits: int) -> Column:
    """The first address of the network of so many bits that an address is in."""
    whole, more = divmod(bits + (96 if family == 4 else 0), 4)
    parts = [F.substring(at, 1, whole)]
    if more:
        step = 1 << (4 - more)
        parts.append(F.translate(F.substring(at, whole + 1, 1), HEX, "".join(HEX[d - d % step] for d in range(16))))
    return F.concat(*parts, F.lit("0" * (32 - whole - bool(more))))


def zone_of(addresses: DataFrame, zones: DataFrame) -> DataFrame:
    """ip and the zone of its most specific network (the first declared, of equal ones); addresses in no zone are left out.

    An address is looked up once for each length of prefix that any network has (162 at
    most): networks are joined by equality, however many there are.
    """
    rows = addresses.select("ip").distinct().withColumn("at", _key(F.col("ip"))).withColumn("family", F.when(net.v4_number(F.col("ip")).isNotNull(), 4).otherwise(6)).where("at IS NOT NULL")
    lengths = sorted(map(tuple, zones.select("family", "bits").distinct().collect()))
    tried = [F.when(F.col("family") == f, F.struct(F.lit(b).alias("bits"), _network(F.col("at"), f, b).alias("low"))) for f, b in lengths]
    none = F.array().cast("array<struct<bits:int, low:string>>")
    rows = rows.select("ip", "family", F.explode(F.array_compact(F.array(*tried)) if tried else none).alias("n")).select("ip", "family", "n.*")
    hits = rows.join(zones.select("family", "bits", "low", "zone", "ord"), ["family", "bits", "low"])
    return hits.groupBy("ip").agg(F.max_by("zone", F.struct("bits", -F.col("ord"))).alias("zone"))


def violations(facts: DataFrame, policy: Policy) -> DataFrame:
    """Finding facts on the source of each conversation between zones that the policy has no route for."""
    spark = facts.sparkSession
    crossing = counted(facts).where("fact = 'crossing'").select(F.col("first_seq").alias("seq"), "n", "ip", F.col("value").alias("dest"), F.col("key").alias("port"))
    zones = zone_of(crossing.select("ip").unionByName(crossing.select(F.col("dest").alias("ip"))), zone_ranges(spark, policy))
    allowed = spark.createDataFrame(sorted(policy.allowed) or [("", "")], "zone_from string, zone_to string")
    rows = crossing.join(zones.withColumnRenamed("zone", "zone_from"), "ip").join(zones.select(F.col("ip").alias("dest"), F.col("zone").alias("zone_to")), "dest")
    rows = rows.where("zone_from <> zone_to").join(small(allowed), ["zone_from", "zone_to"], "left_anti")
    where = F.when(F.col("port").cast("bigint") > 0, F.concat_ws(":", "dest", "port")).otherwise(F.col("dest"))
    seen = F.concat(F.col("zone_from"), F.lit(" to "), F.col("zone_to"), F.lit(", first at "), where)
    return rows.select("seq", "n", "ip", F.lit("finding").alias("fact"), F.concat(F.lit("segmentation-"), "zone_from", F.lit("-to-"), "zone_to").alias("key"), seen.alias("value"), F.lit("HIGH").alias("conclusion"))

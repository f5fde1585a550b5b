"""Lookups and orders that must hold for many rules, networks and rows, against brute force."""

import ipaddress
import random

from pyspark.sql import functions as F

from netquarry.operators import evidence, ordering, segmentation


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "b", None, "c"]), rng.randrange(50)) for k in range(2_000)]
    df = spark.createDataFrame(rows, "id int, name string, n int").repartition(7)
    got = ordering.with_place(df, F.desc("n"), F.col("name"), F.col("id"))
    want = sorted(rows, key=lambda r: (-r[2], r[1] is not None, r[1] or "", r[0]))
    assert [tuple(r)[:3] for r in got.orderBy("place").select("id", "name", "n", "place").collect()] == want
    assert sorted(r["place"] for r in got.collect()) == list(range(1, 2_001))
    assert ordering.with_place(df.limit(0), F.col("id")).isEmpty()


def test_carried(spark):
    """Each value as it was last there, over parts without any and rows in no order."""
    rng = random.Random(2)
    rows = [(k, k if rng.random() < 0.02 else None, -k if rng.random() < 0.5 else None) for k in range(3_000)]
    rng.shuffle(rows)
    got = ordering.carried(spark.createDataFrame(rows, "seq bigint, rare bigint, often bigint").repartition(8), F.col("seq"), "rare", "often")
    assert "SinglePartition" not in plan(got)
    last, want = [None, None], []
    for seq, rare, often in sorted(rows):
        last = [rare if rare is not None else last[0], often if often is not None else last[1]]
        want.append((seq, *last))
    assert sorted(map(tuple, got.collect())) == want


def test_zones(spark):
    """Nested and equal networks, of both families, of every length, against each network in turn."""
    rng = random.Random(3)
    four = [f"10.{rng.randrange(4)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(300)]
    six = [str(ipaddress.ip_address((0xFD00 << 112) + rng.getrandbits(20) * (1 << 90) + rng.getrandbits(10))) for _ in range(200)]
    nets = [str(ipaddress.ip_network(f"{a}/{rng.randrange(33)}", strict=False)) for a in rng.sample(four, 60)] + [str(ipaddress.ip_network(f"{a}/{rng.randrange(129)}", strict=False)) for a in rng.sample(six, 60)]
    policy = segmentation.Policy([(f"z{k}", n) for k, n in enumerate([*nets, *nets[:10], "10.0.0.0/8", "fd00::/16"])])
    odd = ["", "x", "1.2.3", "::ffff:10.1.2.3"]
    got = {r["ip"]: r["zone"] for r in segmentation.zone_of(spark.createDataFrame([(i,) for i in [*four, *six, *odd]], "ip string"), segmentation.zone_ranges(spark, policy)).collect()}
    best = lambda ip: min(((-n.prefixlen, k, name) for k, (name, text) in enumerate(policy.zones) if (n := ipaddress.ip_network(text)).version == ip.version and ip in n), default=(0, 0, None))[2]
    want = {i: best(ipaddress.ip_address(i)) for i in [*four, *six]} | {"::ffff:10.1.2.3": best(ipaddress.ip_address("10.1.2.3"))}
    assert got == {i: z for i, z in want.items() if z}


def test_many_networks_are_looked_up_by_equality(spark):
    zones = spark.range(100_000).select(F.concat(F.lit("z"), "id").alias("zone"), F.lit(4).alias("family"), F.lpad(F.lower(F.hex(F.col("id") * 256 + 0x0A000000)), 32, "0").alias("low"), F.lit(24).alias("bits"), F.col("id").cast("int").alias("ord"))
    got = segmentation.zone_of(spark.createDataFrame([("10.0.5.9",), ("10.1.0.1",), ("11.134.159.255",), ("11.134.160.0",)], "ip string"), zones)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert {r["ip"]: r["zone"] for r in got.collect()} == {"10.0.5.9": "z5", "10.1.0.1": "z256", "11.134.159.255": "z99999"}


def test_rules_in_texts(spark):
    """Rules of every length, none, repeated, of several tables, in texts that hold them once or often."""
    rng = random.Random(4)
    letters = "abcdé日"
    word = lambda low, high: "".join(rng.choices(letters, k=rng.randrange(low, high)))
    rules = [("one", k, word(0, 6), f"c{k}", 0.5, 1) for k in range(60)] + [("two", k, word(2, 5), f"d{k}", 0.5, 1) for k in range(20)] + [("two", 20, "abc", "again", 0.1, 1), ("two", 21, "abc", "again", 0.1, 1)]
    texts = [(k, rng.choice(["one", "two", "three"]), word(0, 30)) for k in range(200)] + [(500, "one", ""), (501, "two", "abcabc")]
    table, every = spark.createDataFrame(texts, "id int, rule_table string, lower string"), spark.createDataFrame(rules, "rule_table string, rule int, match string, conclusion string, weight double, spec int")
    got = evidence.containing(table, every, ["id"])
    assert sorted((r["id"], r["rule_table"], r["rule"]) for r in got.collect()) == sorted((i, t, r[1]) for i, t, x in texts for r in rules if r[0] == t and r[2] in x)
    assert "NestedLoop" not in plan(got) and evidence.containing(table, every.limit(0), ["id"]).isEmpty()


def test_starts_of_fingerprints(spark):
    rules = spark.createDataFrame([(0, "t13", "a", 0.1, 1), (1, "t13d", "b", 0.1, 1), (2, "t", "c", 0.1, 1), (3, "T13", "d", 0.1, 1), (4, "t13", "e", 0.1, 1)], "rule int, match string, conclusion string, weight double, spec int")
    got = evidence.starting(spark.createDataFrame([("t13d99",), ("t1",), ("q",), ("",)], "value string"), rules)
    assert sorted((r["value"], r["rule"]) for r in got.collect()) == [("t1", 2), ("t13d99", 0), ("t13d99", 1), ("t13d99", 2), ("t13d99", 4)]

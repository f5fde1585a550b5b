"""From facts to evidence: rules matched once a distinct text, observations counted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions import net
from netquarry.operators.fold import counted

#: Rule tables are small and of a known size; beyond this many rows they are joined without a broadcast.
BROADCAST_ROWS = 20_000


def small(rules: DataFrame) -> DataFrame:
    """The rules, marked for a broadcast if they are few enough (only their count is looked at)."""
    return F.broadcast(rules) if rules.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rules


#: Characters of the piece by which a rule is found; rules of fewer are found by all they have.
GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """All pieces of so many characters, each once."""
    if size == 0:
        return F.array(F.lit(""))
    piece = lambda letters: lambda i: F.concat(*[F.get(letters, i + k) for k in range(size)])
    every = lambda letters: F.when(F.size(letters) >= size, F.transform(F.sequence(F.lit(0), F.size(letters) - size), piece(letters))).otherwise(F.array().cast("array<string>"))
    # a list of the one text's letters, so that it is taken apart once and not once a piece
    return F.array_distinct(F.flatten(F.transform(F.array(F.filter(F.split(text, ""), lambda c: c != "")), every)))


def containing(texts: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """Columns of ``key`` and of rules, for every rule of a text's table whose match stands anywhere in it.

    texts: ``key`` (which tells rows apart), rule_table and lower; rules: rule_table, match
    and more. Each rule has one piece of its match, the one that fewest rules have; pieces
    of texts and rules are joined by equality, and only those pairs are looked at whole: a
    text is gone through once, however many rules there are.
    """
    ruled = rules.select(F.struct(*rules.columns).alias("__rule"), "rule_table", F.col("match"), F.least(F.lit(GRAM), F.length("match")).alias("__size"))
    sizes = sorted(r[0] for r in ruled.select("__size").distinct().collect())  # up to four numbers
    sized = lambda n: lambda g: F.struct(F.lit(n).alias("__size"), g.alias("__gram"))
    none = F.array().cast("array<struct<__size:int, __gram:string>>")
    pieces = lambda text, here: F.flatten(F.array(none, *[F.when(here(n), F.transform(_grams(text, n), sized(n))).otherwise(none) for n in sizes]))
    own = ruled.select("__rule", "rule_table", "match", F.explode(pieces(F.col("match"), lambda n: F.col("__size") == n)).alias("p")).select("__rule", "rule_table", "match", "p.*")
    shared = own.groupBy("rule_table", "__size", "__gram").agg(F.count(F.lit(1)).alias("__n"))
    anchors = own.join(shared, ["rule_table", "__size", "__gram"]).groupBy("__rule").agg(F.min_by(F.struct("rule_table", "match", "__size", "__gram"), F.struct("__n", "__gram")).alias("a")).select("__rule", "a.*")
    found = texts.select(*key, "rule_table", F.explode(pieces(F.col("lower"), lambda n: F.lit(True))).alias("p")).select(*key, "rule_table", "p.*")
    pairs = found.join(small(anchors), ["rule_table", "__size", "__gram"]).select(*key, "__rule", "match")
    hits = pairs.join(texts.select(*key, "lower"), key).where(F.contains("lower", "match"))
    return hits.select(*key, *[F.col(f"__rule.{c}").alias(c) for c in rules.columns if c not in key])


def starting(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """value and the rules' columns, for every rule whose match a value starts with; looked up once for each length of match."""
    sizes = sorted(r[0] for r in rules.select(F.length("match")).distinct().collect())  # lengths of fingerprints' starts
    starts = F.array(*[F.substring("value", 1, n) for n in sizes]) if sizes else F.array().cast("array<string>")
    rows = texts.select("value", F.explode(F.array_distinct(starts)).alias("match"))
    return rows.join(small(rules), "match")


def match_texts(texts: DataFrame, rules: DataFrame, ja4_rules: DataFrame) -> DataFrame:
    """ip, signal, value, conclusion, weight, spec, ord for every rule that a text fact meets.

    Each distinct text meets the rules once, whatever the number of events it came with.
    A rule is found anywhere in the text, in any case; JA4 rules at its start, case and all.
    """
    seen = texts.groupBy("ip", "key", "value", "conclusion").agg(F.min("ord").alias("at"))
    distinct = seen.select("value", F.col("conclusion").alias("rule_table")).distinct().withColumn("lower", F.lower("value"))
    plain = containing(distinct.where("rule_table <> 'ja4'"), rules, ["value", "rule_table"])
    starts = starting(distinct.where("rule_table = 'ja4'"), ja4_rules).withColumn("rule_table", F.lit("ja4"))
    columns = ["value", "rule_table", "rule", F.col("conclusion").alias("concluded"), "weight", "spec"]
    hits = plain.select(*columns).unionByName(starts.select(*columns))
    joined = seen.withColumnRenamed("conclusion", "rule_table").join(hits, ["value", "rule_table"])
    return joined.select("ip", F.col("key").alias("signal"), "value", F.col("concluded").alias("conclusion"), "weight", "spec", (F.col("at") * 1_000 + F.col("rule")).alias("ord"))


def vendors(macs: DataFrame, registry: DataFrame, curated: DataFrame) -> DataFrame:
    """mac, vendor of the addresses that aren't random: curated prefixes first, then the registry's, longest first."""
    base = macs.select(F.col("value").alias("mac")).distinct().where(~net.is_random_mac(F.col("mac"))).withColumn("digits", net.mac_digits(F.col("mac"))).where(F.length("digits") >= 6)
    ranked = curated.withColumn("rank", F.length("prefix") + 1000).unionByName(registry.where(F.length("prefix").isin(6, 7, 9)).withColumn("rank", F.length("prefix")))
    ranked = ranked.withColumn("size", F.length("prefix"))
    sizes = F.array(*[F.lit(n) for n in (4, 6, 7, 8, 9, 10, 12)])
    parts = base.select("mac", F.explode(F.filter(F.transform(sizes, lambda n: F.struct(n.alias("size"), F.col("digits").substr(F.lit(1), n).alias("prefix"))), lambda p: F.length(p["prefix"]) == p["size"])).alias("p"))
    hits = parts.select("mac", "p.size", "p.prefix").join(ranked, ["size", "prefix"])
    return hits.groupBy("mac").agg(F.max_by("vendor", F.struct("rank", "vendor")).alias("vendor"))


def evidence(facts: DataFrame, rules: dict[str, DataFrame]) -> DataFrame:
    """ip, signal, value, conclusion, weight, spec: each observation once, with the weight of the first rule that gave it.

    rules: text, port, proto, ja4, registry, curated.
    """
    facts = counted(facts)
    kind = lambda name: facts.where(F.col("fact") == name)
    columns = ["ip", "signal", "value", "conclusion", "weight", "spec", "ord"]
    notes = kind("note").select("ip", F.col("key").alias("signal"), "value", "conclusion", "weight", "spec", "ord")
    ports = kind("service").select("ip", F.col("key").cast("bigint").alias("port")).distinct().join(small(rules["port"]), "port")
    ports = ports.select("ip", F.lit("service.port").alias("signal"), F.concat(F.col("port").cast("string"), F.lit(" ("), "note", F.lit(")")).alias("value"), "conclusion", "weight", F.lit(1).alias("spec"), F.lit(0).alias("ord"))
    protos = kind("app_proto").select("ip", F.col("value").alias("app_proto")).distinct().join(small(rules["proto"]), "app_proto")
    protos = protos.select("ip", F.lit("app_proto").alias("signal"), F.col("app_proto").alias("value"), "conclusion", "weight", F.lit(1).alias("spec"), F.lit(0).alias("ord"))
    named = vendors(kind("mac"), rules["registry"], rules["curated"])
    owned = kind("mac").select("ip", F.col("value").alias("mac")).distinct().join(named, "mac")
    makers = owned.select("ip", F.lit("mac.oui").alias("signal"), F.col("mac").alias("value"), F.concat(F.lit("vendor="), "vendor").alias("conclusion"), F.lit(0.85).alias("weight"), F.lit(1).alias("spec"), F.lit(0).alias("ord"))
    maker_texts = owned.select("ip", F.lit("mac.oui").alias("key"), F.col("vendor").alias("value"), F.lit("vendor_class").alias("conclusion"), F.lit(1).alias("ord"))
    texts = kind("text").select("ip", "key", "value", "conclusion", "ord").unionByName(maker_texts)
    every = notes.select(*columns)
    for part in (ports, protos, makers, match_texts(texts, rules["text"], rules["ja4"])):
        every = every.unionByName(part.select(*columns))
    first = F.min_by(F.struct("weight", "spec"), F.struct("ord", F.col("weight") * -1)).alias("f")
    kept = every.where((F.col("weight") > 0) & (F.col("conclusion") != "")).groupBy("ip", "signal", "value", "conclusion").agg(first)
    return kept.select("ip", "signal", "value", "conclusion", "f.weight", "f.spec")


def conclusions(evidence_: DataFrame) -> DataFrame:
    """ip, conclusion, weight (1 - product of 1 - w), spec (the highest)."""
    return evidence_.groupBy("ip", "conclusion").agg((1 - F.product(1 - F.col("weight"))).alias("weight"), F.max("spec").alias("spec"))


def winners(conclusions_: DataFrame) -> DataFrame:
    """ip, class, confidence, os, vendor: class and vendor by weight, os by how specific it is and then weight; ties by name."""
    split = conclusions_.select("ip", F.substring_index("conclusion", "=", 1).alias("part"), F.expr("substring(conclusion, instr(conclusion, '=') + 1)").alias("name"), F.round("weight", 12).alias("weight"), "spec").where("name <> ''")
    rank = F.when(F.col("part") == "os", -F.col("spec")).otherwise(F.lit(0))
    best = split.groupBy("ip", "part").agg(F.min_by(F.struct("name", "weight"), F.struct(rank, -F.col("weight"), "name")).alias("best"))
    pick = lambda part, field: F.max(F.when(F.col("part") == part, F.col(f"best.{field}")))
    return best.groupBy("ip").agg(
        F.coalesce(pick("class", "name"), F.lit("")).alias("class"),
        F.coalesce(pick("class", "weight"), F.lit(0.0)).alias("confidence"),
        F.coalesce(pick("os", "name"), F.lit("")).alias("os"),
        F.coalesce(pick("vendor", "name"), F.lit("")).alias("vendor"),
    )


def ranked(conclusions_: DataFrame) -> DataFrame:
    """Every conclusion with its place among those of its part, 1 for the winner."""
    part = F.substring_index("conclusion", "=", 1)
    rank = F.when(part == "os", -F.col("spec")).otherwise(F.lit(0))
    return conclusions_.withColumn("place", F.row_number().over(Window.partitionBy("ip", part).orderBy(rank, F.desc(F.round("weight", 12)), "conclusion")))

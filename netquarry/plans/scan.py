"""The whole batch job: records to gold tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from netquarry.operators import devices, evidence, findings, fold, handlers, segmentation
from netquarry.sources import events, rules


@dataclass
class Inventory:
    """Gold tables over one set of records; each is worked out when first asked for.

    lines: line and seq; None where events and facts are set from elsewhere, as a watcher
    does. now: what certificates are measured against.
    """

    lines: DataFrame | None
    now: dt.datetime
    since: dt.datetime | None = None
    until: dt.datetime | None = None
    policy: segmentation.Policy | None = None
    registry: DataFrame | None = None
    overrides: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return (self.lines if self.lines is not None else self.folded).sparkSession

    @cached_property
    def rules(self) -> dict[str, DataFrame]:
        spark = self.spark
        found = {"text": rules.text_rules(spark), "port": rules.port_rules(spark), "proto": rules.proto_rules(spark), "ja4": rules.ja4_rules(spark), "curated": rules.curated_prefixes(spark)}
        return found | {"registry": self.registry if self.registry is not None else rules.no_registry(spark)} | self.overrides

    @cached_property
    def records(self) -> DataFrame:
        return events.records(self.lines)

    @cached_property
    def events(self) -> DataFrame:
        return events.in_window(events.events(self.records), self.since, self.until)

    @cached_property
    def facts(self) -> DataFrame:
        """Of all events, those without a use here dropped."""
        return handlers.facts(self.events)

    @cached_property
    def folded(self) -> DataFrame:
        """The facts by what they say, with how often; everything below reads only this."""
        return fold.fold(self.facts)

    @cached_property
    def evidence(self) -> DataFrame:
        return evidence.evidence(self.folded, self.rules)

    @cached_property
    def conclusions(self) -> DataFrame:
        return evidence.conclusions(self.evidence)

    @cached_property
    def winners(self) -> DataFrame:
        return evidence.winners(self.conclusions)

    @cached_property
    def devices(self) -> DataFrame:
        return devices.devices(self.folded, self.evidence, self.winners)

    @cached_property
    def identities(self) -> DataFrame:
        return devices.identities(self.folded)

    @cached_property
    def raw_findings(self) -> DataFrame:
        columns = ["seq", "n", "ip", "fact", "key", "value", "conclusion"]
        out = self.folded.where("fact = 'finding'").withColumnRenamed("first_seq", "seq").select(*columns)
        out = out.unionByName(findings.certificate_findings(self.folded, self.now).select(*columns))
        out = out.unionByName(findings.sensor_findings(self.events).select(*columns))
        if self.policy is not None:
            out = out.unionByName(segmentation.violations(self.folded, self.policy).select(*columns))
        return out

    @cached_property
    def findings(self) -> DataFrame:
        return findings.findings(self.raw_findings)

    @cached_property
    def event_counts(self) -> DataFrame:
        return devices.event_counts(self.events)

    @cached_property
    def extent(self) -> DataFrame:
        return devices.extent(self.events)

    @cached_property
    def sensor_health(self) -> DataFrame:
        return findings.sensor_health(self.events)

    @cached_property
    def line_counts(self) -> DataFrame:
        return events.line_counts(self.records)

    def keep_facts(self, path: str) -> Inventory:
        """Write typed events, facts and what they fold to once, so that the gold tables don't parse the records again."""
        for name in ("events", "facts", "folded"):
            table = getattr(self, name)
            table.write.mode("overwrite").parquet(f"{path}/{name}")
            setattr(self, name, self.spark.read.schema(table.schema).parquet(f"{path}/{name}"))
        return self


def scan(spark: SparkSession, inputs: list[str], now: dt.datetime | None = None, last: str = "", since: str = "", until: str = "", zones: str = "", registry: DataFrame | None = None) -> Inventory:
    """The job over files, patterns or folders; ``zones`` is the text of a policy."""
    now = now or dt.datetime.now(dt.UTC)
    start, end = events.window(now, last, since, until)
    policy = segmentation.parse_policy(zones) if zones else None
    return Inventory(events.read_lines(spark, events.expand(spark, inputs)), now, start, end, policy, registry)

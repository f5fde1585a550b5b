"""A watcher's model as kept on disk: folded facts that batches are merged into.

A batch of events is folded on its own and lands as one more table; the model is what all
tables merge to. Compaction merges what has come since into the parts that it touches: parts
by day for presence, by device for all else. Which tables count is told by a manifest. Each
change writes the next manifest, by a name of its own, after its tables: a reader goes on
with the one it has read, a crash leaves the last one in force, and of two writers one fails.
Another run that opens the folder goes on where the last one was.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.operators import fold
from netquarry.sinks.store import Store

VERSION = 2
SCHEMA = "ip string, fact string, key string, value string, conclusion string, weight double, spec int, hour bigint, ord int, n bigint, first_seq bigint, last_seq bigint, first_ts timestamp, last_ts timestamp, last struct<ts: timestamp, seq: bigint, ord: int>"
#: Batches after which they are merged into the parts; parts by device.
BATCHES, BUCKETS = 16, 16
#: Manifests that are kept for readers that began with them, with the tables that they name.
MANIFESTS = 3


class StateError(ValueError):
    """A state folder of another version, or one that two writers change at a time."""


def part() -> Column:
    """The part that a folded row is kept in: d and the day for presence, b and a number of its device for all else."""
    day = F.concat(F.lit("d"), F.floor(F.col("hour") / 24).cast("string"))
    bucket = F.concat(F.lit("b"), F.pmod(F.xxhash64("ip"), F.lit(BUCKETS)).cast("string"))
    return F.when(F.col("hour").isNotNull(), day).otherwise(bucket)


class State:
    """Folded facts in a folder, and counts of lines; see the module."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)
        found = self._manifests()
        if not found and self.store.exists("meta.json"):
            raise StateError(f"{folder} is of an earlier version; start anew from the logs")
        self.manifest = json.loads(self.store.read(found[-1])) if found else {"version": VERSION, "number": 0, "parts": {}, "batches": [], "names": [], "last": {}, "total": 0, "skipped": 0, "rotations": 0, "truncations": 0, "since": None}
        if self.manifest.get("version") != VERSION:
            raise StateError(f"{folder} has version {self.manifest.get('version')}, not {VERSION}")

    def _manifests(self) -> list[str]:
        return sorted(n for n in self.store.names() if re.fullmatch(r"manifest-\d{12}\.json", n))

    def _commit(self, **changes) -> None:
        new = self.manifest | changes | {"number": self.manifest["number"] + 1}
        if not self.store.create(f"manifest-{new['number']:012d}.json", json.dumps(new)):
            raise StateError(f"another writer has changed {self.store.folder}")
        self.manifest = new
        self._clean()

    def _clean(self) -> None:
        """Delete manifests but the last few, and tables that none of those names."""
        names = self._manifests()
        for name in names[:-MANIFESTS]:
            self.store.delete(name)
        if len(names) <= MANIFESTS:
            return
        used = set()
        for name in names[-MANIFESTS:]:
            told = json.loads(self.store.read(name))
            used |= set(told["batches"]) | {p for paths in told["parts"].values() for p in paths}
        for table in self.store.names("tables"):
            folder = f"tables/{table}"
            if folder in used:
                continue
            inner = [n for n in self.store.names(folder) if n.startswith("part=")]
            kept = [n for n in inner if f"{folder}/{n}" in used]
            for n in [f"{folder}/{n}" for n in inner if n not in kept] if kept else [folder]:
                self.store.delete(n)

    def has(self, name: str) -> bool:
        """Whether a batch is in already; those of a numbered stream up to its last one are."""
        stream, _, number = name.rpartition("-")
        return name in self.manifest["names"] or number.isdigit() and int(number) <= self.manifest["last"].get(stream, -1)

    def add(self, name: str, facts: DataFrame, total: int = 0, skipped: int = 0) -> bool:
        """Merge a batch of facts; False if one of that name is in already. ``stream-number`` names count up.

        Only the batch is read. Its rows merge with what is there when the model is read.
        """
        if self.has(name):
            return False
        table = f"tables/{uuid.uuid4().hex}"
        self._write(fold.fold(facts), table)
        stream, _, number = name.rpartition("-")
        told = {"last": self.manifest["last"] | {stream: int(number)}} if number.isdigit() else {"names": [*self.manifest["names"], name]}
        self._commit(batches=[*self.manifest["batches"], table], total=self.manifest["total"] + total, skipped=self.manifest["skipped"] + skipped, **told)
        if len(self.manifest["batches"]) >= BATCHES:
            self.compact()
        return True

    def count(self, rotations: int, truncations: int, batch: int) -> None:
        """Note how often the followed file was renamed away or cut off, in all, up to a batch."""
        if (rotations, truncations) != (self.manifest["rotations"], self.manifest["truncations"]):
            self._commit(rotations=rotations, truncations=truncations, last=self.manifest["last"] | {"turns": batch})

    def set_baseline(self, name: str) -> None:
        """Note which report was told last."""
        self._commit(baseline=name, reported=self.manifest["number"] + 1)

    def _write(self, rows: DataFrame, table: str) -> None:
        """By part; large parts in several files, small ones in one."""
        rows.selectExpr(*[c.strip().split(" ")[0] for c in re.sub(r"<[^>]*>", "", SCHEMA).split(",")]).withColumn("part", part()).hint("rebalance", F.col("part")).write.partitionBy("part").parquet(self.store.path(table))

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*[self.store.path(p) for p in paths]) if paths else self.spark.createDataFrame([], SCHEMA)

    def _tables(self, only: set[str] | None = None) -> list[str]:
        """Folders of parts of the tables and of batches that have come since."""
        parts = [p for name, paths in self.manifest["parts"].items() if only is None or name in only for p in paths]
        since = [f"{b}/part={n}" for b in self.manifest["batches"] for n in self._parts_of(b) if only is None or n in only]
        return parts + since

    def _parts_of(self, table: str) -> list[str]:
        return [n.removeprefix("part=") for n in self.store.names(table) if n.startswith("part=")]

    def folded(self) -> DataFrame:
        """The whole model, one row for all facts that say the same."""
        rows = self._read(self._tables())
        return fold.merged(rows) if self.manifest["batches"] else rows

    def _replace(self, rows: DataFrame, touched: set[str], **changes) -> None:
        """Write these rows in place of the touched parts."""
        table = f"tables/{uuid.uuid4().hex}"
        self._write(rows, table)
        parts = {n: p for n, p in self.manifest["parts"].items() if n not in touched} | {n: [f"{table}/part={n}"] for n in self._parts_of(table)}
        self._commit(parts=parts, **changes)

    def compact(self) -> None:
        """Merge the batches into the parts that they touch; no other part is read or written."""
        touched = {n for b in self.manifest["batches"] for n in self._parts_of(b)}
        if self.manifest["batches"]:
            self._replace(fold.merged(self._read(self._tables(touched))), touched, batches=[])

    def retain(self, before: dt.datetime) -> int:
        """Forget devices not seen since ``before`` and hours before its hour; returns how many devices went.

        Whole days go with their part, unread but for the first times of devices that stay;
        of parts by device, those are written anew that hold something to forget.
        """
        self.compact()
        days, hour = {n for n in self.manifest["parts"] if n[0] == "d"}, fold.hour_of(before)
        old = {n for n in days if int(n[1:]) * 24 <= hour}
        model = self._read(self._tables())
        seen, device = model.where("fact = 'seen'").select("ip").distinct(), F.col("ip") != ""
        alive = fold.alive(self._read(self._tables(days)), before)
        silent = seen.join(alive, "ip", "left_anti").count()
        dead = self._read(self._tables(set(self.manifest["parts"]) - days)).where(device).join(alive, "ip", "left_anti").select(part().alias("part")).distinct()
        touched = old | {r["part"] for r in dead.collect()}  # names of parts
        if not touched:
            return 0
        first = self._read(self._tables(old)).join(alive, "ip", "left_semi")
        cut = fold.since(first, before)
        buckets = {n for n in touched if n[0] == "b"} | {r["part"] for r in cut.where("fact = 'since'").select(part().alias("part")).distinct().collect()}
        rest = self._read(self._tables(buckets))
        rest = rest.where(device).join(alive, "ip", "left_semi").unionByName(rest.where(~device))
        start = before.isoformat()
        self._replace(fold.merged(rest.unionByName(cut)), touched | buckets, since=max(start, self.manifest["since"] or start))
        return silent

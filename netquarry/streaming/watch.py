"""The long-running job: what comes is merged into a kept model, reports are made of it, changes told.

A micro-batch adds its folded facts to the state (streaming.state) under its own number, so
that a batch run again counts once. Folded facts don't depend on the order or the time of
arrival: late events need no watermark. Reports are written and changes told by a clock of
their own, if something has come since; what the last report said is kept as tables too, so
a restart neither repeats nor misses a change.
"""

from __future__ import annotations

import datetime as dt
import json
import sys
import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from netquarry.operators import fold, handlers, segmentation, snapshot
from netquarry.plans.scan import Inventory
from netquarry.sinks import files, html, text
from netquarry.sources import events
from netquarry.streaming import tail
from netquarry.streaming.state import State, StateError

__all__ = ["Outputs", "StateError", "Watch"]


@dataclass
class Outputs:
    """What a watcher writes; at least one must be given."""

    html: str = ""
    snapshot: str = ""
    changes: str = ""
    on_change: str = ""
    notify: bool = False

    def some(self) -> bool:
        return bool(self.html or self.snapshot or self.changes or self.on_change or self.notify)


def facts_of(typed: DataFrame) -> DataFrame:
    """The facts of events, and what is kept of events that are no device's."""
    facts = handlers.facts(typed)
    return facts.unionByName(fold.common(typed).select(*facts.columns))


class Turns(StreamingQueryListener):
    """Counts of renamed and cut-off files, from the offsets of a query's progress."""

    def __init__(self, watch: Watch):
        self.watch = watch

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        source = event.progress.sources[0]
        offsets = [str(o) for o in (source.startOffset, source.endOffset)]
        if event.progress.name == self.watch.query_name and all(o.startswith("{") for o in offsets):  # the first batch has no start
            self.watch.turned(event.progress.batchId, *map(json.loads, offsets))

    def onQueryTerminated(self, event) -> None:
        pass


class Watch:
    """A model in a folder, and what of it has been told."""

    def __init__(self, spark: SparkSession, state: str, policy: segmentation.Policy | None = None, retain: dt.timedelta | None = None):
        self.spark, self.policy, self.retain = spark, policy, retain
        self.kept = State(spark, state)
        self.query_name = f"netquarry-{uuid.uuid4().hex}"
        self._lock = threading.RLock()  # batches, reports and counts follow each other
        self._pending = {"write": False, "notify": False}
        self._last: dict[str, dt.datetime | None] = {"write": None, "notify": None}

    def add(self, lines: DataFrame, batch: str) -> bool:
        """Merge a batch of lines; False if it had none, or is in already."""
        if self.kept.has(batch):
            return False
        total = lines.where(F.length(F.regexp_replace(F.coalesce("line", F.lit("")), r"\s", "")) > 0).count()
        if not total:
            return False
        typed = self._rewritten(events.events(events.records(lines)), "typed")
        facts = self._rewritten(facts_of(typed), "facts")
        return self.kept.add(batch, facts, total, total - typed.count())

    def _rewritten(self, table: DataFrame, name: str) -> DataFrame:
        """A batch's table, in place of the last batch's."""
        path = self.kept.store.path(name)
        table.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)

    def catch_up(self, path: str) -> list[str]:
        """Take in the rotated files beside the followed one, each once, by what it holds; files that can't be read are returned and left out."""
        failed = []
        for k, name in enumerate(tail.siblings(path)):
            try:
                size = tail.length(name)
                lines = events.read_lines(self.spark, [name]).select("line", (F.col("seq.place") - F.lit((1 << 62) - (k << 40))).alias("seq"))
                self.add(lines, f"{tail.signature(name, size)}:{size}")
            except Exception as error:  # noqa: BLE001  what is wrong with one old file must not keep the watcher from starting
                failed.append(f"{name}: {error}")
        return failed

    def turned(self, batch: int, start: dict, end: dict) -> None:
        """Count the renamed and cut-off files between two offsets of a batch, once."""
        with self._lock:
            told = self.kept.manifest
            if batch > told["last"].get("turns", -1):
                renamed, cut = tail.turns(start, end)
                self.kept.count(told["rotations"] + renamed, told["truncations"] + cut, batch)

    def counts(self) -> dict[str, int]:
        """Lines, those that couldn't be read, and how often the log was renamed away or cut off in place."""
        return {k: self.kept.manifest[k] for k in ("total", "skipped", "rotations", "truncations")}

    def inventory(self, now: dt.datetime) -> Inventory:
        """The gold tables of what is kept; what all of them read, and what several outputs read, is written once."""
        found, counts, since, store = Inventory(None, now, policy=self.policy), self.counts(), self.kept.manifest["since"], self.kept.store
        for old in store.names("reports")[:-1]:
            store.delete(f"reports/{old}")
        folder = f"reports/{time.time_ns():020d}"

        def landed(table: DataFrame, name: str) -> DataFrame:
            table.write.parquet(store.path(f"{folder}/{name}"))
            return self.spark.read.schema(table.schema).parquet(store.path(f"{folder}/{name}"))

        kept = self.kept.folded()
        if self.retain is not None:
            kept = fold.retained(kept, now - self.retain)
            since = max(since or "", (now - self.retain).isoformat())
        found.folded = landed(kept, "folded")
        found.events, found.event_counts, found.extent = fold.stats_events(found.folded), fold.event_counts(found.folded), fold.extent(found.folded)
        found.devices, found.findings = landed(found.devices, "devices"), landed(found.findings, "findings")
        if since:
            found.extent = found.extent.withColumn("first_event", F.greatest("first_event", F.lit(dt.datetime.fromisoformat(since))))
        found.line_counts = self.spark.createDataFrame([(counts["total"], counts["skipped"])], "total bigint, skipped bigint")
        return found

    def _baseline(self) -> tuple[DataFrame, DataFrame] | None:
        name = self.kept.manifest.get("baseline")
        if not name:
            return None
        return tuple(self.spark.read.parquet(self.kept.store.path(f"baseline/{name}/{t}")) for t in ("devices", "findings"))

    def _set_baseline(self, found: Inventory, now: dt.datetime) -> None:
        name, store = f"{now:%Y%m%dT%H%M%S%f}", self.kept.store
        snapshot.exported(found.devices).write.mode("overwrite").parquet(store.path(f"baseline/{name}/devices"))
        found.findings.write.mode("overwrite").parquet(store.path(f"baseline/{name}/findings"))
        self.kept.set_baseline(name)
        for old in store.names("baseline"):
            if old != name:
                store.delete(f"baseline/{old}")

    def report(self, now: dt.datetime, source: str, out: Outputs, found: Inventory | None = None) -> dict | None:
        """Tell what changed since the last report, which this one replaces if its hook succeeds; None the first time."""
        found, before = found or self.inventory(now), self._baseline()
        document = None
        if before is not None:
            document = text.compare(before, (snapshot.exported(found.devices), found.findings)).document()
            if text.total(document):
                said = text.diff_report(document)
                if out.changes:
                    files.append_change(out.changes, now, source, document)
                if out.on_change and not files.run_hook(out.on_change, said, {k: len(v) for k, v in document.items()} | {"total": text.total(document)}):
                    return document  # told again next time
                if out.notify:
                    print(said)
        self._set_baseline(found, now)
        return document

    def refresh(self, now: dt.datetime, source: str, out: Outputs, found: Inventory | None = None) -> None:
        """Write the reports anew."""
        found = found or self.inventory(now)
        if out.snapshot:
            files.write_snapshot(found, out.snapshot, source, now)
        if out.html:
            files.replace_file(out.html, html.page(found, refresh=30))

    def tick(self, now: dt.datetime, source: str, out: Outputs, every: float, notify: float, at_once: bool = False, begun: dt.datetime | None = None) -> list[str]:
        """Do what is due of writing and telling, if something has come since it was done last; returns what was done.

        What was never done is due at once, or its time after ``begun``.
        """
        with self._lock:
            past = lambda at, span: at is None or (now - at).total_seconds() >= span
            due = lambda what, span: self._pending[what] and (at_once or past(self._last[what] or begun, span))
            todo = [what for what, span in (("write", every), ("notify", notify)) if due(what, span)]
            if todo:
                if self.retain is not None:
                    self.kept.retain(now - self.retain)
                found = self.inventory(now)
            for what, do in (("write", self.refresh), ("notify", self.report)):
                if what in todo:
                    do(now, source, out, found)
                    self._pending[what], self._last[what] = False, now
            return todo

    def run(self, path: str, out: Outputs, every: float = 60, poll: float = 2, notify: float = 3600, catch_up: bool = True, once: bool = False, clock=lambda: dt.datetime.now(dt.UTC), size: int = tail.RANGE_BYTES) -> StreamingQuery:
        """Follow ``path``; reports are written at most every ``every`` seconds, changes told every ``notify`` seconds, within that time of what came.

        once: take in what is there, report and stop. The query's checkpoint is in the state
        folder, so a restart goes on at the byte where it was.
        """
        if not out.some():
            raise ValueError("nothing to write: give an HTML file, a snapshot, a change log or a command")
        store = self.kept.store
        if not store.exists("begin.json"):  # before rotated files are listed: what is renamed after this is followed
            store.create("begin.json", json.dumps(tail.begin(path)))
            if not catch_up:
                store.create("caught-up", "")
        if not store.exists("caught-up"):
            for said in self.catch_up(path):
                print(f"left out: {said}", file=sys.stderr)
            store.create("caught-up", "")
        self._pending = dict.fromkeys(self._pending, self.kept.manifest["number"] > self.kept.manifest.get("reported", 0))

        def each(batch: DataFrame, number: int) -> None:
            with self._lock:
                if self.add(batch.select("line", "seq"), f"new-{number}"):
                    self._pending = dict.fromkeys(self._pending, True)
                self.tick(clock(), path, out, every, notify, at_once=once)

        listener = Turns(self)
        self.spark.streams.addListener(listener)
        lines = tail.follow(self.spark, path, json.loads(store.read("begin.json")), size)
        writer = lines.writeStream.queryName(self.query_name).foreachBatch(each).option("checkpointLocation", store.path("checkpoint"))
        query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{poll} seconds")).start()

        def keep_time() -> None:
            """What has come is reported when it is due, whether more comes or not; and at the end."""
            begun = clock()
            while query.isActive:
                try:
                    self.tick(clock(), path, out, every, notify, begun=begun)
                except Exception as error:  # noqa: BLE001  a report that fails is tried again, the log is followed meanwhile
                    print(f"report: {error}", file=sys.stderr)
                time.sleep(min(poll, 1))
            if once:  # only rotated files, and nothing new
                self.tick(clock(), path, out, every, notify, at_once=True)
            time.sleep(2)  # the last batch's progress is told after its end
            self.spark.streams.removeListener(listener)

        threading.Thread(target=keep_time, daemon=True).start()
        return query

    def stop(self, query: StreamingQuery, path: str, out: Outputs, now: dt.datetime) -> None:
        """End a query and report what is pending."""
        query.stop()
        self.tick(now, path, out, 0, 0, at_once=True)

"""Command line: scan, watch, diff and registry."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from netquarry.operators import segmentation
from netquarry.plans.scan import scan
from netquarry.sinks import files, html, text
from netquarry.sources import events, registry


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="netquarry", description=__doc__)
    kinds = top.add_subparsers(dest="kind", required=True)
    s = kinds.add_parser("scan", help="read logs once")
    s.add_argument("inputs", nargs="*", default=["-"], help="files, patterns, folders, or - for standard input")
    s.add_argument("-v", dest="verbose", action="store_true")
    s.add_argument("--min-confidence", type=float, default=0.0)
    for name in ("html", "json", "netbox", "last", "since", "until", "zones", "registry"):
        s.add_argument(f"--{name}", default="")
    w = kinds.add_parser("watch", help="follow a log")
    w.add_argument("path")
    w.add_argument("--state", required=True)
    for name in ("html", "json", "changes", "on-change", "zones", "retain"):
        w.add_argument(f"--{name}", default="")
    for name, value in (("every", "60s"), ("poll", "2s"), ("notify", "1h")):
        w.add_argument(f"--{name}", default=value)
    w.add_argument("--no-catchup", action="store_true")
    w.add_argument("-q", dest="quiet", action="store_true")
    d = kinds.add_parser("diff", help="compare two snapshots; exit code 1 if they differ")
    d.add_argument("before")
    d.add_argument("after")
    d.add_argument("--json", action="store_true")
    d.add_argument("-q", dest="quiet", action="store_true")
    r = kinds.add_parser("registry", help="build a table of hardware address prefixes from the registries' CSV files")
    r.add_argument("inputs", nargs="+")
    r.add_argument("--out", required=True)
    return top


def _text(path: str) -> str:
    if not path:
        return ""
    with open(path, encoding="utf-8") as file:
        return file.read()


def run(spark: SparkSession, args: list[str]) -> int:
    o = _parser().parse_args(args)
    if o.kind == "registry":
        registry.build(spark, o.inputs).orderBy("prefix").write.mode("overwrite").option("sep", "\t").csv(o.out)
        return 0
    if o.kind == "diff":
        document = text.compare(files.read_snapshot(spark, o.before), files.read_snapshot(spark, o.after)).document()
        if not o.quiet:
            print(json.dumps(document, indent=2, ensure_ascii=False) if o.json else text.diff_report(document))
        return 1 if text.total(document) else 0
    if o.kind == "watch":
        from netquarry.streaming.watch import Outputs, Watch

        retain = events.retention(o.retain)
        policy = segmentation.parse_policy(_text(o.zones)) if o.zones else None
        out = Outputs(o.html, o.json, o.changes, o.on_change, not o.quiet)
        seconds = {n: events.span(getattr(o, n)).total_seconds() for n in ("every", "poll", "notify")}
        Watch(spark, o.state, policy, retain).run(o.path, out, catch_up=not o.no_catchup, **seconds).awaitTermination()
        return 0
    inputs = o.inputs
    if inputs == ["-"]:
        with tempfile.NamedTemporaryFile("w", suffix=".json", delete=False) as file:
            file.writelines(sys.stdin)
        inputs = [file.name]
    vendors = spark.read.option("sep", "\t").schema("prefix string, vendor string").csv(o.registry) if o.registry else None
    found = scan(spark, inputs, dt.datetime.now(dt.UTC), o.last, o.since, o.until, _text(o.zones), vendors)
    with tempfile.TemporaryDirectory() as folder:
        found.keep_facts(folder if spark.sparkContext.master.startswith("local") else f"{spark.conf.get('spark.checkpoint.dir')}/scan")
        if o.json:
            files.write_snapshot(found, o.json, ", ".join(inputs))
        if o.netbox:
            files.write_netbox(found, o.netbox)
        if o.html:
            files.replace_file(o.html, html.page(found))
        if not (o.json or o.netbox or o.html):
            print(text.inventory_report(found, o.min_confidence, o.verbose))
            counts = found.line_counts.select(F.col("skipped")).first()
            if counts["skipped"]:
                print(f"{text.plural(counts['skipped'], 'line')} couldn't be read")
    return 0


def main() -> int:
    spark = SparkSession.builder.appName("netquarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        return run(spark, sys.argv[1:])
    except (FileNotFoundError, ValueError) as error:
        print(f"netquarry: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

"""Writing results: whole files that replace the old ones at once, tables, change logs and hooks."""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import os
import subprocess
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions import net
from netquarry.operators import devices, findings, snapshot
from netquarry.plans.scan import Inventory

TOOL = "netquarry"
DEVICE = """ip string, mac string, random_mac boolean, hostname string, hostnames array<string>, class string, confidence double, vendor string, os string, model string,
firmware string, serial string, services array<struct<port:int,proto:string,app_proto:string>>, protocols array<string>, users array<string>, shares array<string>, vlans array<int>,
ot_identifiers array<string>, ja4 array<string>, first_seen timestamp, last_seen timestamp, alerts bigint, anomalies bigint, evidence array<struct<signal:string,value:string,conclusion:string,weight:double>>"""
FINDING = "severity string, kind string, device string, title string, detail string, fix string"
IDENTITY = "user string, devices array<string>"
SNAPSHOT = f"schema int, tool string, source string, generated string, first_event string, last_event string, events bigint, skipped bigint, devices array<struct<{{d}}>>, findings array<struct<{FINDING.replace(' ', ':').replace(',:', ', ')}>>, identities array<struct<user:string, devices:array<string>>>"


def replace_file(path: str, text: str) -> None:
    """Write beside the file and put it in its place, so that readers see the old text or the new one; ``-`` prints it."""
    if path == "-":
        sys.stdout.write(text)
        return
    folder = os.path.dirname(os.path.abspath(path))
    handle, own = tempfile.mkstemp(dir=folder, prefix=".", suffix=".part")
    with os.fdopen(handle, "w", encoding="utf-8", newline="") as file:
        file.write(text)
    os.chmod(own, 0o644)
    os.replace(own, path)


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return {str(k): _plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def rows(df: DataFrame) -> list[dict]:
    """The rows of a gold table that goes into a document for people, read a partition at a time."""
    return [_plain(r) for r in df.toLocalIterator()]


def snapshot_document(found: Inventory, source: str = "", generated: dt.datetime | None = None) -> dict:
    """The versioned document of an inventory: devices by address, findings worst first, accounts by number of devices."""
    extent, counts = found.extent.first(), found.line_counts.first()
    return {
        "schema": snapshot.SCHEMA_VERSION,
        "tool": TOOL,
        "source": source,
        "generated": (generated or found.now).isoformat(),
        "first_event": _plain(extent["first_event"]),
        "last_event": _plain(extent["last_event"]),
        "events": extent["events"],
        "skipped": counts["skipped"],
        "devices": rows(snapshot.exported(found.devices).orderBy(net.ip_key(F.col("ip")))),
        "findings": rows(findings.ordered(found.findings).select("severity", "kind", "device", "title", "detail", "fix")),
        "identities": rows(devices.identities_ordered(found.identities).select("user", "devices")),
    }


def write_snapshot(found: Inventory, path: str, source: str = "", generated: dt.datetime | None = None) -> None:
    replace_file(path, json.dumps(snapshot_document(found, source, generated), indent=2, ensure_ascii=False) + "\n")


def write_tables(found: Inventory, folder: str, name: str) -> None:
    """The same as Parquet tables, one folder a snapshot: for inventories too large for one document."""
    snapshot.exported(found.devices).write.mode("overwrite").parquet(f"{folder}/devices/snapshot={name}")
    found.findings.drop("first_seq").write.mode("overwrite").parquet(f"{folder}/findings/snapshot={name}")
    found.identities.write.mode("overwrite").parquet(f"{folder}/identities/snapshot={name}")


class SnapshotError(ValueError):
    """A file that is no snapshot, or of a later version."""


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Devices and findings of a snapshot document."""
    fields = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in spark.createDataFrame([], DEVICE).schema)
    doc = spark.read.schema(SNAPSHOT.format(d=fields)).option("multiLine", True).json(path)
    version = (doc.select(F.coalesce("schema", F.lit(0))).first() or [0])[0]
    if version < 1:
        raise SnapshotError(f"{path} is no snapshot")
    if version > snapshot.SCHEMA_VERSION:
        raise SnapshotError(f"{path} has version {version}; this program reads up to {snapshot.SCHEMA_VERSION}")
    return doc.select(F.explode("devices").alias("d")).select("d.*"), doc.select(F.explode("findings").alias("f")).select("f.*")


def write_netbox(found: Inventory, path: str) -> None:
    """The address import as CSV."""
    out = io.StringIO()
    table = snapshot.netbox(found.devices.orderBy(net.ip_key(F.col("ip"))))
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(table.columns)
    for row in table.toLocalIterator():
        writer.writerow(row)
    replace_file(path, out.getvalue())


def append_change(path: str, at: dt.datetime, source: str, diff: dict) -> None:
    """One more line in a change log."""
    with open(path, "a", encoding="utf-8") as file:
        file.write(json.dumps({"at": at.isoformat(), "source": source, **diff}, ensure_ascii=False) + "\n")


HOOK_SECONDS = 30


def run_hook(command: str, report: str, counts: dict[str, int], timeout: float = HOOK_SECONDS) -> bool:
    """Run a shell command with the report on its input and the counts in its environment; False if it failed or took too long."""
    names = {f"NETQUARRY_{k.upper()}": str(v) for k, v in counts.items()}
    try:
        return subprocess.run(command, shell=True, input=report, text=True, env=os.environ | names, timeout=timeout, check=False).returncode == 0
    except subprocess.TimeoutExpired:
        return False

"""Reports in plain text: an inventory, and what changed between two."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions import net
from netquarry.operators import devices, findings, reports, snapshot
from netquarry.plans.scan import Inventory
from netquarry.sinks.files import rows

SERVICES_SHOWN = 8


def plural(n: int, one: str, many: str = "") -> str:
    return f"{n:,} {one if n == 1 else many or one + 's'}"


def services(ports: list[dict]) -> str:
    """Port/protocol of the first services, and how many more there are."""
    shown = [f"{s['port']}" + (f"/{s['app_proto']}" if s["app_proto"] else "") for s in ports[:SERVICES_SHOWN]]
    return ", ".join(shown) + (f" +{len(ports) - SERVICES_SHOWN} more" if len(ports) > SERVICES_SHOWN else "")


def identity(d: dict) -> str:
    said = " ".join(x for x in (d["vendor"], d["model"] or d["class"]) if x)
    return " · ".join(x for x in (said, d["os"]) if x) or "unidentified"


def inventory_report(found: Inventory, min_confidence: float = 0.0, verbose: bool = False) -> str:
    """Coverage, devices (surest first), findings (worst first) and a summary."""
    out = ["Coverage"]
    for c in rows(reports.coverage(found.event_counts, reports.WANTED_SHORT).orderBy("place")):
        out.append(f"  {c['event_type']:<6} " + (f"{c['n']:>12,}" if c["present"] else "     not seen"))
    out += ["", "Devices"]
    for d in rows(devices.ordered(found.devices.where(F.col("confidence") >= min_confidence))):
        out.append(f"  {d['ip']:<16} {d['hostname'] or '-':<28} {d['confidence']:>4.0%}  {identity(d)}")
        if d["services"]:
            out.append(f"      ports {services(d['services'])}")
        if verbose:
            for e in sorted(d["evidence"], key=lambda e: -e["weight"]):
                out.append(f"      {e['weight']:.2f} {e['conclusion']}  {e['signal']}: {e['value'][:80]}")
    out += ["", "Findings"]
    for f in rows(findings.ordered(found.findings)):
        out.append(f"  {f['severity']:<8} {f['device']:<16} {f['title']}" + (f" ({f['count']:,} times)" if f["count"] > 1 else ""))
        out += [f"           {f['detail']}", f"           {f['fix']}"]
    s = reports.summary(found.devices).first()
    classes = rows(reports.class_counts(found.devices).orderBy(F.desc("n"), "class"))
    out += ["", f"{plural(s['devices'], 'device')}, {s['identified']:,} identified, {s['named']:,} with a name, {s['with_users']:,} with accounts", "  ".join(f"{c['class'] or 'other'} {c['n']:,}" for c in classes)]
    return "\n".join(out) + "\n"


@dataclass
class Diff:
    """What changed between two snapshots."""

    appeared: DataFrame
    disappeared: DataFrame
    changed: DataFrame
    new_findings: DataFrame
    fixed_findings: DataFrame

    def document(self) -> dict:
        """The parts as lists, devices by address; none is null."""
        by_ip = lambda df: rows(df.orderBy(net.ip_key(F.col("ip")), "key"))
        by_rank = lambda df: rows(df.select("severity", "kind", "device", "title", "detail").orderBy(F.desc(findings.rank(F.col("severity"))), net.ip_key(F.col("device")), "kind"))
        return {"appeared": by_ip(self.appeared), "disappeared": by_ip(self.disappeared), "changed": by_ip(self.changed), "new_findings": by_rank(self.new_findings), "fixed_findings": by_rank(self.fixed_findings)}


def compare(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> Diff:
    """The difference of two (devices, findings)."""
    (old, old_findings), (new, new_findings) = before, after
    return Diff(snapshot.appeared(old, new), snapshot.appeared(new, old), snapshot.changed(old, new), snapshot.findings_only_in(new_findings, old_findings), snapshot.findings_only_in(old_findings, new_findings))


def total(document: dict) -> int:
    return sum(len(part) for part in document.values())


def diff_report(document: dict) -> str:
    """A difference for people."""
    if not total(document):
        return "No changes.\n"
    out = []
    for part, title in (("appeared", "Appeared"), ("disappeared", "Disappeared")):
        if document[part]:
            out += [f"{title} ({len(document[part])})", *[f"  {d['label']}  {d['detail']}" for d in document[part]], ""]
    if document["changed"]:
        out.append(f"Changed ({len(document['changed'])})")
        for d in document["changed"]:
            out.append(f"  {d['label']}  {d['ip']}")
            for f in d["fields"]:
                out.append(f"    {f['field']}: {f['to'] or f['from']}" if f["list"] else f"    {f['field']}: {f['from'] or '(none)'} -> {f['to'] or '(none)'}")
        out.append("")
    for part, title in (("new_findings", "New findings"), ("fixed_findings", "No longer found")):
        if document[part]:
            out += [f"{title} ({len(document[part])})", *[f"  {f['severity']:<8} {f['device']:<16} {f['title']}" for f in document[part]], ""]
    return "\n".join(out)

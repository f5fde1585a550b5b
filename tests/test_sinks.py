"""Reports, snapshots, the command line."""

import csv
import datetime as dt
import gzip
import json
import os
import shutil
import subprocess

import pytest

from netquarry.__main__ import run
from netquarry.operators import devices, findings, reports
from netquarry.plans.scan import scan
from netquarry.sinks import files, html, text
from netquarry.sources import events, registry


def put(path, *records):
    opened = gzip.open if path.endswith(".gz") else open
    with opened(path, "wt") as file:
        file.writelines(json.dumps(r) + "\n" for r in records)


A = {"timestamp": "2026-07-30T09:00:00Z", "event_type": "dhcp", "dhcp": {"assigned_ip": "10.0.0.5", "client_mac": "00:15:5d:00:00:01", "hostname": "<b>pc</b>"}}
B = {"timestamp": "2026-07-30T19:00:00Z", "event_type": "flow", "src_ip": "10.0.0.6", "dest_ip": "10.0.0.5", "dest_port": 9100, "proto": "TCP"}
C = {"timestamp": "2026-07-31T09:00:00Z", "event_type": "tftp", "src_ip": "10.0.0.6", "dest_ip": "10.0.0.7"}


def test_scan_and_diff(spark, tmp_path, capsys):
    folder = tmp_path / "logs"
    folder.mkdir()
    put(str(folder / "eve-1.json.gz"), A)
    put(str(folder / "eve-2.json"), B)
    put(str(folder / "other.txt"), C)
    before, after, page, table = (str(tmp_path / n) for n in ("a.json", "b.json", "page.html", "net.csv"))
    assert run(spark, ["scan", "--json", before, "--html", page, "--netbox", table, str(folder)]) == 0
    put(str(folder / "eve-3.json"), C)
    assert run(spark, ["scan", "--json", after, str(folder)]) == 0
    assert run(spark, ["scan", "--min-confidence", "0.1", "-v", str(folder)]) == 0
    said = capsys.readouterr().out
    assert "10.0.0.5" in said and "TFTP in use" in said and "tls" in said
    assert "<b>pc" not in open(page).read() and "&lt;b&gt;pc" in open(page).read()
    assert [r["address"] for r in csv.DictReader(open(table))] == ["10.0.0.5/32", "10.0.0.6/32"]
    assert run(spark, ["diff", before, before]) == 0
    assert run(spark, ["diff", "--json", before, after]) == 1
    shown = json.loads(capsys.readouterr().out.split("No changes.\n")[1])
    assert [d["ip"] for d in shown["appeared"]] == ["10.0.0.7"] and [f["kind"] for f in shown["new_findings"]] == ["tftp-in-use"] and shown["disappeared"] == []
    assert "Appeared (1)" in text.diff_report(shown)
    with pytest.raises(FileNotFoundError):
        events.expand(spark, [str(tmp_path / "none*")])


def test_snapshots_of_other_kinds(spark, tmp_path):
    for k, doc in enumerate(({"x": 1}, {"schema": 99})):
        path = str(tmp_path / f"{k}.json")
        with open(path, "w") as file:
            json.dump(doc, file)
        with pytest.raises(files.SnapshotError):
            files.read_snapshot(spark, path)


def test_files(tmp_path):
    path = str(tmp_path / "f")
    files.replace_file(path, "a")
    files.replace_file(path, "b")
    assert open(path).read() == "b" and os.listdir(tmp_path) == ["f"]
    log = str(tmp_path / "log")
    for _ in range(2):
        files.append_change(log, dt.datetime(2026, 1, 1, tzinfo=dt.UTC), "s", {"appeared": []})
    assert len(open(log).readlines()) == 2
    assert files.run_hook(f"cat > {path}; test $NETQUARRY_TOTAL = 3", "said", {"total": 3}) and open(path).read() == "said"
    assert not files.run_hook("sleep 5", "", {}, timeout=0.2)
    assert text.services([{"port": p, "app_proto": ""} for p in range(10)]).endswith("+2 more")


def test_registry(spark, tmp_path):
    big, small = str(tmp_path / "l.csv"), str(tmp_path / "s.csv")
    head = "Registry,Assignment,Organization Name,Organization Address\n"
    with open(big, "w") as file:
        file.write(head + 'MA-L,00005E,"Acme Co., Ltd.","Street ""1"",\nTown"\nMA-L,AABBCC,Private,x\nMA-L,DDDDDD,IEEE Registration Authority,x\n')
    with open(small, "w") as file:
        file.write(head + "MA-S,00005E001,Small GmbH,y\nMA-S,00005E,Later Inc,y\n")
    assert {tuple(r) for r in registry.build(spark, [big, small]).collect()} == {("00005E", "Later"), ("00005E001", "Small")}


def test_coverage_of_nothing(spark):
    assert reports.coverage(spark.createDataFrame([], "event_type string, n bigint")).where("present").isEmpty()


def test_page_panels(spark, tmp_path):
    """What the page's script counts for a range is what the tables say."""
    records = []
    for k in range(60):
        at, ip = f"2026-07-{28 + k // 20}T{k % 20:02d}:10:00Z", f"10.0.{k % 3}.{k % 7}"
        records.append({"timestamp": at, "event_type": "tftp", "src_ip": ip, "dest_ip": f"10.1.0.{k % 4}"})
        records.append({"timestamp": at, "event_type": "smb", "app_proto": "smb", "src_ip": ip, "dest_ip": "10.1.0.1", "dest_port": 445, "smb": {"dialect": "NT LM 0.12" if k % 5 else "3.11", "ntlmssp": {"user": f"</script>u{k % 4}", "host": f"pc{k % 7}"}}})
    early = {"timestamp": "2026-07-28T00:00:00Z", "src_ip": "10.9.9.9", "dest_ip": "10.9.9.8"}  # silent afterwards, with findings
    records += [early | {"event_type": "tftp"}, early | {"event_type": "smb", "smb": {"dialect": "NT LM 0.12"}}]
    put(str(tmp_path / "eve.json"), *records)
    found = scan(spark, [str(tmp_path / "eve.json")], dt.datetime(2026, 8, 1, tzinfo=dt.UTC)).keep_facts(str(tmp_path / "kept"))
    for name in ("devices", "findings"):
        getattr(found, name).write.parquet(str(tmp_path / name))
        setattr(found, name, spark.read.parquet(str(tmp_path / name)))
    page = html.page(found, refresh=30)
    assert page.count("</script>") == 1 and "value=24 selected" in page and "value=168 disabled" in page and ">last 72 h" in page
    assert [tuple(r) for r in reports.presets(found.extent).collect()] == [(24, True), (72, True), (168, False), (336, False), (720, False)]
    script = page.split("<script>")[1].split("</script>")[0]
    data = json.loads(script[len("const DATA=") : script.index("\nconst total") - 1])
    assert data["refresh"] == 30 and len(data["findings"]) == found.findings.count() and {d["kind"] for d in data["devices"]} >= {r["class"] or "other" for r in reports.class_counts(found.devices).collect()}
    if not shutil.which("node"):
        pytest.skip("nothing here runs the page's script")
    (tmp_path / "whole.js").write_text(script)
    assert subprocess.run(["node", "--check", str(tmp_path / "whole.js")], check=False).returncode == 0
    said = html.PANELS + f"const d={html.embedded(data)};console.log(JSON.stringify([panels(d,[30,40],''),panels(d,null,'PC3'),panels(d,null,'')]))"
    part, named, whole = json.loads(subprocess.run(["node", "-e", said], capture_output=True, text=True, check=True).stdout)
    shown = reports.visible(found.devices, reports.bucket_strings(devices.activity(found.folded), found.extent), 30, 40)
    pairs = lambda df: [list(r) for r in df.collect()]
    assert sorted(part["shown"]) == sorted(r["ip"] for r in shown.collect()) and 0 < part["devices"] < whole["devices"]
    one = reports.summary(shown).first()
    assert (part["devices"], part["identified"], part["named"]) == (one["devices"], one["identified"], one["named"])
    assert part["protocols"] == pairs(reports.most_common(shown, "protocols")) and part["users"] == pairs(reports.most_common(shown, "users"))
    assert dict(map(tuple, part["classes"])) == {r["class"] or "other": r["n"] for r in reports.class_counts(shown).collect()}
    volumes = reports.talkers(shown, 1000).collect()
    assert [t[1] for t in part["talkers"]] == [r["volume"] for r in volumes][:6] and {tuple(t) for t in part["talkers"]} <= {tuple(r) for r in volumes}
    assert dict(map(tuple, part["severities"])) == {r["severity"]: r["n"] for r in reports.severities(shown, found.findings).collect() if r["severity"] != "INFO"}
    held = reports.findings_held(found.findings, shown).first()
    assert (part["held"], part["heldCritical"]) == (held["held"], held["held_critical"]) and held["held"] > 0 and part["findings"] == reports.findings_shown(found.findings, shown).count()
    assert sorted(named["shown"]) == sorted(r["ip"] for r in reports.search(found.devices, "PC3").collect()) and named["held"] == 0
    assert findings.worst(found.findings).where("worst = 'INFO'").isEmpty()

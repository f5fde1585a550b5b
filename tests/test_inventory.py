"""Records in, devices and findings out."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from netquarry.functions import access, ja4, names, net
from netquarry.operators import devices, reports, segmentation, snapshot
from netquarry.plans.scan import Inventory
from netquarry.sources import events, rules

NOW = dt.datetime(2026, 9, 1, tzinfo=dt.UTC)


def record(kind, src="", dest="", ts="2026-07-30T09:00:00.5+0000", **payload):
    return {"timestamp": ts, "event_type": kind, "src_ip": src, "dest_ip": dest, **payload}


RECORDS = [
    record("dhcp", dhcp={"assigned_ip": "10.0.4.87", "client_mac": "00:80:77:31:01:07", "hostname": "BRN0080", "vendor_class_identifier": "Brother NC-8800"}),
    *[record("flow", "10.0.1.20", "10.0.4.87", dest_port=9100, proto="TCP") for _ in range(50)],
    record("arp", arp={"src_ip": "10.0.1.33", "src_mac": "00:15:5D:00:00:01", "dest_ip": "10.0.1.34", "dest_mac": "00:00:00:00:00:00"}),
    record("dhcp", dhcp={"assigned_ip": "10.0.3.66", "client_mac": "02:42:ac:11:00:02", "hostname": "* "}),
    record("http", "10.0.1.20", "93.184.216.34", http={"http_user_agent": "Mozilla/5.0 (Windows NT 6.1; x64)", "hostname": "example.com"}),
    record("snmp", "10.0.1.20", "10.0.9.1", snmp={"sysdescr": "Cisco IOS Software", "version": 2, "community": ["public", "x"]}, vlan=[20, 0, 5000, "7"]),
    record("snmp", "10.0.1.20", "10.0.9.2", snmp={"version": "2c", "community": "PRIVATE"}),
    record("enip", "198.51.100.9", "10.0.20.9", ts="2026-07-30T10:00:00Z", enip={"identity": {"product_name": " New ", "vendor_id": 1, "device_type": 14}}),
    record("enip", "198.51.100.9", "10.0.20.9", ts="2026-07-29T10:00:00Z", enip={"response": {"identity": {"product_name": "Old", "serial": "S1"}}}),
    record("modbus", "10.0.20.5", "10.0.20.9", modbus={"unit_id": 3}),
    record("flow", "10.0.20.5", "10.0.20.9", dest_port="502", proto="TCP", app_proto="modbus"),
    record("krb5", "10.0.1.20", "10.0.0.10", krb5={"cname": "Alice", "encryption": "rc4-hmac"}),
    record("krb5", "10.0.1.21", "10.0.0.10", krb5={"cname": "HOST1$"}),
    record("smb", "10.0.1.21", "10.0.0.10", smb={"ntlmssp": {"user": "Alice", "host": "WS-21"}, "dialect": "NT LM 0.12", "share": "c"}),
    record("tls", "10.0.1.20", "10.0.0.42", tls={"subject": "O=x, cn=nas.local", "issuerdn": "O=x, cn=nas.local", "notafter": "2026-08-11T00:00:00", "version": "TLSv1", "ja4": "t10d1516h2_a_b", "sni": "files.corp"}),
    record("stats", stats={"uptime": 5, "capture": {"kernel_packets": 1000, "kernel_drops": 20}}),
    record("stats", stats={"uptime": 6, "capture": {"kernel_packets": 0}}),
    record("alert", "10.0.1.20", "1.2.3.4", alert={"severity": 1, "signature": "Bad thing"}),
    record("drop", "8.8.8.8", "10.0.1.20"),
    record("mystery", "fe80::1", "10.0.1.20"),
    record("fileinfo", "10.0.1.20", "1.2.3.4", fileinfo={"filename": "Setup.EXE"}),
]


def kept(inventory):
    return inventory.keep_facts(f"/tmp/netquarry-test-{random.randrange(1 << 60)}")


@pytest.fixture(scope="module")
def found(spark):
    rows = [(json.dumps(r), k) for k, r in enumerate(RECORDS)]
    policy = segmentation.parse_policy("zone office 10.0.1.0/24 10.0.4.0/24\nzone plant 10.0.20.0/24\nzone servers 10.0.0.0/16\nallow office -> servers\n")
    return kept(Inventory(spark.createDataFrame(rows, "line string, seq bigint"), NOW, policy=policy))


@pytest.fixture(scope="module")
def by_ip(found):
    return {r["ip"]: r for r in found.devices.collect()}


def test_devices(by_ip):
    printer = by_ip["10.0.4.87"]
    assert (printer["class"], round(printer["confidence"], 6)) == ("printer", 0.98)  # 0.8 and 0.9; fifty flows count once
    assert [(s["port"], s["hits"]) for s in printer["services"]] == [(9100, 50)]
    assert by_ip["10.0.1.33"]["vendor"] == "Microsoft Hyper-V" and by_ip["10.0.1.33"]["class"] == "vm"
    assert "10.0.1.34" not in by_ip and "93.184.216.34" not in by_ip and "198.51.100.9" not in by_ip
    assert by_ip["10.0.3.66"]["random_mac"] and by_ip["10.0.3.66"]["vendor"] == "" and by_ip["10.0.3.66"]["hostname"] == ""
    assert by_ip["10.0.3.66"]["first_seen"] is None  # named by a payload only
    assert by_ip["10.0.1.20"]["os"] == "Windows 7 (end of life)" and by_ip["10.0.1.20"]["users"] == ["alice"]
    assert by_ip["10.0.9.1"]["vlans"] == [20] and by_ip["10.0.9.1"]["model"] == "Cisco IOS Software"
    plc = by_ip["10.0.20.9"]
    assert (plc["model"], plc["serial"], plc["class"]) == ("New", "S1", "plc")  # the newest value, whatever came last
    assert "EtherNet/IP device type: Programmable logic controller" in plc["ot_identifiers"] and "Modbus unit 3" in plc["ot_identifiers"]
    assert by_ip["10.0.1.21"]["users"] == ["alice"] and by_ip["10.0.1.21"]["hostname"] == "ws-21"
    assert by_ip["10.0.0.42"]["hostname"] == "files.corp" and len(by_ip["10.0.0.42"]["certs"]) == 1
    assert "fe80::1" in by_ip and by_ip["10.0.1.20"]["drops"] == 1 and by_ip["10.0.1.20"]["external_dsts"] == []


def test_findings(found):
    kinds = {(r["device"], r["kind"]): r for r in found.findings.collect()}
    wanted = {
        ("10.0.1.20", "end-of-life-os"), ("10.0.9.1", "default-snmp-community"), ("10.0.9.2", "default-snmp-community"), ("10.0.9.2", "snmp-v1v2"), ("10.0.20.9", "ot-exposed"),
        ("10.0.0.10", "weak-kerberos"), ("10.0.0.10", "smbv1"), ("10.0.0.42", "self-signed-cert"), ("10.0.0.42", "weak-tls"), ("10.0.0.42", "cert-expired"), ("10.0.1.20", "client-obsolete-tls"),
        ("sensor", "sensor-packet-loss"), ("10.0.1.20", "high-severity-alert"), ("1.2.3.4", "executable-transfer"),
    }
    assert set(kinds) == wanted  # a version that is a number isn't reported; flows inside a zone are allowed
    assert kinds[("10.0.20.9", "ot-exposed")]["count"] == 2 and kinds[("sensor", "sensor-packet-loss")]["count"] == 2
    assert all(r["title"] and r["fix"] for r in kinds.values())


def test_tables(found):
    assert {r["event_type"]: r["n"] for r in found.event_counts.collect()}["flow"] == 51
    assert [(r["user"], r["devices"]) for r in found.identities.collect()] == [("alice", ["10.0.1.20", "10.0.1.21"])]
    health = found.sensor_health.first()
    assert (health["uptime"], health["captured"], round(health["loss"], 3)) == (6, 1000, 2.0)
    assert found.line_counts.first()["skipped"] == 0
    assert reports.presets(100) == [(24, True), (72, True), (168, True), (336, False), (720, False)]


def test_order_and_repeats_do_not_matter(spark, found):
    shuffled = RECORDS + RECORDS[:40]
    random.Random(5).shuffle(shuffled)
    other = kept(Inventory(spark.createDataFrame([(json.dumps(r), k) for k, r in enumerate(shuffled)], "line string, seq bigint"), NOW))
    pick = lambda inv: sorted((r["ip"], r["class"], round(r["confidence"], 9), r["os"], r["vendor"]) for r in inv.winners.collect())
    assert pick(other) == pick(found)


def test_diff_of_equal_snapshots_is_empty(found):
    assert snapshot.changed(found.devices, found.devices).isEmpty()
    assert snapshot.appeared(found.devices, found.devices).isEmpty()
    assert snapshot.findings_only_in(found.findings, found.findings).isEmpty()


def test_lines(lines):
    made = lines({"event_type": "flow"}, '{"event_type": "dns"', "", "  \t", "null", "[1]", '{"a": 1} x', '{"event_type": "new", "event_type": "last"}', {"event_type": 5}, {"event_type": "x", "big": "y" * 200_000})
    rows = events.records(made)
    assert events.line_counts(rows).first().asDict() == {"total": 8, "skipped": 3}
    kinds = [r[0] for r in rows.where("record IS NOT NULL").orderBy("seq").select(access.text(F.col("record"), "event_type")).collect()]
    assert kinds == ["flow", "", "last", "", "x"]


def test_empty_table(lines):
    out = kept(Inventory(lines(), NOW))
    assert out.devices.isEmpty() and out.findings.isEmpty() and out.extent.first()["events"] == 0


def test_values(spark):
    row = spark.sql("""SELECT parse_json('{"a": {"s": "x", "n": 2.9, "d": "17", "neg": "-1", "list": ["p", 3, "q"], "none": null}}') AS v""")
    v, at = F.col("v"), lambda path: F.try_variant_get("v", f"$.{path}", "variant")
    got = row.select(access.text(v, "a.s"), access.text(v, "a.n"), access.number(v, "a.n"), access.number(v, "a.d"), access.number(v, "a.neg"), access.texts_of(at("a.list")), access.texts_of(at("a.s")), access.has(v, "a.none"), access.has(v, "a.s"), access.first_text(at("a.q"), at("a.s")), access.first_number(at("a.neg"), at("a.d"))).first()
    assert list(got) == ["x", "", 2, 17, 0, ["p", "q"], ["x"], False, True, "x", 17]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("2026-07-30T09:14:02.113422+0000", "2026-07-30 09:14:02.113422"), ("2026-07-30T09:14:02Z", "2026-07-30 09:14:02.000000"), ("2026-07-30T11:14:02.5+02:00", "2026-07-30 09:14:02.500000"), ("2026-07-30", None), ("rubbish", None), ("", None)],
)
def test_timestamps(spark, text, wanted):
    assert spark.range(1).select(F.date_format(access.timestamp(F.lit(text)), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0] == wanted


def test_addresses(spark):
    ips = {"10.1.2.3": True, "172.31.0.1": True, "172.32.0.1": False, "192.168.1.1": True, "127.0.0.1": True, "169.254.9.9": True, "224.0.0.251": True, "224.0.1.1": False, "100.64.0.1": False, "0.0.0.0": False,
           "8.8.8.8": False, "fe80::1": True, "fd00::5": True, "ff02::fb": True, "2001:db8::1": False, "::1": True, "::ffff:10.0.0.1": True, "10.0.0": False, "010.0.0.1": False, "": False, "host": False}
    rows = spark.createDataFrame(list(ips.items()), "ip string, wanted boolean").select("ip", net.is_private(F.col("ip")).alias("got")).collect()
    assert {r["ip"]: r["got"] for r in rows} == ips


def test_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(names.hostname(F.lit(x))) for x in (" .Host.Lan. ", "*", "a b", "", "PC\x00")] == ["host.lan", None, None, None, "pc"]
    assert one(names.best_hostname(F.array(F.lit("a.local"), F.lit("b")))) == "b"
    assert one(names.common_name(F.lit("O=x, cn=Srv, CN=y"))) == "Srv"
    assert [one(names.first_word(F.lit(x))) for x in ("Cisco IOS", "HP;x", " lead")] == ["Cisco", "HP", " lead"]
    assert [one(names.clean_vendor(F.lit(x))) for x in ("Acme Co., Ltd.", "Private", "Foo  Bar GmbH", "X", "Nokia Corporation")] == ["Acme", "", "Foo Bar", "", "Nokia"]


def test_ja4(spark):
    prints = {"t13d1516h2_8daaf6152771_e5627efa2ab1": ("TCP", "TLS 1.3", False, True, 15, 16, "HTTP/2", True), "q13i0310h3_a": ("QUIC", "TLS 1.3", False, False, 3, 10, "HTTP/3", True), "t10d0708dt": ("TCP", "TLS 1.0", True, True, 7, 8, "DNS-over-TLS", True), "dd1d010200_x": ("DTLS", "DTLS 1.0", True, True, 1, 2, "", True)}
    bad = ["", "x13d1516h2", "t14d1516h2", "t13x1516h2", "t13dab16h2", "t13d1516h", "t13d1516h22_a"]
    rows = spark.createDataFrame([(p,) for p in [*prints, *bad]], "p string").select("p", ja4.decode(F.col("p")).alias("j")).collect()
    got = {r["p"]: tuple(r["j"]) for r in rows}
    assert all(got[p] == w for p, w in prints.items())
    assert not any(got[p][-1] for p in bad)


def test_policy(spark):
    policy = segmentation.parse_policy("# plan\nzone a 10.0.0.0/8\nzone b 10.0.1.0/24 fd00::/8  # more\nzone c 10.0.1.7/32\nallow a -> b\nallow b <-> c\n")
    assert policy.allowed == {("a", "b"), ("b", "c"), ("c", "b")}
    ips = {"10.9.9.9": "a", "10.0.1.6": "b", "10.0.1.7": "c", "fd12::1": "b", "192.168.0.1": None, "junk": None}
    rows = segmentation.zone_of(spark.createDataFrame([(i,) for i in ips], "ip string"), segmentation.zone_ranges(spark, policy)).collect()
    assert {r["ip"]: r["zone"] for r in rows} == {k: v for k, v in ips.items() if v}
    for text in ("", "zone a", "zone a 10.0.0.300/8", "zone a 10.0.0.0/8\nallow a b", "zone a 10.0.0.0/8\nallow a => a", "zone a 10.0.0.0/8\nallow a -> q", "speak"):
        with pytest.raises(segmentation.PolicyError):
            segmentation.parse_policy(text)


def test_windows():
    assert events.window(NOW, last="2d") == (NOW - dt.timedelta(days=2), NOW)
    assert events.window(NOW, until="2026-08-01")[1] == dt.datetime(2026, 8, 1, 23, 59, 59, 999999, tzinfo=dt.UTC)
    assert events.retention("") is None and events.retention("1h30m") == dt.timedelta(minutes=90)
    for bad in ("-1d", "0d", "x"):
        with pytest.raises(ValueError):
            events.window(NOW, last=bad)


def test_rule_tables(spark):
    for table in (rules.text_rules(spark), rules.port_rules(spark), rules.proto_rules(spark)):
        for r in table.collect():
            assert 0 < r["weight"] <= 1 and r["conclusion"].startswith(("os=", "class=", "vendor="))
    assert rules.text_rules(spark).count() == 167 and rules.read_rows("# c\n\na\tb\n x \t y \tz\n", 3) == [["x", "y", "z"]]


def test_activity_of_devices_without_time(lines):
    out = kept(Inventory(lines(record("flow", "10.0.0.1", "10.0.0.2", ts="bad", dest_port=22)), NOW, since=NOW))
    assert out.event_counts.count() == 1 and devices.activity(out.facts).isEmpty()


def test_description_is_cut_between_characters(spark):
    """200 bytes at most, and no part of a character."""
    empty = dict.fromkeys(("hostname", "class", "os", "mac", "firmware", "serial"), "") | {"random_mac": False, "confidence": 0.5, "ip": "10.0.0.1"}
    for n in range(60, 75):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in empty.items()], F.lit("é" * n).alias("vendor"), F.lit("日" * 30).alias("model"), *[F.array().cast("array<string>").alias(c) for c in ("vlans", "protocols", "ot_identifiers")], F.array().cast("array<struct<port:int,app_proto:string>>").alias("services"), F.lit(None).cast("timestamp").alias("first_seen"), F.lit(None).cast("timestamp").alias("last_seen"))
        got = snapshot.netbox(row).first()["description"]
        whole = f"{'é' * n} · {'日' * 30} (passive inventory, 50% confidence)"
        assert whole.startswith(got) and 197 < len(got.encode()) <= 200

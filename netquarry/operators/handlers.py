"""What each type of event says about devices, as rows of facts.

A fact has the address it is about, its kind, and key, value, conclusion, weight, spec and
ord, used as the kind needs:

* note: key is the signal; value, conclusion, weight, spec as evidence has them
* text: key is the signal, value the text, conclusion the rule table to match it with
* hostname, user, protocol, share, ja3, ja4, ot, external, vlan: value
* mac, model, firmware, serial: value, of which the newest counts
* file, alert, drop, anomaly: one each
* service: key is the port, value the transport, conclusion the application protocol
* cert: value is subject, issuer, end and version as JSON
* finding: key is the kind, conclusion the severity, value what was seen
* seen: the device took part; device: it was named by a payload only

ord orders the facts of one event; all facts come from one pass over the events. Signal
names, conclusions and weights are fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions import ja4, names, net
from netquarry.functions.reuse import literal, once

SCHEMA = "ip string, fact string, key string, value string, conclusion string, weight double, spec int, ord int"
EXECUTABLE = (".exe", ".dll", ".ps1", ".scr", ".bat", ".jar", ".vbs")
INDUSTRIAL = ("modbus", "dnp3", "enip")
#: Windows versions without updates, by what a user agent says.
END_OF_LIFE = {"windows nt 5.1": "Windows XP", "windows nt 6.0": "Windows Vista", "windows nt 6.1": "Windows 7", "windows nt 6.2": "Windows 8"}
#: The CIP vendor that is certain, and the device profiles of the CIP specification.
CIP_VENDORS = {1: "Rockwell Automation/Allen-Bradley"}
CIP_DEVICE_TYPES = {
    0x02: "AC drive", 0x03: "Motor overload protection", 0x04: "Limit switch", 0x05: "Inductive proximity switch",
    0x06: "Photoelectric sensor", 0x07: "General purpose discrete I/O", 0x09: "Resolver", 0x0C: "Communications adapter",
    0x0E: "Programmable logic controller", 0x10: "Position controller", 0x13: "DC drive", 0x15: "Contactor",
    0x16: "Motor starter", 0x17: "Soft start", 0x18: "Human-machine interface", 0x1A: "Mass flow controller",
    0x1B: "Pneumatic valve", 0x1C: "Vacuum pressure gauge", 0x1D: "Process control value", 0x1E: "Residual gas analyser",
    0x1F: "DC power generator", 0x20: "RF power generator", 0x21: "Turbomolecular vacuum pump", 0x22: "Encoder",
    0x23: "Safety discrete I/O device", 0x24: "Fluid flow controller", 0x25: "CIP motion drive", 0x26: "CompoNet repeater",
    0x2A: "CIP modbus device", 0x2B: "CIP modbus translator", 0x2C: "Safety analog I/O device", 0x32: "ControlNet physical layer component",
}


def _src() -> Column:
    return F.col("src_ip")


def _dest() -> Column:
    return F.col("dest_ip")


def _here() -> Column:
    """Whether the source is a local address."""
    return F.col("src_private")


def _there() -> Column:
    """Whether the destination is a local address."""
    return F.col("dest_private")


def _local() -> Column:
    """The local end of an event, the source first; null if neither is."""
    return F.when(_here(), _src()).when(_there(), _dest())


def fact(when: Column, ip: Column, kind: str, value: Column | str = "", key: Column | str = "", conclusion: Column | str = "", weight: float | Column = 0.0, spec: int = 1, ord: int = 0) -> Column:
    named = lambda x, name: x.alias(name) if isinstance(x, Column) else literal(x, name)
    weight = weight.cast("double") if isinstance(weight, Column) else float(weight)
    row = F.struct(named(ip, "ip"), named(kind, "fact"), named(key, "key"), named(value, "value"), named(conclusion, "conclusion"), named(weight, "weight"), named(spec, "spec"), named(ord, "ord"))
    return F.when(when, row)


def note(when: Column, ip: Column, signal: str, value: Column | str, conclusion: Column | str, weight: float, spec: int = 1, ord: int = 0) -> Column:
    return fact(when, ip, "note", value, signal, conclusion, weight, spec, ord)


def matched(when: Column, ip: Column, signal: str, value: Column, table: str, ord: int = 0) -> Column:
    return fact(when & (value != ""), ip, "text", value, signal, table, ord=ord)


def given(when: Column, ip: Column, kind: str, value: Column, **more) -> Column:
    """A fact if there is a value."""
    return fact(when & (value != ""), ip, kind, value, **more)


def finding(when: Column, ip: Column, kind: Column | str, severity: str, seen: Column | str = "") -> Column:
    return fact(when & (ip != ""), ip, "finding", seen, kind, severity)


def client_fingerprint(when: Column, ip: Column, print_: Column) -> list[Column]:
    """What a JA4 fingerprint says about the client."""
    read = ja4.decode(print_)
    has = when & (print_ != "")
    return [
        given(when, ip, "ja4", print_),
        fact(has, ip, "text", print_, "tls.ja4", "ja4"),
        fact(has & (read["transport"] == "QUIC"), ip, "protocol", "quic"),
        fact(has & (read["alpn"] == "DNS-over-TLS"), ip, "protocol", "dns-over-tls"),
        fact(has & (read["alpn"] == "DNS-over-QUIC"), ip, "protocol", "dns-over-quic"),
        note(has & read["obsolete"], ip, "tls.ja4", print_, "class=iot", 0.25, ord=9_000),
        finding(has & read["obsolete"], ip, "client-obsolete-tls", "MEDIUM", read["tls_version"]),
    ]


def server(protocol: str, weight: float) -> list[Column]:
    return [fact(_there(), _dest(), "protocol", protocol), note(_there(), _dest(), "service", protocol, "class=server", weight)]


def dhcp() -> list[Column]:
    told, host, vendor = F.col("dhcp.told"), F.col("dhcp.host"), F.col("dhcp.vendor")
    alone = told.isin("", "0.0.0.0")
    ip, local = F.when(alone, _src()).otherwise(told), F.when(alone, _here()).otherwise(F.col("told_private"))
    return [
        fact(local, ip, "device"),
        given(local, ip, "mac", F.lower(F.col("dhcp.mac"))),
        given(local, ip, "hostname", host),
        matched(local, ip, "dhcp.hostname", host, "hostname_prefix"),
        matched(local, ip, "dhcp.vendor_class", vendor, "dhcp_vendor_class"),
        matched(local, ip, "dhcp.vendor_class", vendor, "dhcp_vendor_class_secondary", 1),
    ]


def arp() -> list[Column]:
    out = []
    for side in ("src", "dest"):
        ip, mac = F.col(f"arp.{side}_ip"), F.col(f"arp.{side}_mac")
        known = F.col(f"arp_{side}_private") & (mac != "") & ~mac.startswith("00:00:00:00:00:00")
        out += [fact(known, ip, "device"), fact(known, ip, "mac", F.lower(mac))]
    return out


def dns() -> Column:
    """Addresses and names in answers: an array of facts."""
    per = lambda p: F.array(fact(F.lit(True), p["ip"], "device"), fact(F.lit(True), p["ip"], "hostname", p["name"]), fact(F.lit(True), p["ip"], "text", p["name"], "dns.name", "hostname_prefix"))
    return F.flatten(F.transform("dns.names", per))


def doh2() -> list[Column]:
    return [fact(_here(), _src(), "protocol", "dns-over-https"), finding(_here(), _src(), "dns-over-https", "LOW")]


def http() -> list[Column]:
    agent, banner, host = F.col("http.agent"), F.col("http.banner"), F.col("http.host")
    old = F.coalesce(*[F.when(F.lower(agent).contains(m), F.lit(n)) for m, n in END_OF_LIFE.items()])
    return [
        matched(_here(), _src(), "http.user_agent", agent, "user_agent"),
        matched(_here(), _src(), "http.user_agent", agent, "user_agent_class", 1),
        finding(_here() & old.isNotNull(), _src(), "end-of-life-os", "HIGH", old),
        matched(_there(), _dest(), "http.server", banner, "dhcp_vendor_class_secondary"),
        matched(_there(), _dest(), "http.server", banner, "server_banner", 1),
        note(_there() & (banner != ""), _dest(), "http.server", banner, "class=server", 0.3, ord=2_000),
        given(_there() & ~host.contains(":"), _dest(), "hostname", host),
    ]


def tls() -> list[Column]:
    subject, issuer, end, version = (F.col(f"tls.{f}") for f in ("subject", "issuer", "end", "version"))
    cert, said = _there() & (subject != ""), F.upper(F.trim(version))
    return [
        given(_here(), _src(), "ja3", F.col("tls.ja3")),
        *client_fingerprint(_here(), _src(), F.col("tls.ja4")),
        given(cert, _dest(), "hostname", names.common_name(subject)),
        note(cert, _dest(), "tls.subject", subject, "class=server", 0.4),
        fact(cert, _dest(), "cert", F.to_json(F.struct(subject.alias("subject"), issuer.alias("issuer"), end.alias("not_after"), version.alias("version")))),
        finding(cert & (subject == issuer), _dest(), "self-signed-cert", "LOW"),
        given(_there(), _dest(), "hostname", F.col("tls.sni")),
        finding(_there() & said.isin("SSLV2", "SSLV3"), _dest(), "obsolete-ssl", "CRITICAL", version),
        finding(_there() & said.isin("TLS 1.0", "TLSV1", "TLS 1.1", "TLSV1.1"), _dest(), "weak-tls", "MEDIUM", version),
    ]


def quic() -> list[Column]:
    name = F.col("quic.sni")
    return [
        fact(_here(), _src(), "protocol", "quic"),
        *client_fingerprint(_here(), _src(), F.col("quic.ja4")),
        given(_here(), _src(), "ja3", F.col("quic.ja3")),
        matched(_here(), _src(), "quic.ua", F.col("quic.agent"), "user_agent"),
        given(_there(), _dest(), "hostname", name),
        note(_there() & (name != ""), _dest(), "quic.sni", name, "class=server", 0.3),
    ]


def ssh() -> list[Column]:
    banner, version = F.col("ssh.server"), F.col("ssh.version")
    return [
        matched(_there(), _dest(), "ssh.server.banner", banner, "ssh_banner"),
        note(_there() & (banner != ""), _dest(), "ssh.server.banner", banner, "class=server", 0.3, ord=2_000),
        finding(_there() & version.isin("1.0", "1.99"), _dest(), "ssh-v1", "HIGH"),
        matched(_here(), _src(), "ssh.client.banner", F.col("ssh.client"), "ssh_banner"),
    ]


def rdp() -> list[Column]:
    build = F.col("rdp.build")
    return [
        note(_here(), _src(), "rdp", "RDP client", "os=Windows", 0.6),
        given(_here(), _src(), "hostname", F.col("rdp.client")),
        note(_here() & (build != ""), _src(), "rdp.client.build", build, "class=workstation", 0.4),
        note(_there(), _dest(), "rdp", "RDP service", "os=Windows", 0.7),
        note(_there(), _dest(), "rdp", "RDP service", "class=server", 0.4),
        given(_there(), _dest(), "hostname", names.common_name(F.col("rdp.subject"))),
    ]


def snmp() -> list[Column]:
    described, version = F.col("snmp.described"), F.col("snmp.version")
    said = _there() & (described != "")
    return [
        note(_there(), _dest(), "snmp", "SNMP agent", "class=network", 0.6),
        given(_there(), _dest(), "model", described),
        matched(_there(), _dest(), "snmp.sysDescr", described, "dhcp_vendor_class"),
        matched(_there(), _dest(), "snmp.sysDescr", described, "server_banner", 1),
        note(said, _dest(), "snmp.sysDescr", described, F.concat(F.lit("vendor="), names.first_word(described)), 0.8, 2, 2_000),
        finding(_there() & version.isin("1", "2", "2c"), _dest(), "snmp-v1v2", "LOW", version),
    ]


def communities() -> Column:
    """A finding for each default community string: an array of facts."""
    return F.transform("snmp.defaults", lambda c: fact(_there(), _dest(), "finding", c, "default-snmp-community", "HIGH"))


def rfb() -> list[Column]:
    kind = F.lower("rfb.security")
    return [fact(_there(), _dest(), "protocol", "vnc"), note(_there(), _dest(), "rfb", "VNC server", "class=server", 0.5), finding(_there() & kind.contains("none"), _dest(), "vnc-no-auth", "CRITICAL")]


def smb() -> list[Column]:
    dialect = F.col("smb.dialect")
    return [
        note(_here(), _src(), "smb", "SMB client", "os=Windows", 0.4),
        given(_here(), _src(), "hostname", F.col("smb.host")),
        given(_here(), _src(), "user", F.lower("smb.user")),
        note(_there(), _dest(), "smb", "SMB service", "class=server", 0.4),
        given(_there(), _dest(), "share", F.col("smb.share")),
        finding(_there() & (dialect.startswith("1.") | (dialect == "NT LM 0.12")), _dest(), "smbv1", "HIGH"),
    ]


def krb5() -> list[Column]:
    name, cipher = F.col("krb5.name"), F.lower("krb5.cipher")
    person = _here() & (name != "") & ~name.endswith("$")
    return [
        fact(person, _src(), "user", F.lower(name)),
        note(person, _src(), "krb5.cname", name, "class=workstation", 0.4),
        note(_here(), _src(), "krb5", "Kerberos client", "os=Windows", 0.3),
        note(_there(), _dest(), "krb5", "Kerberos service", "class=server", 0.8),
        finding(cipher.contains("rc4") | cipher.contains("des"), _dest(), "weak-kerberos", "MEDIUM", cipher),
    ]


def ldap() -> list[Column]:
    return [fact(_there(), _dest(), "protocol", "ldap"), note(_there(), _dest(), "ldap", "LDAP service", "class=server", 0.7), given(_here(), _src(), "user", F.lower("ldap.name"))]


def dcerpc() -> list[Column]:
    return [note(_there(), _dest(), "dcerpc", "DCERPC service", "os=Windows", 0.6), note(_there(), _dest(), "dcerpc", "DCERPC service", "class=server", 0.5), note(_here(), _src(), "dcerpc", "DCERPC client", "os=Windows", 0.4)]


def nfs() -> list[Column]:
    return [note(_there(), _dest(), "nfs", "NFS export", "class=nas", 0.7), given(_there(), _dest(), "share", F.col("nfs.share"))]


def smtp() -> list[Column]:
    return [fact(_there(), _dest(), "protocol", "smtp"), note(_there(), _dest(), "smtp", "SMTP service", "class=server", 0.7), given(_there(), _dest(), "hostname", F.col("smtp.helo")), fact(_here(), _src(), "protocol", "smtp")]


def sip() -> list[Column]:
    agent, out = F.col("sip.agent"), []
    for local, ip in ((_here(), _src()), (_there(), _dest())):
        out += [fact(local, ip, "protocol", "sip"), note(local, ip, "sip", "SIP telephony", "class=phone", 0.6), matched(local, ip, "sip.user_agent", agent, "dhcp_vendor_class")]
    return out


def mqtt() -> list[Column]:
    return [
        fact(_there(), _dest(), "protocol", "mqtt"),
        note(_there(), _dest(), "mqtt", "MQTT broker", "class=iot", 0.6),
        fact(_here(), _src(), "protocol", "mqtt"),
        note(_here(), _src(), "mqtt", "MQTT client", "class=iot", 0.7),
        given(_here(), _src(), "hostname", F.col("mqtt.client")),
    ]


def ftp() -> list[Column]:
    return [
        fact(_there(), _dest(), "protocol", "ftp"),
        note(_there(), _dest(), "ftp", "FTP service", "class=server", 0.6),
        matched(_there(), _dest(), "ftp.banner", F.col("ftp.banner"), "server_banner"),
        finding(F.upper("ftp.command").isin("USER", "PASS"), _dest(), "cleartext-credentials", "HIGH"),
        fact(_here(), _src(), "protocol", "ftp"),
    ]


def tftp() -> list[Column]:
    return [fact(_there(), _dest(), "protocol", "tftp"), note(_there(), _dest(), "tftp", "TFTP service", "class=network", 0.5), finding(_there(), _dest(), "tftp-in-use", "MEDIUM")]


def fileinfo() -> list[Column]:
    name = F.lower("file.name")
    runs = F.lit(False)
    for ending in EXECUTABLE:
        runs = runs | name.endswith(ending)
    return [fact(_local().isNotNull(), _local(), "file"), finding(runs, _dest(), "executable-transfer", "LOW", name)]


def ot_identity(local: Column, ip: Column, protocol: str) -> list[Column]:
    if protocol == "modbus":
        unit = F.col("modbus.unit")
        return [fact(local & (unit > 0), ip, "ot", F.concat(F.lit("Modbus unit "), unit.cast("string")))]
    if protocol == "dnp3":
        ends = [F.col("dnp3.src"), F.col("dnp3.dst")]
        return [fact(local & (n > 0), ip, "ot", F.concat(F.lit("DNP3 address "), n.cast("string"))) for n in ends]
    product, revision, serial = (F.regexp_replace(f"enip.{f}", r"^\s+|\s+$", "") for f in ("product", "revision", "serial"))
    maker, kind = F.col("enip.maker"), F.col("enip.kind")
    table = lambda m: F.create_map(*[F.lit(x) for k, v in m.items() for x in (k, v)])
    vendor, type_ = F.try_element_at(table(CIP_VENDORS), maker.cast("int")), F.try_element_at(table(CIP_DEVICE_TYPES), kind.cast("int"))
    return [
        given(local, ip, "model", product),
        note(local & (product != ""), ip, "enip.identity.product_name", product, "class=plc", 0.95, 2),
        matched(local, ip, "enip.identity.product_name", product, "server_banner", 1),
        matched(local, ip, "enip.identity.product_name", product, "dhcp_vendor_class_secondary", 2),
        given(local, ip, "firmware", revision),
        note(local & (revision != ""), ip, "enip.identity.revision", revision, "class=plc", 0.6),
        given(local, ip, "serial", serial),
        note(local & vendor.isNotNull(), ip, "enip.identity.vendor_id", maker.cast("string"), F.concat(F.lit("vendor="), vendor), 0.9),
        fact(local & vendor.isNotNull(), ip, "text", vendor, "enip.identity.vendor", "vendor_class"),
        fact(local & (maker > 0) & vendor.isNull(), ip, "ot", F.concat(F.lit("EtherNet/IP vendor ID "), maker.cast("string"))),
        fact(local & type_.isNotNull(), ip, "ot", F.concat(F.lit("EtherNet/IP device type: "), type_)),
    ]


def industrial(protocol: str) -> list[Column]:
    return [
        fact(_there(), _dest(), "protocol", protocol),
        note(_there(), _dest(), protocol, f"{protocol} endpoint", "class=plc", 0.95, 2),
        *ot_identity(_there(), _dest(), protocol),
        fact(_here(), _src(), "protocol", protocol),
        note(_here(), _src(), protocol, f"{protocol} client", "class=server", 0.3),
        *ot_identity(_here(), _src(), protocol),
        finding(_there() & ~_here(), _dest(), "ot-exposed", "CRITICAL", _src()),
    ]


def alert() -> list[Column]:
    signature = F.col("alert.signature")
    return [fact(_local().isNotNull(), _local(), "alert"), finding((F.col("alert.severity") == 1) & (signature != ""), F.when(_here(), _src()).otherwise(_dest()), "high-severity-alert", "HIGH", signature)]


def bittorrent() -> list[Column]:
    return [fact(_here(), _src(), "protocol", "bittorrent"), finding(_here(), _src(), "p2p", "LOW")]


def flow() -> list[Column]:
    port = F.col("dest_port")
    return [
        fact(_there() & (port > 0), _dest(), "service", F.col("proto"), port.cast("string"), F.col("app_proto")),
        fact(_here() & ~_there() & (_dest() != ""), _src(), "external", _dest()),
        fact(_here() & _there(), _src(), "crossing", _dest(), port.cast("string")),
    ]


def every_event() -> list[Column]:
    good = ~F.col("app_proto").isin("", "failed", "unknown")
    return [
        fact(_here(), _src(), "seen"),
        fact(_there(), _dest(), "seen"),
        fact(_here() & good, _src(), "protocol", F.col("app_proto")),
        fact(_there() & good, _dest(), "protocol", F.col("app_proto")),
        fact(_there() & good, _dest(), "app_proto", F.col("app_proto")),
    ]


def tags() -> Column:
    """VLAN tags of both ends: an array of facts."""
    return F.flatten(F.transform(F.col("vlans"), lambda t: F.array(fact(_here(), _src(), "vlan", t.cast("string")), fact(_there(), _dest(), "vlan", t.cast("string")))))


#: Types of event and the facts of each; types that aren't here are counted only.
HANDLERS = {
    ("dhcp",): dhcp, ("arp",): arp, ("doh2",): doh2, ("http", "http2"): http, ("tls",): tls, ("quic",): quic, ("ssh",): ssh,
    ("rdp",): rdp, ("snmp",): snmp, ("rfb",): rfb, ("smb",): smb, ("krb5",): krb5, ("ldap",): ldap, ("dcerpc",): dcerpc,
    ("nfs",): nfs, ("smtp",): smtp, ("sip",): sip, ("mqtt",): mqtt, ("ftp", "ftp_data"): ftp, ("tftp",): tftp,
    ("fileinfo", "files"): fileinfo, ("alert",): alert, ("bittorrent-dht",): bittorrent, ("flow", "netflow"): flow,
    ("websocket",): lambda: server("websocket", 0.3), ("pgsql",): lambda: server("postgresql", 0.8), ("ike", "ikev2"): lambda: server("vpn", 0.6),
    ("drop",): lambda: [fact(_local().isNotNull(), _local(), "drop")], ("anomaly",): lambda: [fact(_local().isNotNull(), _local(), "anomaly")],
}


#: The events' payload lists, and the facts of each of their items.
LISTED = {("dns",): dns, ("snmp",): communities}


def prepared(events: DataFrame) -> DataFrame:
    """Events with what several facts of one event need, worked out once."""
    private = {"told_private": "dhcp.told", "arp_src_private": "arp.src_ip", "arp_dest_private": "arp.dest_ip"}
    return events.withColumns({name: net.is_private(F.col(column)) for name, column in private.items()})


def _exploded(events: DataFrame, every: Column) -> DataFrame:
    # outer: a plain explode is given a condition on its list, which makes all facts twice
    rows = prepared(events).select("seq", "ts", every.alias("all")).select("seq", "ts", F.explode_outer("all").alias("f"))
    return rows.where("f.ip IS NOT NULL").select("seq", "ts", "f.*")


def _machine(protocol: str) -> Column:
    """Whether an event is of an industrial protocol: by its type, or a flow's application protocol."""
    return (F.col("event_type") == protocol) | (F.col("event_type").isin("flow", "netflow") & (F.col("app_proto") == protocol))


@once
def _all_facts() -> Column:
    none = F.array().cast(f"array<struct<{SCHEMA.replace(' ', ':').replace(',:', ', ')}>>")
    pick = lambda cases: F.coalesce(reduce(lambda c, x: F.when(*x) if c is None else c.when(*x), cases, None), none)
    by_type = pick([(F.col("event_type").isin(*kinds), F.array(*handler())) for kinds, handler in HANDLERS.items()])
    controls = pick([(_machine(p), F.array(*industrial(p))) for p in INDUSTRIAL])
    lists = pick([(F.col("event_type").isin(*kinds), rows()) for kinds, rows in LISTED.items()])
    return F.concat(F.array(*every_event()), tags(), by_type, controls, lists)


def facts(events: DataFrame) -> DataFrame:
    """seq, ts and the columns of SCHEMA: every fact of every event, in one pass."""
    return _exploded(events, _all_facts())


def facts_of(events: DataFrame, *kinds: str) -> DataFrame:
    """The facts that only the handler of these event types gives; events of other types aren't looked at."""
    rows = events.where(F.col("event_type").isin(*kinds))
    found = [F.array(*handler()) for of, handler in HANDLERS.items() if set(of) & set(kinds)] + [items() for of, items in LISTED.items() if set(of) & set(kinds)]
    return _exploded(rows, F.concat(*found))


def industrial_facts(events: DataFrame) -> DataFrame:
    """The facts of industrial protocols, from their own events and from flows."""
    cases = [(_machine(p), F.array(*industrial(p))) for p in INDUSTRIAL]
    return _exploded(events.where(reduce(lambda a, b: a | b, [c for c, _ in cases])), reduce(lambda c, x: F.when(*x) if c is None else c.when(*x), cases, None))


def shared_facts(events: DataFrame, tags_too: bool = True) -> DataFrame:
    """The facts that events of every type give."""
    return _exploded(events, F.concat(F.array(*every_event()), tags()) if tags_too else F.array(*every_event()))

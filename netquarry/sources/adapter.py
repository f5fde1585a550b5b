"""Turns the ``events`` table into lines of JSON records, so that every operator can run on it.

An event's type goes by its id, its addresses by user and by k (in props), and the fields
of its payload are picked from short lists by k. The same values are given as SQL, for
checks by another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = (
    "flow", "dhcp", "arp", "dns", "http", "tls", "quic", "ssh", "rdp", "snmp", "rfb", "websocket", "smb", "krb5", "ldap", "dcerpc", "nfs", "smtp", "pgsql", "sip",
    "mqtt", "ike", "ftp", "tftp", "fileinfo", "modbus", "dnp3", "enip", "alert", "drop", "anomaly", "bittorrent-dht", "doh2", "stats", "http2", "flow", "netflow", "packet", "flow", "dhcp",
)
#: Name of a field: the values that k picks from.
LISTS = {
    "app": ("", "failed", "http", "tls", "modbus", "smb", "unknown", "sip", "krb5", "dns", "enip"),
    "proto": ("TCP", "UDP", "tcp"),
    "port": ("443", "9100", "502", "0", "22", "3389", "8080", "2049", "53", "5060", "1883", "44818", "12345"),
    "mac_head": ("00:15:5d", "08:00:27", "02:42:ac", "aa:bb:cc", "00:16:3e", "00:11:22"),
    "host": ("DESKTOP-", "brn", "host.", "iphone-", "*", "two words ", "WIN-", "printer.local."),
    "vendor": ("MSFT 5.0", "android-dhcp-13", "Hewlett-Packard JetDirect", "Siemens SIMATIC", "", "udhcp 1.2", "Brother NC", "unknown thing"),
    "agent": ("Mozilla/5.0 (Windows NT 6.1; Win64)", "Mozilla/5.0 (iPhone; CPU)", "curl/8.0", "", "Mozilla/5.0 (X11; CrOS x86)", "Microsoft BITS", "Debian APT-HTTP/1.3", "Mozilla/5.0 (Windows NT 10.0)"),
    "banner": ("nginx/1.2", "Microsoft-IIS/10.0", "", "Boa/0.94 Hikvision", "RouterOS", "Apache (Synology)", "lighttpd"),
    "ja4": ("t13d1516h2_8daaf6152771_e5627efa2ab1", "q13i0310h3_a_b", "t10d0708dt_x", "", "garbage", "d110000000_z", "t12d1209dq_y"),
    "tls_version": ("TLS 1.3", "SSLv3", "TLSv1", " tls 1.1 ", "", "TLS 1.2"),
    "ssh": ("OpenSSH_8.9p1 Ubuntu", "OpenSSH_9.2 Debian", "", "dropbear_2020", "ROSSSH", "OpenSSH_for_Windows_9"),
    "ssh_version": ("2.0", "1.99", "", "1.0"),
    "community": ("public", "s3cret", "Private"),
    "snmp_version": ("1", "3", "2c", ""),
    "described": ("Cisco IOS Software, C2960", "HP JetDirect", "", "Linux,embedded", "RICOH Aficio"),
    "security": ("None", "VNC Authentication", "nOnE (x)"),
    "dialect": ("NT LM 0.12", "3.11", "1.0", "2.02"),
    "cname": ("Alice", "HOST1$", "bob", ""),
    "cipher": ("aes256-cts", "rc4-hmac", "DES-CBC", ""),
    "command": ("USER", "RETR", "pass", ""),
    "file": ("Setup.EXE", "notes.txt", "a.ps1", "", "jar"),
    "product": ("1756-L71/B LOGIX5571", " Siemens S7 ", "", "WAGO 750"),
    "fired": ("1", "2", "3"),
}


def _user() -> Column:
    return F.col("user_id")


def _k() -> Column:
    return F.col("k")


def _id() -> Column:
    return F.col("event_id")


def pick(name: str) -> Column:
    values = LISTS[name]
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_k() % len(values) + 1).cast("int"))


def _hex2(n: Column) -> Column:
    return F.lower(F.lpad(F.hex(n), 2, "0"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def base(events: DataFrame) -> DataFrame:
    """event_id, ts, user_id and k, and what is common to all records: type, src, dest, mac."""
    rows = events.select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    types = F.array(*[F.lit(t) for t in TYPES])
    return rows.select(
        "*",
        F.element_at(types, (_id() % len(TYPES) + 1).cast("int")).alias("type"),
        _text("10.1.", F.floor(_user() / 256), ".", _user() % 256).alias("src"),
        F.when(_k() < 80, _text("10.0.9.", _k() % 25)).otherwise(_text("203.0.113.", _k())).alias("dest"),
        _text(pick("mac_head"), ":00:", _hex2(F.floor(_user() / 256)), ":", _hex2(_user() % 256)).alias("mac"),
    )


def lines(events: DataFrame) -> DataFrame:
    """line and seq (the event's id)."""
    b = base(events)
    obj = lambda **fields: F.struct(*[v.alias(n) for n, v in fields.items()])
    src, dest, mac = F.col("src"), F.col("dest"), F.col("mac")
    named = F.when(pick("host") == "*", F.lit("*")).otherwise(_text(pick("host"), _user()))
    subject = _text("O=x, CN=srv", _k() % 10, ".corp")
    end = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (_k() * 10).cast("int")), "yyyy-MM-dd'T'00:00:00")
    identity = obj(product_name=pick("product"), revision=_text("1.", _k() % 4), serial=_text("S", _user()), vendor_id=_k() % 3, device_type=_k() % 16)
    payload = {
        "dhcp": obj(assigned_ip=F.when(_k() % 2 == 0, src).otherwise(F.lit("0.0.0.0")), client_mac=F.upper(mac), hostname=named, vendor_class_identifier=pick("vendor")),
        "arp": obj(src_ip=src, src_mac=mac, dest_ip=dest, dest_mac=F.when(_k() % 2 == 0, F.lit("00:00:00:00:00:00")).otherwise(_text("00:1c:42:00:00:", _hex2(_k())))),
        "dns": obj(rrname=_text("pc", _k(), ".Lan"), rdata=dest, answers=F.array(obj(rrname=_text("brn", _k()), rdata=src))),
        "http": obj(http_user_agent=pick("agent"), http_server=pick("banner"), hostname=F.when(_k() % 5 == 0, _text("h:", _k())).otherwise(_text("web", _k() % 10, ".corp.local"))),
        "tls": obj(ja3=obj(hash=_text("h", _k() % 4)), ja4=pick("ja4"), subject=F.when(_k() % 4 == 0, F.lit("")).otherwise(subject), issuerdn=F.when(_k() % 3 == 0, subject).otherwise(F.lit("CN=ca")), notafter=end, version=pick("tls_version"), sni=_text("s", _k() % 7, ".corp")),
        "quic": obj(ja4=pick("ja4"), ua=pick("agent"), sni=_text("q", _k() % 7, ".corp")),
        "ssh": obj(server=obj(software_version=pick("ssh"), proto_version=pick("ssh_version")), client=obj(software=pick("ssh"))),
        "rdp": obj(client=obj(client_name=_text("PC-", _user()), build=F.when(_k() % 2 == 0, F.lit("Windows 10")))),
        "snmp": obj(sysdescr=pick("described"), community=pick("community"), version=pick("snmp_version")),
        "rfb": obj(security_type_name=pick("security")),
        "smb": obj(ntlmssp=obj(host=_text("WS", _user()), user=_text("User", _user() % 20)), share=_text("share", _k() % 3), dialect=pick("dialect")),
        "krb5": obj(cname=pick("cname"), encryption=pick("cipher")),
        "ldap": obj(bind=obj(name=_text("CN=u", _user() % 10))),
        "nfs": obj(export=_text("/export", _k() % 2)),
        "smtp": obj(helo=_text("mail", _k() % 3, ".corp")),
        "sip": obj(user_agent=pick("vendor")),
        "mqtt": obj(client_id=_text("sensor", _user() % 30)),
        "ftp": obj(reply=pick("banner"), command=pick("command")),
        "fileinfo": obj(filename=pick("file")),
        "modbus": obj(unit_id=_k() % 6),
        "dnp3": obj(src=_k() % 5, dst=_k() % 7),
        "enip": obj(identity=identity),
        "alert": obj(severity=pick("fired").cast("int"), signature=_text("SIG ", _k() % 4)),
        "stats": obj(uptime=_id(), capture=obj(kernel_packets=F.when(_k() % 3 == 0, _id() * 100), kernel_drops=F.when(_k() % 2 == 0, _id() * (_k() % 4)))),
    }
    used = {"http2": "http"}
    fields = [
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0000'").alias("timestamp"),
        F.col("type").alias("event_type"),
        src.alias("src_ip"),
        dest.alias("dest_ip"),
        pick("port").cast("int").alias("dest_port"),
        pick("proto").alias("proto"),
        pick("app").alias("app_proto"),
        F.when(_k() % 4 == 0, F.array((_k() % 5 * 10).cast("int"))).alias("vlan"),
        *[F.when(F.col("type").isin(name, *[a for a, b_ in used.items() if b_ == name]), value).alias(name) for name, value in payload.items()],
    ]
    return b.select(F.to_json(F.struct(*fields)).alias("line"), _id().alias("seq"))


def sql_base() -> str:
    """The same values as columns: seq, ts, t, src, dest, here, there, and each picked field by its name."""
    picks = ", ".join(f"[{', '.join(repr(v) for v in values)}][(k % {len(values)} + 1)::INT] AS {name}" for name, values in LISTS.items())
    types = ", ".join(f"'{t}'" for t in TYPES)
    return f"""b0 AS (SELECT event_id AS seq, ts, user_id AS u, json_extract(props, '$.k')::BIGINT AS k FROM events),
b AS (
  SELECT *, [{types}][(seq % {len(TYPES)} + 1)::INT] AS t, '10.1.' || (u // 256) || '.' || (u % 256) AS src,
    CASE WHEN k < 80 THEN '10.0.9.' || (k % 25) ELSE '203.0.113.' || k END AS dest, true AS here, k < 80 AS there, {picks}
  FROM b0
), e AS (
  SELECT *, mac_head || ':00:' || lpad(format('{{:x}}', u // 256), 2, '0') || ':' || lpad(format('{{:x}}', u % 256), 2, '0') AS mac,
    CASE WHEN host = '*' THEN '*' ELSE host || u END AS named, 'O=x, CN=srv' || (k % 10) || '.corp' AS cn_subject
  FROM b
)"""

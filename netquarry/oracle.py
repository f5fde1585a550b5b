"""The same results as SQL for another engine, over the adapter's columns; written by hand, not derived from the operators."""

from __future__ import annotations

from netquarry.sources import adapter, rules

HOST_OK = "regexp_replace(lower(x), '^[. ]+|[. ]+$', '', 'g')"
SUBJECT = "CASE WHEN k % 4 = 0 THEN '' ELSE cn_subject END"
ISSUER = "CASE WHEN k % 3 = 0 THEN cn_subject ELSE 'CN=ca' END"
END_DAY = "(DATE '2024-01-01' + (k * 10)::INT)"
HTTP_HOST = "'web' || (k % 10) || '.corp.local'"
TLS_UP = "upper(trim(tls_version))"
OLD = "CASE WHEN agent ILIKE '%windows nt 6.1%' THEN 'Windows 7' END"
JA4_OK = "ja4 IN ('t13d1516h2_8daaf6152771_e5627efa2ab1', 'q13i0310h3_a_b', 't10d0708dt_x', 'd110000000_z', 't12d1209dq_y')"
JA4_OK = "regexp_full_match(split_part(ja4, '_', 1), '[tqd](1[0-3]|s[23]|d[123]|00)[di][0-9]{4}..')"
JA4_OLD = f"{JA4_OK} AND substr(ja4, 2, 2) IN ('10', '11', 's2', 's3', 'd1')"
VERSION = "CASE substr(ja4, 2, 2) WHEN '10' THEN 'TLS 1.0' WHEN '11' THEN 'TLS 1.1' WHEN 's2' THEN 'SSL 2.0' WHEN 's3' THEN 'SSL 3.0' ELSE 'DTLS 1.0' END"
WORD = "CASE WHEN regexp_matches(described, '^[ \\t,;]') THEN described ELSE regexp_extract(described, '^([^ \\t,;]*)', 1) END"
PRODUCT = "trim(product)"


def ja4_rows(kinds: str) -> list[tuple]:
    return [
        (kinds, "here AND ja4 <> ''", "src", "ja4", "", "ja4", "", 0, 1),
        (kinds, "here AND ja4 <> ''", "src", "text", "tls.ja4", "ja4", "ja4", 0, 1),
        (kinds, f"here AND {JA4_OK} AND ja4[1] = 'q'", "src", "protocol", "", "'quic'", "", 0, 1),
        (kinds, f"here AND {JA4_OK} AND ja4[9:10] = 'dt'", "src", "protocol", "", "'dns-over-tls'", "", 0, 1),
        (kinds, f"here AND {JA4_OK} AND ja4[9:10] = 'dq'", "src", "protocol", "", "'dns-over-quic'", "", 0, 1),
        (kinds, f"here AND {JA4_OLD}", "src", "note", "tls.ja4", "ja4", "class=iot", 0.25, 1),
        (kinds, f"here AND {JA4_OLD}", "src", "finding", "client-obsolete-tls", VERSION, "MEDIUM", 0, 1),
    ]


def ot_rows(protocol: str, when: str) -> list[tuple]:
    out = []
    for side, ip in (("there", "dest"), ("here", "src")):
        last = ("endpoint", "class=plc", 0.95, 2) if ip == "dest" else ("client", "class=server", 0.3, 1)
        out += [(when, side, ip, "protocol", "", f"'{protocol}'", "", 0, 1), (when, side, ip, "note", protocol, f"'{protocol} {last[0]}'", last[1], last[2], last[3])]
        own = f"{side} AND t = '{protocol}'"  # identity fields stand only in the protocol's own records
        if protocol == "modbus":
            out += [(when, f"{own} AND k % 6 > 0", ip, "ot", "", "'Modbus unit ' || (k % 6)", "", 0, 1)]
        elif protocol == "dnp3":
            out += [(when, f"{own} AND k % {n} > 0", ip, "ot", "", f"'DNP3 address ' || (k % {n})", "", 0, 1) for n in (5, 7)]
        else:
            out += [
                (when, f"{own} AND {PRODUCT} <> ''", ip, "model", "", PRODUCT, "", 0, 1),
                (when, f"{own} AND {PRODUCT} <> ''", ip, "note", "enip.identity.product_name", PRODUCT, "class=plc", 0.95, 2),
                (when, f"{own} AND {PRODUCT} <> ''", ip, "text", "enip.identity.product_name", PRODUCT, "server_banner", 0, 1),
                (when, f"{own} AND {PRODUCT} <> ''", ip, "text", "enip.identity.product_name", PRODUCT, "dhcp_vendor_class_secondary", 0, 1),
                (when, own, ip, "firmware", "", "'1.' || (k % 4)", "", 0, 1),
                (when, own, ip, "note", "enip.identity.revision", "'1.' || (k % 4)", "class=plc", 0.6, 1),
                (when, own, ip, "serial", "", "'S' || u", "", 0, 1),
                (when, f"{own} AND k % 3 = 1", ip, "note", "enip.identity.vendor_id", "'1'", "vendor=Rockwell Automation/Allen-Bradley", 0.9, 1),
                (when, f"{own} AND k % 3 = 1", ip, "text", "enip.identity.vendor", "'Rockwell Automation/Allen-Bradley'", "vendor_class", 0, 1),
                (when, f"{own} AND k % 3 = 2", ip, "ot", "", "'EtherNet/IP vendor ID 2'", "", 0, 1),
            ]
            for n, name in ((2, "AC drive"), (3, "Motor overload protection"), (4, "Limit switch"), (5, "Inductive proximity switch"), (6, "Photoelectric sensor"), (7, "General purpose discrete I/O"), (9, "Resolver"), (12, "Communications adapter"), (14, "Programmable logic controller")):
                out.append((when, f"{own} AND k % 16 = {n}", ip, "ot", "", f"'EtherNet/IP device type: {name}'", "", 0, 1))
    return [*out, (when, "there AND NOT here", "dest", "finding", "ot-exposed", "src", "CRITICAL", 0, 1)]


GOOD_APP = "app NOT IN ('', 'failed', 'unknown')"
#: Types, condition, address, fact, key, value, conclusion, weight, spec.
ROWS: dict[str, list[tuple]] = {
    "e00_every_event": [("", "here", "src", "seen", "", "''", "", 0, 1), ("", "there", "dest", "seen", "", "''", "", 0, 1), ("", "here AND k % 4 = 0 AND k % 5 > 0", "src", "vlan", "", "(k % 5 * 10)::VARCHAR", "", 0, 1), ("", "there AND k % 4 = 0 AND k % 5 > 0", "dest", "vlan", "", "(k % 5 * 10)::VARCHAR", "", 0, 1)],
    "e01_app_proto": [("", f"here AND {GOOD_APP}", "src", "protocol", "", "app", "", 0, 1), ("", f"there AND {GOOD_APP}", "dest", "protocol", "", "app", "", 0, 1), ("", f"there AND {GOOD_APP}", "dest", "app_proto", "", "app", "", 0, 1)],
    "e02_dhcp": [
        ("dhcp", "here", "src", "device", "", "''", "", 0, 1), ("dhcp", "here", "src", "mac", "", "mac", "", 0, 1), ("dhcp", "here", "src", "hostname", "", "named", "", 0, 1),
        ("dhcp", "here", "src", "text", "dhcp.hostname", "named", "hostname_prefix", 0, 1), ("dhcp", "here AND vendor <> ''", "src", "text", "dhcp.vendor_class", "vendor", "dhcp_vendor_class", 0, 1),
        ("dhcp", "here AND vendor <> ''", "src", "text", "dhcp.vendor_class", "vendor", "dhcp_vendor_class_secondary", 0, 1),
    ],
    "e03_arp": [
        ("arp", "here", "src", "device", "", "''", "", 0, 1), ("arp", "here", "src", "mac", "", "mac", "", 0, 1),
        ("arp", "there AND k % 2 = 1", "dest", "device", "", "''", "", 0, 1), ("arp", "there AND k % 2 = 1", "dest", "mac", "", "'00:1c:42:00:00:' || lpad(format('{:x}', k), 2, '0')", "", 0, 1),
    ],
    "e04_dns": [(("dns"), c, ip, f, s, v, r, 0, 1) for c, ip, name in (("there", "dest", "'pc' || k || '.Lan'"), ("here", "src", "'brn' || k")) for f, s, v, r in (("device", "", "''", ""), ("hostname", "", name, ""), ("text", "dns.name", name, "hostname_prefix"))],
    "e05_doh2": [("doh2", "here", "src", "protocol", "", "'dns-over-https'", "", 0, 1), ("doh2", "here", "src", "finding", "dns-over-https", "''", "LOW", 0, 1)],
    "e06_http": [
        ("http,http2", "here AND agent <> ''", "src", "text", "http.user_agent", "agent", "user_agent", 0, 1), ("http,http2", "here AND agent <> ''", "src", "text", "http.user_agent", "agent", "user_agent_class", 0, 1),
        ("http,http2", f"here AND {OLD} IS NOT NULL", "src", "finding", "end-of-life-os", OLD, "HIGH", 0, 1),
        ("http,http2", "there AND banner <> ''", "dest", "text", "http.server", "banner", "dhcp_vendor_class_secondary", 0, 1), ("http,http2", "there AND banner <> ''", "dest", "text", "http.server", "banner", "server_banner", 0, 1),
        ("http,http2", "there AND banner <> ''", "dest", "note", "http.server", "banner", "class=server", 0.3, 1), ("http,http2", "there AND k % 5 > 0", "dest", "hostname", "", HTTP_HOST, "", 0, 1),
    ],
    "e07_tls": [
        ("tls", "here", "src", "ja3", "", "'h' || (k % 4)", "", 0, 1), *ja4_rows("tls"),
        ("tls", f"there AND {SUBJECT} <> ''", "dest", "hostname", "", "'srv' || (k % 10) || '.corp'", "", 0, 1), ("tls", f"there AND {SUBJECT} <> ''", "dest", "note", "tls.subject", SUBJECT, "class=server", 0.4, 1),
        ("tls", f"there AND {SUBJECT} <> ''", "dest", "cert", "", f"'{{\"subject\":\"' || {SUBJECT} || '\",\"issuer\":\"' || {ISSUER} || '\",\"not_after\":\"' || strftime({END_DAY}, '%Y-%m-%dT00:00:00') || '\",\"version\":\"' || tls_version || '\"}}'", "", 0, 1),
        ("tls", f"there AND {SUBJECT} <> '' AND {SUBJECT} = {ISSUER}", "dest", "finding", "self-signed-cert", "''", "LOW", 0, 1), ("tls", "there", "dest", "hostname", "", "'s' || (k % 7) || '.corp'", "", 0, 1),
        ("tls", f"there AND {TLS_UP} IN ('SSLV2', 'SSLV3')", "dest", "finding", "obsolete-ssl", "tls_version", "CRITICAL", 0, 1), ("tls", f"there AND {TLS_UP} IN ('TLS 1.0', 'TLSV1', 'TLS 1.1', 'TLSV1.1')", "dest", "finding", "weak-tls", "tls_version", "MEDIUM", 0, 1),
    ],
    "e08_quic": [
        ("quic", "here", "src", "protocol", "", "'quic'", "", 0, 1), *ja4_rows("quic"), ("quic", "here AND agent <> ''", "src", "text", "quic.ua", "agent", "user_agent", 0, 1),
        ("quic", "there", "dest", "hostname", "", "'q' || (k % 7) || '.corp'", "", 0, 1), ("quic", "there", "dest", "note", "quic.sni", "'q' || (k % 7) || '.corp'", "class=server", 0.3, 1),
    ],
    "e09_ssh": [
        ("ssh", "there AND ssh <> ''", "dest", "text", "ssh.server.banner", "ssh", "ssh_banner", 0, 1), ("ssh", "there AND ssh <> ''", "dest", "note", "ssh.server.banner", "ssh", "class=server", 0.3, 1),
        ("ssh", "there AND ssh_version IN ('1.0', '1.99')", "dest", "finding", "ssh-v1", "''", "HIGH", 0, 1), ("ssh", "here AND ssh <> ''", "src", "text", "ssh.client.banner", "ssh", "ssh_banner", 0, 1),
    ],
    "e10_rdp": [
        ("rdp", "here", "src", "note", "rdp", "'RDP client'", "os=Windows", 0.6, 1), ("rdp", "here", "src", "hostname", "", "'PC-' || u", "", 0, 1), ("rdp", "here AND k % 2 = 0", "src", "note", "rdp.client.build", "'Windows 10'", "class=workstation", 0.4, 1),
        ("rdp", "there", "dest", "note", "rdp", "'RDP service'", "os=Windows", 0.7, 1), ("rdp", "there", "dest", "note", "rdp", "'RDP service'", "class=server", 0.4, 1),
    ],
    "e11_snmp": [
        ("snmp", "there", "dest", "note", "snmp", "'SNMP agent'", "class=network", 0.6, 1), ("snmp", "there AND described <> ''", "dest", "model", "", "described", "", 0, 1),
        ("snmp", "there AND described <> ''", "dest", "text", "snmp.sysDescr", "described", "dhcp_vendor_class", 0, 1), ("snmp", "there AND described <> ''", "dest", "text", "snmp.sysDescr", "described", "server_banner", 0, 1),
        ("snmp", "there AND described <> ''", "dest", "note", "snmp.sysDescr", "described", ("vendor=", WORD), 0.8, 2),
        ("snmp", "there AND snmp_version IN ('1', '2', '2c')", "dest", "finding", "snmp-v1v2", "snmp_version", "LOW", 0, 1), ("snmp", "there AND lower(community) IN ('public', 'private')", "dest", "finding", "default-snmp-community", "lower(community)", "HIGH", 0, 1),
    ],
    "e12_rfb": [("rfb", "there", "dest", "protocol", "", "'vnc'", "", 0, 1), ("rfb", "there", "dest", "note", "rfb", "'VNC server'", "class=server", 0.5, 1), ("rfb", "there AND lower(security) LIKE '%none%'", "dest", "finding", "vnc-no-auth", "''", "CRITICAL", 0, 1)],
    "e13_websocket": [("websocket", "there", "dest", "protocol", "", "'websocket'", "", 0, 1), ("websocket", "there", "dest", "note", "service", "'websocket'", "class=server", 0.3, 1)],
    "e14_smb": [
        ("smb", "here", "src", "note", "smb", "'SMB client'", "os=Windows", 0.4, 1), ("smb", "here", "src", "hostname", "", "'WS' || u", "", 0, 1), ("smb", "here", "src", "user", "", "'user' || (u % 20)", "", 0, 1),
        ("smb", "there", "dest", "note", "smb", "'SMB service'", "class=server", 0.4, 1), ("smb", "there", "dest", "share", "", "'share' || (k % 3)", "", 0, 1), ("smb", "there AND dialect IN ('1.0', 'NT LM 0.12')", "dest", "finding", "smbv1", "''", "HIGH", 0, 1),
    ],
    "e15_krb5": [
        ("krb5", "here AND cname <> '' AND cname NOT LIKE '%$'", "src", "user", "", "lower(cname)", "", 0, 1), ("krb5", "here AND cname <> '' AND cname NOT LIKE '%$'", "src", "note", "krb5.cname", "cname", "class=workstation", 0.4, 1),
        ("krb5", "here", "src", "note", "krb5", "'Kerberos client'", "os=Windows", 0.3, 1), ("krb5", "there", "dest", "note", "krb5", "'Kerberos service'", "class=server", 0.8, 1),
        ("krb5", "lower(cipher) LIKE '%rc4%' OR lower(cipher) LIKE '%des%'", "dest", "finding", "weak-kerberos", "lower(cipher)", "MEDIUM", 0, 1),
    ],
    "e16_ldap": [("ldap", "there", "dest", "protocol", "", "'ldap'", "", 0, 1), ("ldap", "there", "dest", "note", "ldap", "'LDAP service'", "class=server", 0.7, 1), ("ldap", "here", "src", "user", "", "'cn=u' || (u % 10)", "", 0, 1)],
    "e17_dcerpc": [("dcerpc", "there", "dest", "note", "dcerpc", "'DCERPC service'", "os=Windows", 0.6, 1), ("dcerpc", "there", "dest", "note", "dcerpc", "'DCERPC service'", "class=server", 0.5, 1), ("dcerpc", "here", "src", "note", "dcerpc", "'DCERPC client'", "os=Windows", 0.4, 1)],
    "e18_nfs": [("nfs", "there", "dest", "note", "nfs", "'NFS export'", "class=nas", 0.7, 1), ("nfs", "there", "dest", "share", "", "'/export' || (k % 2)", "", 0, 1)],
    "e19_smtp": [("smtp", "there", "dest", "protocol", "", "'smtp'", "", 0, 1), ("smtp", "there", "dest", "note", "smtp", "'SMTP service'", "class=server", 0.7, 1), ("smtp", "there", "dest", "hostname", "", "'mail' || (k % 3) || '.corp'", "", 0, 1), ("smtp", "here", "src", "protocol", "", "'smtp'", "", 0, 1)],
    "e20_pgsql": [("pgsql", "there", "dest", "protocol", "", "'postgresql'", "", 0, 1), ("pgsql", "there", "dest", "note", "service", "'postgresql'", "class=server", 0.8, 1)],
    "e21_sip": [r for c, ip in (("here", "src"), ("there", "dest")) for r in (("sip", c, ip, "protocol", "", "'sip'", "", 0, 1), ("sip", c, ip, "note", "sip", "'SIP telephony'", "class=phone", 0.6, 1), ("sip", f"{c} AND vendor <> ''", ip, "text", "sip.user_agent", "vendor", "dhcp_vendor_class", 0, 1))],
    "e22_mqtt": [("mqtt", "there", "dest", "protocol", "", "'mqtt'", "", 0, 1), ("mqtt", "there", "dest", "note", "mqtt", "'MQTT broker'", "class=iot", 0.6, 1), ("mqtt", "here", "src", "protocol", "", "'mqtt'", "", 0, 1), ("mqtt", "here", "src", "note", "mqtt", "'MQTT client'", "class=iot", 0.7, 1), ("mqtt", "here", "src", "hostname", "", "'sensor' || (u % 30)", "", 0, 1)],
    "e23_ike": [("ike,ikev2", "there", "dest", "protocol", "", "'vpn'", "", 0, 1), ("ike,ikev2", "there", "dest", "note", "service", "'vpn'", "class=server", 0.6, 1)],
    "e24_ftp": [("ftp,ftp_data", "there", "dest", "protocol", "", "'ftp'", "", 0, 1), ("ftp,ftp_data", "there", "dest", "note", "ftp", "'FTP service'", "class=server", 0.6, 1), ("ftp,ftp_data", "there AND banner <> ''", "dest", "text", "ftp.banner", "banner", "server_banner", 0, 1), ("ftp,ftp_data", "upper(command) IN ('USER', 'PASS')", "dest", "finding", "cleartext-credentials", "''", "HIGH", 0, 1), ("ftp,ftp_data", "here", "src", "protocol", "", "'ftp'", "", 0, 1)],
    "e25_tftp": [("tftp", "there", "dest", "protocol", "", "'tftp'", "", 0, 1), ("tftp", "there", "dest", "note", "tftp", "'TFTP service'", "class=network", 0.5, 1), ("tftp", "there", "dest", "finding", "tftp-in-use", "''", "MEDIUM", 0, 1)],
    "e26_fileinfo": [("fileinfo,files", "true", "src", "file", "", "''", "", 0, 1), ("fileinfo,files", "file IN ('Setup.EXE', 'a.ps1')", "dest", "finding", "executable-transfer", "lower(file)", "LOW", 0, 1)],
    "e27_industrial": [r for p in ("modbus", "dnp3", "enip") for r in ot_rows(p, f"={p}")],
    "e28_alert": [("alert", "true", "src", "alert", "", "''", "", 0, 1), ("alert", "fired = '1'", "src", "finding", "high-severity-alert", "'SIG ' || (k % 4)", "HIGH", 0, 1)],
    "e29_drop": [("drop", "true", "src", "drop", "", "''", "", 0, 1)],
    "e30_anomaly": [("anomaly", "true", "src", "anomaly", "", "''", "", 0, 1)],
    "e31_bittorrent": [("bittorrent-dht", "here", "src", "protocol", "", "'bittorrent'", "", 0, 1), ("bittorrent-dht", "here", "src", "finding", "p2p", "''", "LOW", 0, 1)],
    "e32_flow": [("flow,netflow", "there AND port <> '0'", "dest", "service", ("", "port"), "lower(proto)", ("", "app"), 0, 1), ("flow,netflow", "here AND NOT there", "src", "external", "", "dest", "", 0, 1), ("flow,netflow", "here AND there", "src", "crossing", ("", "port"), "dest", "", 0, 1)],
}


def _sql(value) -> str:
    """A literal, or (literal, expression) joined."""
    if isinstance(value, tuple):
        return f"'{value[0]}' || {value[1]}" if value[0] else value[1]
    return "'" + value.replace("'", "''") + "'"


def fact_rows(rows: list[tuple]) -> str:
    parts = []
    for kinds, cond, ip, fact, key, value, conclusion, weight, spec in rows:
        if kinds.startswith("="):
            p = kinds[1:]
            when = f"(t = '{p}' OR (t IN ('flow', 'netflow') AND app = '{p}'))"
        else:
            when = f"t IN ({', '.join(repr(t) for t in kinds.split(','))})" if kinds else "true"
        parts.append(f"SELECT seq, ts, u, k, {ip} AS ip, '{fact}' AS fact, {_sql(key)} AS key, {value} AS value, {_sql(conclusion)} AS conclusion, {weight}::DOUBLE AS weight, {spec} AS spec FROM e WHERE {when} AND ({cond})")
    return "\nUNION ALL ".join(parts)


def handler_sql(name: str) -> str:
    return f"WITH {adapter.sql_base()}, f AS ({fact_rows(ROWS[name])}) SELECT seq, ip, fact, key, value, conclusion, weight, spec FROM f"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


def _rule_ctes() -> str:
    text, seen = [], {}
    for r in rules.read_rows((rules.DATA / "fingerprints.tsv").read_text("utf-8"), 4):
        seen[r[0]] = seen.get(r[0], -1) + 1
        text.append((r[0], seen[r[0]], r[1], r[2], float(r[3]), int(r[4])))
    ports = [(int(r[0]), r[1], float(r[2]), r[3]) for r in rules.read_rows((rules.DATA / "ports.tsv").read_text("utf-8"), 4)]
    protos = [(r[0], r[1], float(r[2])) for r in rules.read_rows((rules.DATA / "app_proto.tsv").read_text("utf-8"), 3)]
    curated = [(r[0], r[1]) for r in rules.read_rows((rules.DATA / "oui_override.tsv").read_text("utf-8"), 2)]
    return f"""rt(rule_table, rule, match, concluded, w, s) AS (VALUES {_values(text)}),
rp(port, concluded, w, note) AS (VALUES {_values(ports)}),
ra(app, concluded, w) AS (VALUES {_values(protos)}),
ro(prefix, vendor) AS (VALUES {_values(curated)})"""


ALL = [r for rows in ROWS.values() for r in rows]
RANDOM = "(('0x' || substr(value, 1, 2))::INT & 2) <> 0"
#: All facts (f), rules, owned addresses (mo), evidence (ev), conclusions (co), winners (wi).
GOLD = f"""{adapter.sql_base()}, f AS ({fact_rows(ALL)}), {_rule_ctes()},
mo AS (
  SELECT DISTINCT ip, value AS mac, arg_max(vendor, length(prefix)) AS vendor
  FROM (SELECT DISTINCT ip, value FROM f WHERE fact = 'mac' AND NOT {RANDOM}) m JOIN ro ON starts_with(upper(replace(m.value, ':', '')), prefix) GROUP BY ip, value
),
tx AS (
  SELECT DISTINCT ip, key, value, conclusion AS rule_table, CASE WHEN conclusion IN ('dhcp_vendor_class_secondary', 'user_agent_class', 'server_banner') THEN 1 ELSE 0 END AS nth, fact FROM f WHERE fact = 'text'
  UNION ALL SELECT DISTINCT ip, 'mac.oui', vendor, 'vendor_class', 1, 'text' FROM mo
),
ty AS (
  SELECT ip, key, value, rule_table, CASE
    WHEN key = 'http.server' THEN CASE rule_table WHEN 'server_banner' THEN 1 ELSE 0 END
    WHEN key = 'enip.identity.product_name' THEN CASE rule_table WHEN 'server_banner' THEN 1 ELSE 2 END
    WHEN key = 'ftp.banner' THEN 0 ELSE nth END AS nth FROM tx
),
raw AS (
  SELECT ip, key AS signal, value, conclusion, weight, spec, CASE WHEN key IN ('http.server', 'ssh.server.banner') OR (key = 'snmp.sysDescr') THEN 2000 ELSE 0 END AS ord FROM f WHERE fact = 'note'
  UNION ALL SELECT ip, key, value, concluded, w, s, nth * 1000 + rule FROM ty JOIN rt ON rt.rule_table = ty.rule_table AND contains(lower(ty.value), rt.match)
  UNION ALL SELECT DISTINCT ip, 'service.port', key || ' (' || note || ')', concluded, w, 1, 0 FROM f JOIN rp ON f.key = rp.port::VARCHAR WHERE fact = 'service'
  UNION ALL SELECT DISTINCT ip, 'app_proto', value, concluded, w, 1, 0 FROM f JOIN ra ON f.value = ra.app WHERE fact = 'app_proto'
  UNION ALL SELECT ip, 'mac.oui', mac, 'vendor=' || vendor, 0.85, 1, 0 FROM mo
),
ev AS (SELECT ip, signal, value, conclusion, arg_min(weight, ord) AS weight, arg_min(spec, ord)::INT AS spec FROM raw WHERE weight > 0 GROUP BY ALL),
co AS (SELECT ip, conclusion, 1 - product(1 - weight) AS weight, max(spec) AS spec FROM ev GROUP BY ALL),
pl AS (
  SELECT *, split_part(conclusion, '=', 1) AS part, substr(conclusion, strpos(conclusion, '=') + 1) AS name,
    row_number() OVER (PARTITION BY ip, split_part(conclusion, '=', 1) ORDER BY CASE WHEN starts_with(conclusion, 'os=') THEN -spec ELSE 0 END, round(weight, 12) DESC, conclusion) AS place FROM co
),
wi AS (
  SELECT ip, coalesce(max(name) FILTER (WHERE part = 'class'), '') AS class, coalesce(max(weight) FILTER (WHERE part = 'class'), 0) AS confidence,
    coalesce(max(name) FILTER (WHERE part = 'os'), '') AS os, coalesce(max(name) FILTER (WHERE part = 'vendor'), '') AS vendor FROM pl WHERE place = 1 GROUP BY ip
)"""


def gold(select: str, more: str = "") -> str:
    return f"WITH {GOLD}{', ' + more if more else ''} {select}"


def sets(*kinds: str) -> str:
    return ", ".join(f"coalesce(string_agg(DISTINCT value, ',' ORDER BY value) FILTER (WHERE fact = '{k}'), '') AS {n}" for k, n in (x.split(":") for x in kinds))


LATEST = "coalesce(arg_max(value, ts::VARCHAR || lpad(seq::VARCHAR, 12, '0')) FILTER (WHERE fact = '{0}'), '') AS {0}"
HOST_NAME = "regexp_replace(value, '^[. ]+|[. ]+$', '', 'g')"
HOSTS = f"h AS (SELECT ip, string_agg(DISTINCT n, ',' ORDER BY n) AS hostnames, coalesce(min(n) FILTER (WHERE n NOT LIKE '%.local'), min(n)) AS hostname FROM (SELECT ip, lower({HOST_NAME}) AS n FROM f WHERE fact = 'hostname') WHERE n NOT IN ('', '*') AND n NOT LIKE '% %' GROUP BY ip)"
NOW = "TIMESTAMP '2025-06-01 12:00:00'"
CERT_FINDINGS = f"""cf AS (
  SELECT seq, ip, CASE WHEN d < 0 THEN 'cert-expired' ELSE 'cert-expiring' END AS key, strftime(x, '%Y-%m-%d') AS value, CASE WHEN d < 0 THEN 'HIGH' ELSE 'MEDIUM' END AS conclusion
  FROM (SELECT seq, ip, x, trunc(epoch(x::TIMESTAMP - {NOW}) / 86400)::INT AS d FROM (SELECT seq, ip, DATE '2024-01-01' + (k * 10)::INT AS x FROM f WHERE fact = 'cert')) WHERE d <= 30
)"""
STATS = """st0 AS (
  SELECT seq, seq AS up, CASE WHEN k % 3 = 0 AND seq > 0 THEN seq * 100 END AS c, CASE WHEN k % 2 = 0 AND seq * (k % 4) > 0 THEN seq * (k % 4) END AS d FROM e WHERE t = 'stats'
), st AS (
  SELECT seq, up, coalesce(last_value(c IGNORE NULLS) OVER w, 0) AS captured, coalesce(last_value(d IGNORE NULLS) OVER w, 0) AS dropped FROM st0 WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)
)"""
ZONES = "zone users 10.1.0.0/16\nzone servers 10.0.0.0/16\nzone printers 10.0.9.4/30\nzone plant 10.0.9.16/28\nallow users -> servers\nallow printers <-> users\n"
ZONE_SQL = """zn AS (SELECT ip, CASE WHEN ip LIKE '10.1.%' THEN 'users' WHEN split_part(ip, '.', 4)::INT BETWEEN 4 AND 7 THEN 'printers' WHEN split_part(ip, '.', 4)::INT BETWEEN 16 AND 31 THEN 'plant' ELSE 'servers' END AS zone FROM (SELECT DISTINCT ip FROM f WHERE fact = 'crossing' UNION SELECT DISTINCT value FROM f WHERE fact = 'crossing')),
vi AS (
  SELECT seq, f.ip, 'segmentation-' || a.zone || '-to-' || b.zone AS key, a.zone || ' to ' || b.zone || ', first at ' || value || CASE WHEN key <> '0' THEN ':' || key ELSE '' END AS value, 'HIGH' AS conclusion
  FROM f JOIN zn a ON a.ip = f.ip JOIN zn b ON b.ip = f.value WHERE fact = 'crossing' AND a.zone <> b.zone AND (a.zone, b.zone) NOT IN (('users', 'servers'), ('printers', 'users'), ('users', 'printers'))
)"""
FINDINGS = f"""{CERT_FINDINGS}, {STATS}, {ZONE_SQL}, rf AS (
  SELECT seq, ip, key, value, conclusion FROM f WHERE fact = 'finding' UNION ALL SELECT * FROM cf UNION ALL SELECT * FROM vi
  UNION ALL SELECT seq, 'sensor', 'sensor-packet-loss', '', 'MEDIUM' FROM st WHERE captured > 0 AND 100.0 * dropped / captured > 1
), fi AS (
  SELECT ip AS device, key AS kind, arg_min(conclusion, seq) AS severity, arg_min(value, seq) AS seen, count(*) AS count, min(seq) AS first_seq FROM rf GROUP BY ALL
)"""

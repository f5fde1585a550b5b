"""The typed payload of each event type: one struct a type, null in events of other types.

Every field that an operator reads is named here once, with the paths it may stand at
(fixed values: the sensor's format). A payload's values are taken out of its record all at
once, for the type it has only; what reads the columns later needs no JSON, and columns
that a query doesn't use are pruned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netquarry.functions import access, net
from netquarry.functions.reuse import once

#: Payload: the event types that carry it.
KINDS = {
    "dhcp": ("dhcp",), "arp": ("arp",), "dns": ("dns",), "http": ("http", "http2"), "tls": ("tls",), "quic": ("quic",), "ssh": ("ssh",), "rdp": ("rdp",),
    "snmp": ("snmp",), "rfb": ("rfb",), "smb": ("smb",), "krb5": ("krb5",), "ldap": ("ldap",), "nfs": ("nfs",), "smtp": ("smtp",), "sip": ("sip",),
    "mqtt": ("mqtt",), "ftp": ("ftp", "ftp_data"), "file": ("fileinfo", "files"), "alert": ("alert",), "stats": ("stats",),
    "modbus": ("modbus", "flow", "netflow"), "dnp3": ("dnp3", "flow", "netflow"), "enip": ("enip", "flow", "netflow"),
}


def _ends(field: str) -> tuple[str, ...]:
    return (f"dnp3.{field}", f"dnp3.request.{field}", f"dnp3.response.{field}")


def _identity(field: str) -> tuple[str, ...]:
    return tuple(f"enip.{at}identity.{field}" for at in ("response.", "request.", ""))


#: Text fields: of several paths, the first that holds a string that isn't empty.
TEXTS = {
    "dhcp": {"told": ("dhcp.assigned_ip", "dhcp.client_ip"), "mac": ("dhcp.client_mac",), "host": ("dhcp.hostname",), "vendor": ("dhcp.vendor_class_identifier", "dhcp.vendor_class")},
    "arp": {"src_ip": ("arp.src_ip", "arp.sender_ip"), "src_mac": ("arp.src_mac", "arp.sender_mac"), "dest_ip": ("arp.dest_ip", "arp.target_ip"), "dest_mac": ("arp.dest_mac", "arp.target_mac")},
    "http": {"agent": ("http.http_user_agent", "http.user_agent"), "banner": ("http.http_server", "http.server"), "host": ("http.hostname",)},
    "tls": {"ja3": ("tls.ja3.hash",), "ja4": ("tls.ja4", "tls.ja4.hash"), "subject": ("tls.subject",), "issuer": ("tls.issuerdn",), "end": ("tls.notafter", "tls.not_after"), "version": ("tls.version",), "sni": ("tls.sni",)},
    "quic": {"ja3": ("quic.ja3.hash",), "ja4": ("quic.ja4",), "agent": ("quic.ua",), "sni": ("quic.sni", "quic.server_name")},
    "ssh": {"server": ("ssh.server.software_version", "ssh.server.software"), "version": ("ssh.server.proto_version",), "client": ("ssh.client.software_version", "ssh.client.software")},
    "rdp": {"client": ("rdp.client.client_name", "rdp.client.hostname"), "build": ("rdp.client.build",), "subject": ("rdp.tls.subject",)},
    "snmp": {"described": ("snmp.sysdescr", "snmp.sys_descr"), "version": ("snmp.version",)},
    "rfb": {"security": ("rfb.authentication.security_type_name", "rfb.security_type_name")},
    "smb": {"host": ("smb.ntlmssp.host",), "user": ("smb.ntlmssp.user",), "share": ("smb.share",), "dialect": ("smb.dialect",)},
    "krb5": {"name": ("krb5.cname",), "cipher": ("krb5.encryption",)},
    "ldap": {"name": ("ldap.request.bind_request.name", "ldap.bind.name")},
    "nfs": {"share": ("nfs.filename", "nfs.export")},
    "smtp": {"helo": ("smtp.helo",)},
    "sip": {"agent": ("sip.user_agent", "sip.request_line")},
    "mqtt": {"client": ("mqtt.connect.client_id", "mqtt.client_id")},
    "ftp": {"command": ("ftp.command",), "banner": ("ftp.completion_code", "ftp.reply")},
    "file": {"name": ("fileinfo.filename", "files.filename")},
    "alert": {"signature": ("alert.signature",)},
    "enip": {"product": _identity("product_name"), "revision": _identity("revision"), "serial": _identity("serial")},
}
#: Whole numbers: of several paths, the first that isn't 0.
NUMBERS = {
    "alert": {"severity": ("alert.severity",)},
    "stats": {"uptime": ("stats.uptime",), "captured": ("stats.capture.kernel_packets",), "dropped": ("stats.capture.kernel_drops",)},
    "modbus": {"unit": ("modbus.request.unit_id", "modbus.response.unit_id", "modbus.unit_id")},
    "dnp3": {"src": _ends("src"), "dst": _ends("dst")},
    "enip": {"maker": _identity("vendor_id"), "kind": _identity("device_type")},
}


def _dns_names(at) -> Column:
    """ip and name of the flat answer and of each of the list that names a local address."""
    flat = F.struct(access.text_of(at("dns.rdata")).alias("ip"), access.text_of(at("dns.rrname")).alias("name"))
    pairs = F.concat(F.array(flat), F.transform(access.items_of(at("dns.answers")), lambda a: F.struct(access.text(a, "rdata").alias("ip"), access.text(a, "rrname").alias("name"))))
    return F.filter(pairs, lambda p: net.is_private(p["ip"]) & (p["name"] != ""))


def _default_communities(at) -> Column:
    lower = F.transform(access.texts_of(at("snmp.community")), lambda c: F.lower(c))
    return F.filter(lower, lambda c: c.isin("public", "private"))


#: Fields that are lists, and the paths they are made of.
LISTS = {"dns": {"names": (_dns_names, ("dns.rdata", "dns.rrname", "dns.answers"))}, "snmp": {"defaults": (_default_communities, ("snmp.community",))}}


def paths_of(name: str) -> list[str]:
    """All paths that a payload's fields may stand at."""
    found = [p for kind in (TEXTS, NUMBERS) for paths in kind.get(name, {}).values() for p in paths]
    return found + [p for _, paths in LISTS.get(name, {}).values() for p in paths]


def _plain(name: str) -> set[str]:
    """Paths of a payload that hold texts and nothing else."""
    texts = [p for paths in TEXTS.get(name, {}).values() for p in paths]
    others = [p for paths in NUMBERS.get(name, {}).values() for p in paths] + [p for _, paths in LISTS.get(name, {}).values() for p in paths]
    return access.plain(texts, others)


def _raw(name: str) -> str:
    return f"__{name}"


@once
def raw() -> dict[str, Column]:
    """Column name: all values of a payload as one struct of texts' bytes and VARIANTs, null in events of other types; from the columns record, event_type and app_proto."""
    v, event_type, app_proto = F.col("record"), F.col("event_type"), F.col("app_proto")
    out = {}
    for name, kinds in KINDS.items():
        has = event_type.isin(*kinds)
        if "flow" in kinds:  # flows of an industrial protocol may carry its payload too
            has = (event_type == kinds[0]) | (event_type.isin(*kinds[1:]) & (app_proto == kinds[0]))
        out[_raw(name)] = F.when(has, F.try_variant_get(v, "$", access.tree(paths_of(name), _plain(name))))
    return out


@once
def columns() -> dict[str, Column]:
    """Payload name: its struct of typed fields, from the columns of raw()."""
    out = {}
    for name in KINDS:
        column, paths = _raw(name), paths_of(name)
        at = lambda path, column=column, paths=paths: access.at(column, path, paths)
        text = lambda path, column=column, paths=paths, texts=_plain(name): access.text_at(column, path, paths, texts)
        fields = [access.first_of(*map(text, of)).alias(f) for f, of in TEXTS.get(name, {}).items()]
        fields += [access.first_number(*map(at, of)).alias(f) for f, of in NUMBERS.get(name, {}).items()]
        fields += [read(at).alias(f) for f, (read, _) in LISTS.get(name, {}).items()]
        out[name] = F.when(F.col(column).isNotNull(), F.struct(*fields))
    return out

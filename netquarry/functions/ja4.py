"""The readable first part of a JA4 client fingerprint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the fingerprint's format.
TRANSPORTS = {"t": "TCP", "q": "QUIC", "d": "DTLS"}
VERSIONS = {"13": "TLS 1.3", "12": "TLS 1.2", "11": "TLS 1.1", "10": "TLS 1.0", "s3": "SSL 3.0", "s2": "SSL 2.0", "d1": "DTLS 1.0", "d2": "DTLS 1.2", "d3": "DTLS 1.3", "00": "unknown"}
OBSOLETE = ("11", "10", "s3", "s2", "d1")
ALPN = {"h1": "HTTP/1.1", "h2": "HTTP/2", "h3": "HTTP/3", "dt": "DNS-over-TLS", "dq": "DNS-over-QUIC", "00": ""}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def decode(fingerprint: Column) -> Column:
    """Struct of transport, tls_version, obsolete, sni, ciphers, extensions, alpn, ok; ok is false for what doesn't parse."""
    head = F.substring_index(fingerprint, "_", 1)
    part = lambda start, size: F.substring(head, start, size)
    # lengths and classes are bytes: a head with other characters is no fingerprint
    ok = F.coalesce((F.octet_length(head) == 10) & head.rlike(r"^[tqd](?:1[0-3]|s[23]|d[123]|00)[di][0-9]{4}(?s:..)$"), F.lit(False))
    alpn = F.coalesce(_lookup(ALPN, part(9, 2)), part(9, 2))
    kept = lambda value, none: F.when(ok, value).otherwise(none)
    return F.struct(
        kept(_lookup(TRANSPORTS, part(1, 1)), F.lit("")).alias("transport"),
        kept(_lookup(VERSIONS, part(2, 2)), F.lit("")).alias("tls_version"),
        kept(part(2, 2).isin(*OBSOLETE), F.lit(False)).alias("obsolete"),
        kept(part(4, 1) == "d", F.lit(False)).alias("sni"),
        kept(part(5, 2).try_cast("int"), F.lit(0)).alias("ciphers"),
        kept(part(7, 2).try_cast("int"), F.lit(0)).alias("extensions"),
        kept(alpn, F.lit("")).alias("alpn"),
        ok.alias("ok"),
    )

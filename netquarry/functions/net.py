"""Addresses and hardware addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
#: IPv6 text: up to eight groups of hex digits with at most one gap, the last two perhaps as dotted IPv4.
V6 = (
    r"(?i)^(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?=(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}$)(?:(?:[0-9a-f]{1,4}:)*[0-9a-f]{1,4})?::(?:(?:[0-9a-f]{1,4}:)*[0-9a-f]{1,4})?"
    rf"|(?:[0-9a-f]{{1,4}}:){{6}}{OCTET}(?:\.{OCTET}){{3}}|(?:(?:[0-9a-f]{{1,4}}:)*[0-9a-f]{{1,4}})?::(?:[0-9a-f]{{1,4}}:)*{OCTET}(?:\.{OCTET}){{3}})$"
)
#: What may stand before an IPv4 address mapped into IPv6.
MAPPED = r"(?:0{0,4}:){0,5}:?ffff:"
#: Loopback, RFC 1918, link-local and link-local multicast addresses of IPv4, mapped or not.
LOCAL_V4 = rf"(?:(?:127|10)(?:\.{OCTET}){{3}}|(?:169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))(?:\.{OCTET}){{2}}|224\.0\.0\.{OCTET})$"
PRIVATE_V4, PRIVATE_MAPPED = f"^{LOCAL_V4}", f"(?i)^{MAPPED}{LOCAL_V4}"


def v4_number(ip: Column) -> Column:
    """A dotted IPv4 address, or one mapped into IPv6, as a number; null for all else."""
    plain = F.regexp_replace(ip, rf"(?i)^{MAPPED}(?=[0-9.]+$)", "")
    parts = F.split(plain, r"\.")
    total = F.lit(0).cast("bigint")
    for k in range(4):
        total = total * 256 + F.get(parts, F.lit(k)).try_cast("bigint")
    return F.when(plain.rlike(V4), total)


def is_private(ip: Column) -> Column:
    """Loopback, link-local (multicast too), RFC 1918 and unique local addresses; false for what is no address."""
    six = ip.rlike(V6) & (ip.rlike(r"(?i)^(?:fe[89ab][0-9a-f]:|f[cd][0-9a-f]{2}:|ff[0-9a-f]2:)") | ip.rlike(r"^(?:0{1,4}:){7}0{0,3}1$|^(?:(?:0{1,4}:)*0{1,4})?::(?:(?:0{1,4}:)*)0{0,3}1$"))
    return F.coalesce(F.when(ip.contains(":"), ip.rlike(PRIVATE_MAPPED) | six).otherwise(ip.rlike(PRIVATE_V4)), F.lit(False))


def ip_key(ip: Column) -> Column:
    """Sorts IPv4 by number before all else by text."""
    return F.struct(v4_number(ip).isNull().alias("other"), F.coalesce(v4_number(ip), F.lit(0)).alias("number"), ip.alias("text"))


def mac_digits(mac: Column) -> Column:
    return F.upper(F.regexp_replace(mac, "[^0-9A-Fa-f]", ""))


def is_random_mac(mac: Column) -> Column:
    """Whether the locally administered bit is set."""
    first = F.conv(F.substring(mac_digits(mac), 1, 2), 16, 10).try_cast("int")
    return F.coalesce((F.length(mac_digits(mac)) >= 2) & (first.bitwiseAND(F.lit(2)) != 0), F.lit(False))

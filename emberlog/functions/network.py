"""Addresses, hosts and domains as column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IPV4 = rf"(?<![0-9.])({OCTET}(?:\.{OCTET}){{3}})(?![0-9.])"
IPV6 = r"(?<![:\w])((?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4})(?![:\w])"

_COUNTED, _ANY = "[1-9][0-9]{0,2}", "(?:0|[1-9][0-9]{0,2})"
_PLAUSIBLE = rf"^(?:(?:10|172|192)(?:\.{_ANY}){{3}}|{_COUNTED}(?:\.{_COUNTED}){{3}})$"

# IPv4 networks that are not public, and the part of them that is.
NOT_PUBLIC = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]
PUBLIC_WITHIN = ["192.0.0.9/32", "192.0.0.10/32"]
# The same for IPv6: unspecified, loopback, mapped, local, documentation, reserved and multicast ones.
NOT_PUBLIC_V6 = [
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5",
    "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "fec0::/10", "ff00::/8", "2001::/23", "2001:db8::/32", "2002::/16", "64:ff9b:1::/48",
]
PUBLIC_WITHIN_V6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else, leading zeros included."""
    parts = F.split(ip, r"\.")
    number = sum((F.get(parts, i).try_cast("bigint") * F.lit(1 << 8 * (3 - i)) for i in range(4)), F.lit(0).cast("bigint"))
    return F.when(ip.rlike(r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"), number)


def _within(number: Column, networks: list[str]) -> Column:
    inside = F.lit(False)
    for net in map(ipaddress.ip_network, networks):
        inside = inside | number.between(int(net.network_address), int(net.broadcast_address))
    return inside


def is_public_ipv4(ip: Column) -> Column:
    """Whether a text is a public IPv4 address, in plain arithmetic; false for null."""
    n = ipv4_number(ip)
    return F.coalesce(~_within(n, NOT_PUBLIC) | _within(n, PUBLIC_WITHIN), F.lit(False))


def _ipv6_groups(ip: Column) -> Column:
    """The eight numbers of an IPv6 address (``::`` filled with zeros); null for anything else."""
    halves = F.split(ip, "::")
    group = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")
    left, right = group(F.get(halves, 0)), group(F.coalesce(F.get(halves, 1), F.lit("")))
    gap = 8 - F.size(left) - F.size(right)
    short = F.size(halves) == 2
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.when(short, F.greatest(gap, F.lit(0))).otherwise(0)), right)
    fits = ip.rlike("(?i)^[0-9a-f:]+$") & ~ip.rlike("(^:[^:])|([^:]:$)|:::") & (F.size(halves) <= 2) & F.when(short, gap >= 1).otherwise(gap == 0) & F.forall(filled, lambda g: F.length(g) <= 4)
    return F.when(fits, F.transform(filled, lambda g: F.conv(g, 16, 10).cast("int")))


def _within6(groups: Column, networks: list[str]) -> Column:
    """Whether the first four groups (all networks here are that long at most) lie in one of the networks."""
    inside = F.lit(False)
    for net in map(ipaddress.ip_network, networks):
        low, fit = int(net.network_address), F.lit(True)
        for k in range(8):
            bits = min(16, max(0, net.prefixlen - 16 * k))
            if bits:
                unit, want = 1 << (16 - bits), low >> (112 - 16 * k) & 0xFFFF
                fit = fit & F.get(groups, k).between(want, want + unit - 1)
        inside = inside | fit
    return inside


def is_public_ipv6(ip: Column) -> Column:
    """Whether a text is a public IPv6 address; false for null."""
    groups = _ipv6_groups(ip)
    return F.coalesce(F.transform(F.array(groups), lambda g: ~_within6(g, NOT_PUBLIC_V6) | _within6(g, PUBLIC_WITHIN_V6))[0], F.lit(False))


def is_public_ip(ip: Column) -> Column:
    return F.when(ip.contains(":"), is_public_ipv6(ip)).otherwise(is_public_ipv4(ip))


def is_private_ipv4(ip: Column) -> Column:
    n = ipv4_number(ip)
    return F.coalesce(_within(n, NOT_PUBLIC) & ~_within(n, PUBLIC_WITHIN), F.lit(False))


def plausible_ip(ip: Column) -> Column:
    """An address rather than a version number: no leading zeros and, outside 10, 172 and 192, no octet that is zero."""
    return F.coalesce(ip.rlike(_PLAUSIBLE), F.lit(False))


def find_ipv4(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IPV4), F.lit(1))


def find_ipv6(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(IPV6), F.lit(1)), lambda x: ~x.startswith("::"))


def url_host(url: Column) -> Column:
    """Lower-cased host of a url without credentials, port and trailing dot; null if there is none."""
    authority = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.\-]*://([^/?#\s]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":[0-9]*$", ""), r"\.$", ""))
    return F.when(host != "", host)


def clean_domain(text: Column) -> Column:
    """A domain name out of a text that may be percent-encoded or a whole url: lower case, no trailing dot; null if there is none.

    Encoded separators and a scheme in front, and whatever follows the host, are dropped. Addresses and long numeric
    client ids are no names.
    """
    # Bound to a lambda's variable, a value is worked out once and not wherever it is named; only % and + are decoded.
    decoded = lambda v: F.when(v.contains("%") | v.contains("+"), F.coalesce(F.try_url_decode(F.coalesce(F.try_url_decode(v), v)), v)).otherwise(v)
    plain = F.transform(F.array(text), decoded)[0]
    name = F.regexp_replace(F.lower(F.trim(plain)), r"\.+$", "")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "^[/=:,&?]+", ""), "^(%?2f|%?3d|%?3a|%?2c|%?26|%?3f)+", ""), "^https?:?/*", "")
    name = F.regexp_replace(F.regexp_replace(name, "[/?&].*$", ""), "^.*=", "")
    fits = lambda n: n.rlike(r"^(?=.{4,253}$)[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)+$")
    return F.transform(F.array(name), lambda n: F.when(fits(n) & ~n.rlike(f"^{IPV4}$") & ~n.rlike(r"^[0-9]{9,}\."), n))[0]

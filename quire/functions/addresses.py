"""Addresses that may be fetched, as Spark columns: links by their parts, IPv4 numbers by ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IPv4 ranges that aren't of the public internet.
BLOCKED = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]
# End of the fixed values.
_IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$"


def ipv4_number(ip: Column) -> Column:
    """The number of a dotted address; null for anything else."""
    p = F.split(ip, r"\.")
    return F.when(ip.rlike(_IPV4), p[0].cast("long") * (1 << 24) + p[1].cast("long") * (1 << 16) + p[2].cast("long") * 256 + p[3].cast("long"))


def is_public(ip: Column) -> Column:
    """Whether an IPv4 address is one of the public internet; false for what is no such address."""

    def number(a: str) -> int:
        return sum(int(x) << (24 - 8 * k) for k, x in enumerate(a.split(".")))

    n = ipv4_number(ip)
    blocked = F.lit(False)
    for address, bits in BLOCKED:
        blocked = blocked | n.between(number(address), number(address) + (1 << (32 - bits)) - 1)
    return F.coalesce(~blocked, F.lit(False))


def may_fetch(url: Column) -> Column:
    """Whether a link is one of http or https with a host, without a user, and not to an address or name of the local network."""
    host = F.lower(F.parse_url(url, F.lit("HOST")))
    local = host.rlike(r"^localhost$|\.localhost$|\.local$|\.internal$") | (ipv4_number(host).isNotNull() & ~is_public(host))
    good = url.rlike("(?i)^https?://") & host.isNotNull() & (host != "") & F.parse_url(url, F.lit("USERINFO")).isNull() & ~local
    return F.coalesce(good, F.lit(False))

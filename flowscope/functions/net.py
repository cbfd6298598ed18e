"""Address predicates."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: reserved networks that count as private ----------------------------------------
PRIVATE_IPV4 = [
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/29",
    "192.0.0.170/31",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
]
# IPv6: ::1, ::, ::ffff:0:0/96, 100::/64, 2001::/23, 2001:db8::/32, 2001:10::/28, fc00::/7, fe80::/10
PRIVATE_IPV6 = r"^(::1?|::ffff:[0-9a-f.:]+|100::[0-9a-f:]*|2001:(0?[01]?[0-9a-f]{1,2})?:[0-9a-f:]*|2001:0?db8:[0-9a-f:]*|f[cd][0-9a-f]{2}:[0-9a-f:]*|fe[89ab][0-9a-f]:[0-9a-f:]*)$"
# --- end of fixed values ---------------------------------------------------------------------------

OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
ADDRESS = rf"^{OCTET}(\.{OCTET}){{3}}$"


def ipv4_number(text: Column) -> Column:
    """Dotted quad to bigint, null where the text is no IPv4 address."""
    octets = F.split(text, r"\.")
    total = F.lit(0).cast("bigint")
    for place in range(4):
        total = total * 256 + F.get(octets, F.lit(place)).try_cast("bigint")
    return F.when(text.rlike(ADDRESS), total)


def is_private_ip(text: Column) -> Column:
    def reserved(number: Column) -> Column:
        private = F.lit(False)
        for network in map(ipaddress.IPv4Network, PRIVATE_IPV4):
            private = private | number.between(int(network.network_address), int(network.broadcast_address))
        return private

    # the one-element array binds the number once instead of once per range
    v4 = F.get(F.transform(F.array(ipv4_number(text)), reserved), F.lit(0))
    return F.coalesce(v4, F.lower(text).rlike(PRIVATE_IPV6), F.lit(False))


def is_ipv4(text: Column) -> Column:
    """An IPv4 address or a network in CIDR (length or mask) form whose host bits are all zero."""
    parts = F.split(text, "/")
    number = ipv4_number(F.get(parts, F.lit(0)))
    suffix = F.get(parts, F.lit(1))
    length = F.when(suffix.rlike(r"^[0-9]+$"), suffix.try_cast("int"))
    mask = ipv4_number(suffix)
    low_bits = F.bitwise_not(mask).bitwiseAND(F.lit(0xFFFFFFFF))
    contiguous = low_bits.bitwiseAND(low_bits + 1) == 0
    inverted = mask.bitwiseAND(mask + 1) == 0
    host = (
        F.when(length.between(0, 32), F.expr("1L") * F.pow(F.lit(2), 32 - length).cast("bigint") - 1)
        .when(contiguous, low_bits)
        .when(inverted, mask)
    )
    valid = (
        F.when(F.size(parts) == 1, number.isNotNull())
        .when(F.size(parts) == 2, number.isNotNull() & host.isNotNull() & (number.bitwiseAND(host) == 0))
        .otherwise(F.lit(False))
    )
    return F.coalesce(valid, F.lit(False))

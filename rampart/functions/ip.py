"""Address columns: validity, canonical text, prefix bits, classification.

Everything is built from string and integer expressions, so address work stays
inside the JVM and needs no Python worker.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

from rampart.functions.text import let

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_HEXTET = "[0-9a-f]{1,4}"
_SIDE = rf"(?:{_HEXTET}(?::{_HEXTET})*)?"

# Address ranges of the IANA special-purpose registries.
PRIVATE_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
]
PRIVATE_V4_EXCEPT = ["192.0.0.9/32", "192.0.0.10/32"]
SHARED_V4 = ["100.64.0.0/10"]
PRIVATE_V6 = [
    "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32",
    "2002::/16", "fc00::/7", "fe80::/10",
]
PRIVATE_V6_EXCEPT = [
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
]
RESERVED_V6 = [
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3",
    "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9",
]
DOCUMENTATION = ["192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "2001:db8::/32"]


def is_v4(c: Column) -> Column:
    return c.rlike(rf"^{_V4}\z")


def v4_number(c: Column) -> Column:
    """The address as a number in 0..2^32-1; null unless it is IPv4."""
    parts = F.split(c, r"\.")
    octet = lambda i: F.get(parts, F.lit(i)).try_cast("bigint")
    return F.when(is_v4(c), octet(0) * 16777216 + octet(1) * 65536 + octet(2) * 256 + octet(3))


def _v6_body(text: Column) -> Column:
    """Lower-case hextet text; a zone suffix is removed, a dotted tail becomes two hextets."""

    def undot(t: Column) -> Column:
        octet = lambda q, i: F.get(q, F.lit(i)).try_cast("bigint")
        pair = lambda q, i: F.lower(F.hex(octet(q, i) * 256 + octet(q, i + 1)))
        head = F.regexp_replace(t, r"[0-9.]+\z", "")
        quad = F.split(F.regexp_extract(t, rf":({_V4})\z", 1), r"\.")
        return F.when(
            F.contains(t, F.lit(".")), let(quad, lambda q: F.concat(head, pair(q, 0), F.lit(":"), pair(q, 2)))
        ).otherwise(t)

    return let(F.lower(F.regexp_replace(text, r"%[^%]+\z", "")), undot)


def hextets(c: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address as lower-case hex; null if it is not one."""

    def split_body(body: Column) -> Column:
        side = lambda n: F.filter(F.split(F.substring_index(body, "::", n), ":"), lambda x: x != "")
        joined = F.struct(side(1).alias("l"), side(-1).alias("r"))
        fill = lambda s: F.when(
            F.size(s["l"]) + F.size(s["r"]) <= 7,
            F.concat(s["l"], F.array_repeat(F.lit("0"), F.lit(8) - F.size(s["l"]) - F.size(s["r"])), s["r"]),
        )
        return F.when(body.rlike(rf"^{_SIDE}::{_SIDE}\z"), let(joined, fill)).when(
            body.rlike(rf"^(?:{_HEXTET}:){{7}}{_HEXTET}\z"), F.split(body, ":")
        )

    return F.when(F.contains(c, F.lit(":")), let(_v6_body(c), split_body))


def is_v6(c: Column) -> Column:
    return hextets(c).isNotNull()


def is_ip(c: Column) -> Column:
    """Whether the text is a valid IPv4 or IPv6 address (null stays null)."""
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(is_v4(c) | F.coalesce(is_v6(c), F.lit(False)))


def ip_version(c: Column) -> Column:
    return F.when(is_v4(c), F.lit(4)).when(is_v6(c), F.lit(6))


def _v6_text(groups: Column) -> Column:
    """Shortest form: leading zeros dropped, the longest run of zero groups squeezed."""

    def squeeze(plain: Column) -> Column:
        out = plain
        for run in range(2, 9):  # longer runs wrap shorter ones, so the longest wins
            zeros = "0" + ":0" * (run - 1)
            cut = F.regexp_replace(plain, rf"^((?:[0-9a-f]+:)*?){zeros}((?::[0-9a-f]+)*)\z", "<$1:$2>")
            cut = F.regexp_replace(F.regexp_replace(cut, "<:", "::"), ":>", "::")
            cut = F.regexp_replace(F.regexp_replace(cut, "[<>]", ""), ":{3,}", "::")
            out = F.when(plain.rlike(rf"(?:^|:){zeros}(?::|\z)"), cut).otherwise(out)
        return out

    trimmed = F.array_join(F.transform(groups, lambda x: F.regexp_replace(x, "^0+(?=.)", "")), ":")
    return let(trimmed, squeeze)


def canonical_ip(c: Column) -> Column:
    """Canonical address text; null when the text is not an address."""
    zone = F.regexp_extract(c, r"(%[^%]+)\z", 1)
    v6 = let(hextets(c), lambda g: F.when(g.isNotNull(), F.concat(_v6_text(g), zone)))
    return F.when(is_v4(c), c).when(F.contains(c, F.lit(":")), v6)


def _v6_bits(c: Column) -> Column:
    wide = lambda x: F.lpad(F.conv(x, 16, 2), 16, "0")
    return let(hextets(c), lambda g: F.when(g.isNotNull(), F.array_join(F.transform(g, wide), "")))


def ip_bits(c: Column) -> Column:
    """The address as a string of 32 or 128 binary digits; a prefix match is a string prefix."""
    return F.when(is_v4(c), F.lpad(F.bin(v4_number(c)), 32, "0")).when(F.contains(c, F.lit(":")), _v6_bits(c))


def network_bits(cidr: str) -> tuple[int, str]:
    """``(family, prefix digits)`` of one range; the driver-side twin of :func:`ip_bits`."""
    net = ipaddress.ip_network(cidr, strict=False)
    width = 32 if net.version == 4 else 128
    return net.version, format(int(net.network_address), f"0{width}b")[: net.prefixlen]


def _in_v4(n: Column, ranges: list[str]) -> Column:
    hit = F.lit(False)
    for net in map(ipaddress.ip_network, ranges):
        hit = hit | n.between(int(net.network_address), int(net.broadcast_address))
    return hit


def _in_v6(bits: Column, ranges: list[str]) -> Column:
    hit = F.lit(False)
    for text in ranges:
        hit = hit | bits.startswith(network_bits(text)[1])
    return hit


def _v4_private(n: Column) -> Column:
    return _in_v4(n, PRIVATE_V4) & ~_in_v4(n, PRIVATE_V4_EXCEPT)


def _v6_private(bits: Column) -> Column:
    return _in_v6(bits, PRIVATE_V6) & ~_in_v6(bits, PRIVATE_V6_EXCEPT)


def _mapped_number(bits: Column) -> Column:
    """The IPv4 number inside ``::ffff:0:0/96``, else null."""
    prefix = "0" * 80 + "1" * 16
    return F.when(bits.startswith(prefix), F.conv(F.substring(bits, 97, 32), 2, 10).cast("bigint"))


def _v6_facts(bits: Column) -> Column:
    """``struct(private, shared, loopback, multicast, reserved, doc)`` of 128 binary digits."""

    def facts(mapped: Column) -> Column:
        pick = lambda v4, v6: F.when(mapped.isNotNull(), v4).otherwise(v6)
        return F.struct(
            pick(_v4_private(mapped), _v6_private(bits)).alias("private"),
            F.coalesce(_in_v4(mapped, SHARED_V4), F.lit(False)).alias("shared"),
            pick(_in_v4(mapped, ["127.0.0.0/8"]), _in_v6(bits, ["::1/128"])).alias("loopback"),
            pick(_in_v4(mapped, ["224.0.0.0/4"]), _in_v6(bits, ["ff00::/8"])).alias("multicast"),
            _in_v6(bits, RESERVED_V6).alias("reserved"),
            _in_v6(bits, [r for r in DOCUMENTATION if ":" in r]).alias("doc"),
        )

    return let(_mapped_number(bits), facts)


def is_private(c: Column) -> Column:
    """Not globally reachable, documentation ranges included; false for text that is no address."""
    v6 = let(_v6_bits(c), lambda b: F.when(b.isNotNull(), _v6_facts(b)["private"]))
    private = let(v4_number(c), lambda n: F.when(n.isNotNull(), _v4_private(n)).when(F.contains(c, F.lit(":")), v6))
    return F.coalesce(private, F.lit(False))


def classify_ip(c: Column) -> Column:
    """``struct(ip_version, is_private, is_loopback, is_multicast, is_reserved, is_global)``.

    Documentation ranges stand for outside hosts and count as public here.
    """

    def shape(version, private, shared, loopback, multicast, reserved, doc):
        return F.struct(
            F.lit(version).alias("ip_version"),
            (private & ~doc).alias("is_private"),
            loopback.alias("is_loopback"),
            multicast.alias("is_multicast"),
            reserved.alias("is_reserved"),
            ((~private & ~shared) | doc).alias("is_global"),
        )

    v4 = lambda n: shape(
        4, _v4_private(n), _in_v4(n, SHARED_V4), _in_v4(n, ["127.0.0.0/8"]), _in_v4(n, ["224.0.0.0/4"]),
        _in_v4(n, ["240.0.0.0/4"]), _in_v4(n, [r for r in DOCUMENTATION if ":" not in r]),
    )
    of = lambda f: shape(6, f["private"], f["shared"], f["loopback"], f["multicast"], f["reserved"], f["doc"])
    v6 = let(_v6_bits(c), lambda b: F.when(b.isNotNull(), let(_v6_facts(b), of)))
    return let(v4_number(c), lambda n: F.when(n.isNotNull(), v4(n)).when(F.contains(c, F.lit(":")), v6))


# scope pair (source, destination) -> direction
_DIRECTIONS = {(True, False): "outbound", (False, True): "inbound", (True, True): "internal", (False, False): "transit"}


def direction_of(src_private: Column, dst_private: Column) -> Column:
    out = F.lit(None).cast("string")
    for (src, dst), name in _DIRECTIONS.items():
        out = F.when((src_private == src) & (dst_private == dst), name).otherwise(out)
    return out


def flow_direction(src: Column, dst: Column) -> Column:
    """outbound / inbound / internal / transit from the scopes of both ends; null if either is no address."""
    inside = lambda c: classify_ip(c)["is_private"]
    scopes = F.struct(inside(src).alias("s"), inside(dst).alias("d"))
    return let(scopes, lambda x: direction_of(x["s"], x["d"]))

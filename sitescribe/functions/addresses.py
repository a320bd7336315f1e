"""Literal network addresses as 128 bits, and whether they are of the public net."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks that are not public, and parts of them that are, by the registries of special addresses.
SPECIAL = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4 "
    "::/128 ::1/128 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16 3fff::/20 fc00::/7 fe80::/10"
).split()
PUBLIC = "192.0.0.9/32 192.0.0.10/32 2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()
#: What stands before the 32 bits of an IPv4 address.
MAPPED = "0" * 20 + "ffff"


def let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def _spans(networks: list[str]) -> list[tuple[str, str]]:
    """First and last address of each network as hexadecimal digits, in order."""
    out = []
    for n in map(ipaddress.ip_network, networks):
        digits = lambda a: f"{int(a):032x}" if a.version == 6 else MAPPED + f"{int(a):08x}"
        out.append((digits(n[0]), digits(n[-1])))
    return sorted(out)


def _number(part: Column) -> Column:
    """A part of an IPv4 address: decimal, octal after a 0, hexadecimal after 0x; null for other text."""
    return (
        F.when(part.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(part, 3, 8), 16, 10))
        .when(part.rlike("^0[0-7]{1,11}$"), F.conv(part, 8, 10)).when(part.rlike("^(0|[1-9][0-9]{0,9})$"), part).try_cast("long")
    )


def ipv4_bits(text: Column) -> Column:
    """The number of an IPv4 address of one to four parts, of which the last fills what is left; else null."""

    def value(numbers: Column) -> Column:
        n = F.size(numbers)
        head, last = F.slice(numbers, 1, n - 1), F.element_at(numbers, -1)
        room = F.element_at(F.array(*[F.lit(1 << 8 * k) for k in (4, 3, 2, 1)]), F.least(n, F.lit(4)))
        fits = (n <= 4) & F.forall(numbers, lambda x: x.isNotNull()) & F.forall(head, lambda x: x < 256) & (last < room)
        return F.when(fits, F.aggregate(head, F.lit(0).cast("long"), lambda total, x: total * 256 + x) * room + last)

    return F.when(text.rlike("^[0-9a-fx.]+$"), let(F.transform(F.split(text, r"\."), _number), value))


def _groups(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))


def ipv6_digits(text: Column) -> Column:
    """The 32 digits of an IPv6 address with or without its short form and an IPv4 tail; else null."""
    four = F.lpad(F.lower(F.hex(ipv4_bits(F.regexp_extract(text, r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)))), 8, "0")
    whole = F.when(text.contains("."), let(four, lambda x: F.concat(F.regexp_replace(text, r"[0-9.]+$", ""), F.substring(x, 1, 4), F.lit(":"), F.substring(x, 5, 4)))).otherwise(text)

    def groups(halves: Column) -> Column:
        several = F.size(halves) == 2
        sides = F.struct(_groups(halves[0]).alias("a"), F.when(several, _groups(F.element_at(halves, -1))).otherwise(F.array().cast("array<string>")).alias("b"))
        filled = lambda s: let(8 - F.size(s["a"]) - F.size(s["b"]), lambda gap: F.when(F.when(several, gap >= 1).otherwise(gap == 0), F.concat(s["a"], F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), s["b"])))
        return F.when(F.size(halves) <= 2, let(sides, filled))

    digits = lambda g: F.when(F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), ""))
    return F.when(text.contains(":"), let(let(F.split(whole, "::"), groups), digits))


def address_digits(host: Column) -> Column:
    """The 32 hexadecimal digits of a literal address, an IPv4 one as mapped; null for names.  Brackets and zones don't count."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r"^\[|\]$", ""), "%.*$", "")
    mapped = lambda four: F.concat(F.lit(MAPPED), F.lpad(F.lower(F.hex(four)), 8, "0"))
    return let(plain, lambda h: F.when(h.contains(":"), ipv6_digits(h)).otherwise(let(ipv4_bits(h), mapped)))


def public_address(digits: Column) -> Column:
    """Whether an address is of the public net: two look-ups in sorted tables of fixed spans."""
    table = lambda networks: F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _spans(networks)])
    inside = lambda networks: F.exists(table(networks), lambda s: digits.between(s["a"], s["b"]))
    return ~inside(SPECIAL) | inside(PUBLIC)

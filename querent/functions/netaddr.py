"""INET and CIDR values: parsing, canonical text, masks.

Scalars are :class:`NetAddress`; whole columns are handled by expressions for
IPv4 and, as column expressions cannot express IPv6, by a vectorised function.
The canonical text always has the mask, and IPv6 is never compressed.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True, order=True)
class NetAddress:
    """A host address as an integer, with a mask; version 4 or 6."""

    version: int
    host: int
    mask: int

    @property
    def bits(self) -> int:
        return 32 if self.version == 4 else 128

    @property
    def network(self) -> int:
        """The host with the bits below the mask cleared."""
        free = self.bits - self.mask
        return self.host >> free << free

    def __str__(self) -> str:
        if self.version == 4:
            host = ".".join(str(self.host >> s & 255) for s in (24, 16, 8, 0))
        else:
            host = ":".join(f"{self.host >> s & 0xFFFF:x}" for s in range(112, -1, -16))
        return f"{host}/{self.mask}"


def net_address(version: int, host: int, mask: int) -> NetAddress | None:
    """None if the mask is out of range."""
    bits = 32 if version == 4 else 128
    return NetAddress(version, host, mask) if 0 <= mask <= bits and 0 <= host < 1 << bits else None


def v4(a: int, b: int, c: int, d: int) -> int:
    return a << 24 | b << 16 | c << 8 | d


def v6(left: list[int], right: list[int] = ()) -> int | None:
    """Words before and after a run of zeros; None if there are more than eight."""
    gap = 8 - len(left) - len(right)
    if gap < 0:
        return None
    out = 0
    for w in [*left, *[0] * gap, *right]:
        out = out << 16 | w
    return out


def cidr(version: int, host: int, mask: int) -> NetAddress | None:
    """None if the mask is out of range or the host has bits below it."""
    out = net_address(version, host, mask)
    return out if out and out.network == out.host else None


def cidr_masked(version: int, host: int, mask: int) -> NetAddress | None:
    """As :func:`cidr`, with the bits below the mask cleared."""
    out = net_address(version, host, mask)
    return NetAddress(version, out.network, mask) if out else None


_V4 = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})")


def parse(text: str | None) -> NetAddress | None:
    """``host[/mask]``; without a mask it is the whole address. None if it is no address."""
    if text is None:
        return None
    host, slash, mask = text.strip().partition("/")
    if slash and not (mask.isascii() and mask.isdigit()):
        return None
    if "%" in host:
        return None
    if m := _V4.fullmatch(host):
        octets = [int(x) for x in m.groups()]
        return net_address(4, v4(*octets), int(mask) if slash else 32) if max(octets) < 256 else None
    try:
        return net_address(6, int(ipaddress.IPv6Address(host)), int(mask) if slash else 128)
    except ValueError:
        return None


V4_TEXT = r"^\s*(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?:/(\d{1,3}))?\s*$"


def v4_host(text: Column) -> Column:
    """The host of an IPv4 address as a long; NULL if it is none."""
    octets = [F.try_to_number(F.regexp_extract(text, V4_TEXT, i), F.lit("999")).cast("long") for i in range(1, 5)]
    sound = text.rlike(V4_TEXT)
    for o in octets:
        sound = sound & (o < 256)
    return F.when(sound, octets[0] * (1 << 24) + octets[1] * (1 << 16) + octets[2] * (1 << 8) + octets[3])


def v4_mask(text: Column) -> Column:
    """The mask of an IPv4 address, 32 if it has none; NULL if it is out of range."""
    mask = F.when(F.regexp_extract(text, V4_TEXT, 5) == "", F.lit(32)).otherwise(F.try_to_number(F.regexp_extract(text, V4_TEXT, 5), F.lit("999")).cast("int"))
    return F.when(v4_host(text).isNotNull() & (mask <= 32), mask)


def v4_network(text: Column) -> Column:
    """The host with the bits below the mask cleared."""
    size = F.pow(F.lit(2.0), 32 - v4_mask(text)).cast("long")
    return v4_host(text) - v4_host(text) % size


def v4_text(host: Column, mask: Column) -> Column:
    parts = [F.shiftright(host, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat(F.concat_ws(".", *parts), F.lit("/"), mask.cast("string"))


#: A half of an IPv6 address, before or after its run of zeros.
_HALF = r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?$"
_TAIL = r"^(.*:)(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})$"


def v6_words(text: Column) -> Column:
    """The eight 16-bit words of an IPv6 address as an array of ints; NULL if it is none."""
    host = F.lower(F.trim(F.split_part(text, F.lit("/"), F.lit(1))))
    octets = [F.try_to_number(F.regexp_extract(host, _TAIL, i), F.lit("999")).cast("int") for i in range(2, 6)]
    tail = F.concat_ws(":", *[F.lower(F.hex(octets[i] * 256 + octets[i + 1])) for i in (0, 2)])
    mixed = host.rlike(_TAIL)
    host = F.when(~mixed, host).when(F.greatest(*octets) < 256, F.concat(F.regexp_extract(host, _TAIL, 1), tail))
    halves = F.split(host, "::")
    words = [F.transform(F.filter(F.split(F.coalesce(F.get(halves, i), F.lit("")), ":"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int")) for i in (0, 1)]
    given = F.size(words[0]) + F.size(words[1])
    sound = F.forall(halves, lambda x: x.rlike(_HALF)) & F.when(F.size(halves) == 1, given == 8).otherwise((F.size(halves) == 2) & (given <= 7))
    return F.when(sound, F.concat(words[0], F.array_repeat(F.lit(0), 8 - given), words[1]))


def v6_mask(text: Column) -> Column:
    """The mask of an IPv6 address, 128 if it has none; NULL if it is out of range."""
    given = F.split_part(F.trim(text), F.lit("/"), F.lit(2))
    mask = F.when(~F.contains(text, F.lit("/")), F.lit(128)).when(given.rlike(r"^\d{1,3}$"), F.try_to_number(given, F.lit("999")).cast("int"))
    return F.when(v6_words(text).isNotNull() & ~F.trim(text).rlike("/.*/") & (mask <= 128), mask)


def v6_network(text: Column) -> Column:
    """The words with the bits below the mask cleared."""
    mask = v6_mask(text)
    keep = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.least(F.greatest(mask - 16 * i, F.lit(0)), F.lit(16)))
    cleared = F.zip_with(v6_words(text), keep, lambda w, k: w - w % F.pow(F.lit(2.0), 16 - k).cast("int"))
    return F.when(mask.isNotNull(), cleared)


def v6_text(words: Column, mask: Column) -> Column:
    return F.when(words.isNotNull() & mask.isNotNull(), F.concat(F.concat_ws(":", F.transform(words, lambda w: F.lower(F.hex(w)))), F.lit("/"), mask.cast("string")))


def canonical(text: Column | str) -> Column:
    """Canonical text of a column of addresses of either version; NULL if it is none."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(v4_text(v4_host(t), v4_mask(t)), v6_text(v6_words(t), v6_mask(t)))


def cidr_text(text: Column | str) -> Column:
    """Canonical text of the network that an address lies in; NULL if it is none."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(v4_text(v4_network(t), v4_mask(t)), v6_text(v6_network(t), v6_mask(t)))


def is_cidr(text: Column | str) -> Column:
    """Whether an address has no bits below its mask; NULL if it is none."""
    return canonical(text) == cidr_text(text)

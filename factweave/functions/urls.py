"""URL keys, domain boundaries, addresses and hash similarity as Column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, let

_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^?#]*)(\?[^#]*)?"


def host(url) -> Column:
    """Lower-cased host, NULL where the url has none."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(_c(url)), _URL, 2)), F.lit(""))


def path(url) -> Column:
    return F.regexp_extract(F.trim(_c(url)), _URL, 3)


def url_key(url) -> Column:
    """Host, path without closing slashes, query; no scheme, port or fragment.  A text that is
    no url is its own key, lower-cased."""
    trimmed = F.trim(_c(url))
    query = F.regexp_extract(trimmed, _URL, 4)
    key = F.concat(host(url), F.regexp_replace(path(url), "/+$", ""), F.when(query == "?", "").otherwise(query))
    return F.coalesce(key, F.lower(F.regexp_replace(trimmed, "/+$", "")))


def page_key(url) -> Column:
    """Host and path only, to recognise a homepage."""
    return F.concat(host(url), F.regexp_replace(path(url), "/+$", ""))


def within_domain(url, domain) -> Column:
    """The host is the domain or one of its subdomains; unreadable urls are outside."""
    domain = F.lower(_c(domain))
    return F.coalesce((host(url) == domain) | host(url).endswith(F.concat(F.lit("."), domain)), F.lit(False))


# fixed values: address ranges that must not be fetched
RESERVED_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]
RESERVED_V6 = ["::1/128", "::/128", "fe80::/10", "fc00::/7", "2001:db8::/32", "ff00::/8"]


def reserved_ranges() -> list[tuple[int, int]]:
    """The IPv4 ranges as numbers, for range joins."""
    nets = [ipaddress.ip_network(n) for n in RESERVED_V4]
    return [(int(n.network_address), int(n.broadcast_address)) for n in nets]


def ipv4_number(ip) -> Column:
    """The address as a number, NULL unless four decimal bytes."""
    parts = F.split(_c(ip), r"\.")
    byte = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    number = sum((F.get(parts, F.lit(i)).try_cast("long") * (1 << (8 * (3 - i))) for i in range(4)), F.lit(0))
    return F.when(_c(ip).rlike(rf"^{byte}(\.{byte}){{3}}$"), number)


def blocked_v4(ip) -> Column:
    """Reserved or no IPv4 address at all."""
    n = ipv4_number(ip)
    hit = F.lit(False)
    for lo, hi in reserved_ranges():
        hit = hit | n.between(lo, hi)
    return F.coalesce(hit, F.lit(True))


def ipv6_halves(ip) -> Column:
    """``struct(hi, lo)``, the 128 bits of an IPv6 address as two longs; NULL unless it is one.  A run of
    zero groups may be left out once, the last two groups may be an IPv4 address, a zone is ignored."""
    bare = F.regexp_replace(_c(ip), r"%[^%]+$", "")
    tail = F.nullif(F.regexp_extract(bare, r":([^:]*\.[^:]*)$", 1), F.lit(""))
    groups = lambda n: F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(65535)))

    def parts(x: Column) -> Column:
        text = F.when(x["tail"].isNull(), x["bare"]).otherwise(F.concat(F.regexp_replace(x["bare"], r"[^:]*$", ""), groups(ipv4_number(x["tail"]))))
        return let(halves, text=text)

    def halves(x: Column) -> Column:
        cut = F.split(x["text"], "::", -1)
        side = lambda i: F.filter(F.split(F.coalesce(F.get(cut, F.lit(i)), F.lit("")), ":", -1), lambda g: g != "")
        return let(whole, text=x["text"], cuts=F.size(cut), left=side(0), right=side(1))

    def whole(x: Column) -> Column:
        n = F.size(x["left"]) + F.size(x["right"])
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0)))
        every = F.transform(F.concat(x["left"], zeros, x["right"]), lambda g: F.conv(g, 16, 10).cast("long"))
        said = x["text"].rlike(r"^(?i)([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?)?$")
        ok = said & F.when(x["cuts"] == 1, n == 8).otherwise((x["cuts"] == 2) & (n <= 7))
        half = lambda e, lo: F.aggregate(F.slice(e, lo, 4), F.lit(0).cast("long"), lambda a, g: F.shiftleft(a, 16).bitwiseOR(g))
        return F.when(ok, let(lambda y: F.struct(half(y["e"], 1).alias("hi"), half(y["e"], 5).alias("lo")), e=every))

    return let(parts, bare=bare, tail=tail)


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def blocked_any(ip) -> Column:
    """Reserved addresses of either family, IPv4 ones also in their IPv6 form; what can't be read is
    blocked.  A range of 128-bit addresses is a prefix, that is, two masked longs."""
    def six(x: Column) -> Column:
        hit = F.lit(False)
        for n in map(ipaddress.ip_network, RESERVED_V6):
            base, mask = int(n.network_address), int(n.netmask)
            for_half = lambda c, shift: x["v"][c].bitwiseAND(_signed(mask >> shift & (1 << 64) - 1)) == _signed(base >> shift & (1 << 64) - 1)  # noqa: E731, B023
            hit = hit | (for_half("hi", 64) & for_half("lo", 0))
        four = x["v"]["lo"].bitwiseAND(0xFFFFFFFF)
        inside = F.lit(False)
        for lo, hi in reserved_ranges():
            inside = inside | four.between(lo, hi)
        mapped = (x["v"]["hi"] == 0) & (F.shiftrightunsigned(x["v"]["lo"], 32) == 0xFFFF)
        return F.when(x["v"].isNull(), True).otherwise(hit | (mapped & inside))

    return F.when(F.contains(_c(ip), F.lit(":")), let(six, v=ipv6_halves(ip))).otherwise(blocked_v4(ip))


def hash_similarity(a, b) -> Column:
    """1 - different bits / all bits of two hexadecimal hashes; 0 for unequal lengths or other
    characters.  Compared in pieces of eight digits, which fit a number."""
    a, b = F.lower(_c(a)), F.lower(_c(b))
    starts = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)), F.lit(8))
    number = lambda v, i: F.conv(F.substring(v, i, F.lit(8)), 16, 10).cast("long")
    apart = F.aggregate(starts, F.lit(0), lambda n, i: n + F.bit_count(number(a, i).bitwiseXOR(number(b, i))))
    ok = (F.length(a) == F.length(b)) & (F.length(a) > 0) & a.rlike("^[0-9a-f]+$") & b.rlike("^[0-9a-f]+$")
    return F.when(ok, 1 - apart / (4 * F.length(a))).otherwise(F.lit(0.0))

"""Internet addresses of both families as 128-bit numbers, and longest-prefix match against network tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import let

#: Networks that are broadcast, counted before (a few dozen bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000

# Networks that are not global unicast, as text and prefix length; of IPv6, what lies outside the first is not global either.
SPECIAL_IPV4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.31.196.0", 24), ("192.52.193.0", 24),
    ("192.88.99.0", 24), ("192.168.0.0", 16), ("192.175.48.0", 24), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]
GLOBAL_IPV6 = ("2000::", 3)
SPECIAL_IPV6 = [("2001::", 23), ("2001:db8::", 32), ("2002::", 16), ("3ffe::", 16)]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_DOTTED = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _dotted_hex(text: Column) -> Column:
    """Eight hex digits of a dotted address that is known to be one."""
    return F.lower(F.array_join(F.transform(F.split(text, r"\."), lambda p: F.lpad(F.hex(p.try_cast("long")), 2, "0")), ""))


def address_hex(text: Column) -> Column:
    """32 hex digits of an address, or null if it is none.

    IPv6 in all spellings: upper case, groups without leading zeros, one :: for one or more groups, a dotted tail. Zones,
    brackets and prefixes are not part of an address. An IPv4 address stands at ::ffff:0:0/96, like its mapped form.
    """
    whole = F.lower(text)
    tail = F.when(whole.contains("."), F.regexp_extract(whole, rf"(?:^|:)({_DOTTED})$", 1)).otherwise("")
    digits = _dotted_hex(tail)
    six = F.when(tail == "", whole).otherwise(F.concat(F.substring(whole, F.lit(1), F.length(whole) - F.length(tail)), F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4)))
    groups = lambda side: F.array_remove(F.split(side, ":"), "")

    def spread(t: Column) -> Column:
        short = t.contains("::")
        left = groups(F.substring_index(t, "::", 1))
        right = F.when(short, groups(F.regexp_replace(t, "^.*::", ""))).otherwise(F.array().cast("array<string>"))
        well = t.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$")

        def filled(s: Column) -> Column:  # both sides are split once
            n = F.size(s["left"]) + F.size(s["right"])
            full = F.concat(s["left"], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - n)), s["right"])
            return F.when(F.when(short, n <= 7).otherwise(n == 8), F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))

        return F.when(well, let(F.struct(left.alias("left"), right.alias("right")), filled))

    four = F.when(whole.rlike(f"^{_DOTTED}$"), F.concat(F.lit("0" * 20 + "ffff"), digits))
    return F.coalesce(four, F.when(whole.contains(":"), let(six, spread)))


def halves(digits: Column) -> Column:
    """The number as struct (hi, lo) of two longs of 64 bits each."""
    part = lambda a: F.conv(F.substring(digits, a, 16), 16, -10).cast("long")
    return F.struct(part(1).alias("hi"), part(17).alias("lo"))


def canonical(digits: Column) -> Column:
    """One spelling for each address: dotted for IPv4, else groups without leading zeros, the first longest run of two or more zero groups as ::."""
    dotted = F.array_join(F.transform(F.sequence(F.lit(25), F.lit(31), F.lit(2)), lambda k: F.conv(F.substring(digits, k, F.lit(2)), 16, 10)), ".")
    plain = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(29), F.lit(4)), lambda k: F.regexp_replace(F.substring(digits, k, F.lit(4)), "^0{1,3}", "")), ":")
    out = plain
    for n in range(2, 9):  # longer runs overwrite shorter ones
        run = ":".join(["0"] * n)
        head, last = F.regexp_replace(plain, f"^(.*?)(?:^|:){run}(?::|$).*$", "$1"), F.regexp_replace(plain, f"^.*?(?:^|:){run}(?::|$)", "")
        out = F.when(plain.rlike(f"(?:^|:){run}(?::|$)"), F.concat(head, F.lit("::"), last)).otherwise(out)
    return F.when(digits.startswith("0" * 20 + "ffff"), dotted).otherwise(out)


def _key(number: Column, bits: int) -> Column:
    """The first bits of a number, as struct (hi, lo); null of none."""
    hi = F.shiftrightunsigned(number["hi"], 64 - bits) if 0 < bits < 64 else number["hi"] if bits else F.lit(0).cast("long")
    lo = F.shiftrightunsigned(number["lo"], 128 - bits) if 64 < bits < 128 else number["lo"] if bits == 128 else F.lit(0).cast("long")
    return F.when(number["hi"].isNotNull(), F.struct(hi.alias("hi"), lo.alias("lo")))


def longest_prefix(df: DataFrame, address: str, networks: DataFrame, digits: str | None = None) -> DataFrame:
    """df with network, bits and label of the longest network that holds the address, or nulls. digits: a column of its address_hex, if df has one.

    networks: network (text), bits (of its own family), label. One equality join on the first bits of the address for each
    prefix length in use (129 at most), the longest first; no inequality is tested, so the work is rows times lengths. Of
    equal networks the least label counts; networks and addresses that are none match nothing.
    """
    of = networks.select("network", F.col("bits").cast("int").alias("bits"), "label", F.explode(F.array(address_hex(F.col("network")))).alias("_d")).filter("_d IS NOT NULL")
    whole = F.col("bits") + F.when(F.col("network").contains(":"), 0).otherwise(96)
    of = of.withColumn("_all", whole).filter("_all BETWEEN 0 AND 128")
    lengths = [r[0] for r in of.select("_all").distinct().orderBy(F.desc("_all")).collect()]
    small = of.count() <= BROADCAST_ROWS
    out = df.select("*", F.explode(F.array(F.col(digits) if digits else address_hex(F.col(address)))).alias("_x"))  # worked out once a row, not once a length
    out = out.select(*df.columns, F.explode(F.array(halves(F.col("_x")))).alias("_n"))
    for n in lengths:
        side = of.filter(F.col("_all") == n).groupBy(_key(halves(F.col("_d")), n).alias(f"_k{n}")).agg(F.min(F.struct("label", "network", "bits")).alias(f"_m{n}"))
        out = out.join(F.broadcast(side) if small else side, _key(F.col("_n"), n) == F.col(f"_k{n}"), "left").drop(f"_k{n}")
    kind = "struct<label:string,network:string,bits:int>"
    best = F.coalesce(*(F.col(f"_m{n}") for n in lengths), F.lit(None).cast(kind))
    return out.withColumn("_b", best).drop("_n", *(f"_m{n}" for n in lengths)).select("*", "_b.network", "_b.bits", "_b.label").drop("_b")


def _in(number: Column, network: str, bits: int) -> Column:
    import ipaddress

    base = int(ipaddress.ip_address(network)) + (0 if ":" in network else 0xFFFF << 32)
    total = bits if ":" in network else 96 + bits
    first = base >> (128 - total)
    hi, lo = (first >> (total - 64), first & ((1 << (total - 64)) - 1)) if total > 64 else (first, 0)
    own = _key(number, total)
    return (own["hi"] == F.lit(hi - (1 << 64) if hi >> 63 else hi).cast("long")) & (own["lo"] == F.lit(lo).cast("long"))


def is_global(text: Column, digits: Column | None = None) -> Column:
    """Whether an address of either family is global unicast; false for what is no address. digits: its address_hex, if worked out before."""
    digits = address_hex(text) if digits is None else digits

    def told(x: Column) -> Column:
        four = F.lit(False)
        for network, bits in SPECIAL_IPV4:
            four = four | _in(x, network, bits)
        six = F.lit(False)
        for network, bits in SPECIAL_IPV6:
            six = six | _in(x, network, bits)
        return F.when(~text.contains(":"), ~four).otherwise(_in(x, *GLOBAL_IPV6) & ~six)

    return F.coalesce(F.when(digits.isNotNull(), let(halves(digits), told)), F.lit(False))


def is_loopback(text: Column) -> Column:
    """127.0.0.1 or ::1 in any spelling."""
    digits = address_hex(text)
    return F.coalesce(digits.isin("0" * 31 + "1", "0" * 20 + "ffff7f000001") & ~(text.contains(":") & digits.startswith("0" * 20 + "ffff")), F.lit(False))

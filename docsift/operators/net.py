"""Network connections against an address whitelist."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import once

# Addresses that stand for none, and the loopback entries that every whitelist has.
NO_ADDRESS = ("", "0.0.0.0", "::")
LOOPBACK = ("127.0.0.1", "::1", "localhost")
_OCTETS = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})"


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    p = _OCTETS + r"\z"
    part = [F.regexp_extract(ip, p, k).try_cast("bigint") for k in range(1, 5)]
    number = part[0] * (1 << 24) + part[1] * (1 << 16) + part[2] * (1 << 8) + part[3]
    return F.when((part[0] <= 255) & (part[1] <= 255) & (part[2] <= 255) & (part[3] <= 255), number)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bits(family: int, hi: Column, lo: Column) -> Column:
    return F.struct(F.lit(family).alias("family"), hi.alias("hi"), lo.alias("lo"))


def _of_groups(groups: Column) -> Column:
    """The bits of eight groups of hexadecimal digits."""
    number = lambda k: F.shiftleft(F.conv(F.get(groups, F.lit(k)), 16, 10).cast("bigint"), 48 - 16 * (k % 4))
    four = lambda k: number(k).bitwiseOR(number(k + 1)).bitwiseOR(number(k + 2)).bitwiseOR(number(k + 3))

    def named(b: Column) -> Column:
        mapped = (b["hi"] == 0) & (F.shiftright(b["lo"], 32) == 0xFFFF)
        return F.when(mapped, _bits(4, F.lit(0).cast("bigint"), b["lo"].bitwiseAND(0xFFFFFFFF))).otherwise(_bits(6, b["hi"], b["lo"]))

    return _let(F.struct(four(0).alias("hi"), four(4).alias("lo")), named)


def _filled(text: Column) -> Column:
    """The bits of colon-separated groups, a double colon filled with zeros; null for what is no address."""
    fit = text.rlike(r"^[0-9a-f:]+\z") & ~text.rlike(r"[0-9a-f]{5}|:::|::.*::|^:[^:]|[^:]:\z")
    side = lambda k: F.filter(F.split(F.coalesce(F.get(F.split(text, "::"), F.lit(k)), F.lit("")), ":"), lambda g: g != "")

    def whole(s: Column) -> Column:
        n = F.size(s["l"]) + F.size(s["r"])
        groups = F.concat(s["l"], F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), s["r"])
        return F.when(s["fit"] & F.when(s["open"], n <= 7).otherwise(n == 8), _let(groups, _of_groups))

    return _let(F.struct(side(0).alias("l"), side(1).alias("r"), F.contains(text, F.lit("::")).alias("open"), fit.alias("fit")), whole)


def address(ip: Column) -> Column:
    """struct(family 4 or 6, hi, lo): the 128 bits of an address as two longs; null for anything else.

    IPv4 addresses are lo alone, and so are IPv6 addresses that map one (::ffff:1.2.3.4).
    """

    def six(low: Column) -> Column:
        last = ip_number(F.regexp_extract(low, r"([\d.]+)\z", 1))
        two = lambda n: F.lower(F.concat(F.regexp_replace(low, r"[^:]*\z", ""), F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(0xFFFF))))
        return _let(F.when(F.contains(low, F.lit(".")), _let(last, two)).otherwise(low), _filled)

    four = _let(ip_number(ip), lambda n: F.when(n.isNotNull(), _bits(4, F.lit(0).cast("bigint"), n)))
    return F.when(F.contains(ip, F.lit(":")), _let(F.lower(ip), six)).otherwise(four)


def _mask(bits: int) -> int:
    """The first bits of 64, as a signed long."""
    m = ((1 << 64) - 1) ^ ((1 << (64 - bits)) - 1)
    return m - (1 << 64) if m >> 63 else m


def _masks(family: int, bits: int) -> tuple[int, int]:
    """Masks of hi and lo for the first bits of an address."""
    return (0, _mask(32 + bits)) if family == 4 else (_mask(min(bits, 64)), _mask(max(bits - 64, 0)))


def blocks(whitelist: DataFrame) -> DataFrame:
    """(entry, family, bits, hi, lo) of addresses and CIDR blocks; other entries have nulls."""
    at = address(F.regexp_extract("entry", r"^([^/]*)(?:/\d{1,3})?\z", 1))
    given = F.regexp_extract("entry", r"/(\d{1,3})\z", 1).try_cast("int")
    known = once(whitelist.select("entry"), {"_a": at, "_given": given})
    written = F.when(F.contains("entry", F.lit(":")), 128).otherwise(32)  # bits of the address as it is written
    bits = F.coalesce("_given", written) - F.when((written == 128) & (F.col("_a.family") == 4), 96).otherwise(0)
    fit = (F.coalesce("_given", written) <= written) & (bits >= 0)
    return known.select("entry", *[F.when(fit, c).alias(n) for n, c in (("family", F.col("_a.family")), ("bits", bits), ("hi", F.col("_a.hi")), ("lo", F.col("_a.lo")))])


def violations(connections: DataFrame, whitelist: DataFrame, ip: str = "remote_ip") -> DataFrame:
    """Connections to addresses that no entry covers, IPv4 and IPv6; those to no address are skipped.

    An equi-join for each prefix length that the whitelist has (161 at most), so a whitelist of any size
    does: Spark broadcasts what is small and shuffles the rest by prefix. Works on streams of connections.
    """
    known = blocks(whitelist)
    conn = connections.where(F.col(ip).isNotNull() & ~F.col(ip).isin(*NO_ADDRESS, *LOOPBACK))
    left = once(conn, {"_a": address(F.col(ip))}).join(known.select("entry"), F.col(ip) == F.col("entry"), "left_anti")
    for family, bits in sorted((r.family, r.bits) for r in known.select("family", "bits").where("family is not null").distinct().collect()):
        high, low = _masks(family, bits)
        net = known.where((F.col("family") == family) & (F.col("bits") == bits)).select(F.col("hi").bitwiseAND(high).alias("_hi"), F.col("lo").bitwiseAND(low).alias("_lo")).distinct()
        own = F.col("_a.family") == family
        same = (F.when(own, F.col("_a.hi").bitwiseAND(high)) == F.col("_hi")) & (F.when(own, F.col("_a.lo").bitwiseAND(low)) == F.col("_lo"))
        left = left.join(net, same, "left_anti")
    return left.drop("_a")


def first_alerts(found: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The first row of each address."""
    w = Window.partitionBy(by).orderBy(*order)
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def direction(local_port: Column) -> Column:
    return F.when(local_port < 1024, "inbound").otherwise("outbound")


def connection_stats(connections: DataFrame, protocol: str, status: str, ip: str) -> DataFrame:
    """kind (protocol or status), value, n; and the number of distinct addresses as one row."""
    one = lambda k, c: connections.groupBy(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n"))
    real = F.when(F.col(ip).isNotNull() & ~F.col(ip).cast("string").isin(*NO_ADDRESS), F.col(ip))
    ips = connections.agg(F.countDistinct(real).alias("n")).select(F.lit("addresses").alias("kind"), F.lit("distinct").alias("value"), "n")
    return one("protocol", protocol).unionByName(one("status", status)).unionByName(ips)

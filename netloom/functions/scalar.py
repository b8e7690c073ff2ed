"""Scalar functions: lenient parsing, bucketing and counter-based random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the log format.
PROTOCOLS = ["UNKNOWN", "TCP", "UDP", "ICMP"]
CONN_STATES = ["UNKNOWN", "S0", "S1", "SF", "REJ", "S2", "S3", "RSTO", "RSTR", "RSTOS0", "RSTRH", "SH", "SHR", "OTH"]


def ipv4_to_long(address: Column) -> Column:
    """Dotted quad as a number, first octet highest."""
    return F.aggregate(F.split(address, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.try_cast("long"))


def is_ipv4(address: Column) -> Column:
    return ~address.contains(":")


def is_tcp_or_udp(proto: Column) -> Column:
    return proto.contains("tcp") | proto.contains("udp")


def number(text: Column, kind: str) -> Column:
    """A number, or zero where the text is none."""
    return F.coalesce(text.try_cast(kind), F.lit(0).cast(kind))


def whole_seconds(text: Column) -> Column:
    return number(F.substring_index(text, ".", 1), "long")


def member(text: Column, names: list[str]) -> Column:
    """The upper-cased name if it is one of ``names``, else UNKNOWN."""
    upper = F.upper(text)
    return F.when(upper.isin(names), upper).otherwise(F.lit("UNKNOWN"))


def bucketed(value: Column, width: int) -> Column:
    """value - value mod width; unchanged for a width of 0 or less."""
    return value - value % F.lit(width) if width > 0 else value


def random_long(*parts: Column | str | int) -> Column:
    """52 uniform bits from the parts' text: the same wherever and however often a row is computed."""
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def random_unit(*parts: Column | str | int) -> Column:
    return random_long(*parts) / F.lit(float(1 << 52))

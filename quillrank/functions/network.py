"""The key a client is limited by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions.words import strip

GROUP = "[0-9a-fA-F]{1,4}"
IPV4 = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}"


def client_address(forwarded: Column) -> Column:
    """The last entry of a forwarding header, which the proxy adds; ``direct`` without one."""
    last = strip(F.element_at(F.split(forwarded, ","), -1))
    return F.when(last.isNotNull() & (last != ""), last).otherwise(F.lit("direct"))


def client_key(address: Column) -> Column:
    """IPv6 by its /64, an IPv4-mapped one by its IPv4 address; all else as it is."""
    tail = F.regexp_extract(address, rf"^(.*:)({IPV4})\z", 2)
    numbers = F.transform(F.split(tail, r"\."), lambda part: part.cast("long"))
    high = F.hex(F.get(numbers, F.lit(0)) * 256 + F.get(numbers, F.lit(1)))
    low = F.hex(F.get(numbers, F.lit(2)) * 256 + F.get(numbers, F.lit(3)))
    # An IPv4 address at the end stands for the last two groups.
    plain = F.when(tail == "", address).otherwise(F.concat(F.regexp_extract(address, rf"^(.*:)({IPV4})\z", 1), high, F.lit(":"), low))
    halves = F.split(plain, "::")
    sides = F.transform(halves, lambda half: F.filter(F.split(half, ":"), lambda group: group != ""))
    left, right = F.get(sides, F.lit(0)), F.coalesce(F.get(sides, F.lit(1)), F.array().cast("array<string>"))
    zeros = F.when(F.size(halves) == 2, F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right)))
    groups = F.concat(left, F.coalesce(zeros, F.array().cast("array<string>")), right)
    valid = (
        plain.rlike(rf"^({GROUP}(:{GROUP})*)?(::({GROUP}(:{GROUP})*)?)?\z")
        & (F.size(groups) == 8)
        & ((F.size(halves) == 1) | (F.size(left) + F.size(right) < 8))
    )
    values = F.transform(groups, lambda group: F.conv(group, 16, 10).cast("long"))
    mapped = F.forall(F.slice(values, 1, 5), lambda value: value == 0) & (F.get(values, F.lit(5)) == 0xFFFF)

    def byte(group: int, divisor: int) -> Column:
        return (F.floor(F.get(values, F.lit(group)) / divisor) % 256).cast("string")

    ipv4 = F.concat_ws(".", byte(6, 256), byte(6, 1), byte(7, 256), byte(7, 1))
    network = F.concat(F.array_join(F.transform(F.slice(values, 1, 4), lambda value: F.lower(F.hex(value))), ":"), F.lit("::/64"))
    is_ipv6 = F.contains(address, F.lit(":")) & ~F.contains(address, F.lit("%")) & valid
    return F.when(is_ipv6 & mapped, ipv4).when(is_ipv6, network).otherwise(address)

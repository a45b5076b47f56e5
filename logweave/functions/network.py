"""IPv4 addresses as text, with numbers in between; all on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(address: Column) -> Column:
    return F.split_part(address, F.lit("/"), F.lit(1))


def mask_length(address: Column) -> Column:
    """Bits of the network, 32 where none are given."""
    return F.coalesce(F.nullif(F.split_part(address, F.lit("/"), F.lit(2)), F.lit("")).try_cast("int"), F.lit(32))


def to_number(address: Column) -> Column:
    parts = F.split(host(address), r"\.")
    return sum((F.get(parts, i).cast("bigint") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("bigint"))


def to_text(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftrightunsigned(number, 24 - 8 * i).bitwiseAND(F.lit(255).cast("bigint")).cast("string") for i in range(4)])


def _host_bits(address: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), 32 - mask_length(address)) - 1


def netmask(address: Column) -> Column:
    return to_text(F.lit(4294967295) - _host_bits(address))


def network(address: Column) -> Column:
    return F.concat(to_text(to_number(address) - to_number(address).bitwiseAND(_host_bits(address))), F.lit("/"), mask_length(address))


def broadcast_address(address: Column) -> Column:
    return F.concat(to_text(to_number(address).bitwiseOR(_host_bits(address))), F.lit("/"), mask_length(address))


def contains(net: Column, address: Column) -> Column:
    low = to_number(net) - to_number(net).bitwiseAND(_host_bits(net))
    return (mask_length(net) <= mask_length(address)) & to_number(address).between(low, low + _host_bits(net))

"""64-bit signatures held in a long: the bit pattern, compared as unsigned where order matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = 8


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / F.lit(64.0)


def band(key: Column, i: Column | int) -> Column:
    """Byte i of a key, from the lowest."""
    return F.call_function("shiftrightunsigned", key, (i if isinstance(i, Column) else F.lit(i)) * 8).bitwiseAND(F.lit(255))


def shard_id(key: Column, bits: int = 8) -> Column:
    """The highest `bits` bits."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0)


def pack(flags: str) -> Column:
    """Bits from an SQL array expression of 64 booleans, the first the lowest."""
    return F.expr(f"aggregate(transform({flags}, (f, i) -> if(f, shiftleft(1L, i), 0L)), 0L, (a, x) -> a | x)")


def unsigned_least(keys: Column) -> Column:
    """The least of an array of keys by unsigned order."""
    low = F.lit(-(2**63))
    return F.array_min(F.transform(keys, lambda k: k.bitwiseXOR(low))).bitwiseXOR(low)


def to_hex(key: Column) -> Column:
    return F.lpad(F.lower(F.hex(key)), 16, "0")


def from_hex(text: Column) -> Column:
    """16 hexadecimal digits to a key; anything else is 0."""
    return F.when(text.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(text, 16, -10).cast("long")).otherwise(F.lit(0))

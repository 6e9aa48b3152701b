"""Scalar functions: hybrid timestamps, key order and coding, saturating arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DELETE, VALUE, ABORT, INTENT = 0, 1, 2, 3
U64 = 18446744073709551615
MAX_MS = 1 << 47


def hlc(ms: Column, logical) -> Column:
    """Milliseconds and a logical part as one number; milliseconds of 2^47 or more are refused."""
    return F.when(ms < MAX_MS, ms * 65536 + logical).otherwise(F.raise_error(F.lit("milliseconds out of range")).cast("bigint"))


def physical(ts: Column) -> Column:
    return F.shiftrightunsigned(ts, 16)


def logical(ts: Column) -> Column:
    return ts.bitwiseAND(65535)


def following(ts: Column) -> Column:
    """The next timestamp: the logical part carries into the physical one."""
    return ts + 1


def valid_kind(kind: Column) -> Column:
    return kind.between(DELETE, INTENT)


def carries_value(kind: Column) -> Column:
    return kind.isin(VALUE, INTENT)


def compare(left: tuple[Column, Column, Column], right: tuple[Column, Column, Column]) -> Column:
    """-1, 0 or 1: key rising, then version falling, then kind rising."""
    (a, s, x), (b, t, y) = left, right
    less = (a < b) | ((a == b) & ((s > t) | ((s == t) & (x < y))))
    return F.when((a == b) & (s == t) & (x == y), 0).when(less, -1).otherwise(1)


def encode_key(key: Column, ts: Column, kind: Column) -> Column:
    """Key, complement of the version in eight bytes, kind in one."""
    return F.concat(key, F.unhex(F.lpad(F.hex(F.bitwise_not(ts)), 16, "0")), F.unhex(F.lpad(F.hex(kind.cast("bigint")), 2, "0")))


def decode_key(coded: Column) -> Column:
    """struct(key, ts, kind) of what encode_key made, for versions under 2^63."""
    n = F.octet_length(coded)
    tail = F.hex(F.substring(coded, n - 8, F.lit(8)))
    ts = F.bitwise_not(F.conv(tail, 16, -10).cast("bigint"))
    kind = F.conv(F.hex(F.substring(coded, n, F.lit(1))), 16, 10).cast("int")
    return F.struct(F.substring(coded, F.lit(1), n - 9).alias("key"), ts.alias("ts"), kind.alias("kind"))


def wide(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(str(x))).cast("decimal(38,0)")


def add_sat(a, b) -> Column:
    return F.least(wide(a) + wide(b), wide(U64))


def mul_sat(a, b) -> Column:
    """Products of numbers under 2^63; more than 64 bits saturate."""
    return F.least(wide(a) * wide(b), wide(U64))


def sub_sat(a, b) -> Column:
    return F.greatest(wide(a) - wide(b), wide(0))


def mul_div(a: Column, b, c: Column) -> Column:
    """a * b / c without remainder, as a whole number; 0 if c is 0."""
    by, product = F.nullif(wide(c), wide(0)), wide(a) * wide(b)
    return F.coalesce(((product - product % by) / by).cast("decimal(38,0)"), wide(0))


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that two strings share at their start."""
    n = F.least(F.length(a), F.length(b))
    at = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.array_max(at)


def majority(n: Column) -> Column:
    return F.floor(n / 2).cast("bigint") + 1


def middle(n: Column) -> Column:
    return F.floor(n / 2).cast("bigint")


#: The reversed polynomial of CRC-32C; the seed, offset and factors of the key hash. Fixed values.
CASTAGNOLI = 0x82F63B78
HASH_SEED, HASH_OFFSET, HASH_PRIME = 0x9E3779B97F4A7C15, 14695981039346656037, 1099511628211
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))
PROBES, BITS_A_KEY = 7, 10


def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (CASTAGNOLI if x & 1 else 0)
        out.append(x)
    return out


def crc32c(data: Column) -> Column:
    """CRC-32C of a binary column, byte by byte through a table; 0 of no bytes."""
    table = F.array(*[F.lit(x).cast("bigint") for x in _crc_table()])
    byte = lambda i: F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("bigint")
    step = lambda c, i: F.shiftright(c, 8).bitwiseXOR(F.element_at(table, (c.bitwiseXOR(byte(i)).bitwiseAND(F.lit(255)) + 1).cast("int")))
    ones = F.lit(0xFFFFFFFF).cast("bigint")
    done = F.aggregate(F.sequence(F.lit(1), F.length(data)), ones, step, lambda c: c.bitwiseXOR(ones))
    return F.when(F.length(data) > 0, done).when(data.isNotNull(), F.lit(0).cast("bigint"))


def key_hashes(keys):
    """(first, delta) as unsigned numbers of some byte strings: probe i of a key stands at first + i * delta.

    All strings take one step a byte together; numbers wrap at 64 bits.
    """
    import numpy as np

    size = np.array([len(k) for k in keys], np.int64)
    value = np.full(len(keys), HASH_OFFSET ^ HASH_SEED, np.uint64)
    flat, start = np.frombuffer(b"".join(keys), np.uint8), np.cumsum(size) - size
    for i in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > i)
        value[own] = (value[own] ^ flat[start[own] + i]) * np.uint64(HASH_PRIME)
    mixed = value + np.uint64(HASH_SEED)
    for shift, factor in MIX:
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return value, mixed | np.uint64(1)


def hash_of_key(key: Column) -> Column:
    """struct<first, delta>, both as decimal text, of a string column, in Arrow batches."""

    def of(keys):
        import pandas as pd

        first, delta = key_hashes([k.encode() for k in keys])
        return pd.DataFrame({"first": first.astype(str), "delta": delta.astype(str)})

    of.__annotations__ = {}
    return F.pandas_udf(of, "first string, delta string", F.PandasUDFType.SCALAR)(key)


def probe_bits(key: Column, bits: int) -> Column:
    """The places of a string column's probes in a bitmap of so many bits, in Arrow batches."""

    def of(keys):
        import numpy as np
        import pandas as pd

        first, delta = key_hashes([k.encode() for k in keys])
        at = (first[:, None] + np.arange(PROBES, dtype=np.uint64) * delta[:, None]) % np.uint64(bits)
        return pd.Series(list(at.astype(np.int64)))

    of.__annotations__ = {}
    return F.pandas_udf(of, "array<bigint>", F.PandasUDFType.SCALAR)(key)

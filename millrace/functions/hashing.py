"""Shard ids from keys, as column expressions.

A key of up to 16 UTF-8 bytes is hashed with FNV-1a, a longer one with XXH3-64;
the shard is the hash modulo a power of two.  FNV-1a's low bits depend on low
bits only, so the fold runs in plain longs and stays a native expression.
"""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: FNV-1a's 64-bit offset basis and prime, and the longest short key.
FNV_OFFSET, FNV_PRIME, SHORT_BYTES = 0xCBF29CE484222325, 0x100000001B3, 16
#: Bits of the hash that the native fold keeps: shard counts up to 2**20.
LOW_BITS = 20
_MASK = (1 << LOW_BITS) - 1


def pow2(n: int) -> int:
    """The least power of two that is n or more; 1 for 0."""
    return 1 << max(n - 1, 0).bit_length()


def fnv_low(key: Column) -> Column:
    """FNV-1a of the key's UTF-8 bytes, modulo 2**20; null for a null key."""
    data = F.encode(key, "utf-8")
    size = F.octet_length(key)
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    # ascii() reads one byte of an ASCII key; other keys go through hexadecimal digits.
    plain = F.transform(places, lambda i: F.ascii(F.substring(key, i, F.lit(1))).cast("long"))
    other = F.transform(places, lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    values = F.when(F.length(key) == size, plain).otherwise(other)
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME & _MASK)).bitwiseAND(F.lit(_MASK))
    return F.when(key.isNotNull(), F.aggregate(values, F.lit(FNV_OFFSET & _MASK).cast("long"), step))


@F.pandas_udf(LongType())
def xxh3_low(keys: pd.Series) -> pd.Series:
    """XXH3-64 modulo 2**20, for keys longer than Spark has a native hash for."""
    import xxhash

    return pd.Series([None if k is None else xxhash.xxh3_64_intdigest(k.encode()) & _MASK for k in keys], dtype="Int64")


def key_shard(key: Column, shards: int, mode: str = "parity") -> Column:
    """The shard (int) of a key among pow2(shards).

    parity: FNV-1a or XXH3-64 by length, in Arrow batches for the long keys;
    short: the same for short keys, all native, and an error for a long one;
    native: Spark's XXH64, any keys, other ids but the same contract."""
    n = pow2(shards)
    if n > 1 << LOW_BITS:
        raise ValueError(f"at most {1 << LOW_BITS} shards")
    if mode == "native":
        h = F.when(key.isNotNull(), F.xxhash64(key))
    elif mode == "short":
        h = F.when(F.octet_length(key) > SHORT_BYTES, F.raise_error(F.lit("a key is longer than 16 bytes; use mode='parity'")).cast("long")).otherwise(fnv_low(key))
    elif mode == "parity":
        h = F.when(F.octet_length(key) > SHORT_BYTES, xxh3_low(key)).otherwise(fnv_low(key))
    else:
        raise ValueError("mode is 'parity', 'short' or 'native'")
    return h.bitwiseAND(F.lit(n - 1).cast("long")).cast("int")


def wrapping_affine(value: Column, steps: int, mul: int = 31, add: int = 1) -> Column:
    """``steps`` times v * mul + add in unsigned 64-bit arithmetic, in closed form.

    Returns decimal(20, 0).  v is taken as an unsigned value below 2**63."""
    a, b = 1, 0
    for _ in range(steps):
        a, b = a * mul % 2**64, (b * mul + add) % 2**64
    wide = "decimal(20,0)"
    low = 1 << 32
    # v = hi * 2**32 + lo keeps each product within 38 digits.
    hi, lo = F.shiftrightunsigned(value, 32).cast("decimal(10,0)"), value.bitwiseAND(F.lit(low - 1)).cast("decimal(10,0)")
    full, mod = F.lit(str(a)).cast(wide), F.lit(str(1 << 64)).cast(wide)
    upper = F.pmod(F.pmod(hi * full, mod).cast(wide) * F.lit(low).cast("decimal(10,0)"), mod).cast(wide)
    lower = F.pmod(lo * full, mod).cast(wide)
    return F.pmod(upper + lower + F.lit(str(b)).cast(wide), mod).cast(wide)

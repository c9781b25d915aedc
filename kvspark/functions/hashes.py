"""Key hashes as Column expressions, so they stay in generated code.

Unsigned 32-bit values are non-negative longs. Where a hash is defined over
doubles (products beyond 2**53 lose low bits), the expression goes through a
double too, so results agree bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

M32 = (1 << 32) - 1


def signed32(x: Column) -> Column:
    """The low 32 bits as a signed number."""
    return F.shiftright(F.shiftleft(x.cast("long"), 32), 32)


def unsigned32(x: Column) -> Column:
    return x.cast("long").bitwiseAND(F.lit(M32))


def _s32(n: int) -> int:
    return ((n & M32) ^ 0x80000000) - 0x80000000


def _double_product(x: Column, factor: int) -> Column:
    return (x.cast("double") * F.lit(float(factor))).cast("long")


def _fold(x: Column, bits: int) -> Column:
    """x ^ (x >>> bits), signed, of the low 32 bits of x."""
    return signed32(x).bitwiseXOR(F.shiftright(unsigned32(x), bits))


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with ``x`` evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def hash_int(key: Column, seed: int = 0) -> Column:
    """Hash of keys of up to 32 bits, in [0, 2**31)."""
    x = signed32(key).bitwiseXOR(F.lit(_s32(seed)).cast("long")) + F.lit(_s32(seed << 13)).cast("long")
    for _ in range(2):
        x = signed32(x)
        x = _double_product(F.shiftright(x, 16).bitwiseXOR(x), 73244475)
    x = signed32(x)
    return F.shiftright(x, 16).bitwiseXOR(x)


def hash_u64(key: Column, seed: int = 0) -> Column:
    """Hash of 64-bit keys, in [0, 2**32); keys are longs, unsigned ones by their bits."""
    x = signed32(unsigned32(key).bitwiseXOR(F.lit(seed & M32)))
    x = _double_product(_fold(x, 16), 0x85EBCA6B)
    x = signed32(x).bitwiseXOR(signed32(F.shiftright(key.cast("long"), 32)))
    x = _double_product(_fold(x, 13), 0xC2B2AE35)
    return unsigned32(_fold(x, 16))


def long_bits(key: Column) -> Column:
    """The 64 bits of an unsigned decimal as a long."""
    half = F.lit("9223372036854775808").cast("decimal(20,0)")
    whole = F.lit("18446744073709551616").cast("decimal(21,0)")
    return F.when(key < half, key.cast("long")).otherwise((key - whole).cast("long"))


def code_units(text: Column) -> Column:
    """Bytes of a text as an array of ints."""
    digits = F.hex(F.encode(text, "UTF-8"))
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.length(digits) / 2 - 1, F.lit(0)).cast("int")),
        lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"),
    )


def _bytes(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(code_units(text))


def hash_chars(text: Column, seed: int = 0) -> Column:
    """Multiply-by-31 over bytes with a final mix; for composite ids."""
    x = F.aggregate(_bytes(text), F.lit(seed & M32).cast("long"), lambda h, b: unsigned32(h * 31 + b))
    x = _let(x, lambda h: _double_product(_fold(h, 16), 0x85EBCA6B))
    x = _let(x, lambda h: _double_product(_fold(h, 13), 0xC2B2AE35))
    return _let(x, lambda h: unsigned32(_fold(h, 16)))


def hash_fnv1a(text: Column, seed: int = 0) -> Column:
    """FNV-1a over bytes in exact 32-bit arithmetic, the offset basis xored with the seed."""
    start = F.lit((2166136261 ^ seed) & M32).cast("long")
    return F.aggregate(_bytes(text), start, lambda h, b: unsigned32(h.bitwiseXOR(b) * 16777619))


def hash_big(key: Column, seed: int = 0) -> Column:
    """Hash of 64-bit ids that folds both halves before mixing, in [0, 2**32)."""
    x = signed32(unsigned32(key).bitwiseXOR(F.shiftrightunsigned(key.cast("long"), 32)).bitwiseXOR(F.lit(seed & M32)))
    x = _double_product(_fold(x, 16), 0x85EBCA6B)
    x = _double_product(_fold(_fold(x, 13), 13), 0xC2B2AE35)
    return unsigned32(_fold(x, 16))


def _times(a: Column, b: int) -> Column:
    """Exact product modulo 2**32 of an unsigned 32-bit column and constant."""
    high = F.shiftleft((F.shiftright(a, 16) * F.lit(b)).bitwiseAND(F.lit(0xFFFF)), 16)
    return unsigned32(a.bitwiseAND(F.lit(0xFFFF)) * F.lit(b) + high)


def _rotated(a: Column, bits: int) -> Column:
    return unsigned32(F.shiftleft(a, bits)).bitwiseOR(F.shiftright(a, 32 - bits))


def _xor_shift(a: Column, bits: int) -> Column:
    return a.bitwiseXOR(F.shiftright(a, bits))


def murmur3(text: Column, seed: int = 0) -> Column:
    """Canonical 32-bit x86 MurmurHash3 of the UTF-8 bytes."""

    def block(b: Column, i: Column) -> Column:
        k = F.coalesce(F.get(b, i), F.lit(0))
        for j in (1, 2, 3):
            k = k.bitwiseOR(F.shiftleft(F.coalesce(F.get(b, i + j), F.lit(0)), 8 * j))
        k = _let(k, lambda x: _times(x, 0xCC9E2D51))
        k = _let(k, lambda x: _rotated(x, 15))
        return _let(k, lambda x: _times(x, 0x1B873593))

    def whole(data: Column) -> Column:
        n = F.size(data)

        def step(h: Column, i: Column) -> Column:
            mixed = h.bitwiseXOR(block(data, i))
            turned = _let(_let(mixed, lambda x: _rotated(x, 13)), lambda x: _times(x, 5))
            return F.when(i + 4 <= n, unsigned32(turned + F.lit(0xE6546B64))).otherwise(mixed)

        starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1, F.lit(4)))
        h = F.aggregate(starts, F.lit(seed & M32).cast("long"), step).bitwiseXOR(n.cast("long"))
        h = _let(_let(h, lambda x: _xor_shift(x, 16)), lambda x: _times(x, 0x85EBCA6B))
        h = _let(_let(h, lambda x: _xor_shift(x, 13)), lambda x: _times(x, 0xC2B2AE35))
        return _let(h, lambda x: _xor_shift(x, 16))

    return _let(_bytes(text), whole)


CHECKSUM_SEED = 0xCAFEBABE
_P1, _P2, _P3, _P4, _P5 = (np.uint32(p) for p in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint32(bits)) | (x >> np.uint32(32 - bits))


def xxh32_rows(rows: np.ndarray, seed: int = CHECKSUM_SEED) -> np.ndarray:
    """xxHash32 of every row of a matrix of bytes, one step for all rows at a time."""
    n, size = rows.shape
    seed32 = np.uint32(seed)
    words = np.ascontiguousarray(rows[:, : size // 4 * 4]).view("<u4").reshape(n, size // 4)
    with np.errstate(over="ignore"):
        at = 0
        if size >= 16:
            lanes = [np.full(n, x, np.uint32) for x in (seed32 + _P1 + _P2, seed32 + _P2, seed32, seed32 - _P1)]
            for at in range(0, size // 16 * 4, 4):
                lanes = [_turned(v + words[:, at + i] * _P2, 13) * _P1 for i, v in enumerate(lanes)]
            at += 4
            h = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
        else:
            h = np.full(n, seed32 + _P5, np.uint32)
        h = h + np.uint32(size)
        for i in range(at, size // 4):
            h = _turned(h + words[:, i] * _P3, 17) * _P4
        for i in range(size // 4 * 4, size):
            h = _turned(h + rows[:, i].astype(np.uint32) * _P5, 11) * _P1
        h = (h ^ (h >> np.uint32(15))) * _P2
        h = (h ^ (h >> np.uint32(13))) * _P3
        return h ^ (h >> np.uint32(16))


@F.pandas_udf(T.LongType())
def xxh32(data: pd.Series) -> pd.Series:
    """xxHash32 of binary data with the record checksum's seed; values of one length are hashed together."""
    out = pd.Series(pd.NA, index=data.index, dtype="Int64")
    sizes = data.map(len, na_action="ignore")
    for size in sizes.dropna().unique():
        own = data[sizes == size]
        rows = np.frombuffer(b"".join(own), np.uint8).reshape(len(own), int(size))
        out.loc[own.index] = xxh32_rows(rows).astype(np.int64)
    return out


# The filters' hashes once more in numpy, for files that are read and written outside of Spark's expressions.


def _signed32(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64).astype(np.uint32).astype(np.int32).astype(np.int64)


def _double_times(x: np.ndarray, factor: int) -> np.ndarray:
    return (x.astype(np.float64) * float(factor)).astype(np.int64)


def _folded(x: np.ndarray, bits: int) -> np.ndarray:
    low = x.astype(np.uint32)
    return _signed32(x) ^ (low >> np.uint32(bits)).astype(np.int64)


def _murmur3_bytes(data: bytes, seed: int) -> int:
    def mixed(k: int) -> int:
        k = k * 0xCC9E2D51 & M32
        return (k << 15 | k >> 17) * 0x1B873593 & M32

    h, whole = seed & M32, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= mixed(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & M32
    if whole < len(data):
        h ^= mixed(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & M32
    h = (h ^ h >> 13) * 0xC2B2AE35 & M32
    return h ^ h >> 16


def hash_keys(keys: np.ndarray, token: str, seed: int) -> np.ndarray:
    """The hash of ``hash_for(token)`` of an array of integers, or of byte strings for ``str``."""
    if token.startswith("str:"):
        return np.array([_murmur3_bytes(k, seed) for k in keys.tolist()], dtype=np.int64)
    if token in ("i64", "u64"):
        bits = keys.astype(np.uint64) if token == "u64" else keys.astype(np.int64).view(np.uint64)
        low = (bits & np.uint64(M32)).astype(np.int64)
        x = _signed32(low ^ (seed & M32))
        x = _double_times(_folded(x, 16), 0x85EBCA6B)
        x = _signed32(x) ^ _signed32((bits >> np.uint64(32)).astype(np.int64))
        x = _double_times(_folded(x, 13), 0xC2B2AE35)
        return _folded(x, 16).astype(np.uint32).astype(np.int64)
    x = (_signed32(keys) ^ _s32(seed)) + _s32(seed << 13)
    for _ in range(2):
        x = _signed32(x)
        x = _double_times((x >> 16) ^ x, 73244475)
    x = _signed32(x)
    return (x >> 16) ^ x


Hash = Callable[[Column, int], Column]
_registry: dict[str, Hash] = {}


def register_hash(name: str, function: Hash) -> None:
    """Make a hash of (key column, seed) available to filters by name."""
    _registry[name] = function


def hash_for(token: str, custom: str | None = None) -> Hash:
    """The hash of a key type, or a registered one."""
    if custom:
        if custom not in _registry:
            raise KeyError(f"no hash named {custom!r}")
        return _registry[custom]
    if token.startswith("str:"):
        return murmur3
    return hash_u64 if token in ("i64", "u64") else hash_int

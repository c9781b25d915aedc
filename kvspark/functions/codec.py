"""Values and records as bytes, and back.

Multi-byte integers are big-endian both ways, floats little-endian. A record is

    START | key width | value width | 4 | key | value | checksum | ts | deleted | END

with little-endian 32-bit widths and checksum (xxHash32 of key and value) and the
time in milliseconds as a little-endian double. A deleted record keeps its key and
has a value of zero bytes, which is read as null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvspark.functions.hashes import long_bits, xxh32
from kvspark.functions.types import kind

START, END = b"STAR", b"ENDE"
RECORD_BASE = 33
LOG_START, LOG_END = bytes([0x01, 0x10, 0xEF, 0xFE]), bytes([0xFE, 0xEF, 0x10, 0x01])
LOG_BASE = 27
PUT, FLUSH, DELETE, UPDATE = range(4)


def _pieces(x: pd.Series, kind_: str) -> pd.Series:
    """Each number as its bytes; null stays null."""
    raw = x.to_numpy(kind_, na_value=0).tobytes()
    size = np.dtype(kind_).itemsize
    return pd.Series([raw[i : i + size] for i in range(0, len(raw), size)], index=x.index, dtype=object).where(x.notna(), None)


def _numbers(x: pd.Series, kind_: str) -> pd.Series:
    held = x.notna()
    out = pd.Series(pd.NA, index=x.index, dtype="Float64")
    out.loc[held] = np.frombuffer(b"".join(x[held]), kind_).astype("f8")
    return out


@F.pandas_udf(T.BinaryType())
def double_bytes(x: pd.Series) -> pd.Series:
    """Little-endian bytes of doubles."""
    return _pieces(x, "<f8")


@F.pandas_udf(T.BinaryType())
def float_bytes(x: pd.Series) -> pd.Series:
    return _pieces(x, "<f4")


@F.pandas_udf(T.DoubleType())
def bytes_double(x: pd.Series) -> pd.Series:
    return _numbers(x, "<f8")


@F.pandas_udf(T.DoubleType())
def bytes_float(x: pd.Series) -> pd.Series:
    return _numbers(x, "<f4")


def encode_value(x: Column, token: str) -> Column:
    """Bytes of a value of a type; integers out of range wrap, strings must fit and are padded with zero bytes."""
    k = kind(token)
    if token == "f64":
        return double_bytes(x)
    if token == "f32":
        return float_bytes(x)
    if token == "bool":
        return F.when(x, F.unhex(F.lit("01"))).when(~x, F.unhex(F.lit("00")))
    if token.startswith("str:"):
        raw = F.encode(x, "UTF-8")
        fits = F.octet_length(raw) <= k.width
        padded = F.unhex(F.rpad(F.hex(raw), 2 * k.width, "0"))
        return F.when(fits, padded).when(x.isNotNull(), F.raise_error(F.lit(f"text longer than {k.width} bytes")).cast("binary"))
    whole = long_bits(x.cast("decimal(20,0)")) if token == "u64" else x.cast("long")
    return F.unhex(F.substring(F.lpad(F.hex(whole), 16, "0"), 17 - 2 * k.width, 2 * k.width))


def decode_value(b: Column, token: str) -> Column:
    """The value of bytes of a type."""
    k = kind(token)
    if token == "f64":
        return bytes_double(b)
    if token == "f32":
        return bytes_float(b).cast("float")
    if token == "bool":
        return b == F.unhex(F.lit("01"))
    if token.startswith("str:"):
        return F.rtrim(F.decode(b, "UTF-8"), F.lit("\0"))
    unsigned = F.conv(F.hex(b), 16, 10).cast("decimal(20,0)")
    if token.startswith("u"):
        return unsigned.cast(k.spark)
    span = F.lit(str(1 << 8 * k.width)).cast("decimal(21,0)")
    return F.when(unsigned > F.lit(k.high), unsigned - span).otherwise(unsigned).cast(k.spark)


def _u32_le(x: Column) -> Column:
    h = F.lpad(F.hex(x.cast("long")), 8, "0")
    return F.unhex(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))


def _constant(b: bytes) -> Column:
    return F.unhex(F.lit(b.hex()))


def checksum(key_bytes: Column, value_bytes: Column) -> Column:
    """xxHash32 of key and value, as four little-endian bytes."""
    return _u32_le(xxh32(F.concat(key_bytes, value_bytes)))


def encode_record(key: Column, value: Column, ts_ms: Column, deleted: Column, key_type: str, value_type: str) -> Column:
    """Bytes of a record."""
    kw, vw = kind(key_type).width, kind(value_type).width
    k = encode_value(key, key_type)
    v = F.when(deleted, _constant(bytes(vw))).otherwise(encode_value(value, value_type))
    sizes = _constant(kw.to_bytes(4, "little") + vw.to_bytes(4, "little") + (4).to_bytes(4, "little"))
    flag = F.when(deleted, _constant(b"\1")).otherwise(_constant(b"\0"))
    return F.concat(
        _constant(START), sizes, k, v, checksum(k, v), double_bytes(ts_ms.cast("double")), flag, _constant(END)
    )


def decode_record(b: Column, key_type: str, value_type: str) -> dict[str, Column]:
    """Columns key, value, ts_ms, deleted and valid of the bytes of a record."""
    kw, vw = kind(key_type).width, kind(value_type).width
    part = lambda at, n: F.substring(b, at + 1, n)
    key, value, at = part(16, kw), part(16 + kw, vw), 16 + kw + vw
    deleted = part(at + 12, 1) == _constant(b"\1")
    framed = (part(0, 4) == _constant(START)) & (part(at + 13, 4) == _constant(END))
    return {
        "key": decode_value(key, key_type),
        "value": F.when(~deleted, decode_value(value, value_type)),
        "ts_ms": bytes_double(part(at + 4, 8)),
        "deleted": deleted,
        "valid": framed & (checksum(key, value) == part(at, 4)),
    }


def encode_log(key: Column, value: Column, ts_ms: Column, method: int, key_type: str, value_type: str) -> Column:
    """Bytes of a write-ahead record; a delete keeps its key and has a value of zero bytes."""
    k, v = kind(key_type), kind(value_type)
    head = LOG_START + bytes([k.type_id, v.type_id]) + k.width.to_bytes(4, "little") + v.width.to_bytes(4, "little")
    body = _constant(bytes(v.width)) if method == DELETE else encode_value(value, value_type)
    return F.concat(
        _constant(head), encode_value(key, key_type), body, double_bytes(ts_ms.cast("double")), _constant(bytes([method]) + LOG_END)
    )


def decode_log(b: Column, key_type: str, value_type: str) -> dict[str, Column]:
    """Columns key, value, ts_ms and deleted of the bytes of a write-ahead record."""
    kw, vw = kind(key_type).width, kind(value_type).width
    part = lambda at, n: F.substring(b, at + 1, n)
    deleted = part(22 + kw + vw, 1) == _constant(bytes([DELETE]))
    return {
        "key": decode_value(part(14, kw), key_type),
        "value": F.when(~deleted, decode_value(part(14 + kw, vw), value_type)),
        "ts_ms": bytes_double(part(14 + kw + vw, 8)),
        "deleted": deleted,
    }

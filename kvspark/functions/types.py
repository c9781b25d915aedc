"""The twelve fixed-width key and value types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Kind:
    token: str
    type_id: int
    width: int
    low: float | int | None
    high: float | int | None
    spark: T.DataType

    @property
    def is_key(self) -> bool:
        """Whether filters can be built over keys of this type."""
        return self.token not in ("f32", "f64", "bool")


def _int(token: str, type_id: int, signed: bool, spark: T.DataType) -> Kind:
    bits = int(token[1:])
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    return Kind(token, type_id, bits // 8, low, high, spark)


KINDS = {
    k.token: k
    for k in (
        Kind("str", 0, 0, 0, 65535, T.StringType()),
        _int("i8", 1, True, T.ByteType()),
        _int("i16", 2, True, T.ShortType()),
        _int("i32", 3, True, T.IntegerType()),
        _int("i64", 4, True, T.LongType()),
        _int("u8", 5, False, T.ShortType()),
        _int("u16", 6, False, T.IntegerType()),
        _int("u32", 7, False, T.LongType()),
        _int("u64", 8, False, T.DecimalType(20, 0)),
        Kind("f32", 9, 4, -3.4028234663852886e38, 3.4028234663852886e38, T.FloatType()),
        Kind("f64", 10, 8, -1.7976931348623157e308, 1.7976931348623157e308, T.DoubleType()),
        Kind("bool", 11, 1, 0, 1, T.BooleanType()),
    )
}


def kind(token: str) -> Kind:
    """The kind of a token such as ``u32`` or ``str:18``."""
    name, _, width = token.partition(":")
    if name not in KINDS or (name == "str") != bool(width) or (width and not width.isdigit()):
        raise ValueError(f"unknown type {token!r}")
    base = KINDS[name]
    return Kind(token, base.type_id, int(width), base.low, base.high, base.spark) if width else base


def width(token: str) -> int:
    return kind(token).width


def token_of(type_id: int, key_width: int | None = None) -> str:
    """The token of a stored type id; strings need their width."""
    for base in KINDS.values():
        if base.type_id == type_id:
            return f"str:{key_width}" if base.token == "str" else base.token
    raise ValueError(f"unknown type id {type_id}")


def quarter_points(token: str) -> list[int | float]:
    """Four multiples, 0 to 3, of a quarter of the way that the type's range spans from its middle."""
    k = kind(token)
    if k.token == "bool":
        raise ValueError("bool can't be a key")
    if token in ("i64", "u64"):
        # Whole numbers that a double can't hold divide towards zero.
        middle = k.low + (k.high - k.low) // 2
        step = -(-middle // 2) if middle < 0 else middle // 2
    else:
        step = (k.low + (k.high - k.low) / 2) / 2
    return [step * i for i in range(4)]

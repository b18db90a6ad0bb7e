"""Integer column functions: division, bits, fixed point, wrap-around.

All are built-in expressions, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str | int


def _col(x: ColumnLike) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def int_div(a: ColumnLike, b: ColumnLike) -> Column:
    """Quotient truncated towards zero; null where ``b`` is 0."""
    return F.call_function("div", _col(a), F.nullif(_col(b), F.lit(0)))


def floor_div(a: ColumnLike, b: ColumnLike) -> Column:
    """Quotient rounded down; null where ``b`` is 0.  Exact over the whole BIGINT range."""
    a, b = _col(a).cast("long"), F.nullif(_col(b), F.lit(0)).cast("long")
    down = ((a % b) != 0) & ((a < 0) != (b < 0))
    return F.call_function("div", a, b) - F.when(down, 1).otherwise(0)


def is_negative(x: ColumnLike) -> Column:
    return _col(x) < 0


def multiplex(selector: ColumnLike, if_false: ColumnLike, if_true: ColumnLike) -> Column:
    """``if_true`` where the selector is true or not 0, else ``if_false``."""
    return F.when(_col(selector).cast("boolean"), _col(if_true)).otherwise(_col(if_false))


def low_bit(x: ColumnLike) -> Column:
    return _col(x).bitwiseAND(1)


def bit_mask(x: ColumnLike) -> Column:
    """-1 (all ones) where the lowest bit is set, else 0."""
    return -low_bit(x)


def logical_not(x: ColumnLike) -> Column:
    """1 where the lowest bit is clear, else 0."""
    return 1 - low_bit(x)


def keep_bits(x: ColumnLike, mask: int) -> Column:
    return _col(x).bitwiseAND(mask)


def set_bits(x: ColumnLike, mask: int) -> Column:
    return _col(x).bitwiseOR(mask)


def bit_parity(x: ColumnLike) -> Column:
    """Exclusive or of all bits."""
    return F.bit_count(_col(x)) % 2


def shift_left(x: ColumnLike, n: int) -> Column:
    return F.shiftleft(_col(x), n)


def shift_right(x: ColumnLike, n: int) -> Column:
    """Arithmetic: the sign is kept."""
    return F.shiftright(_col(x), n)


def shift_right_logical(x: ColumnLike, n: int) -> Column:
    return F.shiftrightunsigned(_col(x), n)


def fixed_from_double(x: ColumnLike, bits: int = 16) -> Column:
    """The double as an integer with ``bits`` fractional bits, rounded to the nearest."""
    return F.round(_col(x) * float(1 << bits)).cast("long")


def fixed_to_double(x: ColumnLike, bits: int = 16) -> Column:
    return _col(x).cast("double") / float(1 << bits)


def fixed_mul(a: ColumnLike, b: ColumnLike, bits: int = 16) -> Column:
    """Product of two fixed-point columns, truncated by an arithmetic shift."""
    return F.shiftright(_col(a) * _col(b), bits)


def fixed_div(a: ColumnLike, b: ColumnLike, bits: int = 16) -> Column:
    return int_div(F.shiftleft(_col(a), bits), b)


def fixed_sqrt(x: ColumnLike, bits: int = 16) -> Column:
    return fixed_from_double(F.sqrt(fixed_to_double(x, bits)), bits)


#: Bits of the signed types that ``wrap`` knows.
WIDTHS = {"byte": 8, "short": 16, "int": 32, "long": 64}


def wrap(x: ColumnLike, kind: str = "int") -> Column:
    """A BIGINT reduced to the range of a narrower signed type, as two's complement wraps.

    Sums and products of BIGINT columns themselves raise on overflow.
    """
    spare = 64 - WIDTHS[kind]
    return F.shiftright(F.shiftleft(_col(x).cast("long"), spare), spare).cast(kind)


def money_cents(x: ColumnLike) -> Column:
    """An amount as whole cents."""
    return F.round(_col(x) * 100).cast("long")


def percent(part: ColumnLike, whole: ColumnLike) -> Column:
    """Whole percent, truncated; null where ``whole`` is 0."""
    return int_div(_col(part) * 100, whole)


def bucket_by_bounds(x: ColumnLike, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most ``x``: the number of its histogram bucket."""
    out = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        out = F.when(_col(x) < bounds[i], i).otherwise(out)
    return F.when(_col(x).isNotNull(), out)

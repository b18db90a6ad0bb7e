"""Column functions and the registry of aggregates."""

from tessera.functions.aggregates import AGGREGATES, aggregate_column, register_aggregate
from tessera.functions.scalar import (
    bit_mask,
    bit_parity,
    bucket_by_bounds,
    fixed_div,
    fixed_from_double,
    fixed_mul,
    fixed_sqrt,
    fixed_to_double,
    floor_div,
    int_div,
    is_negative,
    keep_bits,
    logical_not,
    low_bit,
    money_cents,
    multiplex,
    percent,
    set_bits,
    shift_left,
    shift_right,
    shift_right_logical,
    wrap,
)

__all__ = [
    "AGGREGATES", "aggregate_column", "bit_mask", "bit_parity", "bucket_by_bounds", "fixed_div", "fixed_from_double", "fixed_mul",
    "fixed_sqrt", "fixed_to_double", "floor_div", "int_div", "is_negative", "keep_bits", "logical_not", "low_bit", "money_cents",
    "multiplex", "percent", "register_aggregate", "set_bits", "shift_left", "shift_right", "shift_right_logical", "wrap",
]

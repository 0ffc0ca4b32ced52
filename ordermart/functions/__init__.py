from ordermart.functions.columns import (
    fill_defaults,
    has_time,
    null_flags,
    parse_score,
    parse_timestamp,
    typed_zero,
)

__all__ = [
    "fill_defaults",
    "has_time",
    "null_flags",
    "parse_score",
    "parse_timestamp",
    "typed_zero",
]

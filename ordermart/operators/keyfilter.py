"""A Bloom filter over keys as a small table: it thins a large table to the rows whose key
may be among them, before any shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermart.functions.columns import quoted

#: Words of 64 bits a filter has at most, whatever the number of keys: some 16 MB in
#: memory. With four million keys one stranger in 190 passes, with sixteen million one in six
#: (simulated); more keys thin less, and the rows stay right.
WORDS = 1 << 20
_WORD, _MASK, _BITS = "__word", "__mask", "__bits"


def _marks(columns: Sequence[str], words: int) -> dict[str, Column]:
    """Which word a key belongs to, and its four bits there. Null is a value."""
    cells = ", ".join(quoted(c) for c in columns)
    bits = f"xxhash64(17, {cells})"
    mask = " | ".join(f"shiftleft(1L, cast(shiftright({bits}, {6 * i}) & 63 AS INT))" for i in range(4))
    return {
        _WORD: F.expr(f"pmod(xxhash64({cells}), {words}L)"),
        _MASK: F.expr(mask),
    }


def key_filter(keys: DataFrame, columns: Sequence[str], words: int = WORDS) -> DataFrame:
    """The filter: one row per word in use. Words are merged before the shuffle, so
    a map task sends no more than the filter has, however many keys it saw."""
    marked = keys.select(*[c.alias(name) for name, c in _marks(columns, words).items()])
    return marked.groupBy(_WORD).agg(F.bit_or(_MASK).alias(_BITS))


def may_hold(
    rows: DataFrame, columns: Sequence[str], held: DataFrame, words: int = WORDS
) -> DataFrame:
    """The rows whose key may be in the filter `held`: all that are, few others. The
    filter is broadcast, as its size has a bound; the rows are not shuffled."""
    marked = rows.withColumns(_marks(columns, words))
    met = marked.join(F.broadcast(held), _WORD)
    found = met.filter(F.col(_BITS).bitwiseAND(F.col(_MASK)) == F.col(_MASK))
    return found.select(*[F.col(quoted(c)) for c in rows.columns])

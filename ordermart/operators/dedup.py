"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermart.functions.columns import quoted

_RANK = "__rank"


def keep_one(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = (),
    descending: Sequence[str] = (),
) -> DataFrame:
    """The first row of each key in a total order, so the choice is reproducible.

    Rows are compared by the `order` columns, of which those in `descending` run
    from the highest; all other columns break the remaining ties. `row_number() = 1`
    is limited to one row per key before the shuffle as well, so a key with any
    number of rows sends at most one row per map task.
    """
    ties = [c for c in df.columns if c not in order and c not in keys]
    by = [
        quoted(c) + (" DESC" if c in descending else "") for c in [*order, *ties] or keys
    ]
    partition = ", ".join(quoted(k) for k in keys)
    rank = f"row_number() OVER (PARTITION BY {partition} ORDER BY {', '.join(by)}) AS {_RANK}"
    return df.selectExpr("*", rank).filter(F.col(_RANK) == 1).drop(_RANK)

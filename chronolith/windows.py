"""Windows that only look at strictly earlier rows of an entity.

Rows are ordered by ``(time, id)``.  Rows without a key have no history: their
counts and sums are 0, and so on; :func:`masked` sees to that.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from chronolith.spec import Roles


def ordered(roles: Roles, *keys: str) -> WindowSpec:
    """All rows of the entity in order."""
    return Window.partitionBy(*(keys or (roles.key,))).orderBy(roles.time, roles.id)


def prior(roles: Roles, *keys: str) -> WindowSpec:
    """The rows before the current one."""
    return ordered(roles, *keys).rowsBetween(Window.unboundedPreceding, -1)


def older(roles: Roles, width: int, *keys: str) -> WindowSpec:
    """The rows more than ``width`` ticks before the current one."""
    return Window.partitionBy(*(keys or (roles.key,))).orderBy(roles.time).rangeBetween(Window.unboundedPreceding, -(width + 1))


def masked(value: Column, default, *keys: str) -> Column:
    """``default`` for rows without a key."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    return F.when(missing, F.lit(default)).otherwise(value)


def prior_count(roles: Roles, *keys: str) -> Column:
    return (F.row_number().over(ordered(roles, *keys)) - 1).cast("long")


def recent_count(roles: Roles, width: int, *keys: str) -> Column:
    """Earlier rows with a time of at least the current one less ``width``; exact when times tie."""
    return prior_count(roles, *keys) - F.count(F.lit(1)).over(older(roles, width, *keys))


def recent_sum(value: Column, roles: Roles, width: int, *keys: str) -> Column:
    """The sum over the rows that :func:`recent_count` counts, nulls as 0: a difference of two running sums."""
    value = F.coalesce(value, F.lit(0.0))
    zero = F.lit(0.0)
    return F.coalesce(F.sum(value).over(prior(roles, *keys)), zero) - F.coalesce(F.sum(value).over(older(roles, width, *keys)), zero)

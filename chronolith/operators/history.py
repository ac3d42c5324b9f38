"""What an entity did before each of its rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators import hot
from chronolith.spec import Roles
from chronolith.windows import masked, ordered, prior, prior_count, recent_count, recent_sum

STATS = ("count", "sum", "mean", "std", "min", "max")


def _checked(stats: Sequence[str]) -> None:
    if unknown := set(stats) - set(STATS):
        raise ValueError(f"unknown statistics: {sorted(unknown)}")


def history_features(df: DataFrame, roles: Roles, windows: Sequence[int] = (3600,), stats: Sequence[str] = ("count", "sum", "mean"), columns: Sequence[str] | None = None) -> DataFrame:
    """Time since the last row, spending so far, and statistics of the last ``w`` ticks for each window.

    The standard deviation is the population's, taken around the entity's own
    mean so that large amounts lose no digits.  One shuffle for all windows.  Keys
    too hot for one task are found and cut (:mod:`chronolith.operators.hot`).
    """
    _checked(stats)
    columns = [roles.amount] if columns is None else list(columns)
    return _with_hot(df, [roles.key], lambda d: _history(d, roles, windows, stats, columns), lambda d: _history_hot(d, roles, windows, stats, columns))


def _with_hot(df: DataFrame, keys: Sequence[str], plain: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``plain`` on the rows of ordinary keys, ``cut`` on those of hot ones, with the same columns."""
    rest, heated = hot.apart(df, keys)
    out = plain(rest)
    if heated is None:
        return out
    found = cut(heated)
    return out.unionByName(found.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in out.schema]))


def _history_hot(df: DataFrame, roles: Roles, windows: Sequence[int], stats: Sequence[str], columns: Sequence[str]) -> DataFrame:
    out = df
    for w in windows:
        out = history_in_chunks(out, roles, w, stats, columns)
    rows = hot.segmented(out, [roles.key], roles.time, roles.id)
    timed = hot.by_segment(rows, roles, lambda d, r: d.withColumn("time_since_last", F.coalesce(F.col(r.time) - F.lag(r.time).over(ordered(r)), F.lit(0)).cast("long")))
    met, spent = hot.expanding(timed, [roles.key], roles.time, roles.id, roles.amount)
    return met.select(*out.columns, "time_since_last", spent["sum"].alias("cumulative_spend"))


def _history(df: DataFrame, roles: Roles, windows: Sequence[int], stats: Sequence[str], columns: Sequence[str]) -> DataFrame:
    key, time = roles.key, F.col(roles.time)
    out: dict[str, Column] = {
        "time_since_last": F.coalesce(time - F.lag(time).over(ordered(roles)), F.lit(0)).cast("long"),
        "cumulative_spend": F.coalesce(F.sum(roles.amount).over(prior(roles)), F.lit(0.0)),
    }
    for w in windows:
        n = recent_count(roles, w)
        if "count" in stats:
            out[f"tx_count_last_{w}s"] = n
        for c in columns:
            total = recent_sum(F.col(c), roles, w)
            if "sum" in stats:
                out[f"{c}_sum_last_{w}s"] = total
            if "mean" in stats:
                out[f"{c}_mean_last_{w}s"] = F.when(n > 0, total / n).otherwise(0.0)
            if "std" in stats:
                centre = F.coalesce(F.avg(c).over(Window.partitionBy(key)), F.lit(0.0))
                off = F.coalesce(F.col(c), F.lit(0.0)) - centre
                mean, squares = recent_sum(off, roles, w) / n, recent_sum(off * off, roles, w) / n
                # one value has no spread; what is below the digits of the sums is none either
                spread = squares - mean * mean
                out[f"{c}_std_last_{w}s"] = F.when((n > 1) & (spread > 1e-12 * squares), F.sqrt(F.greatest(spread, F.lit(0.0)))).otherwise(0.0)
            for name, function, pick in (("min", F.min, F.least), ("max", F.max, F.greatest)):
                if name in stats:
                    before = function(c).over(Window.partitionBy(key).orderBy(roles.time).rangeBetween(-w, -1))
                    tied = function(c).over(Window.partitionBy(key, roles.time).orderBy(roles.id).rowsBetween(Window.unboundedPreceding, -1))
                    out[f"{c}_{name}_last_{w}s"] = F.coalesce(pick(before, tied), F.lit(0.0))
    return df.select("*", *[masked(v, 0, key).alias(k) for k, v in out.items()])


def prior_aggregates(df: DataFrame, roles: Roles, group_keys: Sequence[Sequence[str]], columns: Sequence[str] | None = None, stats: Sequence[str] = ("count", "sum", "mean", "std"), suffix: str = "") -> DataFrame:
    """Expanding statistics of the rows before, by each key set; the deviation is the sample's, 0 if undefined.

    Keys too hot for one task are found and cut (:mod:`chronolith.operators.hot`).
    """
    _checked(stats)
    columns = [roles.amount] if columns is None else list(columns)
    sets = [own for keys in group_keys if (own := [k for k in keys if k in df.columns])]
    # key sets that have no hot keys share one plan
    heated = {tuple(k) for k in sets if hot.apart(df, k)[1] is not None}
    out = _prior(df, roles, [k for k in sets if tuple(k) not in heated], columns, stats, suffix)
    for keys in sets:
        if tuple(keys) in heated:
            out = _with_hot(out, keys, lambda d, k=keys: _prior(d, roles, [k], columns, stats, suffix), lambda d, k=keys: _prior_hot(d, roles, k, columns, stats, suffix))
    return out


def _prior_hot(df: DataFrame, roles: Roles, keys: Sequence[str], columns: Sequence[str], stats: Sequence[str], suffix: str) -> DataFrame:
    rows = hot.segmented(df, keys, roles.time, roles.id)
    for c in columns:
        met, values = hot.expanding(rows, keys, roles.time, roles.id, c)
        rows = met.select(*rows.columns, *[values[s].alias(f"{'+'.join(keys)}_{c}_{s}{suffix}") for s in stats])
    return rows.drop("_seg")


def _prior(df: DataFrame, roles: Roles, group_keys: Sequence[Sequence[str]], columns: Sequence[str], stats: Sequence[str], suffix: str) -> DataFrame:
    out: dict[str, Column] = {}
    for keys in group_keys:
        n, frame = prior_count(roles, *keys), prior(roles, *keys)
        for c in columns:
            values = {"count": n, "sum": F.coalesce(F.sum(c).over(frame), F.lit(0.0)), "mean": F.when(n > 0, F.coalesce(F.sum(c).over(frame), F.lit(0.0)) / n).otherwise(0.0), "std": F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0)), "min": F.coalesce(F.min(c).over(frame), F.lit(0.0)), "max": F.coalesce(F.max(c).over(frame), F.lit(0.0))}
            for stat in stats:
                out[f"{'+'.join(keys)}_{c}_{stat}{suffix}"] = masked(values[stat], 0, *keys)
    return df.select("*", *[v.alias(k) for k, v in out.items()])


def _by_chunk(df: DataFrame, roles: Roles, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a key, numbered by chunk of time; and the rows without one."""
    return df.where(F.col(roles.key).isNotNull()).withColumn("_chunk", F.floor(F.col(roles.time) / chunk)), df.where(F.col(roles.key).isNull())


def prior_in_chunks(df: DataFrame, roles: Roles, chunk: int, columns: Sequence[str] | None = None, stats: Sequence[str] = STATS) -> DataFrame:
    """What :func:`prior_aggregates` gives by the entity, with every key cut by time into chunks of ``chunk`` ticks.

    A chunk is reduced by itself and what the earlier ones hold is added, so a task
    has the rows of one chunk, or one row for each chunk.  Rows without a key need no window.
    """
    _checked(stats)
    columns = [roles.amount] if columns is None else list(columns)
    parted, rest = _by_chunk(df, roles, chunk)
    rows, names = parted.withColumnRenamed("_chunk", "_seg"), []
    for c in columns:
        met, values = hot.expanding(rows, [roles.key], roles.time, roles.id, c)
        own = [values[s].alias(f"{roles.key}_{c}_{s}") for s in stats]
        rows = met.select(*rows.columns, *own)
        names += [f"{roles.key}_{c}_{s}" for s in stats]
    found = rows.drop("_seg")
    return found.unionByName(rest.select("*", *[F.lit(0).cast(found.schema[k].dataType).alias(k) for k in names]))


def prior_sums_in_chunks(df: DataFrame, roles: Roles, chunk: int, column: str | None = None) -> DataFrame:
    """Count and sum of the rows before, by :func:`prior_in_chunks`."""
    column = column or roles.amount
    found = prior_in_chunks(df, roles, chunk, [column], ["count", "sum"])
    return found.withColumnsRenamed({f"{roles.key}_{column}_count": "prior_count", f"{roles.key}_{column}_sum": "prior_sum"})


def history_in_chunks(df: DataFrame, roles: Roles, width: int, stats: Sequence[str] = ("count", "sum", "mean"), columns: Sequence[str] | None = None) -> DataFrame:
    """The statistics of :func:`history_features` for one window, for keys too hot for one task.

    The last ``width`` ticks of a row lie in its own chunk of ``width`` ticks and
    the one before, so each row is dealt to its chunk and, to be looked back at,
    to the next; the window then runs inside a chunk.  Rows without a key need
    no window.
    """
    parted, rest = _by_chunk(df, roles, width)
    dealt = parted.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False))))
    dealt = dealt.withColumn("_part", F.struct(F.col(roles.key).alias("k"), (F.col("_chunk") + F.when(F.col("_own"), 0).otherwise(1)).alias("c")))
    found = _history(dealt, replace(roles, key="_part"), [width], stats, [roles.amount] if columns is None else list(columns))
    found = found.where("_own").drop("_own", "_part", "_chunk", "time_since_last", "cumulative_spend")
    new = [c for c in found.columns if c not in df.columns]
    return found.unionByName(rest.select("*", *[F.lit(0).cast(found.schema[c].dataType).alias(c) for c in new]))


def amount_features(df: DataFrame, roles: Roles) -> DataFrame:
    """Log, whole-number flag, first row, change from the last amount, ratio to the earlier mean; hot keys are cut."""
    return _with_hot(df, [roles.key], lambda d: _amounts(d, roles), lambda d: _amounts_hot(d, roles))


def _amounts_hot(df: DataFrame, roles: Roles) -> DataFrame:
    rows = hot.segmented(df, [roles.key], roles.time, roles.id)
    near = hot.by_segment(rows, roles, lambda d, r: _amounts(d, r).drop("amount_ratio"))
    met, values = hot.expanding(near, [roles.key], roles.time, roles.id, roles.amount)
    ratio = F.coalesce(F.try_divide(F.col(roles.amount), F.try_divide(values["sum"], values["known"])), F.lit(1.0))
    return met.withColumn("amount_ratio", ratio).select(*near.drop("_seg").columns, "amount_ratio")


def _amounts(df: DataFrame, roles: Roles) -> DataFrame:
    amount, order = F.col(roles.amount), ordered(roles)
    known = F.coalesce(amount, F.lit(0.0))
    last = F.lag(amount).over(order)
    mean = F.avg(amount).over(prior(roles))
    return df.select(
        "*",
        F.log1p(known).alias("log_amount"),
        (known == F.floor(known)).cast("int").alias("is_integer_amount"),
        masked(last.isNull().cast("int"), 1, roles.key).alias("is_first_trx"),
        masked(F.coalesce(amount - last, F.lit(0.0)), 0.0, roles.key).alias("amount_delta"),
        masked(F.coalesce(F.try_divide(amount, mean), F.lit(1.0)), 1.0, roles.key).alias("amount_ratio"),
    )


def velocity_features(df: DataFrame, roles: Roles) -> DataFrame:
    """Change of amount by time, and change of that by time; 0 where no time passed; hot keys are cut."""
    return _with_hot(df, [roles.key], lambda d: _velocity(d, roles), lambda d: hot.by_segment(hot.segmented(d, [roles.key], roles.time, roles.id), roles, _velocity).drop("_seg"))


def _velocity(df: DataFrame, roles: Roles) -> DataFrame:
    order = ordered(roles)
    change = F.coalesce(F.col(roles.amount) - F.lag(roles.amount).over(order), F.lit(0.0))
    passed = F.coalesce(F.col(roles.time) - F.lag(roles.time).over(order), F.lit(0))
    fast = df.select("*", F.coalesce(F.try_divide(change, passed), F.lit(0.0)).alias("velocity"), passed.alias("_passed"))
    turn = F.col("velocity") - F.coalesce(F.lag("velocity").over(order), F.lit(0.0))
    return fast.select(*df.columns, masked(F.col("velocity"), 0.0, roles.key).alias("velocity"), masked(F.coalesce(F.try_divide(turn, F.col("_passed")), F.lit(0.0)), 0.0, roles.key).alias("acceleration"))


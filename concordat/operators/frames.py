"""Column and window building blocks of panel data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def guarded_ratio(x: str | Column, y: str | Column, digits: int = 6) -> Column:
    """x / y rounded, NULL unless y is positive."""
    return F.when(col(y) > 0, F.round(col(x).cast("double") / col(y).cast("double"), digits))


def gap_lag(value: str, keys: Sequence[str], year: str, k: int) -> Column:
    """The value k calendar years earlier, NULL where that year has no row."""
    return F.max(value).over(Window.partitionBy(*keys).orderBy(year).rangeBetween(-k, -k))


def backward_imputed(df: DataFrame, base: str, lags: dict[int, str], year: str, first: int) -> DataFrame:
    """Overwrite what lies before the data: in the year after first, lags 2 and 3 take lag 1; two years after, lag 3 takes lag 2."""
    one, two, three = lags[1], lags[2], lags[3]
    return df.withColumns(
        {
            two: F.when(F.col(year) == first + 1, F.col(one)).otherwise(F.col(two)),
            three: F.when(F.col(year) == first + 1, F.col(one)).when(F.col(year) == first + 2, F.col(two)).otherwise(F.col(three)),
        }
    )


def locf_nocb(value: str, keys: Sequence[str], order: str) -> Column:
    """The last known value, or before the first the next one."""
    w = Window.partitionBy(*keys).orderBy(order)
    return F.coalesce(
        F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    )


def argmax_row(df: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """One whole row of each group: the first in the given total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_n = 1").drop("_n")


def first_non_null(df: DataFrame, keys: Sequence[str], by: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """A row for each group with each column's first known value in the given order; values may come from several rows."""
    w = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(*keys, *(F.first(c, True).over(w).alias(c) for c in columns)).distinct()


def with_zscore(df: DataFrame, value: str, keys: Sequence[str], name: str, digits: int = 6) -> DataFrame:
    """df with the distance of each value from its group's mean in sample standard deviations; 0 where there is none.

    Groups are summed up before the shuffle and met again by their keys, so that the rows of a large group stay apart.
    """
    stats = df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_spread"))
    same = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}")) if same is None else same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    z = F.when(F.col(value).isNull(), None).when(F.col("_spread") > 0, F.round((F.col(value) - F.col("_mean")) / F.col("_spread"), digits)).otherwise(F.lit(0.0))
    return df.join(stats, same, "left").withColumn(name, z).drop("_mean", "_spread", *(f"_{k}" for k in keys))


def zscore(value: str, keys: Sequence[str], digits: int = 6) -> Column:
    """Distance from the group's mean in sample standard deviations; 0 where there is no deviation."""
    w = Window.partitionBy(*keys)
    spread = F.stddev_samp(value).over(w)
    return F.when(F.col(value).isNull(), None).when(spread > 0, F.round((F.col(value) - F.avg(value).over(w)) / spread, digits)).otherwise(F.lit(0.0))


def weighted_mean(value: str, weight: str, digits: int = 6) -> Column:
    """Mean over the rows where both are known, with weights that add up to one over those."""
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    total = F.sum(F.when(both, F.col(weight)))
    return F.when(total > 0, F.round(F.sum(F.when(both, F.col(value) * F.col(weight).cast("double"))) / total.cast("double"), digits))


def fill(df: DataFrame, policy: dict[str, object]) -> DataFrame:
    """Constants for unknown values, for the columns that df has."""
    return df.fillna({k: v for k, v in policy.items() if k in df.columns})


def complete_entities(df: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """The rows of entities that never lack a required value."""
    lacking = F.greatest(F.lit(0), *(F.col(c).isNull().cast("int") for c in required))
    return df.withColumn("_lacking", F.max(lacking).over(Window.partitionBy(key))).filter("_lacking = 0").drop("_lacking")


def select_any_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(c for c in columns if c in df.columns))


def not_in(column: str, values: Sequence) -> Column:
    """NOT IN that keeps NULL."""
    return ~F.coalesce(F.col(column).isin(list(values)), F.lit(False))

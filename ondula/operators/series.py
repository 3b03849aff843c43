"""Preprocessing of (x, y) series.

Parameters may be Python values or SQL expressions over per-series columns, so
one job can hold series with different settings. Row order is never stored:
"sorted by x" is the order in which windows read a series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ondula.functions.slices import masked
from ondula.operators.segments import (
    MAX_ROWS,
    by_length,
    group_columns,
    neighbours,
    with_stats,
)
from ondula.session import bounded_batches, sql_value

BEYOND = "step int, left double, right double, x_left double, x_right double"
FINITE = "NOT (isnan({c}) OR abs({c}) = double('inf'))"


def finite_only(samples: DataFrame) -> DataFrame:
    """Keep rows whose x and y are both finite (the drop mode of P3)."""
    return samples.where(f"{FINITE.format(c='x')} AND {FINITE.format(c='y')}")


def dedup_mean(samples: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct x, with the mean of its y values.

    Grouping on (keys, x) combines map-side, so repeats of one x never meet
    in one task; adding 0.0 turns -0.0 into 0.0 before they are compared.
    """
    group = group_columns(samples, keys)
    unified = samples.selectExpr(*group, "x + 0.0D AS x", "y")
    return unified.groupBy(*group, "x").agg(F.expr("avg(y) AS y"))


def on_monotonic(
    samples: DataFrame,
    keys: list[str],
    chain: Callable[[DataFrame], DataFrame],
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Deduplicate, lay out, and run a chain of ordered operators."""
    return by_length(
        samples, keys, chain, max_rows=max_rows, prepare=lambda df: dedup_mean(df, keys)
    )


def domain_stats(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Left and right end, length and sample count of each series."""
    ends = samples.groupBy(*keys).agg(
        F.expr("min(x) AS x_left"), F.expr("max(x) AS x_right"), F.expr("count(1) AS n")
    )
    return ends.selectExpr(
        *keys, "x_left", "x_right", "x_right - x_left AS x_length", "n", "log2(n) AS log2_n"
    )


def plot_extent(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Axis ranges of each series, and whether its x range is positive."""
    sides = [F.expr(f"{f}({c}) AS {c}_{f}") for c in "xy" for f in ("min", "max")]
    return samples.groupBy(*keys).agg(*sides).selectExpr("*", "x_min < x_max AS increasing")


def neighbour_dx(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Distance to the previous sample; the first sample of a series has none."""
    return neighbours(samples, keys, ["x"]).selectExpr(
        *samples.columns, "abs(x - prev_x) AS dx"
    )


def mask(samples: DataFrame, keys: list[str], left, right) -> DataFrame:
    """Remove one x range. The first sample at or beyond ``right`` goes too.

    A NULL bound leaves the series alone.
    """
    lo, hi = sql_value(left), sql_value(right)
    removed = (
        f"(x >= {lo} OR (next_x IS NULL AND {lo} IS NOT NULL))"
        f" AND (prev_x < {hi} OR (prev_x IS NULL AND {hi} IS NOT NULL))"
    )
    kept = neighbours(samples, keys, ["x"]).where(f"NOT coalesce({removed}, false)")
    return kept.select(*samples.columns)


def mask_all(samples: DataFrame, keys: list[str], masks, count: int | None = None) -> DataFrame:
    """Apply several masks in order, each to what the previous one left.

    ``masks`` is a list of (left, right) pairs, or the name of an
    array<struct<left,right>> column whose first ``count`` entries are used.
    """
    if isinstance(masks, str):
        masks = [(f"get({masks}, {i}).left", f"get({masks}, {i}).right") for i in range(count)]
    for left, right in masks:
        samples = mask(samples, keys, left, right)
    return samples


def mask_packed(samples: DataFrame, keys: list[str], masks: str) -> DataFrame:
    """Apply an array<struct<left,right>> column of masks, constant within a
    series, to series that fit a task: one row per series (keys, _kept, _found).

    ``_kept`` holds the samples that are left, ``_found`` the masks that reach
    beyond what the ones before them left (step, left, right, x_left, x_right).
    All masks of all series take one pass; ``inline`` gives rows again.
    """
    bounded_batches(samples.sparkSession)
    packed = samples.groupBy(*keys).agg(
        F.expr(f"first({masks}) AS _masks"), F.expr("collect_list(struct(x, y)) AS _data")
    ).select(*keys, "_masks", "_data")
    schema = T.StructType(
        [
            *[packed.schema[k] for k in keys],
            T.StructField("_kept", packed.schema["_data"].dataType),
            T.StructField("_found", T.ArrayType(T.StructType.fromDDL(BEYOND))),
        ]
    )
    return packed.mapInArrow(masked(schema.names), schema)


def trim_bounds(x_left: str, x_right: str, left, right) -> tuple[str, str]:
    """Effective trim bounds: open ends default to the domain, and bounds given
    as magnitudes are mirrored onto a domain that lies left of zero."""
    lo = f"coalesce({sql_value(left)}, {x_left})"
    hi = f"coalesce({sql_value(right)}, {x_right})"
    mirrored = f"({x_right} <= 0 AND {hi} >= 0)"
    return f"IF({mirrored}, -{hi}, {lo})", f"IF({mirrored}, -{lo}, {hi})"


def trim(samples: DataFrame, keys: list[str], left=None, right=None) -> DataFrame:
    """Keep ``left <= x < right``. The right end is exclusive and never beyond
    the last sample, so trimming to the full domain drops the last sample."""
    lo, hi = trim_bounds("_left", "_right", left, right)
    bounded = with_stats(samples, keys, _left=("min", "x"), _right=("max", "x"))
    return bounded.where(f"x >= {lo} AND x < least({hi}, _right)").select(*samples.columns)


def _replace(samples: DataFrame, column: str, expr: str) -> DataFrame:
    columns = [f"{expr} AS {c}" if c == column else f"`{c}`" for c in samples.columns]
    return samples.selectExpr(*columns)


def scale_x(samples: DataFrame, factor) -> DataFrame:
    """Multiply x; a negative factor reverses the order by itself."""
    return _replace(samples, "x", f"x * {sql_value(factor)}")


def scale_y(samples: DataFrame, factor) -> DataFrame:
    return _replace(samples, "y", f"y * {sql_value(factor)}")


def invert_x(samples: DataFrame, when=True) -> DataFrame:
    """x becomes 1/x where ``when`` holds. x must not be zero there."""
    return _replace(samples, "x", f"IF({sql_value(when, 'boolean')}, try_divide(1.0D, x), x)")

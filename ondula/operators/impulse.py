"""Robust filters over a moving window of sample positions.

The window of width K reaches K // 2 samples to either side and is cut off at
the series ends, so an even K acts as K + 1. Scale is the Sn statistic of
Rousseeuw and Croux (1993): 1.1926 * c_n * lomed_i himed_j |y_i - y_j|.
``impulse_filter`` is native, for one width; its cost per sample grows with K
squared. ``impulse_filter_mixed`` takes a width per series: it holds a series
(or a segment with what lies around it) as an array, and its cost per sample
is K log K.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ondula.functions.slices import SN_FACTOR, SN_SMALL, mixed_filter
from ondula.operators.segments import group_columns, moving_window, segmented, surroundings
from ondula.session import bounded_batches, sql_value

# Median of the sorted array w of n values.
MEDIAN = "(get(w, CAST((n - 1) DIV 2 AS int)) + get(w, CAST(n DIV 2 AS int))) / 2"

# The h-th smallest distance from one value lies at the far end of a run of h
# neighbours that contains it, so the high median is a minimum over runs.
HIGH_MEDIANS = """
    transform(w, (v, i) -> array_min(transform(
        sequence(greatest(0, i - h + 1), least(i, n - h)),
        a -> greatest(v - get(w, a), get(w, a + h - 1) - v))))"""


def _correction() -> str:
    small = " ".join(f"WHEN n = {size} THEN {factor}D" for size, factor in SN_SMALL.items())
    return f"CASE {small} WHEN n > 9 AND n % 2 = 1 THEN n / (n - 0.9D) ELSE 1.0D END"


SN = (
    f"{SN_FACTOR}D * ({_correction()})"
    f" * get(sort_array({HIGH_MEDIANS}), CAST((n - 1) DIV 2 AS int))"
)


def _windowed(samples: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Adds the sorted window w, its size n and the rank h of a high median."""
    return (
        moving_window(samples, keys, "y", width // 2, "_window")
        .selectExpr("*", "sort_array(_window) AS w", "size(_window) AS n")
        .selectExpr("*", "CAST(n DIV 2 + 1 AS int) AS h")
    )


def median_filter(samples: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Replace y by the median of its window."""
    if width < 1:
        raise ValueError("the window width must be positive")
    filtered = [f"{MEDIAN} AS y" if c == "y" else f"`{c}`" for c in samples.columns]
    return _windowed(samples, keys, width).selectExpr(*filtered)


def impulse_filter(samples: DataFrame, keys: list[str], width: int, tuning=1.0) -> DataFrame:
    """Replace y by the window median where it is more than ``tuning`` * Sn off."""
    if width < 0:
        raise ValueError("the window width must not be negative")
    if width == 0:
        return samples
    scored = _windowed(samples, keys, width).selectExpr("*", f"{MEDIAN} AS _m")
    # Sn is computed only where it can matter
    outlier = f"y != _m AND abs(y - _m) > {sql_value(tuning)} * {SN}"
    filtered = [f"IF({outlier}, _m, y) AS y" if c == "y" else f"`{c}`" for c in samples.columns]
    return scored.selectExpr(*filtered)


def impulse_filter_mixed(samples: DataFrame, keys: list[str], width: str, tuning: str) -> DataFrame:
    """The same with a width and a tuning for each series, by two columns of
    ``samples`` that are constant within a series; a width of 0 or NULL leaves
    a series as it is. Rows (keys, x, y), and the segment if there is one.

    One grouping serves all widths. A NULL tuning counts as 1.
    """
    bounded_batches(samples.sparkSession)
    group = group_columns(samples, keys)
    rows = samples.selectExpr(
        *[f"`{k}`" for k in group],
        f"CAST({width} AS int) AS _width",
        f"coalesce(CAST({tuning} AS double), 1.0D) AS _tuning",
        "x",
        "y",
    )
    if rows.where("_width < 0").limit(1).count():
        raise ValueError("the window width must not be negative")
    packed = rows.groupBy(*group).agg(
        F.expr("first(_width) AS _width"),
        F.expr("first(_tuning) AS _tuning"),
        F.expr("collect_list(struct(x, y)) AS _data"),
    )
    nothing = "CAST(array() AS array<struct<x: double, y: double>>)"
    if segmented(samples):
        depth = (rows.agg(F.expr("max(_width) DIV 2")).first()[0] or 0) or 1
        around = surroundings(rows, keys, ["y"], depth, "x")
        packed = packed.join(around, group, "left")
        before, after = f"coalesce(_before, {nothing})", f"coalesce(_after, {nothing})"
    else:
        before = after = nothing
    packed = packed.selectExpr(
        *[f"`{k}`" for k in group], "_width", "_tuning", f"{before} AS _ahead",
        f"{after} AS _behind", "_data",
    )
    fields = [packed.schema[k] for k in group]
    schema = T.StructType([*fields, packed.schema["_data"]])
    done = packed.mapInArrow(mixed_filter(schema.names), schema)
    return done.select(*group, F.inline("_data"))

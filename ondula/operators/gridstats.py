"""Automatic grid lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.functions.values import LENGTH_GLOBAL, LENGTH_PER_VARIABLE, parse_length
from ondula.operators.segments import window_sql, with_stats
from ondula.operators.series import neighbour_dx

# The grid step is the third smallest sample distance: one or two spurious
# tiny steps are passed over.
STEP_RANK = 3

# Series whose length policy is automatic take part, interpolated or not.
COUNTS_FOR_STATS = f"interpolation_n IN ('{LENGTH_GLOBAL}', '{LENGTH_PER_VARIABLE}')"


def min_dx_length(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Grid length of each series: ceil(domain length / grid step).

    Bounds, distances and the top-k share one partitioning. Of a segmented
    series only three distances per task survive to the shuffle by series.
    """
    bounded = with_stats(
        neighbour_dx(samples, keys), keys, _left=("min", "x"), _right=("max", "x")
    )
    smallest = (
        bounded.where("dx IS NOT NULL")
        .selectExpr(
            *keys, "dx", "_left", "_right", f"row_number() {window_sql(keys, 'dx')} AS _rank"
        )
        .where(f"_rank <= {STEP_RANK}")
    )
    steps = smallest.groupBy(*keys).agg(
        F.expr("max(dx) AS dx"), F.expr("max(_right) - min(_left) AS _length")
    )
    return steps.selectExpr(*keys, "dx", "CAST(ceil(_length / dx) AS bigint) AS n")


def interp_stats(lengths: DataFrame, variable: str = "variable") -> DataFrame:
    """Per variable: mean grid length, its spread, and the length in use, which
    is the mean cut to an integer."""
    return lengths.groupBy(variable).agg(
        F.expr("avg(n) AS n_mean"),
        F.expr("stddev_samp(n) AS n_stddev"),
        F.expr("CAST(ceil(log2(avg(n))) AS bigint) AS n_mean_log2"),
        F.expr("CAST(floor(avg(n)) AS bigint) AS n_var"),
    )


def global_length(stats: DataFrame) -> DataFrame:
    """One row: the largest per-variable length, NULL when nothing counted."""
    return stats.agg(F.expr("max(n_var) AS n_global"))


def with_grid_length(
    series: DataFrame, stats: DataFrame, policy: str = "interpolation_n",
    variable: str = "variable",
) -> DataFrame:
    """Attach the grid length ``n`` to one-row-per-series settings, under the
    policy of each: a number, ``2^k``, ``min`` or ``minvar``.

    The global length is joined on the policy that asks for it.
    """
    per_variable = stats.select(variable, "n_var")
    overall = global_length(stats).selectExpr(f"'{LENGTH_GLOBAL}' AS `{policy}`", "n_global")
    joined = series.join(per_variable, variable, "left").join(overall, policy, "left")
    chosen = (
        F.when(F.col(policy) == LENGTH_PER_VARIABLE, F.col("n_var"))
        .when(F.col(policy) == LENGTH_GLOBAL, F.col("n_global"))
        .otherwise(parse_length(F.col(policy)))
    )
    return joined.withColumn("n", chosen).select(*series.columns, "n")

"""Renaming columns and extracting x/y pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ondula.functions.values import to_double
from ondula.session import broadcast_if_small

Rules = list[tuple[str, str]]


def rename_columns(names: DataFrame, rules: Rules) -> DataFrame:
    """Apply rename rules in order to (source, idx, column).

    A rule whose name is absent is skipped, an identity rule ignored. A rename
    onto a name that the source already has is not done; ``clash`` names it.
    """
    source = Window.partitionBy("source")
    out = names.withColumn("clash", F.lit(None).cast("string"))
    for old, new in rules:
        if old == new:
            continue
        hit = F.col("column") == old
        taken = F.max(F.col("column") == new).over(source)
        out = out.withColumn("_taken", taken).withColumns(
            {
                "clash": F.coalesce("clash", F.when(hit & F.col("_taken"), F.lit(new))),
                "column": F.when(hit & ~F.col("_taken"), F.lit(new)).otherwise(F.col("column")),
            }
        )
    return out.drop("_taken")


def locate_pairs(work: DataFrame, names: DataFrame) -> DataFrame:
    """Find the x and y column of each work item (source, x_col, y_col, ...).

    ``x_idx`` and ``y_idx`` are set where the columns hold data; ``x_found`` and
    ``y_found`` tell whether the names exist at all.
    """
    out = work
    for axis in ("x", "y"):
        side = names.select(
            "source",
            F.col("column").alias(f"{axis}_col"),
            F.col("idx").alias(f"{axis}_idx"),
            F.lit(True).alias(f"{axis}_found"),
        )
        out = out.join(side, ["source", f"{axis}_col"], "left").withColumn(
            f"{axis}_found", F.coalesce(f"{axis}_found", F.lit(False))
        )
    return out


def extract_pairs(rows: DataFrame, located: DataFrame, keys: list[str]) -> DataFrame:
    """Samples (keys, x, y) of every work item whose columns exist.

    Each row of a source picks its cells by position, so nothing is pivoted and
    only the work list, one row per series, takes part in the join.
    """
    wanted = located.where(F.col("x_idx").isNotNull() & F.col("y_idx").isNotNull())
    return rows.join(wanted.select(*keys, "source", "x_idx", "y_idx"), "source").select(
        *keys,
        to_double(F.get("tokens", F.col("x_idx"))).alias("x"),
        to_double(F.get("tokens", F.col("y_idx"))).alias("y"),
    )


def extract_from_cells(cells: DataFrame, work: DataFrame, keys: list[str]) -> DataFrame:
    """The same from long cells (source, row, column, value). A cell meets only
    the work items that use its column."""
    parts = [
        work.select(*keys, "source", F.col(f"{a}_col").alias("column"), F.lit(a).alias("_axis"))
        for a in ("x", "y")
    ]
    wanted = broadcast_if_small(parts[0].union(parts[1]))
    role = [F.when(F.col("_axis") == a, F.col("value")) for a in ("x", "y")]
    paired = (
        cells.join(wanted, ["source", "column"])
        .groupBy(*keys, "source", "row")
        .agg(F.max(role[0]).alias("x"), F.max(role[1]).alias("y"))
    )
    return paired.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*keys, "x", "y")

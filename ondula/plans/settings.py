"""Resolving per-series settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKS_TYPE = "array<struct<left:double,right:double>>"

# Every setting, its type and its default.
FIELDS = {
    "impulse_filter": ("int", 0),
    "impulse_tuning": ("double", 1.0),
    "masks": (MASKS_TYPE, []),
    "trim_left": ("double", None),
    "trim_right": ("double", None),
    "prefactor_x": ("double", 1.0),
    "prefactor_y": ("double", 1.0),
    "invert_x": ("boolean", False),
    "interpolation": ("string", None),
    "interpolation_n": ("string", "min"),
    "derivative": ("int", 0),
}
PREPROCESSING = list(FIELDS)[:8]
PROCESSING = list(FIELDS)[8:]

Extract = tuple[str, str, str]


def _literal(field: str, value) -> Column:
    dtype = FIELDS[field][0]
    if field == "masks" and value is not None:
        pairs = [F.struct(F.lit(float(m["left"])).alias("left"),
                          F.lit(float(m["right"])).alias("right")) for m in value]
        return F.array(*pairs).cast(dtype)
    return F.lit(value).cast(dtype)


def work_list(files: DataFrame, extracts: list[Extract]) -> DataFrame:
    """Every file (source, dest, ...) with every extract (name, x, y)."""
    if not extracts:
        raise ValueError("no extract section (V30)")
    entries = [
        F.struct(F.lit(n).alias("variable"), F.lit(x).alias("x_col"), F.lit(y).alias("y_col"))
        for n, x, y in extracts
    ]
    return files.withColumn("_e", F.explode(F.array(*entries))).select(*files.columns, "_e.*")


def resolve_settings(
    work: DataFrame, overrides: DataFrame, global_settings: dict | None = None
) -> DataFrame:
    """Attach all settings to each work item (dest, variable, ...).

    ``overrides`` has ``dest`` and ``variable`` (NULL means any) and some of the
    settings. Per setting the most specific non-NULL value wins: dest and
    variable, then dest, then variable, then global, then the default. The three
    lookups are equi joins; Spark broadcasts a level only when it is small.
    """
    given = [f for f in FIELDS if f in overrides.columns]
    levels = [
        ("_dv", ["dest", "variable"], F.col("dest").isNotNull() & F.col("variable").isNotNull()),
        ("_d", ["dest"], F.col("dest").isNotNull() & F.col("variable").isNull()),
        ("_v", ["variable"], F.col("dest").isNull() & F.col("variable").isNotNull()),
    ]
    out = work
    for tag, on, chosen in levels:
        values = F.struct(*[F.col(f).cast(FIELDS[f][0]).alias(f) for f in given])
        out = out.join(overrides.where(chosen).select(*on, values.alias(tag)), on, "left")
    settled = {}
    for field, (_, default) in FIELDS.items():
        value = (global_settings or {}).get(field)
        base = _literal(field, default if value is None else value)
        specific = [F.col(tag)[field] for tag, _, _ in levels] if field in given else []
        settled[field] = F.coalesce(*specific, base)
    return out.withColumns(settled).select(*work.columns, *FIELDS)


def unmatched_overrides(overrides: DataFrame, work: DataFrame) -> DataFrame:
    """Override targets that no work item has."""
    dests = work.select("dest").distinct()
    variables = work.select("variable").distinct()
    no_dest = overrides.where(F.col("dest").isNotNull()).join(dests, "dest", "left_anti")
    no_variable = overrides.where(F.col("variable").isNotNull()).join(
        variables, "variable", "left_anti"
    )
    return no_dest.select("dest", "variable").unionByName(
        no_variable.select("dest", "variable")
    ).distinct()

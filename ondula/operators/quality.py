"""Data and settings verification as rows.

Every check returns violations (key, code, severity, detail, parts): ``key`` is
for display, ``parts`` holds the key columns. ``raise_on_errors`` stops at
errors, ``drop_failed`` leaves the failing series out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondula.functions.names import name_problem
from ondula.functions.values import (
    bad_derivative,
    bad_tuning,
    is_finite,
    is_length,
    is_power_of_two,
    parse_length,
)
from ondula.operators.series import trim_bounds
from ondula.operators.spectrum import band

# Rule codes that warn; all others are errors.
WARNINGS = ("V06", "V18", "V24", "V25", "V26", "V27", "V28", "V33")
# Grids shorter than this draw a warning.
SMALL_LENGTH = 64


class QualityError(ValueError):
    """Raised in strict mode; carries some of the violations found."""


def key_text(keys: list[str]) -> Column:
    return F.concat_ws("/", *[F.col(k).cast("string") for k in keys])


def key_parts(keys: list[str]) -> Column:
    return F.array(*[F.col(k).cast("string") for k in keys])


def check(rows: DataFrame, keys: list[str], rules: list[tuple[str, Column, Column | str]]) -> DataFrame:
    """Violations of several (code, condition, detail) rules in one pass."""
    found = [
        F.when(
            condition,
            F.struct(
                F.lit(code).alias("code"),
                F.lit("warn" if code in WARNINGS else "error").alias("severity"),
                (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"),
            ),
        )
        for code, condition, detail in rules
    ]
    return rows.select(
        key_text(keys).alias("key"),
        key_parts(keys).alias("parts"),
        F.explode(F.array_compact(F.array(*found))).alias("_v"),
    ).select("key", "_v.*", "parts")


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nothing(rows: DataFrame) -> DataFrame:
    """An empty violations table."""
    return rows.sparkSession.createDataFrame(
        [], "key string, code string, severity string, detail string, parts array<string>"
    )


def raise_on_errors(violations: DataFrame, shown: int = 20) -> None:
    """Strict mode. Only the listing in the message is limited."""
    errors = violations.where(F.col("severity") == "error").take(shown)
    if errors:
        listing = "\n".join(f"{r['code']} {r['key']}: {r['detail']}" for r in errors)
        raise QualityError(f"data or settings are invalid:\n{listing}")


def drop_failed(rows: DataFrame, violations: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key columns, the first of the checked ones, have no error."""
    failed = violations.where(F.col("severity") == "error").select(
        F.slice("parts", 1, len(keys)).alias("_parts")
    )
    marked = rows.withColumn("_parts", key_parts(keys))
    return marked.join(failed.distinct(), "_parts", "left_anti").drop("_parts")


def header_violations(names: DataFrame, clashes: DataFrame) -> DataFrame:
    """V02 and V03, from header names and the outcome of the renaming."""
    duplicates = names.groupBy("source", "column").agg(F.count(F.lit(1)).alias("times"))
    return union_all(
        [
            check(clashes, ["source"], [("V02", F.col("clash").isNotNull(),
                  F.concat(F.lit("new name taken: "), F.col("clash")))]),
            check(duplicates, ["source"], [("V03", F.col("times") > 1,
                  F.concat_ws(" x ", F.col("times"), F.col("column")))]),
        ]
    )


def file_violations(names: DataFrame, clashes: DataFrame, arity: DataFrame, tokens: DataFrame) -> DataFrame:
    """V02-V05, from the outputs of the scan and rename operators."""
    return union_all(
        [
            header_violations(names, clashes),
            check(arity, ["source"], [("V04", F.lit(True), F.col("detail"))]),
            check(tokens, ["source"], [("V05", F.lit(True),
                  F.concat(F.lit("token "), F.col("token")))]),
        ]
    )


def pair_violations(located: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """Missing columns, short, non-finite and constant-x series.

    A series without samples is found from the work list.
    """
    sizes = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(~(is_finite(F.col("x")) & is_finite(F.col("y"))), 1).otherwise(0)).alias("bad"),
        F.min("x").alias("_lo"),
        F.max("x").alias("_hi"),
    )
    found = F.col("x_found") & F.col("y_found")
    rows = F.coalesce(F.col("rows"), F.lit(0))
    return check(
        located.join(sizes, keys, "left"),
        keys,
        [
            ("V06", ~found, F.concat_ws(", ", F.when(~F.col("x_found"), F.lit("no x")), F.when(~F.col("y_found"), F.lit("no y")))),
            ("V07", found & (rows < 2), F.concat(F.lit("rows: "), rows)),
            ("V08", F.col("bad") > 0, F.concat(F.lit("NaN or infinite rows: "), F.col("bad"))),
            ("V09", (rows >= 2) & (F.col("bad") == 0) & (F.col("_lo") == F.col("_hi")),
             F.concat(F.lit("all x = "), F.col("_lo"))),
        ],
    )


def settings_violations(settings: DataFrame, keys: list[str], has_fft: bool) -> DataFrame:
    """Settings that are invalid or suspicious by themselves."""
    off = F.col("interpolation").isNull()
    length = F.col("interpolation_n")
    return check(
        settings,
        keys,
        [
            ("V23", bad_tuning(F.col("impulse_tuning")), F.concat(F.lit("impulse_tuning = "), F.col("impulse_tuning"))),
            ("V23", bad_derivative(F.col("derivative")), F.concat(F.lit("derivative = "), F.col("derivative"))),
            ("V23", ~is_length(length), F.concat(F.lit("interpolation_n = "), length)),
            ("V24", parse_length(length) < SMALL_LENGTH, F.concat(F.lit(f"below {SMALL_LENGTH}: interpolation_n = "), length)),
            ("V25", off & F.col("invert_x"), "invert_x on an uneven grid"),
            ("V26", off & (F.col("derivative") > 0), F.concat(F.lit("ignored: derivative = "), F.col("derivative"))),
            ("V27", off & F.lit(has_fft), "fft on an uneven grid"),
            ("V28", (F.col("interpolation") == "linear") & (F.col("derivative") == 2),
             "linear pieces: derivative 2 is 0"),
        ],
    )


def name_violations(files: DataFrame, column: str = "dest") -> DataFrame:
    """Repeated and unusable destinations."""
    repeated = files.groupBy(column).agg(F.count(F.lit(1)).alias("times"))
    return check(
        repeated,
        [column],
        [
            ("V21", F.col("times") > 1, F.concat(F.lit("times: "), F.col("times"))),
            ("V22", name_problem(F.col(column)).isNotNull(), name_problem(F.col(column))),
        ],
    )


def _bounds(samples: DataFrame, keys: list[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(
        F.min("x").alias("_left"), F.max("x").alias("_right"), F.count(F.lit(1)).alias("_rows")
    )


def mask_violations(before: DataFrame, settings: DataFrame, keys: list[str], step: int) -> DataFrame:
    """V10 for mask number ``step``, against what the masks before it left."""
    one = F.get("masks", F.lit(step))
    outside = (one["left"] < F.col("_left")) | (one["right"] > F.col("_right"))
    masked = settings.where(F.size("masks") > step).select(*keys, "masks")
    return check(
        _bounds(before, keys).join(masked, keys), keys, [("V10", outside, F.concat_ws(" ", F.lit("mask"), one["left"], one["right"], F.lit("beyond"), F.col("_left"), F.col("_right")))]
    )


def packed_mask_violations(packed: DataFrame, keys: list[str]) -> DataFrame:
    """V10 for all masks at once, from the rows of ``mask_packed``."""
    found = packed.select(*keys, F.inline("_found"))
    detail = F.concat_ws(
        " ", F.lit("mask"), "left", "right", F.lit("beyond"), "x_left", "x_right"
    )
    return check(found, keys, [("V10", F.lit(True), detail)])


def trim_violations(masked: DataFrame, settings: DataFrame, keys: list[str]) -> DataFrame:
    """V11-V14 and Q8, from the masked series."""
    series = settings.select(*keys, "masks", "trim_left", "trim_right", "invert_x").join(
        _bounds(masked, keys), keys, "left"
    )
    left, right = F.col("_left"), F.col("_right")
    asked_left = F.coalesce(F.col("trim_left"), left)
    asked_right = F.coalesce(F.col("trim_right"), right)
    lo, hi = (F.expr(b) for b in trim_bounds("_left", "_right", "trim_left", "trim_right"))
    straddles = (left < 0) & (right > 0) & (lo < 0) & (hi > 0)
    return check(
        series,
        keys,
        [
            ("V11", left.isNull() & (F.size("masks") > 0), F.concat(F.lit("nothing left by masks: "), F.size("masks"))),
            ("V12", asked_left >= asked_right, F.concat_ws(" >= ", asked_left, asked_right)),
            ("V13", F.col("invert_x") & ((lo == 0) | (hi == 0)), F.concat_ws(" .. ", F.lit("1/x at 0:"), lo, hi)),
            ("V13", F.col("invert_x") & straddles, F.concat_ws(" .. ", F.lit("1/x across 0:"), lo, hi)),
            ("V14", left > lo, F.concat_ws(" < ", lo, left)),
            ("V14", right < hi, F.concat_ws(" > ", hi, right)),
        ],
    )


def preprocessed_violations(series: DataFrame, settings: DataFrame, keys: list[str]) -> DataFrame:
    """What is left after trimming."""
    left = settings.select(*keys).join(_bounds(series, keys), keys, "left")
    rows = F.coalesce(F.col("_rows"), F.lit(0))
    return check(
        left,
        keys,
        [
            ("V15", rows == 0, "rows: 0"),
            ("V29", (rows > 0) & ~(F.col("_left") < F.col("_right")), F.concat_ws(" >= ", F.col("_left"), F.col("_right"))),
            ("V31", rows == 1, "rows: 1"),
        ],
    )


def grid_violations(settings: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Grids of fewer than two points."""
    short = F.col("interpolation").isNotNull() & (F.coalesce(F.col(n), F.lit(0)) < 2)
    return check(settings, keys, [("V16", short, F.concat(F.lit("n = "), F.coalesce(F.col(n), F.lit(0))))])


def spectrum_violations(
    domains: DataFrame, keys: list[str], n_fft: int, lower: float | None = None,
    upper: float | None = None,
) -> DataFrame:
    """V17-V20 and V32 over the rows of ``sweep_domains`` or
    ``window_counts``.

    An inverted band gives no bins either, so it counts as empty. A transform
    shorter than its data is always an error.
    """
    start, stop = (F.expr(b) for b in band(n_fft, lower, upper))
    bins = n_fft // 2 + 1
    top = F.lit(float("inf") if upper is None else float(upper))
    n = F.col("n_data")
    too_high = start >= bins
    return check(
        domains,
        [*keys, "sweep_index"],
        [
            ("V17", too_high, F.concat_ws(" ", F.lit("first bin"), start, F.lit("of"), F.lit(bins))),
            ("V18", top * F.col("dt") * F.lit(float(n_fft)) > bins,
             F.concat_ws(" ", F.lit("end above bin"), F.lit(bins))),
            ("V19", ~too_high & (start >= stop), F.concat_ws(" .. ", F.lit("bins"), start, stop)),
            ("V20", (n > n_fft) | ((n == n_fft) & ~is_power_of_two(n)),
             F.concat_ws(" > ", n, F.lit(n_fft))),
            ("V32", n < 2, F.concat(F.lit("n_data = "), n)),
        ],
    )

"""Name functions: sanitising, natural order, labels, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digit runs are padded to this width, enough for any 64-bit integer.
DIGIT_WIDTH = 20


def name_problem(name: Column) -> Column:
    """Why a title or destination is unusable, or NULL."""
    return (
        F.when(name.isNull() | (name == ""), F.lit("must be non-empty"))
        .when(~name.rlike(r"^[\x00-\x7F]*$"), F.lit("may only contain ASCII"))
        .when(name.rlike(r"^[./\\]|[./\\]\z"), F.lit("may not start or end with . / or \\"))
    )


def sanitise_name(name: Column) -> Column:
    """White space to ``_`` (CR removed); NULL when :func:`name_problem` is set."""
    cleaned = F.translate(name, " \t\n\r", "___")
    return F.when(name_problem(name).isNull(), cleaned)


def natural_key(text: Column) -> Column:
    """Sort key under which digit runs compare as numbers."""
    runs = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    # lpad would cut longer runs, so those keep their own length
    width = lambda t: F.greatest(F.lit(DIGIT_WIDTH), F.length(t))
    padded = F.transform(
        runs, lambda t: F.when(t.rlike("^[0-9]+$"), F.lpad(t, width(t), "0")).otherwise(t)
    )
    return F.array_join(padded, "")


def x_label(x_col: Column, inverted: Column) -> Column:
    return F.when(inverted, F.concat(F.lit("1/"), x_col)).otherwise(x_col)


def y_label(variable: Column, y_col: Column) -> Column:
    return F.format_string("%s (%s)", variable, y_col)


def spectrum_stage(sweep: Column, sweep_index: Column) -> Column:
    """``fft`` for the full domain, else ``fft_sweep_<kind>_<index>``."""
    kind = F.when(sweep == "windows", F.lit("window")).otherwise(sweep)
    return F.when(sweep == "full", F.lit("fft")).otherwise(
        F.concat_ws("_", F.lit("fft_sweep"), kind, sweep_index.cast("string"))
    )


def output_path(project: Column, variable: Column, stage: Column, dest: Column, fmt: Column) -> Column:
    """Name of one stage output; ``dest`` may hold sub-directories."""
    extension = F.when(fmt == "csv", F.lit(".csv")).otherwise(F.lit(".parquet"))
    return F.concat(F.concat_ws("/", F.lit("output"), project, variable, stage, dest), extension)

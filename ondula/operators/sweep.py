"""FFT sub-domains: full range, swept ends, moving windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ondula.functions.slices import marks_in_segments
from ondula.operators.segments import (
    SEG,
    neighbours,
    segmented,
    window_sql,
    with_row_index,
    with_stats,
)
from ondula.session import bounded_batches, cut, sql_value

SWEEPS = ("full", "lower", "upper", "windows")


def sweep_indices(sweep: str, steps: int | None) -> tuple[int, int]:
    """First and last window number. Windows count from zero, swept ends from one."""
    if sweep not in SWEEPS:
        raise ValueError(f"unknown sweep {sweep!r}")
    if sweep == "full":
        return 0, 0
    if steps is None or steps <= 1:
        raise ValueError("a sweep needs more than one step")
    return (0, steps - 1) if sweep == "windows" else (1, steps)


def _uninverted(left: str, right: str, inverted: str) -> tuple[str, str]:
    return (
        f"IF({inverted}, try_divide(1.0D, {right}), {left})",
        f"IF({inverted}, try_divide(1.0D, {left}), {right})",
    )


def sweep_bounds(
    sweep: str, steps: int | None, i: str, left: str, right: str, inverted=False
) -> tuple[str, str]:
    """Bounds of window ``i`` over a series that spans ``left .. right``.

    Swept ends move uniformly in the x before inversion, and are mapped back;
    moving windows are uniform in the current x and overlap by half.
    """
    if sweep == "full":
        return left, right
    if sweep == "windows":
        dx = f"(({right} - {left}) / {steps + 1})"
        return f"({left} + {i} * {dx})", f"({left} + ({i} + 2) * {dx})"
    inv = sql_value(inverted, "boolean")
    plain_left, plain_right = _uninverted(left, right, inv)
    dx = f"(({plain_right} - {plain_left}) / {steps})"
    if sweep == "lower":
        lo, hi = f"({plain_right} - {i} * {dx})", plain_right
    else:
        lo, hi = plain_left, f"({plain_left} + {i} * {dx})"
    return (
        f"IF({inv}, try_divide(1.0D, {hi}), {lo})",
        f"IF({inv}, try_divide(1.0D, {lo}), {hi})",
    )


def _guess_index(sweep: str, steps: int | None, inverted) -> str:
    """Window whose moving end lies next to x, up to rounding."""
    if sweep == "full":
        return "0"
    if sweep == "windows":
        return f"CAST(floor(try_divide(x - x_left, (x_right - x_left) / {steps + 1})) AS int)"
    inv = sql_value(inverted, "boolean")
    plain_left, plain_right = _uninverted("x_left", "x_right", inv)
    plain = f"IF({inv}, try_divide(1.0D, x), x)"
    moved = f"{plain_right} - {plain}" if sweep == "lower" else f"{plain} - {plain_left}"
    return f"CAST(ceil(try_divide({moved}, ({plain_right} - {plain_left}) / {steps})) AS int)"


def with_grid_columns(series: DataFrame, keys: list[str]) -> DataFrame:
    """Add the index, next x and ends to series that weren't resampled."""
    if "i" not in series.columns:
        series = with_row_index(series, keys)
    if "x_next" not in series.columns:
        series = neighbours(series, keys, ["x"]).selectExpr(
            *series.columns, "next_x AS x_next"
        )
    if "x_left" not in series.columns:
        series = with_stats(series, keys, x_left=("min", "x"), x_right=("max", "x"))
    return series


def _held(sweep: str, steps: int | None, inverted) -> tuple[str, str]:
    """For rows that know their guessed window ``_g``: ``_r``, the first window
    that holds the row where each holds the one before it, and then an array of
    all windows that hold the row."""
    first, last = sweep_indices(sweep, steps)

    def held_by(d: int) -> str:
        i = f"(_g + {d})"
        lo, hi = sweep_bounds(sweep, steps, i, "x_left", "x_right", inverted)
        inside = f"x >= {lo} AND x < least({hi}, x_right)"
        return f"IF({i} BETWEEN {first} AND {last} AND {inside}, {i}, NULL)"

    if sweep in ("lower", "upper"):
        # each of these windows holds the one before it
        reached = f"coalesce({', '.join(held_by(d) for d in (-1, 0, 1))}, {last + 1})"
        chosen = f"IF(_r <= {last}, sequence(_r, {last}), NULL)"
    else:
        near = (0,) if sweep == "full" else (-2, -1, 0, 1)
        reached = "_g"
        chosen = f"array_compact(array({', '.join(held_by(d) for d in near)}))"
    return reached, chosen


def sweep_series(
    series: DataFrame, keys: list[str], sweep: str = "full", steps: int | None = None,
    inverted=False,
) -> DataFrame:
    """One copy of each sample per window that holds it, in ``sweep_index``.

    Every row knows the ends of its series, so it finds the windows it belongs
    to by itself: there is no join with a window table, and no row is made for
    a window only to be filtered away. The computed window number may be off by
    rounding, so its neighbours are tested on the window bounds themselves.
    Like every trim, the right end is exclusive.
    """
    reached, chosen = _held(sweep, steps, inverted)
    lo, hi = sweep_bounds(sweep, steps, "sweep_index", "x_left", "x_right", inverted)
    return (
        with_grid_columns(series, keys)
        .selectExpr("*", f"{_guess_index(sweep, steps, inverted)} AS _g")
        .selectExpr("*", f"{reached} AS _r")
        .selectExpr("*", f"explode({chosen}) AS sweep_index")
        .selectExpr(
            *keys, "sweep_index", "i", "x", "y", "x_next",
            f"{lo} AS domain_left", f"{hi} AS domain_right",
            *([SEG] if segmented(series) else []),
        )
    )


def sweep_domains(
    series: DataFrame, keys: list[str], sweep: str = "full", steps: int | None = None,
    inverted=False,
) -> DataFrame:
    """Every window of every series, also those that hold few samples or none:
    keys, sweep_index, domain_left, domain_right, n_data, y_mean, dt (null below
    two samples)."""
    first, last = sweep_indices(sweep, steps)
    gridded = with_grid_columns(series, keys)
    inv = sql_value(inverted, "boolean")
    lo, hi = sweep_bounds(sweep, steps, "sweep_index", "x_left", "x_right", "_inverted")
    expected = (
        gridded.selectExpr(*keys, "x_left", "x_right", f"{inv} AS _inverted")
        .groupBy(*keys)
        .agg(
            F.min("x_left").alias("x_left"),
            F.max("x_right").alias("x_right"),
            F.max("_inverted").alias("_inverted"),
        )
        .selectExpr("*", f"explode(sequence({first}, {last})) AS sweep_index")
        .selectExpr(
            *keys, "sweep_index", f"{lo} AS domain_left", f"{hi} AS domain_right", "x_right"
        )
    )
    totals = window_totals(gridded, keys, expected)
    return expected.drop("x_right").join(totals, [*keys, "sweep_index"], "left").selectExpr(
        *keys, "sweep_index", "domain_left", "domain_right",
        "coalesce(n_data, 0L) AS n_data", "y_mean", "dt",
    )


def window_counts(
    series: DataFrame, keys: list[str], sweep: str = "full", steps: int | None = None,
    inverted=False,
) -> DataFrame:
    """``sweep_domains`` without the means: keys, sweep_index, domain_left,
    domain_right, n_data, dt.

    Rows find their windows by themselves and are counted where they are, in
    one pass: no series is packed, and of each only a row per window is kept.
    """
    first, last = sweep_indices(sweep, steps)
    nested = sweep in ("lower", "upper")
    reached, chosen = _held(sweep, steps, inverted)
    inv = sql_value(inverted, "boolean")
    placed = (
        with_grid_columns(series, keys)
        .selectExpr("*", f"{inv} AS _inverted", f"{_guess_index(sweep, steps, inverted)} AS _g")
        .selectExpr("*", f"{reached} AS _r")
    )
    if not nested:
        placed = placed.drop("_r").selectExpr("*", f"explode_outer({chosen}) AS _r")
    found = cut(
        placed.groupBy(*keys, "_r").agg(
            F.expr("count(1) AS _n"),
            # x_next is the least where x is; plain minima are hashed, not sorted
            F.min("x").alias("_x"),
            F.min("x_next").alias("_x_next"),
            F.min("x_left").alias("x_left"),
            F.max("x_right").alias("x_right"),
            F.max("_inverted").alias("_inverted"),
        )
    )
    lo, hi = sweep_bounds(sweep, steps, "sweep_index", "x_left", "x_right", "_inverted")
    expected = (
        found.groupBy(*keys)
        .agg(
            F.min("x_left").alias("x_left"),
            F.max("x_right").alias("x_right"),
            F.max("_inverted").alias("_inverted"),
        )
        .selectExpr("*", f"explode(sequence({first}, {last})) AS sweep_index")
        .selectExpr(*keys, "sweep_index", f"{lo} AS domain_left", f"{hi} AS domain_right")
    )
    held = found.selectExpr(*[f"`{k}`" for k in keys], "_r AS sweep_index", "_n", "_x", "_x_next")
    # where windows are nested, one holds all that those before it hold
    over = f" {window_sql(keys, 'sweep_index')}" if nested else ""
    total, x, x_next = (
        [f"sum(_n){over}", f"min(_x){over}", f"min(_x_next){over}"] if nested else ["_n", "_x", "_x_next"]
    )
    return (
        expected.join(held, [*keys, "sweep_index"], "left")
        .selectExpr("*", f"coalesce({total}, 0L) AS n_data", f"{x_next} - {x} AS _step")
        .selectExpr(
            *keys, "sweep_index", "domain_left", "domain_right", "n_data",
            "IF(n_data > 1, _step, NULL) AS dt",
        )
    )


def window_totals(series: DataFrame, keys: list[str], windows: DataFrame) -> DataFrame:
    """Samples, mean and step of sub-domains (keys, sweep_index, domain_left,
    domain_right, x_right): n_data, y_mean, dt (both NULL where there are none).

    A prefix scan: each segment of a series is packed once as an array, and
    knows the count and the sum of all segments before it; a window is the
    difference of two look-ups, at its bounds. No sample is copied to the
    windows that hold it.
    """
    bounded_batches(series.sparkSession)
    has_segments = segmented(series)
    rows = series.selectExpr(
        *[f"`{k}`" for k in keys], f"{SEG if has_segments else '0'} AS _part", "x", "y", "x_next"
    )
    over = window_sql(keys, "_from")
    past = window_sql(keys, "_from", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    packed = rows.groupBy(*keys, "_part").agg(F.expr("collect_list(struct(x, y, x_next)) AS _data"))
    parts = (
        rows.groupBy(*keys, "_part")
        .agg(
            F.expr("count(1) AS _n"), F.expr("sum(y) AS _sum"),
            F.expr("min(struct(x, x_next)) AS _start"),
        )
        .selectExpr("*", "_start.x AS _from")
        .selectExpr(
            *keys, "_part",
            f"row_number() {over} = 1 AS _first",
            "_from",
            f"lead(_start) {over} AS _next",
            f"struct(coalesce(sum(_n) {past}, 0L) AS n, coalesce(sum(_sum) {past}, 0D) AS sum)"
            " AS _before",
        )
    )
    if has_segments:
        parts = cut(parts)
    marks = windows.selectExpr(
        *keys,
        "inline(array(struct(sweep_index, domain_left AS at, false AS upper),"
        " struct(sweep_index, least(domain_right, x_right) AS at, true AS upper)))",
    ).where("at IS NOT NULL")
    # a mark belongs to the last segment that begins at or before it
    located = (
        marks.join(parts, keys)
        .where("(_first OR at >= _from) AND (_next IS NULL OR at < _next.x)")
        .groupBy(*keys, "_part")
        .agg(
            F.expr("first(_before) AS _before"), F.expr("first(_next) AS _next"),
            F.expr("collect_list(struct(at, sweep_index, upper)) AS _marks"),
        )
    )
    asked = located.join(packed, [*keys, "_part"]).select(
        *keys, "_before", "_next", "_marks", "_data"
    )
    schema = T.StructType(
        [
            *[series.schema[k] for k in keys],
            *[T.StructField(n, t) for n, t in (
                ("sweep_index", T.IntegerType()), ("upper", T.BooleanType()), ("n", T.LongType()),
                ("sum", T.DoubleType()), ("x", T.DoubleType()), ("x_next", T.DoubleType()),
            )],
        ]
    )
    found = asked.mapInArrow(marks_in_segments(schema.names), schema)
    return (
        found.groupBy(*keys, "sweep_index")
        .agg(
            F.expr("greatest(max(IF(upper, n, NULL)) - max(IF(upper, NULL, n)), 0L) AS n_data"),
            F.expr("max(IF(upper, sum, NULL)) - max(IF(upper, NULL, sum)) AS _sum"),
            F.expr("max(IF(upper, NULL, x_next - x)) AS _step"),
        )
        .selectExpr(
            *keys, "sweep_index", "n_data", "IF(n_data > 0, _sum / n_data, NULL) AS y_mean",
            "IF(n_data > 1, _step, NULL) AS dt",
        )
    )

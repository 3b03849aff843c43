"""Resampling on a uniform grid, with derivatives.

``n`` grid points start at the left end with step (right - left) / n; the right
end itself is not one of them. Each sample owns the grid points up to its
successor, so no range join is needed. Interior slopes of the monotone cubic
follow Steffen (1990); the end slopes are those of the end intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ondula.operators.segments import MAX_ROWS, SEG, explode_range, neighbours, with_stats
from ondula.session import sql_value

LINEAR = "linear"
STEFFEN = "steffen"

# Grids up to this length are generated by one explode, longer ones in blocks.
SMALL_GRID = 65_536
BLOCK = 4096


def _grid_x(i: str) -> str:
    return f"({i} * _step + _left)"


def _first_index_at(bound: str, guess: str) -> str:
    """Smallest grid index whose x is at or beyond ``bound``: the guessed
    quotient may be off by one, so its neighbours are tested on the grid."""
    return f"""CASE WHEN {guess} <= 0 THEN 0
        WHEN {_grid_x(f'({guess} - 1)')} >= {bound} THEN {guess} - 1
        WHEN {_grid_x(guess)} >= {bound} THEN {guess} ELSE {guess} + 1 END"""


def _tangent(first: str, middle: str, last: str) -> str:
    """Steffen slope at the middle of three samples, named by column prefix.
    The first or the last may be missing."""
    h0, h1 = f"({middle}x - {first}x)", f"({last}x - {middle}x)"
    s0, s1 = f"(({middle}y - {first}y) / {h0})", f"(({last}y - {middle}y) / {h1})"
    interior = f"""(sign({s0}) + sign({s1})) * least(abs({s0}), abs({s1}),
        0.5D * abs(({s0} * {h1} + {s1} * {h0}) / ({h0} + {h1})))"""
    return f"""CASE WHEN {first}x IS NULL THEN {s1} WHEN {last}x IS NULL THEN {s0}
        ELSE {interior} END"""


# Values and derivatives at offset _u into an interval of length _h. The
# coefficients are those of y + u * (d + u * (b + u * a)).
LINE = """CASE _derivative WHEN 0 THEN y + _u / _h * (next_y - y)
    WHEN 1 THEN (next_y - y) / _h ELSE 0.0D END"""
CURVE = """CASE _derivative WHEN 0 THEN y + _u * (_d + _u * (_b + _u * _a))
    WHEN 1 THEN _d + _u * (2 * _b + 3 * _u * _a) ELSE 2 * _b + 6 * _u * _a END"""


def resample(
    samples: DataFrame,
    keys: list[str],
    n,
    algorithm: str = LINEAR,
    derivative=0,
    n_bound: int | None = None,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Evaluate every series on its grid: rows (keys, i, x, y), plus the next
    grid point and the grid's ends, which the spectral operators would
    otherwise have to find again.

    ``n`` and ``derivative`` are values or per-series SQL expressions, and
    ``algorithm`` one of the two names or such an expression. Where a series
    can become longer than ``max_rows`` (unless ``n``, or the given ``n_bound``,
    rules it out) rows carry a segment computed from the index.
    """
    fixed = algorithm in (LINEAR, STEFFEN)
    cubic = algorithm != LINEAR
    if isinstance(n, int):
        n_bound = n
    around = neighbours(samples, keys, ["x", "y"], ahead=2 if cubic else 1)
    ends = with_stats(around, keys, _left=("min", "x"), _right=("max", "x"))
    algorithm_sql = f"'{algorithm}'" if fixed else algorithm
    knots = ends.where("next_x IS NOT NULL").selectExpr(
        *keys,
        "x AS _x0",
        "next_x AS _x1",
        "y",
        "next_y",
        "next_x - x AS _h",
        *([
            f"{_tangent('prev_', '', 'next_')} AS _d",
            f"{_tangent('', 'next_', 'next2_')} AS _d1",
        ] if cubic else []),
        "_left",
        f"{sql_value(n, 'bigint')} AS _n",
        f"(_right - _left) / {sql_value(n, 'bigint')} AS _step",
        f"{sql_value(derivative, 'int')} AS _derivative",
        f"{algorithm_sql} AS _algorithm",
    )
    located = knots.selectExpr(
        "*",
        "CAST(ceil((_x0 - _left) / _step) AS bigint) AS _g0",
        "CAST(ceil((_x1 - _left) / _step) AS bigint) AS _g1",
        *(["(_d + _d1 - 2 * ((next_y - y) / _h)) / (_h * _h) AS _a",
           "(3 * ((next_y - y) / _h) - 2 * _d - _d1) / _h AS _b"] if cubic else []),
    )
    single_explode = n_bound is not None and n_bound <= SMALL_GRID
    grid = explode_range(
        located,
        "i",
        _first_index_at("_x0", "_g0"),
        f"least({_first_index_at('_x1', '_g1')}, _n)",
        block=0 if single_explode else BLOCK,
    ).selectExpr("*", f"{_grid_x('i')} - _x0 AS _u")
    value = f"IF(_algorithm = '{STEFFEN}', {CURVE}, {LINE})" if cubic else LINE
    part = f"CAST(i DIV {max_rows} AS int) AS {SEG}"
    return grid.selectExpr(
        *keys,
        "i",
        f"{_grid_x('i')} AS x",
        f"{value} AS y",
        f"{_grid_x('(i + 1)')} AS x_next",
        "_left AS x_left",
        f"{_grid_x('(_n - 1)')} AS x_right",
        *([part] if n_bound is None or n_bound > max_rows else []),
    )

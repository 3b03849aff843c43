"""Queries over the series views: preprocessing, resampling, spectra."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import E, EH, KEYS, L, events, hourly, prices, rounded, six_sql, unique
from ondula.operators.gridstats import global_length, interp_stats, min_dx_length, with_grid_length
from ondula.operators.impulse import impulse_filter, impulse_filter_mixed, median_filter
from ondula.operators.resample import resample
from ondula.operators.segments import MAX_ROWS
from ondula.operators.series import (
    dedup_mean,
    domain_stats,
    finite_only,
    invert_x,
    mask,
    mask_all,
    neighbour_dx,
    on_monotonic,
    plot_extent,
    scale_x,
    scale_y,
    trim,
)
from ondula.operators.spectrum import sweep_spectra, windowed
from ondula.operators.sweep import sweep_series

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Row bound that forces the segmented route on the small test tables.
TINY = 4000


def register(name: str, sql: str | None, run: Query) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def over(view, chain, *columns, max_rows: int = MAX_ROWS) -> Query:
    """Query that runs ``chain`` on the deduplicated series of a view."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = on_monotonic(view(spark, sf_dir), KEYS, chain, max_rows)
        return rounded(out, *columns)

    return run


# -- preprocessing ----------------------------------------------------------

Y6 = six_sql("y")

register(
    "dedup_mean",
    f"SELECT series, x, {Y6} AS y FROM ({unique(L)})",
    lambda spark, d: rounded(dedup_mean(prices(spark, d), KEYS), "y"),
)
register(
    "finite_only",
    f"SELECT series, {six_sql('x')} AS x, {Y6} AS y FROM ({E})"
    " WHERE isfinite(x) AND isfinite(y)",
    lambda spark, d: rounded(finite_only(events(spark, d)), "x", "y"),
)
register(
    "domain_stats",
    f"""SELECT series, min(x) AS x_left, max(x) AS x_right, max(x) - min(x) AS x_length,
               count(*) AS n, {six_sql('log2(count(*))')} AS log2_n
        FROM ({unique(L)}) GROUP BY series""",
    lambda spark, d: rounded(domain_stats(dedup_mean(prices(spark, d), KEYS), KEYS), "log2_n"),
)
register(
    "plot_extent",
    f"""SELECT series, min(x) AS x_min, max(x) AS x_max, {six_sql('min(y)')} AS y_min,
               {six_sql('max(y)')} AS y_max, min(x) < max(x) AS increasing
        FROM ({unique(L)}) GROUP BY series""",
    lambda spark, d: rounded(
        plot_extent(dedup_mean(prices(spark, d), KEYS), KEYS), "y_min", "y_max"
    ),
)
register(
    "neighbour_dx",
    f"""SELECT series, x, {Y6} AS y,
               abs(x - lag(x) OVER (PARTITION BY series ORDER BY x)) AS dx
        FROM ({unique(EH)})""",
    over(hourly, lambda s: neighbour_dx(s, KEYS), "y"),
)


def trim_sql(view: str, left: str, right: str) -> str:
    return f"""
        SELECT series, x, y FROM (
          SELECT *, CASE WHEN r <= 0 AND hi >= 0 THEN -hi ELSE lo END AS tl,
                    CASE WHEN r <= 0 AND hi >= 0 THEN -lo ELSE hi END AS tr
          FROM (SELECT *, coalesce({left}, l) AS lo, coalesce({right}, r) AS hi
                FROM (SELECT *, min(x) OVER (PARTITION BY series) AS l,
                                max(x) OVER (PARTITION BY series) AS r FROM ({view}))))
        WHERE x >= tl AND x < least(tr, r)"""


def mask_sql(view: str, left: float, right: float) -> str:
    return f"""
        SELECT series, x, y FROM (
          SELECT *, lag(x) OVER w AS before, lead(x) OVER w AS after FROM ({view})
          WINDOW w AS (PARTITION BY series ORDER BY x))
        WHERE NOT ((x >= {left} OR after IS NULL) AND (before IS NULL OR before < {right}))"""


MASKS = [(100.5, 130.25), (128.0, 200.0), (400.0, 400.0), (690.0, 900.0)]
NEGATED = f"SELECT series, -x AS x, y FROM ({EH})"
MASKED = unique(EH)
for _left, _right in MASKS:
    MASKED = mask_sql(MASKED, _left, _right)

MASKS_L = [(900.0, 1800.5), (1800.5, 1810.0), (2300.0, 2350.0)]
MASKED_L = unique(L)
for _left, _right in MASKS_L:
    MASKED_L = mask_sql(MASKED_L, _left, _right)


def tidy(view_sql: str) -> str:
    return f"SELECT series, x, {Y6} AS y FROM ({view_sql})"


def negated(spark, d):
    return hourly(spark, d).withColumn("x", -F.col("x"))


register(
    "trim",
    tidy(trim_sql(unique(EH), "50.0", "600.5")),
    over(hourly, lambda s: trim(s, KEYS, 50.0, 600.5), "y"),
)
register(
    "trim_default",
    tidy(trim_sql(unique(EH), "NULL", "NULL")),
    over(hourly, lambda s: trim(s, KEYS), "y"),
)
register(
    "trim_flip",
    tidy(trim_sql(unique(NEGATED), "50.0", "600.0")),
    over(negated, lambda s: trim(s, KEYS, 50.0, 600.0), "y"),
)
register(
    "mask",
    tidy(mask_sql(unique(EH), 100.5, 130.25)),
    over(hourly, lambda s: mask(s, KEYS, 100.5, 130.25), "y"),
)
register(
    "mask_multi", tidy(MASKED), over(hourly, lambda s: mask_all(s, KEYS, MASKS), "y")
)
register(
    "mask_trim_segmented",
    tidy(trim_sql(MASKED_L, "700.5", "2400.0")),
    over(
        prices,
        lambda s: trim(mask_all(s, KEYS, MASKS_L), KEYS, 700.5, 2400.0),
        "y",
        max_rows=TINY,
    ),
)
register(
    "scale_xy",
    f"SELECT series, {six_sql('x * -2.5')} AS x, {six_sql('y * 0.125')} AS y FROM ({unique(E)})",
    over(events, lambda s: scale_y(scale_x(s, -2.5), 0.125), "x", "y"),
)
register(
    "invert_x",
    f"SELECT series, {six_sql('1.0 / x')} AS x, {Y6} AS y FROM ({unique(E)})",
    over(events, lambda s: invert_x(s), "x", "y"),
)

# -- robust filters ---------------------------------------------------------

_CN = """CASE WHEN n = 2 THEN 0.743 WHEN n = 3 THEN 1.851 WHEN n = 4 THEN 0.954
              WHEN n = 5 THEN 1.351 WHEN n = 6 THEN 0.993 WHEN n = 7 THEN 1.198
              WHEN n = 8 THEN 1.005 WHEN n = 9 THEN 1.131
              WHEN n > 9 AND n % 2 = 1 THEN n / (n - 0.9) ELSE 1.0 END"""


def filter_sql(view: str, half: int, y: str) -> str:
    return f"""
      SELECT series, x, {six_sql(y)} AS y FROM (
        SELECT *, list_sort(list_transform(v, lambda a: list_sort(
                    list_transform(v, lambda b: abs(a - b)))[n // 2 + 1]))[(n + 1) // 2]
                  * 1.1926 * ({_CN}) AS sn,
               (v[(n + 1) // 2] + v[n // 2 + 1]) / 2 AS med
        FROM (SELECT series, x, y, list_sort(w) AS v, len(w) AS n FROM (
          SELECT *, list(y) OVER (PARTITION BY series ORDER BY x
                                  ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS w
          FROM ({view}))))"""


IMPULSE = filter_sql(unique(EH), 4, "CASE WHEN abs(y - med) > sn THEN med ELSE y END")
IMPULSE_L = filter_sql(unique(L), 7, "CASE WHEN abs(y - med) > 1.5 * sn THEN med ELSE y END")
register("impulse_filter", IMPULSE, over(hourly, lambda s: impulse_filter(s, KEYS, 9, 1.0), "y"))
register(
    "impulse_filter_segmented",
    IMPULSE_L,
    over(prices, lambda s: impulse_filter(s, KEYS, 14, 1.5), "y", max_rows=TINY),
)
def mixed_sql(view: str, key: str) -> str:
    """Width 2 * (key % 4) + 1 and tuning 0.5 + key % 3 / 2; key % 4 = 0 is off."""
    parts = [f"SELECT series, x, {Y6} AS y FROM ({view}) WHERE {key} % 4 = 0"]
    for half in (1, 2, 3):
        for step in range(3):
            own = f"SELECT * FROM ({view}) WHERE {key} % 4 = {half} AND {key} % 3 = {step}"
            tuning = 0.5 + step / 2
            parts.append(
                filter_sql(own, half, f"CASE WHEN abs(y - med) > {tuning} * sn THEN med ELSE y END")
            )
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


def mixed(key: str):
    def chain(s):
        return impulse_filter_mixed(
            s.selectExpr(
                "*", f"IF({key} % 4 = 0, 0, 2 * ({key} % 4) + 1) AS width",
                f"0.5D + {key} % 3 / 2 AS tuning",
            ),
            KEYS, "width", "tuning",
        )

    return chain


register(
    "impulse_filter_mixed",
    mixed_sql(unique(EH), "series"),
    over(hourly, mixed("series"), "y"),
)
register(
    "impulse_filter_mixed_segmented",
    mixed_sql(unique(L), "ascii(series)"),
    over(prices, lambda s: mixed("ascii(series)")(s).drop("_seg"), "y", max_rows=TINY),
)
register(
    "median_filter",
    filter_sql(unique(EH), 2, "med"),
    over(hourly, lambda s: median_filter(s, KEYS, 5), "y"),
)

# -- grid lengths -----------------------------------------------------------

MIN_DX = f"""
    SELECT series, max(dx) AS dx, CAST(ceil((max(r) - min(l)) / max(dx)) AS BIGINT) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY dx) AS rn FROM (
      SELECT series, x - lag(x) OVER (PARTITION BY series ORDER BY x) AS dx,
             min(x) OVER (PARTITION BY series) AS l, max(x) OVER (PARTITION BY series) AS r
      FROM ({unique(E)})) WHERE dx IS NOT NULL)
    WHERE rn <= 3 GROUP BY series"""
STATS = f"""
    SELECT series % 5 AS variable, avg(n) AS n_mean, stddev_samp(n) AS n_stddev,
           CAST(ceil(log2(avg(n))) AS BIGINT) AS n_mean_log2,
           CAST(floor(avg(n)) AS BIGINT) AS n_var
    FROM ({MIN_DX}) GROUP BY series % 5"""


def lengths(spark, d, max_rows=MAX_ROWS):
    return on_monotonic(events(spark, d), KEYS, lambda s: min_dx_length(s, KEYS), max_rows)


def stats(spark, d):
    return interp_stats(lengths(spark, d).withColumn("variable", F.col("series") % 5))


register(
    "min_dx_n",
    f"SELECT series, {six_sql('dx')} AS dx, n FROM ({MIN_DX})",
    lambda spark, d: rounded(lengths(spark, d), "dx"),
)
register(
    "min_dx_n_segmented",
    f"SELECT series, {six_sql('dx')} AS dx, n FROM ({MIN_DX.replace(E, L)})",
    lambda spark, d: rounded(
        on_monotonic(prices(spark, d), KEYS, lambda s: min_dx_length(s, KEYS), TINY), "dx"
    ),
)
register(
    "interp_stats",
    f"""SELECT variable, {six_sql('n_mean')} AS n_mean, {six_sql('n_stddev')} AS n_stddev,
               n_mean_log2, n_var FROM ({STATS})""",
    lambda spark, d: rounded(stats(spark, d), "n_mean", "n_stddev"),
)
register(
    "global_length",
    f"SELECT max(n_var) AS n_global FROM ({STATS})",
    lambda spark, d: global_length(stats(spark, d)),
)

_POLICIES = "CASE series % 4 WHEN 0 THEN 'min' WHEN 1 THEN 'minvar' WHEN 2 THEN '1000' ELSE '2^10' END"


def policies(spark, d):
    return events(spark, d).select("series").distinct().selectExpr(
        "series", "series % 5 AS variable", f"{_POLICIES} AS interpolation_n"
    )


register(
    "grid_length_policy",
    f"""SELECT series, variable, interpolation_n,
               CASE interpolation_n WHEN 'min' THEN (SELECT max(n_var) FROM ({STATS}))
                 WHEN 'minvar' THEN n_var WHEN '1000' THEN 1000 ELSE 1024 END AS n
        FROM (SELECT DISTINCT user_id AS series, user_id % 5 AS variable,
                     {_POLICIES.replace('series', 'user_id')} AS interpolation_n FROM events)
        LEFT JOIN (SELECT variable, n_var FROM ({STATS})) USING (variable)""",
    lambda spark, d: with_grid_length(policies(spark, d), stats(spark, d)).select(
        "series", "variable", "interpolation_n", "n"
    ),
)

# -- resampling -------------------------------------------------------------


def grid_sql(view: str, n: int, expr: str) -> str:
    """Rows (series, i, x, y) of a resampled view; ``expr`` gives y."""
    return f"""
      SELECT series, i, x, {expr} AS y FROM (
        SELECT g.series, g.i, g.x, k.*  EXCLUDE (series), g.x - x0 AS u, x1 - x0 AS h,
               (y1 - y0) / (x1 - x0) AS s
        FROM (SELECT series, CAST(i AS BIGINT) AS i, i * st + l AS x
              FROM (SELECT series, min(x) AS l, (max(x) - min(x)) / {n} AS st
                    FROM ({view}) GROUP BY series), range({n}) AS t(i)) g
        ASOF JOIN (
          SELECT series, x0, y0, x1, y1, d, lead(d) OVER (PARTITION BY series ORDER BY x0) AS d1
          FROM (SELECT *, CASE WHEN s0 IS NULL THEN s1 WHEN s1 IS NULL THEN s0
                  ELSE (sign(s0) + sign(s1)) * least(abs(s0), abs(s1),
                       0.5 * abs((s0 * h1 + s1 * h0) / (h0 + h1))) END AS d
                FROM (SELECT *, lag(s1) OVER v AS s0, lag(h1) OVER v AS h0
                      FROM (SELECT series, x AS x0, y AS y0, lead(x) OVER w AS x1,
                                   lead(y) OVER w AS y1, lead(x) OVER w - x AS h1,
                                   (lead(y) OVER w - y) / (lead(x) OVER w - x) AS s1
                            FROM ({view}) WINDOW w AS (PARTITION BY series ORDER BY x))
                      WINDOW v AS (PARTITION BY series ORDER BY x0)))) k
        ON g.series = k.series AND g.x >= k.x0)"""


LINEAR_Y = "y0 + u / h * (y1 - y0)"
_A, _B = "((d + d1 - 2 * s) / (h * h))", "((3 * s - 2 * d - d1) / h)"
CURVES = {
    "interp_linear": ("linear", 0, LINEAR_Y),
    "linear_deriv1": ("linear", 1, "s"),
    "linear_deriv2": ("linear", 2, "0.0"),
    "interp_steffen": ("steffen", 0, f"y0 + u * (d + u * ({_B} + u * {_A}))"),
    "deriv1": ("steffen", 1, f"d + u * (2 * {_B} + 3 * u * {_A})"),
    "deriv2": ("steffen", 2, f"2 * {_B} + 6 * u * {_A}"),
}


def grid_query(view, n, algorithm, derivative, max_rows=MAX_ROWS):
    def chain(s):
        return resample(s, KEYS, n, algorithm, derivative, max_rows=max_rows).select(
            "series", "i", "x", "y"
        )

    return over(view, chain, "x", "y", max_rows=max_rows)


for _name, (_algorithm, _derivative, _y) in CURVES.items():
    register(
        _name,
        f"SELECT series, i, {six_sql('x')} AS x, {Y6} AS y FROM ({grid_sql(unique(EH), 500, _y)})",
        grid_query(hourly, 500, _algorithm, _derivative),
    )
register(
    "interp_steffen_segmented",
    f"""SELECT series, i, {six_sql('x')} AS x, {Y6} AS y
        FROM ({grid_sql(unique(L), 5000, CURVES['interp_steffen'][2])})""",
    grid_query(prices, 5000, "steffen", 0, TINY),
)

# -- spectra ----------------------------------------------------------------

N_GRID = 256
GRID = grid_sql(unique(E), N_GRID, LINEAR_Y)
INVERTED_GRID = grid_sql(
    f"SELECT series, 1.0 / x AS x, y FROM ({unique(EH)})", N_GRID, LINEAR_Y
)


def sweep_sql(grid: str, sweep: str, steps: int, inverted: bool = False) -> str:
    """Rows of each sub-domain, with their position, count, step and mean."""
    pl, pr = ("1.0 / r", "1.0 / l") if inverted else ("l", "r")
    if sweep == "full":
        lo, hi, first, last = "l", "r", 0, 0
    elif sweep == "windows":
        first, last = 0, steps - 1
        lo = f"l + si * ((r - l) / {steps + 1})"
        hi = f"l + (si + 2) * ((r - l) / {steps + 1})"
    else:
        first, last = 1, steps
        dx = f"(({pr} - {pl}) / {steps})"
        lo = f"({pr} - si * {dx})" if sweep == "lower" else f"({pl})"
        hi = f"({pr})" if sweep == "lower" else f"({pl} + si * {dx})"
        if inverted:
            lo, hi = f"1.0 / {hi}", f"1.0 / {lo}"
    return f"""
      SELECT series, sweep_index, i - i0 AS r, n AS n_data, x, y - m AS yc, i,
             max(CASE WHEN i = i0 + 1 THEN x END) OVER v
             - max(CASE WHEN i = i0 THEN x END) OVER v AS dt
      FROM (SELECT *, min(i) OVER v AS i0, count(*) OVER v AS n, avg(y) OVER v AS m
            FROM (SELECT series, CAST(si AS INT) AS sweep_index, i, x, y, r, {lo} AS lo, {hi} AS hi
                  FROM (SELECT *, min(x) OVER (PARTITION BY series) AS l,
                                  max(x) OVER (PARTITION BY series) AS r FROM ({grid})),
                       range({first}, {last + 1}) AS t(si))
            WHERE x >= lo AND x < least(hi, r)
            WINDOW v AS (PARTITION BY series, sweep_index))
      WINDOW v AS (PARTITION BY series, sweep_index)"""


def hann_sql(swept: str) -> str:
    return f"""
      SELECT series, sweep_index, r, n_data, dt,
             CASE WHEN r = 0 OR r = n_data - 1 THEN 0.0
                  ELSE yc * pow(sin(r * pi() / (n_data - 1)), 2) END AS y
      FROM ({swept}) WHERE n_data > 1"""


def dft_sql(prepared: str, n_fft: int, lower: float | None, upper: float | None) -> str:
    stop = f"least(ceil({upper} * dt * {n_fft}.0), {n_fft // 2 + 1})" if upper else n_fft // 2 + 1
    return f"""
      SELECT series, sweep_index, k, {six_sql(f'k * (1.0 / (dt * {n_fft}.0))')} AS frequency,
             {six_sql('sqrt(re * re + im * im) / n_data')} AS amplitude
      FROM (SELECT series, sweep_index, CAST(k AS BIGINT) AS k, max(dt) AS dt,
                   max(n_data) AS n_data,
                   sum(y * cos(2 * pi() * ((r * k) % {n_fft}) / {n_fft})) AS re,
                   sum(y * sin(2 * pi() * ((r * k) % {n_fft}) / {n_fft})) AS im
            FROM ({prepared}), range({n_fft // 2 + 1}) AS t(k)
            WHERE k >= floor({lower or 0.0} * dt * {n_fft}.0) AND k < {stop}
            GROUP BY series, sweep_index, k)"""


def spectrum_query(
    view, n_fft, sweep="full", steps=None, inverted=False, lower=None, upper=None,
    method="auto", n=N_GRID, max_rows=MAX_ROWS, center=True, hann=True,
):
    def chain(s):
        s = invert_x(s) if inverted else s
        grid = resample(s, KEYS, n, max_rows=max_rows)
        return sweep_spectra(
            grid, KEYS, n_fft, sweep, steps, inverted, lower, upper, center, hann, method
        )

    def run(spark, d):
        out = on_monotonic(view(spark, d), KEYS, chain, max_rows)
        return rounded(
            out.select("series", "sweep_index", "k", "frequency", "amplitude"),
            "frequency", "amplitude",
        )

    return run


def prepared_query(sweep="full", steps=None):
    def chain(s):
        return windowed(sweep_series(resample(s, KEYS, N_GRID), KEYS, sweep, steps), KEYS)

    columns = ["series", "sweep_index", "r", "n_data", "dt", "y"]
    return lambda spark, d: rounded(
        on_monotonic(events(spark, d), KEYS, chain).select(*columns), "dt", "y"
    )


FULL = hann_sql(sweep_sql(GRID, "full", 1))
register(
    "hann_center",
    f"""SELECT series, sweep_index, r, n_data, {six_sql('dt')} AS dt, {Y6} AS y FROM ({FULL})""",
    prepared_query(),
)
register("spectrum", dft_sql(FULL, 512, None, None), spectrum_query(events, 512))
register(
    "spectrum_boxcar",
    dft_sql(
        f"SELECT *, yc + m0 AS y FROM (SELECT *, 0.0 AS m0 FROM ({sweep_sql(GRID, 'full', 1)}))",
        512, None, 0.05,
    ),
    spectrum_query(events, 512, upper=0.05, hann=False),
)
register(
    "spectrum_band",
    dft_sql(FULL, 1024, 0.01, 0.05),
    spectrum_query(events, 1024, lower=0.01, upper=0.05, method="bins"),
)
register(
    "spectrum_fft",
    dft_sql(FULL, 1024, 0.01, 0.05),
    spectrum_query(events, 1024, lower=0.01, upper=0.05, method="grouped"),
)
register(
    "spectrum_split",
    dft_sql(FULL, 512, None, None),
    spectrum_query(events, 512, method="split"),
)
for _method in ("bins", "grouped", "split"):
    register(
        f"spectrum_negative_lower_{_method}",
        dft_sql(FULL, 512, -0.02, 0.03),
        spectrum_query(events, 512, lower=-0.02, upper=0.03, method=_method),
    )
for _sweep in ("lower", "upper", "windows"):
    register(
        f"sweep_{_sweep}",
        dft_sql(hann_sql(sweep_sql(GRID, _sweep, 4)), 512, None, 0.02),
        spectrum_query(events, 512, _sweep, 4, upper=0.02),
    )
    register(
        f"sweep_{_sweep}_inverted",
        dft_sql(hann_sql(sweep_sql(INVERTED_GRID, _sweep, 3, True)), 512, None, 20.0),
        spectrum_query(hourly, 512, _sweep, 3, True, upper=20.0),
    )
register(
    "sweep_lower_segmented",
    dft_sql(hann_sql(sweep_sql(grid_sql(unique(L), 2000, LINEAR_Y), "lower", 3)), 2048, None, 0.01),
    spectrum_query(
        prices, 2048, "lower", 3, upper=0.01, method="bins", n=2000, max_rows=TINY
    ),
)

"""The whole analysis, with settings that differ by series, against plain SQL."""

from __future__ import annotations

from checks.core import CURVES, LINEAR_Y, dft_sql, filter_sql, hann_sql, register, sweep_sql
from checks.views import E, events, rounded, six_sql, unique
from ondula.plans.analysis import Analysis
from ondula.plans.settings import FIELDS

FFT = {"zero_pad": 4096, "sweep": "upper", "sweep_steps": 3, "truncate_upper": 0.01}

# Settings of a series by its number s and its own ends l and r, as SQL that
# both engines read.
WIDTH = "CASE WHEN {s} % 4 = 0 THEN 0 ELSE 2 * ({s} % 4) + 1 END"
TRIM_LEFT = "CASE WHEN {s} % 2 = 0 THEN l + 20 END"
TRIM_RIGHT = "CASE WHEN {s} % 5 <> 0 THEN r - 30 END"
FACTOR = "CASE WHEN {s} % 2 = 1 THEN -0.5 ELSE 2.0 END"
INVERTED = "{s} % 6 = 5"
ALGORITHM = "CASE WHEN {s} % 7 = 3 THEN NULL WHEN {s} % 2 = 0 THEN 'linear' ELSE 'steffen' END"
POLICY = (
    "CASE WHEN {s} % 6 = 5 OR {s} % 4 = 2 THEN '300' WHEN {s} % 4 = 0 THEN 'min'"
    " WHEN {s} % 4 = 1 THEN 'minvar' ELSE '2^8' END"
)
DERIVATIVE = "CASE WHEN {s} % 6 = 5 THEN 0 ELSE {s} % 3 END"
# frequencies of inverted series are large: they are compared in millions
SCALED = "CASE WHEN series % 6 = 5 THEN frequency / 1e6 ELSE frequency END"
MASKS = [("{s} % 3 > 0", 100, 110), ("{s} % 3 = 2", 300, 305)]


def of(sql: str) -> str:
    return sql.format(s="series")


def settings(samples):
    """One row per series, from its own ends."""
    masks = ", ".join(
        f"IF({of(when)}, struct(l + {a}D AS left, l + {b}D AS right), NULL)" for when, a, b in MASKS
    )
    chosen = {
        "impulse_filter": of(WIDTH),
        "impulse_tuning": "0.5D + series % 3 / 2",
        "masks": f"array_compact(array({masks}))",
        "trim_left": of(TRIM_LEFT),
        "trim_right": of(TRIM_RIGHT),
        "prefactor_y": of(FACTOR),
        "invert_x": of(INVERTED),
        "interpolation": of(ALGORITHM),
        "interpolation_n": of(POLICY),
        "derivative": of(DERIVATIVE),
    }
    ends = samples.selectExpr("variable", "file", "CAST(file AS bigint) AS series", "x").groupBy(
        "variable", "file", "series"
    )
    return ends.agg({"x": "min"}).withColumnRenamed("min(x)", "l").join(
        ends.agg({"x": "max"}).withColumnRenamed("max(x)", "r"), ["variable", "file", "series"]
    ).selectExpr(
        "variable",
        "file",
        *[
            f"CAST({chosen.get(f, 'NULL' if default is None else repr(default))} AS {dtype}) AS {f}"
            for f, (dtype, default) in FIELDS.items()
        ],
    )


def run(spark, d, **options):
    samples = events(spark, d).selectExpr(
        "'V' || series % 3 AS variable", "CAST(series AS string) AS file", "x", "y"
    )
    return Analysis(fft=FFT, **options).run(samples, settings(samples))


def _filtered() -> str:
    """Rows behind the impulse filter, whose width and tuning differ."""
    view = unique(E)
    parts = [f"SELECT series, x, y FROM ({view}) WHERE series % 4 = 0"]
    for half in (1, 2, 3):
        for step in range(3):
            own = f"SELECT * FROM ({view}) WHERE series % 4 = {half} AND series % 3 = {step}"
            value = f"CASE WHEN abs(y - med) > {0.5 + step / 2} * sn THEN med ELSE y END"
            parts.append(filter_sql(own, half, "y0").replace(f"{six_sql('y0')} AS y", f"{value} AS y"))
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


def _masked() -> str:
    out = f"""SELECT series, x, y, min(x) OVER v AS l, max(x) OVER v AS r FROM ({_filtered()})
              WINDOW v AS (PARTITION BY series)"""
    for when, a, b in MASKS:
        out = f"""
          SELECT series, x, y, l, r FROM (
            SELECT *, lag(x) OVER w AS before, lead(x) OVER w AS after FROM ({out})
            WINDOW w AS (PARTITION BY series ORDER BY x))
          WHERE NOT ({of(when)}) OR NOT ((x >= l + {a} OR after IS NULL)
                AND (before IS NULL OR before < l + {b}))"""
    return out


PREPROCESSED = f"""
  SELECT series, x, y * {of(FACTOR)} AS y FROM (
    SELECT *, coalesce({of(TRIM_LEFT)}, l2) AS lo, coalesce({of(TRIM_RIGHT)}, r2) AS hi
    FROM (SELECT *, min(x) OVER v AS l2, max(x) OVER v AS r2 FROM ({_masked()})
          WINDOW v AS (PARTITION BY series)))
  WHERE x >= lo AND x < least(hi, r2)"""
_TURNED = f"SELECT series, CASE WHEN {of(INVERTED)} THEN 1.0 / x ELSE x END AS x, y FROM pre"
_LENGTHS = """
  SELECT series, CAST(ceil((max(r) - min(l)) / max(dx)) AS BIGINT) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY dx) AS rn FROM (
    SELECT series, x - lag(x) OVER (PARTITION BY series ORDER BY x) AS dx,
           min(x) OVER (PARTITION BY series) AS l, max(x) OVER (PARTITION BY series) AS r
    FROM turned) WHERE dx IS NOT NULL)
  WHERE rn <= 3 GROUP BY series"""
STATS = f"""
  SELECT 'V' || series % 3 AS variable, avg(n) AS n_mean, stddev_samp(n) AS n_stddev,
         CAST(ceil(log2(avg(n))) AS BIGINT) AS n_mean_log2,
         CAST(floor(avg(n)) AS BIGINT) AS n_var
  FROM ({_LENGTHS}) WHERE {of(POLICY)} IN ('min', 'minvar') GROUP BY 1"""
_PLANS = f"""
  SELECT series, {of(ALGORITHM)} AS algorithm, {of(DERIVATIVE)} AS der,
         CASE {of(POLICY)} WHEN 'min' THEN (SELECT max(n_var) FROM stats)
              WHEN 'minvar' THEN n_var WHEN '300' THEN 300 ELSE 256 END AS n
  FROM (SELECT DISTINCT series, 'V' || series % 3 AS variable FROM turned)
  LEFT JOIN stats USING (variable)"""
_VALUE = " ".join(
    f"WHEN algorithm = '{a}' AND der = {k} THEN {y}" for a, k, y in CURVES.values() if k or a != "linear"
)
_GRIDS = f"""
  SELECT series, i, x, CASE {_VALUE} ELSE {LINEAR_Y} END AS y FROM (
    SELECT g.series, g.i, g.x, g.algorithm, g.der, k.* EXCLUDE (series), g.x - x0 AS u,
           x1 - x0 AS h, (y1 - y0) / (x1 - x0) AS s
    FROM (SELECT series, algorithm, der, i, i * ((r - l) / n) + l AS x
          FROM (SELECT *, unnest(range(n)) AS i FROM plans JOIN (
                  SELECT series, min(x) AS l, max(x) AS r FROM turned GROUP BY series) USING (series)
                WHERE algorithm IS NOT NULL)) g
    ASOF JOIN (
      SELECT series, x0, y0, x1, y1, d, lead(d) OVER (PARTITION BY series ORDER BY x0) AS d1
      FROM (SELECT *, CASE WHEN s0 IS NULL THEN s1 WHEN s1 IS NULL THEN s0
              ELSE (sign(s0) + sign(s1)) * least(abs(s0), abs(s1),
                   0.5 * abs((s0 * h1 + s1 * h0) / (h0 + h1))) END AS d
            FROM (SELECT *, lag(s1) OVER v AS s0, lag(h1) OVER v AS h0
                  FROM (SELECT series, x AS x0, y AS y0, lead(x) OVER w AS x1,
                               lead(y) OVER w AS y1, lead(x) OVER w - x AS h1,
                               (lead(y) OVER w - y) / (lead(x) OVER w - x) AS s1
                        FROM turned WINDOW w AS (PARTITION BY series ORDER BY x))
                  WINDOW v AS (PARTITION BY series ORDER BY x0)))) k
    ON g.series = k.series AND g.x >= k.x0)"""
_PLAIN = f"""
  SELECT series, row_number() OVER (PARTITION BY series ORDER BY x) - 1 AS i, x, y FROM turned
  WHERE {of(ALGORITHM)} IS NULL"""
CHAIN = f"""
  WITH pre AS MATERIALIZED ({PREPROCESSED}), turned AS MATERIALIZED ({_TURNED}),
       stats AS MATERIALIZED ({STATS}), plans AS MATERIALIZED ({_PLANS}),
       grids AS MATERIALIZED ({_GRIDS}), ready AS MATERIALIZED (
         SELECT series, i, x, y FROM grids UNION ALL SELECT series, i, x, y FROM ({_PLAIN}))"""


def _spectra_sql() -> str:
    parts = []
    for inverted in (False, True):
        own = f"SELECT * FROM ready WHERE ({of(INVERTED)}) = {str(inverted).lower()}"
        swept = sweep_sql(own, FFT["sweep"], FFT["sweep_steps"], inverted)
        parts.append(dft_sql(hann_sql(swept), FFT["zero_pad"], None, FFT["truncate_upper"]))
    return f"""{CHAIN} SELECT series, sweep_index, k, {six_sql(SCALED)} AS frequency, amplitude
               FROM (SELECT * FROM ({parts[0]}) UNION ALL SELECT * FROM ({parts[1]}))"""


def spectra(spark, d, **options):
    return rounded(
        run(spark, d, **options).spectra.selectExpr(
            "CAST(file AS bigint) AS series", "sweep_index", "k", "frequency", "amplitude"
        ).selectExpr("series", "sweep_index", "k", f"{SCALED} AS frequency", "amplitude"),
        "frequency", "amplitude",
    )


register("analysis", _spectra_sql(), spectra)
register(
    "analysis_segmented",
    _spectra_sql(),
    lambda spark, d: spectra(spark, d, max_rows=60),
)


def stages(spark, d):
    found = run(spark, d).stages
    parts = [
        found[s].selectExpr(f"'{s}' AS stage", "CAST(file AS bigint) AS series", "x", "y")
        for s in ("preprocessed", "inverted", "processed")
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "x", "y")


register(
    "analysis_stages",
    f"""{CHAIN}, every AS (
          SELECT 'preprocessed' AS stage, series, x, y FROM pre
          UNION ALL SELECT 'inverted', series, x, y FROM turned WHERE {of(INVERTED)}
          UNION ALL SELECT 'processed', series, x, y FROM grids)
        SELECT stage, series, {six_sql('x')} AS x, {six_sql('y')} AS y FROM every""",
    stages,
)
register(
    "analysis_stats",
    f"""{CHAIN} SELECT variable, {six_sql('n_mean')} AS n_mean, {six_sql('n_stddev')} AS n_stddev,
                       n_mean_log2, n_var FROM stats""",
    lambda spark, d: rounded(run(spark, d).interp_stats, "n_mean", "n_stddev"),
)

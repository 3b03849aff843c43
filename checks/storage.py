"""Queries over what is written and read back, and over rules with details."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.config import _TRIMS, customer_settings, rules_sql, series_settings, SETTLED
from checks.core import (
    EH,
    Y6,
    FULL,
    dft_sql,
    events,
    mask_sql,
    over,
    register,
)
from checks.views import KEYS, hourly, rounded, table, unique
from ondula.operators import quality
from ondula.operators.resample import resample
from ondula.operators.series import dedup_mean, mask, mask_packed
from ondula.operators.spectrum import sweep_spectra
from ondula.plans.catalog import catalog, read_back
from ondula.plans.settings import FIELDS
from ondula.session import cut, shared_folder
from ondula.sinks.runs import open_catalog, publish
from ondula.sinks.stages import read_stage, write_spectra, write_stage
from ondula.sources import text

_PROJECT = {"title": "demo", "format": "messagepack"}
_FFT = {"zero_pad": 1024, "center": True, "hann": True, "sweep": "upper", "sweep_steps": 3}

# -- stores -----------------------------------------------------------------


def stored_orders(spark, d):
    """Orders as a published run: one raw series per customer, and a catalog
    of what was written."""
    samples = table(spark, d, "orders").selectExpr(
        "'Va' AS variable", "'c/' || o_custkey AS file", "CAST(o_orderkey AS double) AS x",
        "o_totalprice AS y",
    )
    root = shared_folder(spark, "orders-store")

    def run(folder):
        write_stage(samples, folder, "raw")
        written = samples.selectExpr("'raw' AS stage", "variable", "file").distinct()
        return catalog(customer_settings(spark, d), _PROJECT, None, folder, written)

    done = publish(spark, root, run)
    return root, done["folder"]


def readback(spark, d):
    root, folder = stored_orders(spark, d)
    stored = read_stage(spark, folder, "raw").withColumn("stage", F.lit("raw"))
    return read_back(open_catalog(spark, root), stored, "raw", "nation", "7").select(
        "variable", "file", "stage", "x", "y"
    )


register(
    "readback",
    """SELECT 'Va' AS variable, 'c/' || o_custkey AS file, 'raw' AS stage,
              CAST(o_orderkey AS DOUBLE) AS x, o_totalprice AS y
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7""",
    readback,
)


def user_settings(spark, d):
    """Work items of the event series, with a tag by the number of the user."""
    defaults = [
        f"CAST({'NULL' if default is None else repr(default) if default != [] else 'array()'}"
        f" AS {dtype}) AS {f}"
        for f, (dtype, default) in FIELDS.items()
    ]
    return events(spark, d).select("series").distinct().selectExpr(
        "'V' AS variable", "'u/' || series AS dest", "'t' AS x_col", "'v' AS y_col",
        "map('group', '\"' || series % 4 || 'K\"') AS tags", *defaults,
    )


def readback_spectrum(spark, d):
    """Write the spectra of all users, publish them, read those of one tag."""
    root = shared_folder(spark, "spectra-store")
    fft = {"zero_pad": 512, "sweep": "full"}

    def run(folder):
        grid = over(events, lambda s: resample(s, KEYS, 256))(spark, d)
        spectra = cut(
            sweep_spectra(grid, KEYS, 512).selectExpr(
                "'fft' AS stage", "'V' AS variable", "'u/' || series AS file", "k",
                "frequency", "amplitude",
            )
        )
        write_spectra(spectra, folder)
        written = spectra.select("stage", "variable", "file").distinct()
        return catalog(user_settings(spark, d), _PROJECT, fft, folder, written)

    folder = publish(spark, root, run)["folder"]
    stored = read_stage(spark, folder, "fft").withColumn("stage", F.lit("fft"))
    found = read_back(open_catalog(spark, root), stored, "fft", "group", '"2K"')
    return rounded(
        found.selectExpr("CAST(substr(file, 3) AS bigint) AS series", "k", "frequency", "amplitude"),
        "frequency", "amplitude",
    )


register(
    "readback_spectrum",
    f"SELECT series, k, frequency, amplitude FROM ({dft_sql(FULL, 512, None, None)})"
    " WHERE series % 4 = 2",
    readback_spectrum,
)


def full_catalog(spark, d):
    """The catalog with grid lengths, the ends of the series and all settings."""
    own = customer_settings(spark, d).withColumns(
        {
            "n": F.expr("CAST(tags['nation'] AS bigint) + 100"),
            "x_left": F.lit(1.0),
            "x_right": F.expr("2.0D + CAST(tags['nation'] AS double)"),
        }
    )
    return catalog(own, _PROJECT, _FFT).select(
        "variable",
        "file",
        "stage",
        F.get_json_object("settings", "$.trim_left").try_cast("double").alias("trim_left"),
        F.get_json_object("settings", "$.impulse_filter").try_cast("int").alias("impulse_filter"),
        F.get_json_object("settings", "$.interpolation").alias("interpolation"),
        F.get_json_object("settings", "$.derivative").try_cast("int").alias("derivative"),
        F.get_json_object("settings", "$.zero_pad").try_cast("int").alias("zero_pad"),
        "interpolation_n",
        F.get("fft_domain", F.lit(0)).alias("domain_left"),
        F.get("fft_domain", F.lit(1)).alias("domain_right"),
    )


register(
    "catalog_settings",
    f"""SELECT variable, dest AS file, stage,
               CASE WHEN stage = 'preprocessed' THEN trim_left END AS trim_left,
               CASE WHEN stage = 'preprocessed' THEN 3 END AS impulse_filter,
               CASE WHEN stage = 'processed' THEN 'steffen' END AS interpolation,
               CASE WHEN stage = 'processed' THEN derivative END AS derivative,
               CASE WHEN w > 0 THEN 1024 END AS zero_pad,
               CASE WHEN stage = 'processed' THEN CAST(c_nationkey + 100 AS BIGINT) END AS interpolation_n,
               CASE WHEN w > 0 THEN CAST(1.0 AS DOUBLE) END AS domain_left,
               CASE WHEN w > 0 THEN 1.0 + w * ((2.0 + c_nationkey - 1.0) / 3) END AS domain_right
        FROM ({SETTLED}), (VALUES ('unprocessed', 0), ('raw', 0), ('preprocessed', 0),
             ('processed', 0), ('fft_sweep_upper_1', 1), ('fft_sweep_upper_2', 2),
             ('fft_sweep_upper_3', 3)) AS s(stage, w)""",
    full_catalog,
)

# -- rules with details -----------------------------------------------------

_BAD_TRIMS = rules_sql(
    _TRIMS, ("V12", "al >= ar"), ("V13", "invert_x AND (lo = 0 OR hi = 0)"),
    ("V14", "l > lo"), ("V14", "r < hi"),
)


def lenient_drop(spark, d):
    rows = dedup_mean(hourly(spark, d), KEYS)
    found = quality.trim_violations(rows, series_settings(spark, d), KEYS)
    return rounded(quality.drop_failed(rows, found, KEYS), "y")


register(
    "lenient_drop",
    f"""SELECT series, x, {Y6} AS y FROM ({unique(EH)})
        WHERE series NOT IN (SELECT series FROM ({_BAD_TRIMS}))""",
    lenient_drop,
)

_THREE = [(10.0, 20.5), (5.0, 650.0), (660.0, 700.0)]
_OFFSETS = "series % 3"


def three_masks(spark, d):
    masks = ", ".join(
        f"struct({a}D + {_OFFSETS} AS left, {b}D + {_OFFSETS} AS right)" for a, b in _THREE
    )
    rows = dedup_mean(hourly(spark, d), KEYS).selectExpr("*", f"array({masks}) AS masks")
    return cut(mask_packed(rows, KEYS, "masks"))


def _three_sql():
    steps, view = [], unique(EH)
    for a, b in _THREE:
        left, right = f"({a} + {_OFFSETS})", f"({b} + {_OFFSETS})"
        steps.append(
            f"""SELECT CAST(series AS VARCHAR) AS key, 'V10' AS code, 'error' AS severity,
                       'mask ' || {left} || ' ' || {right} || ' beyond ' || l || ' ' || r AS detail
                FROM (SELECT series, min(x) AS l, max(x) AS r FROM ({view}) GROUP BY series)
                WHERE {left} < l OR {right} > r"""
        )
        view = mask_sql(view, left, right)
    return steps, view


register(
    "violations_masks",
    " UNION ALL ".join(_three_sql()[0]).replace(
        "|| (", "|| CAST((").replace(f" + {_OFFSETS}) ||", f" + {_OFFSETS}) AS DOUBLE) ||"),
    lambda spark, d: quality.packed_mask_violations(three_masks(spark, d), KEYS).drop("parts"),
)
register(
    "mask_packed",
    f"SELECT series, x, {Y6} AS y FROM ({_three_sql()[1]})",
    lambda spark, d: rounded(three_masks(spark, d).select("series", F.inline("_kept")), "y"),
)


def left_over(spark, d):
    """Series of which little or nothing is left."""
    rows = dedup_mean(hourly(spark, d), KEYS)
    settings = series_settings(spark, d)
    masked = mask(rows, KEYS, "IF(series % 4 = 0, -10.0D, NULL)", "2000.0D")
    first = rows.groupBy("series").agg(F.min("x").alias("x"))
    cut_down = rows.where("series % 3 = 2").unionByName(
        rows.join(first.where("series % 3 = 1"), ["series", "x"], "left_semi").select(*rows.columns)
    )
    parts = [
        quality.trim_violations(masked, settings, KEYS).where("code = 'V11'"),
        quality.preprocessed_violations(cut_down, settings, KEYS),
        quality.grid_violations(settings.selectExpr("*", "series % 4 AS n"), KEYS),
    ]
    return quality.union_all(parts).drop("parts")


register(
    "violations_left",
    f"""
    WITH s AS (SELECT series, min(x) AS l FROM ({EH}) GROUP BY series)
    SELECT CAST(series AS VARCHAR) AS key, code, 'error' AS severity, detail FROM (
      SELECT series, 'V11' AS code, 'nothing left by masks: 2' AS detail FROM s WHERE series % 4 = 0
      UNION ALL SELECT series, 'V15', 'rows: 0' FROM s WHERE series % 3 = 0
      UNION ALL SELECT series, 'V29', l || ' >= ' || l FROM s WHERE series % 3 = 1
      UNION ALL SELECT series, 'V31', 'rows: 1' FROM s WHERE series % 3 = 1
      UNION ALL SELECT series, 'V16', 'n = ' || series % 4 FROM s
                WHERE series % 5 <> 0 AND series % 4 < 2)""",
    left_over,
)


def twice_named(spark, d):
    """Each event's type and the digits of its user as header names."""
    lines = table(spark, d, "events").selectExpr(
        "'e' || event_id AS source", "0 AS pos",
        "concat_ws('\\t', event_type, 'u' || user_id % 10, 'u' || user_id DIV 10 % 10, event_type) AS line",
    )
    names = text.columns(lines)
    clashes = names.withColumn("clash", F.lit(None).cast("string"))
    return quality.header_violations(names, clashes).drop("parts")


register(
    "violations_headers",
    """SELECT 'e' || event_id AS key, 'V03' AS code, 'error' AS severity, detail FROM (
         SELECT event_id, '2 x ' || event_type AS detail FROM events
         UNION ALL SELECT event_id, '2 x u' || user_id % 10 FROM events
                   WHERE user_id % 10 = user_id // 10 % 10)""",
    twice_named,
)

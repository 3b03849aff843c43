"""Spectra of windowed, zero-padded series.

Three equal routes to the amplitude of bin k, |sum_i y_i e^(-2 pi i k r_i / N)| / n:

``grouped``  one window per row as arrays, transformed by numpy in batches.
             A window holds at most N samples, and N is bounded.
``split``    the four-step factorisation N = N1 * N2 (Bailey 1990) for longer
             transforms: two shuffles of sqrt(N)-sized tiles, so no task ever
             holds a whole window.
``bins``     a direct sum per bin, native and combined map-side. Its cost is
             samples times bins, so it suits narrow bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ondula.functions.transforms import FourStep, batch_transform, first_step, second_step
from ondula.functions.slices import sliced_spectra
from ondula.operators.segments import explode_range, segmented, with_stats
from ondula.operators.sweep import sweep_indices, sweep_series
from ondula.session import sql_value

# Columns that the spectra add, which keys can't be called.
RESERVED = {"k", "r", "y", "dt", "n_data", "frequency", "amplitude", "sweep_index"}
# Longest transform that one task does in one piece (8 MB of doubles).
GROUPED_MAX = 1 << 20


def windowed(swept: DataFrame, keys: list[str], center: bool = True, hann: bool = True) -> DataFrame:
    """Remove the mean and apply the Hann window within each sub-domain.

    Rows (keys, sweep_index, domain, n_data, dt, r, y), r being the 0-based
    position in the sub-domain and dt its first step. Sub-domains of fewer than
    two samples have no step and no rows here; ``sweep_domains`` lists them.
    """
    stats = {"n_data": ("count", "y"), "_first": ("min", "struct(x, i, x_next)")}
    if center:
        stats["_mean"] = ("mean", "y")
    rows = with_stats(swept, [*keys, "sweep_index"], **stats).where("n_data > 1")
    y = "(y - _mean)" if center else "y"
    if hann:
        y = f"""IF(r = 0 OR r = n_data - 1, 0.0D,
                   {y} * pow(sin(r * pi() / (n_data - 1)), 2))"""
    carried = [f"`{c}`" for c in swept.columns if c not in ("i", "x", "y", "x_next")]
    return rows.selectExpr("*", "i - _first.i AS r").selectExpr(
        *carried, "n_data", "_first.x_next - _first.x AS dt", "r", f"{y} AS y"
    )


def band(n_fft: int, lower, upper) -> tuple[str, str]:
    """First bin and end bin (exclusive) of a frequency band, for a step dt;
    a negative cutoff counts as zero."""
    bins = n_fft // 2 + 1
    size = f"{float(n_fft)!r}D"
    start = (
        "0L"
        if lower is None
        else f"greatest(0L, CAST(floor({sql_value(lower)} * dt * {size}) AS bigint))"
    )
    if upper is None:
        return start, f"{bins}L"
    # clamped as a double first, so that any bound fits
    stop = f"CAST(least(ceil(least({sql_value(upper)} * dt * {size}, {bins}.0D)), {bins}) AS bigint)"
    return start, f"greatest(0L, {stop})"


def spectrum(
    prepared: DataFrame,
    keys: list[str],
    n_fft: int,
    lower=None,
    upper=None,
    method: str = "auto",
) -> DataFrame:
    """Amplitudes of the bins in [lower, upper) of every prepared sub-domain.

    A sub-domain longer than the transform is an error (V20), raised when it is
    read. A band that holds no bin of a sub-domain (V17, V19) selects no row.
    """
    _refuse(n_fft, keys)
    if method == "auto":
        method = "grouped" if n_fft <= GROUPED_MAX else "split"
    route = {"grouped": _grouped, "split": _split, "bins": _bins}[method]
    start, stop = band(n_fft, lower, upper)
    rows = (
        prepared.selectExpr(
            "*",
            f"IF(n_data > {n_fft}, raise_error(concat('V20: ', n_data, ' samples in a transform of "
            f"{n_fft}')), {start}) AS _start",
            f"{stop} AS _stop",
        )
        .where("_start < _stop")
    )
    window = [c for c in ("domain_left", "domain_right") if c in prepared.columns]
    bins = route(rows, [*keys, "sweep_index"], [*window, "n_data", "dt"], n_fft)
    return _scaled(bins, keys, n_fft, window)


def sweep_spectra(
    series: DataFrame,
    keys: list[str],
    n_fft: int,
    sweep: str = "full",
    steps: int | None = None,
    inverted=False,
    lower=None,
    upper=None,
    center: bool = True,
    hann: bool = True,
    method: str = "auto",
) -> DataFrame:
    """Spectra of the sub-domains of every series, as ``spectrum`` gives them.

    Up to N = 2^20 a series is packed once, as one array, and its sub-domains
    are slices of that: samples aren't copied to every window that holds them.
    Longer transforms and segmented series take the steps one by one.
    """
    if method not in ("auto", "packed") or segmented(series) or n_fft > GROUPED_MAX:
        swept = sweep_series(series, keys, sweep, steps, inverted)
        return spectrum(
            windowed(swept, keys, center, hann), keys, n_fft, lower, upper,
            "auto" if method == "packed" else method,
        )
    _refuse(n_fft, keys)
    first, last = sweep_indices(sweep, steps)
    if "x_left" not in series.columns:
        series = with_stats(series, keys, x_left=("min", "x"), x_right=("max", "x"))
    packed = (
        series.selectExpr(
            *[f"`{k}`" for k in keys], "x_left", "x_right", "x", "y",
            f"coalesce({sql_value(inverted, 'boolean')}, false) AS _inverted",
            f"{sql_value(lower)} AS _lower", f"{sql_value(upper)} AS _upper",
        )
        .groupBy(*keys)
        .agg(
            *_firsts(["x_left", "x_right", "_inverted", "_lower", "_upper"]),
            F.expr("collect_list(struct(x, y)) AS _data"),
        )
    )
    schema = T.StructType(
        [
            *[packed.schema[k] for k in keys],
            T.StructField("sweep_index", T.IntegerType()),
            T.StructField("domain_left", T.DoubleType()),
            T.StructField("domain_right", T.DoubleType()),
            T.StructField("n_data", T.LongType()),
            T.StructField("dt", T.DoubleType()),
            T.StructField("_start", T.LongType()),
            T.StructField("_norms", T.ArrayType(T.DoubleType())),
        ]
    )
    done = packed.mapInArrow(
        sliced_spectra(n_fft, sweep, steps, first, last, center, hann, schema.names), schema
    )
    return _scaled(_unpack(done), keys, n_fft, ["domain_left", "domain_right"])


def _refuse(n_fft: int, keys: list[str]) -> None:
    if n_fft < 2 or n_fft & (n_fft - 1):
        raise ValueError("the transform length must be a power of two")
    if RESERVED & set(keys):
        raise ValueError(f"key columns may not be named {sorted(RESERVED & set(keys))}")


def _scaled(bins: DataFrame, keys: list[str], n_fft: int, window: list[str]) -> DataFrame:
    return bins.selectExpr(
        *keys,
        "sweep_index",
        "k",
        f"k * (1.0D / (dt * {float(n_fft)!r}D)) AS frequency",
        "_norm * (1.0D / n_data) AS amplitude",
        *window,
        "n_data",
    )


def _firsts(columns: list[str]) -> list[Column]:
    return [F.expr(f"first({c}) AS {c}") for c in columns]


def _bins(rows: DataFrame, group: list[str], constants: list[str], n_fft: int) -> DataFrame:
    # the phase is reduced in integers, which keeps it exact for large r * k
    angle = f"2 * pi() * ((r * k) % {n_fft}) / {float(n_fft)!r}D AS _angle"
    sums = (
        explode_range(rows, "k", "_start", "_stop")
        .selectExpr("*", angle)
        .groupBy(*group, "k")
        .agg(
            F.expr("sum(y * cos(_angle)) AS _re"),
            F.expr("sum(y * sin(_angle)) AS _im"),
            *_firsts(constants),
        )
    )
    return sums.selectExpr("*", "hypot(_re, _im) AS _norm")


def _grouped(rows: DataFrame, group: list[str], constants: list[str], n_fft: int) -> DataFrame:
    if n_fft > GROUPED_MAX:
        raise ValueError("transforms this long need the split method")
    packed = rows.groupBy(*group).agg(
        *_firsts([*constants, "_start", "_stop"]),
        F.expr("collect_list(struct(CAST(r AS int) AS r, y)) AS _data"),
    )
    schema = T.StructType(
        [f for f in packed.schema.fields if f.name not in ("_data", "_stop")]
        + [T.StructField("_norms", T.ArrayType(T.DoubleType()))]
    )

    transform = batch_transform(n_fft, schema.names)
    return _unpack(packed.mapInArrow(transform, schema))


def _unpack(packed: DataFrame) -> DataFrame:
    kept = [c for c in packed.columns if c not in ("_norms", "_start")]
    return packed.selectExpr(*kept, "_start", "posexplode(_norms) AS (_pos, _norm)").selectExpr(
        "*", "_start + _pos AS k"
    )


def _split(
    rows: DataFrame, group: list[str], constants: list[str], n_fft: int, tile_doubles: int = 1 << 18
) -> DataFrame:
    """Four-step transform. With r = N2 * r1 + r2 and k = k1 + N1 * k2:

    1. per r2: transform over r1 (length N1), twiddle by e^(-2 pi i r2 k1 / N);
    2. per k1: transform over r2 (length N2).

    y is real, so k1 = 0 .. N1/2 suffice; bins above N/2 mirror onto N - k.
    """
    plan = FourStep.of(n_fft, tile_doubles)
    n2, rows_per_tile = plan.n2, plan.rows_per_tile

    key_fields = [f for f in rows.schema.fields if f.name in group]
    shared = [*constants, "_start", "_stop"]
    shared_fields = [f for f in rows.schema.fields if f.name in shared]
    order = [f.name for f in key_fields + shared_fields]

    columns_in = (
        rows.selectExpr("*", f"CAST(r % {n2} AS int) AS _r2", f"CAST(r DIV {n2} AS int) AS _r1")
        .selectExpr("*", f"CAST(_r2 DIV {rows_per_tile} AS int) AS _row_tile")
        .groupBy(*group, "_row_tile")
        .agg(
            *_firsts(shared),
            F.expr(
                f"collect_list(struct(_r2 % {rows_per_tile} AS row, _r1 AS r1, y)) AS _data"
            ),
        )
        .select(*order, "_row_tile", "_data")
    )
    tile_schema = T.StructType(
        [
            *key_fields,
            *shared_fields,
            T.StructField("_row_tile", T.IntegerType()),
            T.StructField("_col_tile", T.IntegerType()),
            T.StructField("_re", T.ArrayType(T.DoubleType())),
            T.StructField("_im", T.ArrayType(T.DoubleType())),
        ]
    )

    columns_out = (
        columns_in.mapInArrow(first_step(plan, order, tile_schema.names), tile_schema)
        .groupBy(*group, "_col_tile")
        .agg(
            *_firsts(shared),
            F.expr("collect_list(struct(_row_tile, _re, _im)) AS _data"),
        )
        .select(*order, "_col_tile", "_data")
    )
    out_schema = T.StructType(
        [
            *key_fields,
            *shared_fields,
            T.StructField("_ks", T.ArrayType(T.LongType())),
            T.StructField("_norms", T.ArrayType(T.DoubleType())),
        ]
    )

    packed = columns_out.mapInArrow(second_step(plan, order, out_schema.names), out_schema)
    return packed.selectExpr(
        *group, *constants, "inline(arrays_zip(_ks, _norms)) AS (k, _norm)"
    )

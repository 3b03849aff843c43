import math
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import collect

import brute
from ondula.functions import slices
from ondula.operators.gridstats import interp_stats, min_dx_length, with_grid_length
from ondula.operators.impulse import impulse_filter, impulse_filter_mixed, median_filter
from ondula.operators.resample import resample
from ondula.operators.segments import (
    SEG,
    by_length,
    lay_out,
    neighbours,
    with_row_index,
    with_stats,
)
from ondula.operators.series import (
    dedup_mean,
    domain_stats,
    finite_only,
    invert_x,
    mask,
    mask_all,
    mask_packed,
    on_monotonic,
    plot_extent,
    scale_x,
    trim,
)

K = ["k"]
# a hot series that holds most rows, and small ones
SIZES = {"hot": 400, "a": 30, "b": 12}
# with this bound the hot series is segmented, and the small ones are not
BOTH = pytest.mark.parametrize("max_rows", [37])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    out = {}
    for k, n in SIZES.items():
        x = np.sort(rng.uniform(1, 100, n))
        y = np.sin(x / 7) + rng.normal(0, 0.1, n)
        y[rng.integers(0, n, n // 10)] += 5
        out[k] = (x, y)
    return out


def shuffled(data):
    out = {}
    for k, (x, y) in data.items():
        order = list(range(len(x)))
        random.Random(1).shuffle(order)
        out[k] = (x[order], y[order])
    return out


def check(df, expected, tolerance=0.0):
    """Rows (k, ..., x, y) equal {k: (x, y)} in the order of x."""
    got = {}
    for r in df.orderBy("k", "x").collect():
        got.setdefault(r["k"], []).append((r["x"], r["y"]))
    assert set(got) == {k for k, (x, _) in expected.items() if len(x)}
    for k, rows in got.items():
        x, y = expected[k]
        assert len(rows) == len(x)
        np.testing.assert_allclose(rows, np.column_stack([x, y]), rtol=1e-9, atol=max(tolerance, 1e-12))


def test_dedup_takes_the_mean_and_joins_signed_zeros(series):
    df = series({"a": ([2, 1, 2, 0.0, -0.0], [1, 5, 3, 2, 4])})
    assert collect(dedup_mean(df, K), "x") == [("a", 0.0, 3.0), ("a", 1.0, 5.0), ("a", 2.0, 2.0)]
    assert math.copysign(1, collect(dedup_mean(df, K), "x")[0][1]) == 1


def test_lay_out_splits_only_long_series(series, data):
    short, long = lay_out(series(shuffled(data)), K, max_rows=37)
    assert {r[0] for r in short.select("k").distinct().collect()} == {"a", "b"}
    sizes = [r["count"] for r in long.groupBy("k", SEG).count().collect()]
    assert sum(sizes) == 400 and len(sizes) > 4
    whole, none = lay_out(series(shuffled(data)), K, max_rows=10**6)
    assert none is None and SEG not in whole.columns


def test_a_task_holds_several_short_segments(spark, series, data):
    _, long = lay_out(series(shuffled(data)), K, max_rows=3)
    assert long.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    held = {}
    for r in long.collect():
        held.setdefault((r["k"], r[SEG]), []).append(r["x"])
    assert max(map(len, held.values())) <= 3
    for k in {k for k, _ in held}:
        ends = sorted((min(x), max(x)) for (own, _), x in held.items() if own == k)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


@BOTH
def test_neighbours_index_and_stats(series, data, max_rows):
    def chain(df):
        df = neighbours(df, K, ["x", "y"], ahead=2)
        df = with_row_index(df, K)
        return with_stats(df, K, lo=("min", "x"), n=("count", "x"), m=("mean", "y"))

    out = by_length(series(shuffled(data)), K, chain, max_rows=max_rows)
    for k, (x, y) in data.items():
        rows = out.where(f"k = '{k}'").orderBy("x").collect()
        assert [r["i"] for r in rows] == list(range(len(x)))
        assert [r["prev_x"] for r in rows] == [None, *x[:-1]]
        assert [r["next_y"] for r in rows] == [*y[1:], None]
        assert [r["next2_x"] for r in rows] == [*x[2:], None, None]
        assert {(r["lo"], r["n"]) for r in rows} == {(x[0], len(x))}
        assert abs(rows[0]["m"] - y.mean()) < 1e-12


def test_neighbours_across_segments_shorter_than_the_reach(spark):
    # segments of one and two rows, out of numeric order
    rows = [("a", s, float(x), 0.0) for s, x in [(7, 1), (3, 2), (3, 3), (9, 4), (1, 5)]]
    df = spark.createDataFrame(rows, f"k string, {SEG} int, x double, y double")
    out = neighbours(df, K, ["x"], ahead=2).orderBy("x").collect()
    assert [r["next2_x"] for r in out] == [3, 4, 5, None, None]
    assert [r["prev_x"] for r in out] == [None, 1, 2, 3, 4]


@BOTH
@pytest.mark.parametrize("left,right", [(20.0, 40.0), (20.5, 20.6), (1.5, 99.0), (40.0, 30.0), (-5.0, 2.0), (98.0, 500.0)])
def test_mask(series, data, max_rows, left, right):
    out = on_monotonic(series(shuffled(data)), K, lambda s: mask(s, K, left, right), max_rows)
    check(out, {k: brute.mask(x, y, left, right) for k, (x, y) in data.items()})


@BOTH
def test_masks_apply_in_order(series, data, max_rows):
    masks = [(20.0, 40.0), (39.0, 60.0), (10.0, 22.0)]
    expected = {}
    for k, (x, y) in data.items():
        for m in masks:
            x, y = brute.mask(x, y, *m)
        expected[k] = (x, y)
    out = on_monotonic(series(shuffled(data)), K, lambda s: mask_all(s, K, masks), max_rows)
    check(out, expected)


def test_mask_without_bounds_keeps_everything(series, data):
    assert mask(series(data), K, None, None).count() == sum(SIZES.values())


@BOTH
@pytest.mark.parametrize("left,right", [(None, None), (20.0, 60.0), (None, 50.0), (20.3, 1000.0)])
def test_trim(series, data, max_rows, left, right):
    out = on_monotonic(series(shuffled(data)), K, lambda s: trim(s, K, left, right), max_rows)
    check(out, {k: brute.trim(x, y, left, right) for k, (x, y) in data.items()})


def test_trim_flips_on_negative_domains(series):
    x = np.arange(-16.0, 0.0)
    out = trim(series({"a": (x, x)}), K, 4.0, 15.0)
    assert [r[1] for r in collect(out, "x")] == list(np.arange(-15.0, -4.0))


def test_default_trim_of_a_series_ending_at_zero_flips_away(series):
    x = np.arange(-5.0, 1.0)
    assert [r[1] for r in collect(trim(series({"a": (x, x)}), K), "x")] == list(np.arange(0, 0))


def test_scaling_and_inversion(series):
    df = series({"a": ([1, 2, 4], [1, 2, 3])})
    assert [r[1] for r in collect(scale_x(scale_x(df, -1), -1), "x")] == [1, 2, 4]
    assert [r[1:] for r in collect(invert_x(df), "x")] == [(0.25, 3), (0.5, 2), (1, 1)]


def test_extents(series):
    df = series({"a": ([1, 2, 4], [5, -1, 3]), "b": ([2, 2], [0, 1])})
    assert collect(plot_extent(df, K), "k") == [("a", 1, 4, -1, 5, True), ("b", 2, 2, 0, 1, False)]
    assert collect(domain_stats(df, K), "k")[0][:5] == ("a", 1, 4, 3, 3)
    bad = series({"a": ([1, math.nan, math.inf], [1, 1, 1])})
    assert finite_only(bad).count() == 1


@BOTH
@pytest.mark.parametrize("width,tuning", [(3, 1.0), (9, 1.0), (6, 0.0), (31, 2.5)])
def test_impulse_filter(series, data, max_rows, width, tuning):
    out = on_monotonic(
        series(shuffled(data)), K, lambda s: impulse_filter(s, K, width, tuning), max_rows
    )
    check(out, {k: (x, brute.impulse(y, width, tuning)) for k, (x, y) in data.items()})


def test_impulse_filter_reaches_the_ends(series):
    y = np.ones(20)
    y[[0, 10, 19]] = 50
    out = impulse_filter(series({"a": (np.arange(20), y)}), K, 5)
    assert {r[2] for r in collect(out, "x")} == {1.0}
    assert impulse_filter(series({"a": (np.arange(20), y)}), K, 0).count() == 20
    with pytest.raises(ValueError):
        median_filter(series({"a": ([1], [1])}), K, 0)


@BOTH
def test_grid_length_uses_the_third_smallest_step(series, max_rows):
    x = [0, 1, 1.0001, 1.0002, 3, 5, 6.5]
    data = {"a": (x, x), "b": ([0, 4, 5], [0, 0, 0]), "c": ([2, 3], [0, 0])}
    out = by_length(series(data), K, lambda s: min_dx_length(s, K), max_rows=2)
    got = {r["k"]: (r["dx"], r["n"]) for r in out.collect()}
    # fewer than three steps: the largest one
    assert got == {"a": (1.0, 7), "b": (4.0, 2), "c": (1.0, 1)}


def test_grid_length_policies(spark):
    lengths = spark.createDataFrame(
        [("v", 10), ("v", 11), ("w", 30)], "variable string, n bigint"
    )
    stats = interp_stats(lengths)
    assert [tuple(r)[-1] for r in stats.orderBy("variable").collect()] == [10, 30]
    wanted = spark.createDataFrame(
        [("v", p) for p in ("min", "minvar", "1000", "2^10", "2^x")],
        "variable string, interpolation_n string",
    )
    got = {r[1]: r[2] for r in with_grid_length(wanted, stats).select("variable", "interpolation_n", "n").collect()}
    assert got == {"min": 30, "minvar": 10, "1000": 1000, "2^10": 1024, "2^x": None}


@BOTH
@pytest.mark.parametrize("derivative", [0, 1, 2])
def test_resample(series, data, max_rows, derivative):
    for algorithm in ("linear", "steffen"):
        out = on_monotonic(
            series(shuffled(data)), K,
            lambda s: resample(s, K, 300, algorithm, derivative, max_rows=max_rows).select("k", "i", "x", "y"),
            max_rows,
        )
        expected = {}
        for k, (x, y) in data.items():
            at = brute.grid(x, 300)
            if algorithm == "steffen":
                value = brute.steffen(x, y, at, derivative)
            else:
                j = np.searchsorted(x, at, side="right") - 1
                value = {0: np.interp(at, x, y), 1: (np.diff(y) / np.diff(x))[j], 2: 0 * at}[derivative]
            expected[k] = (at, value)
        check(out, expected, 1e-6)


def test_steffen_stays_between_its_samples(series, data):
    x, y = data["hot"]
    out = resample(series({"a": (x, y)}), K, 5000, "steffen").collect()
    at = np.array([r["x"] for r in out])
    j = np.searchsorted(x, at, side="right") - 1
    got = np.array([r["y"] for r in out])
    assert (got >= np.minimum(y[j], y[j + 1]) - 1e-9).all()
    assert (got <= np.maximum(y[j], y[j + 1]) + 1e-9).all()


def test_long_grids_explode_in_blocks(series):
    n = 70_000
    out = resample(series({"a": ([0, 1, 10], [0, 1, 10])}), K, n)
    assert out.count() == n and out.select("i").distinct().count() == n
    assert SEG in resample(series({"a": ([0, 1], [0, 1])}), K, n, max_rows=1000).columns


def ragged_series(seed, n, keys=3):
    rng = np.random.default_rng(seed)
    data = {}
    for k in range(keys):
        x = np.sort(rng.choice(np.arange(4 * n), n - k, replace=False)) / 4.0
        data[f"s{k}"] = (x, np.round(np.sin(x) + (rng.random(n - k) < 0.1) * rng.normal(0, 9, n - k), 6))
    return data


@pytest.mark.parametrize("max_rows", [10**6, 37])
def test_impulse_filter_with_a_width_per_series(series, max_rows):
    data = ragged_series(3, 150)
    width = {"s0": 0, "s1": 5, "s2": 12}

    def chain(df):
        mixed = df.selectExpr(
            "*", "CASE k WHEN 's0' THEN NULL WHEN 's1' THEN 5 ELSE 12 END AS width",
            "IF(k = 's1', 0.5D, NULL) AS tuning",
        )
        return impulse_filter_mixed(mixed, ["k"], "width", "tuning")

    got = collect(on_monotonic(series(data), ["k"], chain, max_rows).select("k", "x", "y"), "k", "x")
    want = []
    for k, (x, y) in data.items():
        y = y if not width[k] else brute.impulse(y, width[k], 0.5 if k == "s1" else 1.0)
        want += [(k, *p) for p in zip(x, y)]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    np.testing.assert_allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-12)
    with pytest.raises(ValueError):
        impulse_filter_mixed(series(data).selectExpr("*", "-1 AS w"), ["k"], "w", "1.0D")


def test_wide_and_short_windows(series):
    data = {"a": (range(40), [0.0] * 20 + [7.0] + [0.0] * 19), "b": ([1], [5]), "c": ([1, 2], [5, 9])}
    got = impulse_filter_mixed(series(data).selectExpr("*", "101 AS w"), ["k"], "w", "1.0D")
    rows = {(k, x): y for k, x, y in collect(got, "k", "x")}
    assert rows[("a", 20)] == 0 and rows[("b", 1)] == 5
    want = brute.impulse(np.array([5.0, 9.0]), 101, 1.0)
    assert [rows[("c", 1)], rows[("c", 2)]] == list(want)


def test_packed_masks_equal_steps(series):
    data = ragged_series(6, 80)
    masks = [(3.0, 9.5), (-5.0, 2.0), (30.0, 30.0), (50.0, 5000.0), (0.0, 1.0)]
    column = ", ".join(f"struct({a}D AS left, {b}D AS right)" for a, b in masks)
    df = series(data).selectExpr("*", f"array({column}) AS masks")
    packed = mask_packed(df, ["k"], "masks").cache()
    kept = packed.selectExpr("k", "inline(_kept)")
    assert collect(kept, "k", "x") == collect(mask_all(series(data), ["k"], masks), "k", "x")
    for k, (x, y) in data.items():
        want, at = [], (np.array(x), np.array(y))
        for step, (a, b) in enumerate(masks):
            if len(at[0]) and (a < at[0][0] or b > at[0][-1]):
                want.append((step, a, b, at[0][0], at[0][-1]))
            at = brute.mask(*at, a, b) if len(at[0]) else at
        got = packed.where(f"k = '{k}'").selectExpr("inline(_found)").collect()
        assert [tuple(r) for r in got] == want


def test_marks_of_a_large_batch_come_in_pieces():
    """A task holds the marks of some series at a time, however many a batch has."""
    pair = pa.list_(pa.struct([("at", pa.float64()), ("sweep_index", pa.int32()), ("upper", pa.bool_())]))
    sample = pa.list_(pa.struct([(c, pa.float64()) for c in ("x", "y", "x_next")]))
    n, steps = 3000, 100
    marks = [{"at": float(i % 7), "sweep_index": i, "upper": i % 2 == 1} for i in range(steps)]
    data = [{"x": float(i), "y": 2.0 * i, "x_next": i + 1.0} for i in range(6)]
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(range(n)),
            pa.array([{"n": 5, "sum": 1.0}] * n),
            pa.array([None] * n, pa.struct([("x", pa.float64()), ("x_next", pa.float64())])),
            pa.array([marks] * n, pair),
            pa.array([data] * n, sample),
        ],
        ["k", "_before", "_next", "_marks", "_data"],
    )
    names = ["k", "sweep_index", "upper", "n", "sum", "x", "x_next"]
    out = list(slices.marks_in_segments(names)(iter([batch])))
    assert len(out) > 2 and max(b.num_rows for b in out) <= slices.PIECE
    table = pa.Table.from_batches(out)
    assert table.column("k").to_pylist() == [k for k in range(n) for _ in range(steps)]
    assert table.column("n").to_pylist() == sorted(5 + i % 7 for i in range(steps)) * n

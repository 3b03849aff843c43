import numpy as np
import pytest

import brute
from ondula.operators.resample import resample
from ondula.operators.segments import by_length
from ondula.operators.series import invert_x
from ondula.operators.spectrum import spectrum, sweep_spectra, windowed
from ondula.operators.sweep import sweep_domains, sweep_series, window_counts

K = ["s"]
METHODS = ("grouped", "split", "bins")


def amplitudes(out, index=0):
    rows = out.where(f"sweep_index = {index}").orderBy("k").collect()
    return np.array([r["amplitude"] for r in rows])


@pytest.fixture(scope="module")
def signal():
    x = np.linspace(1, 9, 400, endpoint=False)
    return x, 3 + np.sin(2 * np.pi * 4 * x) + 0.2 * np.sin(2 * np.pi * 11 * x)


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("center,hann", [(True, True), (False, False)])
def test_full_spectrum(series, signal, method, center, hann):
    x, y = signal
    swept = sweep_series(series({"s": (x, y)}, "s"), K)
    out = spectrum(windowed(swept, K, center, hann), K, 1024, method=method)
    # the full range, too, loses its last point
    want = brute.spectrum(y[:-1], 1024, center, hann)
    np.testing.assert_allclose(amplitudes(out), want, atol=1e-12)


@pytest.mark.parametrize("n_fft", [2, 4, 512, 2048])
def test_split_matches_for_even_and_odd_powers(series, n_fft):
    rng = np.random.default_rng(1)
    n = min(n_fft, 300)
    x, y = np.arange(n + 1.0), rng.normal(size=n + 1)
    swept = sweep_series(series({"s": (x, y)}, "s"), K)
    out = spectrum(windowed(swept, K, False, False), K, n_fft, method="split")
    want = brute.spectrum(y[:-1], n_fft, False, False)
    np.testing.assert_allclose(amplitudes(out), want, atol=1e-12)


@pytest.mark.parametrize("method", METHODS)
def test_a_sine_peaks_at_its_frequency_within_a_band(series, signal, method):
    swept = sweep_series(series({"s": signal}, "s"), K)
    out = spectrum(windowed(swept, K), K, 4096, 2.0, 7.0, method=method).collect()
    best = max(out, key=lambda r: r["amplitude"])
    assert abs(best["frequency"] - 4) < 0.05
    assert min(r["frequency"] for r in out) <= 2 and max(r["frequency"] for r in out) < 7


def bounds(sweep, i, steps, x, inverted):
    left, right = x[0], x[-1]
    if sweep == "windows":
        dx = (right - left) / (steps + 1)
        return left + i * dx, left + (i + 2) * dx
    pl, pr = (1 / right, 1 / left) if inverted else (left, right)
    dx = (pr - pl) / steps
    lo, hi = (pr - i * dx, pr) if sweep == "lower" else (pl, pl + i * dx)
    return (1 / hi, 1 / lo) if inverted else (lo, hi)


@pytest.mark.parametrize("max_rows", [60])
@pytest.mark.parametrize("inverted", [False, True])
@pytest.mark.parametrize("sweep", ["lower", "upper", "windows"])
def test_sweeps(series, signal, sweep, inverted, max_rows):
    x, y = signal
    if inverted:
        x, y = 1 / x[::-1], y[::-1]
    steps = 3

    def chain(s):
        s = invert_x(s) if inverted else s
        swept = sweep_series(s, K, sweep, steps, inverted)
        return spectrum(windowed(swept, K), K, 512)

    out = by_length(series({"s": signal}, "s"), K, chain, max_rows=max_rows).cache()
    first = 0 if sweep == "windows" else 1
    for i in range(first, first + steps):
        lo, hi = bounds(sweep, i, steps, x, inverted)
        a, b = brute.index_of(x, lo), brute.index_of(x, hi)
        np.testing.assert_allclose(amplitudes(out, i), brute.spectrum(y[a:b], 512), atol=1e-12)
    assert out.select("sweep_index").distinct().count() == steps


def test_resampled_rows_carry_what_the_sweep_needs(series, signal):
    grid = resample(series({"s": signal}, "s"), K, 256)
    out = spectrum(windowed(sweep_series(grid, K, "windows", 4), K), K, 256)
    again = spectrum(windowed(sweep_series(grid.select("s", "x", "y"), K, "windows", 4), K), K, 256)
    for i in range(4):
        np.testing.assert_allclose(amplitudes(out, i), amplitudes(again, i), atol=1e-12)


def test_refused_settings(series, signal):
    df = series({"s": signal}, "s")
    with pytest.raises(ValueError):
        spectrum(windowed(sweep_series(df, K), K), K, 1000)
    with pytest.raises(ValueError):
        sweep_series(df, K, "upper", None)
    with pytest.raises(ValueError):
        spectrum(df, ["k"], 128)
    # data longer than the transform is never left out silently
    with pytest.raises(Exception, match="V20"):
        spectrum(windowed(sweep_series(df, K), K), K, 128).collect()


def uneven(seed, n, shift=1.0):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.choice([0.25, 0.5, 3.0], n)) + shift
    return x, rng.normal(size=n)


@pytest.mark.parametrize("sweep,steps", [("full", None), ("lower", 4), ("upper", 7), ("windows", 5)])
@pytest.mark.parametrize("inverted", [False, True])
def test_slices_equal_copies(series, sweep, steps, inverted):
    data = {"a": uneven(1, 90), "b": uneven(2, 61, 0.5), "c": ([1.0, 2.0], [3.0, 4.0]), "d": ([1.0], [1.0])}
    df = series(data, "s")
    if inverted:
        df = invert_x(df)
    args = sweep, steps, inverted
    got = sweep_spectra(df, K, 128, *args, lower=0.1).orderBy("s", "sweep_index", "k").collect()
    want = spectrum(windowed(sweep_series(df, K, *args), K), K, 128, lower=0.1)
    want = want.orderBy("s", "sweep_index", "k").collect()
    assert [r[:3] for r in got] == [r[:3] for r in want] and got
    np.testing.assert_allclose([r[3:] for r in got], [r[3:] for r in want], rtol=1e-9, atol=1e-12)
    plan = sweep_spectra(df, K, 128, *args)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # of the bins, none of the samples


def test_too_short_transforms_raise(series):
    with pytest.raises(Exception, match="V20"):
        sweep_spectra(series({"s": uneven(1, 90)}, "s"), K, 64).collect()
    with pytest.raises(ValueError):
        sweep_spectra(series({"s": uneven(1, 90)}, "s"), K, 100)


@pytest.mark.parametrize("sweep,steps", [("full", None), ("lower", 3), ("upper", 4), ("windows", 30)])
@pytest.mark.parametrize("max_rows", [10**6, 11])
def test_windows_by_prefix_sums(series, sweep, steps, max_rows):
    data = {"a": uneven(3, 100), "b": uneven(4, 57), "c": ([1.0, 2.0], [3.0, 4.0])}
    out = by_length(
        series(data, "s"), K, lambda df: sweep_domains(df, K, sweep, steps), max_rows=max_rows
    )
    rows = out.collect()
    assert len(rows) == 3 * (steps or 1)
    for r in rows:
        x, y = map(np.asarray, data[r["s"]])
        inside = (x >= r["domain_left"]) & (x < min(r["domain_right"], x[-1]))
        assert r["n_data"] == inside.sum()
        if inside.sum() > 1:
            a = int(np.argmax(inside))
            np.testing.assert_allclose([r["y_mean"], r["dt"]], [y[inside].mean(), x[a + 1] - x[a]])
        else:
            assert r["dt"] is None


@pytest.mark.parametrize(
    "sweep,steps,inverted",
    [("full", None, False), ("lower", 3, False), ("upper", 4, True), ("upper", 3, False), ("windows", 9, False)],
)
@pytest.mark.parametrize("max_rows", [10**6, 11])
def test_windows_are_counted_without_packing(series, sweep, steps, inverted, max_rows):
    data = {"a": uneven(3, 100), "b": uneven(4, 57, 0.5), "c": ([1.0, 2.0], [3.0, 4.0]), "d": ([1.0], [1.0])}
    df = series(data, "s")
    if inverted:
        df = invert_x(df)
    args = K, sweep, steps, inverted
    counted = by_length(df, K, lambda part: window_counts(part, *args), max_rows=max_rows)
    want = by_length(df, K, lambda part: sweep_domains(part, *args).drop("y_mean"), max_rows=max_rows)
    got = sorted(counted.collect(), key=lambda r: r[:2])
    assert got == sorted(want.collect(), key=lambda r: r[:2]) and len(got) == 4 * (steps or 1)
    assert "MapInArrow" not in counted._jdf.queryExecution().executedPlan().toString()

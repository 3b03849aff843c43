"""Numpy parts of the operators that hold a series as one array per row.

As in ``transforms``, the functions travel to the executors by value.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from ondula.functions.transforms import BATCH_DOUBLES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Batches = Iterator[pa.RecordBatch]
PIECE = BATCH_DOUBLES // 32  # list items that a task turns into arrays at a time

# Consistency factor of Sn, and its small-sample factors.
SN_FACTOR = 1.1926
SN_SMALL = {2: 0.743, 3: 1.851, 4: 0.954, 5: 1.351, 6: 0.993, 7: 1.198, 8: 1.005, 9: 1.131}


def arrays(batch: pa.RecordBatch, name: str, fields: list[str]) -> Iterator[list[np.ndarray]]:
    """The fields of a list of structs, row by row, in the order of the first."""
    column = batch.column(batch.schema.get_field_index(name))
    flat = column.flatten()
    values = [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    for start, stop in zip([0, *ends[:-1].tolist()], ends.tolist()):
        order = np.argsort(values[0][start:stop], kind="stable")
        yield [v[start:stop][order] for v in values]


def pieces(batch: pa.RecordBatch, columns: list[str], most: int = PIECE) -> Batches:
    """Cut a batch so that each piece holds about ``most`` items of the lists
    in ``columns`` (one row at least)."""
    if not batch.num_rows:
        return
    sizes = sum(
        batch.column(batch.schema.get_field_index(c)).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for c in columns
    )
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for start, stop in zip(edges, edges[1:]):
        yield batch.slice(start, stop - start)


# -- sub-domains --------------------------------------------------------------


def window_bounds(
    sweep: str, steps: int | None, first: int, last: int, left: float, right: float, inverted: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and bounds of all windows, by the arithmetic of ``sweep_bounds``."""
    i = np.arange(first, last + 1)
    if sweep == "full":
        return i, np.full(len(i), left), np.full(len(i), right)
    if sweep == "windows":
        dx = (right - left) / (steps + 1)
        return i, left + i * dx, left + (i + 2) * dx
    with np.errstate(divide="ignore", invalid="ignore"):
        one = np.float64(1.0)
        plain_left = one / right if inverted and right else np.nan if inverted else left
        plain_right = one / left if inverted and left else np.nan if inverted else right
        dx = (plain_right - plain_left) / steps
        if sweep == "lower":
            lo, hi = plain_right - i * dx, np.full(len(i), plain_right)
        else:
            lo, hi = np.full(len(i), plain_left), plain_left + i * dx
        if inverted:
            lo, hi = np.where(hi != 0, one / hi, np.nan), np.where(lo != 0, one / lo, np.nan)
    return i, lo, hi


def band_of(dt: float, n_fft: int, lower: float | None, upper: float | None) -> tuple[int, int]:
    """First bin and end bin, by the arithmetic of ``spectrum.band``."""
    bins = n_fft // 2 + 1
    start = 0 if lower is None else max(0, int(np.floor(lower * dt * float(n_fft))))
    stop = bins if upper is None else max(0, int(min(np.ceil(min(upper * dt * float(n_fft), bins)), bins)))
    return start, stop


def sliced_spectra(
    n_fft: int, sweep: str, steps: int | None, first: int, last: int, center: bool, hann: bool,
    names: list[str],
) -> Callable[[Batches], Batches]:
    """Amplitudes of all windows of each series; windows are slices of its
    array. Columns in: keys, x_left, x_right, _inverted, _lower, _upper, _data."""
    per_step = max(1, BATCH_DOUBLES // n_fft)
    n_keys = names.index("sweep_index")

    def prepare(y: np.ndarray) -> np.ndarray:
        n = len(y)
        if center:
            y = y - y.mean()
        if hann:
            y = y * np.sin(np.arange(n) * np.pi / (n - 1)) ** 2
            y[0] = y[-1] = 0.0
        return y

    def flush(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        padded = np.zeros((len(held), n_fft))
        for at, h in enumerate(held):
            padded[at, : len(h[6])] = h[6]
        norms = np.abs(np.fft.rfft(padded, axis=1))
        kept = [norms[at, h[7] : h[8]] for at, h in enumerate(held)]
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
        rows = pa.array([h[0] for h in held], pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                *[batch.column(i).take(rows) for i in range(n_keys)],
                pa.array([h[1] for h in held], pa.int32()),
                pa.array([h[2] for h in held], pa.float64()),
                pa.array([h[3] for h in held], pa.float64()),
                pa.array([h[4] for h in held], pa.int64()),
                pa.array([h[5] for h in held], pa.float64()),
                pa.array([h[7] for h in held], pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(kept))),
            ],
            names=names,
        )

    def transform(batches: Batches) -> Batches:
        for batch in batches:
            fixed = [
                batch.column(batch.schema.get_field_index(c)).to_pylist()
                for c in ("x_left", "x_right", "_inverted", "_lower", "_upper")
            ]
            held: list[tuple] = []
            series = arrays(batch, "_data", ["x", "y"])
            for row, ((x, y), left, right, inv, lower, upper) in enumerate(zip(series, *fixed)):
                number, lo, hi = window_bounds(sweep, steps, first, last, left, right, inv)
                starts = np.searchsorted(x, lo)
                stops = np.searchsorted(x, np.fmin(hi, right))
                for i, a, b, l, h in zip(
                    number.tolist(), starts.tolist(), stops.tolist(), lo.tolist(), hi.tolist()
                ):
                    if b - a < 2 or l != l:
                        continue
                    if b - a > n_fft:
                        raise ValueError(f"V20: {b - a} samples in a transform of {n_fft}")
                    dt = x[a + 1] - x[a]
                    start, stop = band_of(dt, n_fft, lower, upper)
                    if start < stop:
                        held.append((row, i, l, h, b - a, dt, prepare(y[a:b]), start, stop))
                    if len(held) == per_step:
                        yield flush(batch, held)
                        held = []
            if held:
                yield flush(batch, held)

    return transform


def marks_in_segments(names: list[str]) -> Callable[[Batches], Batches]:
    """For every mark (a bound of a window) in a segment: how many samples of
    the series lie before it and their sum, from the segment's prefix sums and
    what lies before the segment, and the sample at or behind it.

    Columns in: keys, _before (struct n, sum), _next (struct x, x_next: the
    first sample of the next segment), _marks, _data."""
    n_keys = names.index("sweep_index")

    def transform(batches: Batches) -> Batches:
        for batch in (p for b in batches for p in pieces(b, ["_marks", "_data"])):
            before = batch.column(n_keys).to_pylist()
            after = batch.column(n_keys + 1).to_pylist()
            out: list[list] = [[] for _ in range(7)]
            marks = arrays(batch, "_marks", ["at", "sweep_index", "upper"])
            data = arrays(batch, "_data", ["x", "y", "x_next"])
            for row, ((at, number, upper), (x, y, x_next)) in enumerate(zip(marks, data)):
                place = np.searchsorted(x, at)
                sums = np.concatenate([[0.0], np.cumsum(y)])[place] + before[row]["sum"]
                xs = np.append(x, np.nan if after[row] is None else after[row]["x"])
                ends = np.append(x_next, np.nan if after[row] is None else after[row]["x_next"])
                for c, values in enumerate(
                    [np.full(len(at), row), number, upper, place + before[row]["n"], sums, xs[place], ends[place]]
                ):
                    out[c].append(values)
            rows, number, upper, n, sums, xs, ends = [
                np.concatenate(c) if c else np.zeros(0) for c in out
            ]
            which = pa.array(rows.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i).take(which) for i in range(n_keys)],
                    pa.array(number.astype(np.int32)),
                    pa.array(upper.astype(bool)),
                    pa.array(n.astype(np.int64)),
                    pa.array(sums.astype(np.float64)),
                    pa.array(xs.astype(np.float64), from_pandas=True),
                    pa.array(ends.astype(np.float64), from_pandas=True),
                ],
                names=names,
            )

    return transform


def masked(names: list[str]) -> Callable[[Batches], Batches]:
    """Apply all masks of each packed series, in order, each to what the ones
    before it left. Columns in: keys, _masks, _data (x, y); out: keys, _kept,
    _found (the masks that reach beyond what they met: step, left, right, and
    the ends of that)."""
    n_keys = len(names) - 2
    found_type = pa.list_(
        pa.struct([("step", pa.int32()), *[(c, pa.float64()) for c in ("left", "right", "x_left", "x_right")]])
    )

    def transform(batches: Batches) -> Batches:
        for batch in batches:
            masks = batch.column(n_keys).to_pylist()
            xs, ys, lens, found = [], [], [], []
            for own, (x, y) in zip(masks, arrays(batch, "_data", ["x", "y"])):
                beyond = []
                for step, one in enumerate(own or []):
                    if one is None or one["left"] is None or one["right"] is None or not len(x):
                        continue
                    left, right = one["left"], one["right"]
                    if left < x[0] or right > x[-1]:
                        beyond.append(
                            {"step": step, "left": left, "right": right, "x_left": x[0], "x_right": x[-1]}
                        )
                    # from the first sample at or beyond left (the last one if
                    # there is none) to the first at or beyond right
                    gone = x >= left
                    gone[-1] = True
                    gone[1:] &= x[:-1] < right
                    x, y = x[~gone], y[~gone]
                xs.append(x)
                ys.append(y)
                lens.append(len(x))
                found.append(beyond)
            offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            pairs = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(c) if c else np.zeros(0)) for c in (xs, ys)], names=["x", "y"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(n_keys)],
                    pa.ListArray.from_arrays(offsets, pairs),
                    pa.array(found, found_type),
                ],
                names=names,
            )

    return transform


# -- order statistics in a moving window -------------------------------------


def median_and_sn(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and Sn of sorted windows (one per row, all of one size).

    The high median of the distances from a value to all others ends a run of
    h neighbours that holds the value: the larger of the distances to the
    run's ends. One grows and the other shrinks with the place of the run, so
    the least of these maxima is found by bisection: K log K for a window.
    """
    rows, n = w.shape
    median = (w[:, (n - 1) // 2] + w[:, n // 2]) / 2
    h = n // 2 + 1
    i = np.arange(n)
    lo = np.broadcast_to(np.maximum(0, i - h + 1), w.shape).copy()
    hi = np.broadcast_to(np.minimum(i, n - h), w.shape).copy()
    least, most = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            break
        middle = (lo + hi) // 2
        left = w - np.take_along_axis(w, middle, axis=1)
        right = np.take_along_axis(w, middle + h - 1, axis=1) - w
        enough = right >= left
        hi = np.where(open_ & enough, middle, hi)
        lo = np.where(open_ & ~enough, middle + 1, lo)

    def reach(a: np.ndarray) -> np.ndarray:
        return np.maximum(
            w - np.take_along_axis(w, a, axis=1), np.take_along_axis(w, a + h - 1, axis=1) - w
        )

    high = np.minimum(reach(np.minimum(lo, most)), reach(np.maximum(lo - 1, least)))
    factor = SN_SMALL.get(n, n / (n - 0.9) if n > 9 and n % 2 else 1.0)
    return median, SN_FACTOR * factor * np.sort(high, axis=1)[:, (n - 1) // 2]


def filtered(y: np.ndarray, width: int, tuning: float, skip: int, stop: int) -> np.ndarray:
    """The samples ``skip`` to ``stop`` of y behind the impulse filter; those
    around them only fill the windows, which are cut off at the ends of y."""
    half = width // 2
    out = y[skip:stop].copy()
    if width == 0 or len(out) == 0:
        return out
    chunk = max(1, (BATCH_DOUBLES // 8) // (2 * half + 1))

    def judge(places: np.ndarray, windows: np.ndarray) -> None:
        median, sn = median_and_sn(np.sort(windows, axis=1))
        value = y[places]
        off = (value != median) & (np.abs(value - median) > tuning * sn)
        out[places[off] - skip] = median[off]

    whole_from, whole_to = max(skip, half), min(stop, len(y) - half)
    if whole_from < whole_to:
        view = np.lib.stride_tricks.sliding_window_view(y, 2 * half + 1)
        for a in range(whole_from, whole_to, chunk):
            b = min(a + chunk, whole_to)
            judge(np.arange(a, b), view[a - half : b - half])
    for place in range(skip, stop):
        if place < whole_from or place >= max(whole_to, whole_from):
            window = y[max(0, place - half) : place + half + 1]
            judge(np.array([place]), window[None, :])
    return out


def mixed_filter(names: list[str]) -> Callable[[Batches], Batches]:
    """The impulse filter over packed series or segments, each with its own
    width and tuning. Columns in: keys, _width, _tuning, _ahead, _behind (what
    lies before and after a segment), _data (x, y)."""
    n_keys = len(names) - 1

    def transform(batches: Batches) -> Batches:
        for batch in batches:
            width = batch.column(n_keys).to_pylist()
            tuning = batch.column(n_keys + 1).to_pylist()
            ahead = arrays(batch, "_ahead", ["x", "y"])
            behind = arrays(batch, "_behind", ["x", "y"])
            data = arrays(batch, "_data", ["x", "y"])
            xs, ys, lens = [], [], []
            for k, t, (_, before), (_, after), (x, y) in zip(width, tuning, ahead, behind, data):
                k = k or 0
                half = k // 2
                before, after = before[max(0, len(before) - half) :], after[:half]
                around = np.concatenate([before, y, after])
                xs.append(x)
                ys.append(filtered(around, k, t, len(before), len(before) + len(y)))
                lens.append(len(x))
            offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            pairs = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(xs) if xs else np.zeros(0)),
                 pa.array(np.concatenate(ys) if ys else np.zeros(0))], names=["x", "y"]
            )
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(n_keys)], pa.ListArray.from_arrays(offsets, pairs)],
                names=names,
            )

    return transform

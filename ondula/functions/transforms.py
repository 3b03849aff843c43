"""The numpy parts of the spectra, run inside Arrow tasks.

The functions travel to the executors by value, so the package need not be
installed there.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Batches = Iterator[pa.RecordBatch]

# Doubles that one numpy batch may hold.
BATCH_DOUBLES = 1 << 22


def batch_transform(n_fft: int, names: list[str]) -> Callable[[Batches], Batches]:
    """Zero-pad the windows of a batch into one matrix and transform it."""
    per_step = max(1, BATCH_DOUBLES // n_fft)

    def one_step(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = batch.column("_data")
        samples = data.flatten()
        owner = np.repeat(np.arange(batch.num_rows), data.value_lengths().to_numpy())
        padded = np.zeros((batch.num_rows, n_fft))
        padded[owner, samples.field("r").to_numpy()] = samples.field("y").to_numpy()
        norms = np.abs(np.fft.rfft(padded, axis=1))
        start = batch.column("_start").to_numpy()
        stop = batch.column("_stop").to_numpy()
        bins = np.arange(norms.shape[1])
        kept = norms[(bins >= start[:, None]) & (bins < stop[:, None])]
        offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
        columns = [batch.column(n) for n in names[:-1]]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.ListArray.from_arrays(offsets, pa.array(kept))], names=names
        )

    def transform(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, per_step):
                yield one_step(batch.slice(at, per_step))

    return transform


@dataclass(frozen=True)
class FourStep:
    """Sizes of a four-step transform: N = n1 * n2, cut into tiles."""

    n: int
    n1: int
    n2: int
    half: int
    rows_per_tile: int
    cols_per_tile: int

    @staticmethod
    def of(n: int, tile_doubles: int) -> FourStep:
        n2 = 1 << ((n.bit_length() - 1) // 2)
        n1 = n // n2
        half = n1 // 2 + 1
        rows = max(1, min(n2, tile_doubles // n1))
        return FourStep(n, n1, n2, half, rows, max(1, min(half, tile_doubles // n2)))


def first_step(plan: FourStep, order: list[str], names: list[str]) -> Callable[[Batches], Batches]:
    """Per tile of r2 values: transform over r1, twiddle, cut into column tiles."""
    float_list = pa.list_(pa.float64())

    def transform(batches: Batches) -> Batches:
        k1 = np.arange(plan.half)
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                samples = one.column("_data").flatten()
                padded = np.zeros((plan.rows_per_tile, plan.n1))
                row, r1 = samples.field("row").to_numpy(), samples.field("r1").to_numpy()
                padded[row, r1] = samples.field("y").to_numpy()
                top = one.column("_row_tile")[0].as_py() * plan.rows_per_tile
                r2 = top + np.arange(plan.rows_per_tile)
                turn = np.exp(-2j * np.pi * (np.outer(r2, k1) % plan.n) / plan.n)
                partial = np.fft.rfft(padded, axis=1) * turn
                width = plan.cols_per_tile
                tiles = [partial[:, c : c + width].ravel() for c in range(0, plan.half, width)]
                repeat = pa.array(np.zeros(len(tiles), dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[one.column(n).take(repeat) for n in order],
                        one.column("_row_tile").take(repeat),
                        pa.array(np.arange(len(tiles), dtype=np.int32)),
                        pa.array([t.real for t in tiles], float_list),
                        pa.array([t.imag for t in tiles], float_list),
                    ],
                    names=names,
                )

    return transform


def second_step(plan: FourStep, order: list[str], names: list[str]) -> Callable[[Batches], Batches]:
    """Per tile of k1 values: transform over r2, keep the bins of the band."""

    def transform(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                first = one.column("_col_tile")[0].as_py() * plan.cols_per_tile
                k1 = np.arange(first, min(first + plan.cols_per_tile, plan.half))
                tiles = one.column("_data").flatten()
                values = np.zeros((plan.n2, len(k1)), dtype=complex)
                re, im = tiles.field("_re"), tiles.field("_im")
                for j, row_tile in enumerate(tiles.field("_row_tile").to_numpy()):
                    tile = re[j].values.to_numpy() + 1j * im[j].values.to_numpy()
                    top = row_tile * plan.rows_per_tile
                    values[top : top + plan.rows_per_tile] = tile.reshape(plan.rows_per_tile, -1)
                norms = np.abs(np.fft.fft(values, axis=0)).ravel()
                k = (k1[None, :] + plan.n1 * np.arange(plan.n2)[:, None]).ravel()
                # bins above N/2 are mirror images; in the two border columns
                # their originals are present as well
                inner = np.tile((k1 > 0) & (2 * k1 < plan.n1), plan.n2)
                above = 2 * k > plan.n
                k = np.where(above, plan.n - k, k)
                start, stop = one.column("_start")[0].as_py(), one.column("_stop")[0].as_py()
                kept = (inner | ~above) & (k >= start) & (k < stop)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[one.column(n) for n in order],
                        pa.array([k[kept]], pa.list_(pa.int64())),
                        pa.array([norms[kept]], pa.list_(pa.float64())),
                    ],
                    names=names,
                )

    return transform

"""Helpers shared by the text operators: folders, stored cuts, text arrays."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ondula.session import BATCH_BYTES, bounded_batches, ensure_checkpoint_dir  # noqa: F401

# White space of the word pattern [^\x20\x09-\x0D]+.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Bytes of text that a Python task holds as arrays at a time; a longer single
# text is still handled whole.
SLICE_BYTES = (2 << 20) - (1 << 16)



def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+")
    return F.filter(parts, lambda w: w != "")


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about ``max_bytes`` of
    ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.binary_length(values).fill_null(0), dtype=np.int64)
        group = np.cumsum(sizes) // max_bytes
        cuts = np.flatnonzero(np.diff(group)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for start, stop in zip(edges, edges[1:]):
            yield batch.slice(start, stop - start)


def released(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a task gives free memory back to the system. Python
    workers serve one stage after another, and allocators keep what was the
    most that any of them held."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return task


def ragged_take(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenate flat[starts[i] : starts[i] + lens[i]] over all i."""
    total = int(lens.sum())
    if not total:
        return flat[:0]
    before = np.cumsum(lens) - lens
    return flat[np.repeat(starts - before, lens) + np.arange(total)]


class Numbered(dict):
    """Numbers keys in the order they are first asked for; ``fresh`` gathers
    (lead, key) of new ones. Tables that share ``fresh`` share the numbers."""

    def __init__(self, lead: str, fresh: list[tuple[str, str]], base: list[int]):
        super().__init__()
        self.lead, self.fresh, self.base = lead, fresh, base

    def __missing__(self, key: str) -> int:
        self.fresh.append((self.lead, key))
        n = self[key] = self.base[0]
        self.base[0] = n + 1
        return n


class Ragged:
    """A growing list of id arrays, end to end."""

    def __init__(self) -> None:
        self.flat = np.zeros(0, dtype=np.uint32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lens = np.zeros(0, dtype=np.int64)

    def add(self, flat: np.ndarray, lens: np.ndarray) -> None:
        starts = len(self.flat) + np.cumsum(lens) - lens
        self.flat = np.concatenate([self.flat, flat])
        self.starts = np.concatenate([self.starts, starts])
        self.lens = np.concatenate([self.lens, lens])

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.lens[index]
        return ragged_take(self.flat, self.starts[index], lens), lens


def is_latin(text: str) -> bool:
    """No character above U+00FF."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True

"""Shuffles of packed arrays: a row per task and bucket instead of per hash.

A task cuts its hashes into buckets by value and writes for each bucket one
row whose columns are compressed arrays; a later task reads a bucket whole.
The number of buckets grows with the input, so a bucket stays small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.session import parallelism

BUCKET_BYTES = 6 << 20  # bytes of text whose hashes one bucket holds
NO_ID = -(1 << 63)  # stands for a null id, which comes before all others


def bucket_count(docs: DataFrame) -> int:
    """Buckets for the hashes of all texts of ``docs``."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(max(16, total // BUCKET_BYTES))


def repeated(rows: DataFrame) -> bool:
    """Whether an id occurs in more than one row; NO_ID counts as null."""
    ids = rows.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"))
    return bool(ids.count().where("count > 1").limit(1).count())


def identified(docs: DataFrame) -> DataFrame:
    """``_id`` (null ids first) and ``_tag``, which tells rows of one id apart:
    0 if no id repeats, else a hash of the text. Keeps ``text`` and doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tag = F.xxhash64("text") if repeated(rows) else F.lit(0).cast("long")
    return rows.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), tag.alias("_tag"), "text", "doc_id"
    )


def squeeze(values: np.ndarray) -> bytes:
    """Differences of neighbours, bytes of equal weight together, compressed."""
    step = values.copy()
    step[1:] -= values[:-1]
    planes = step.view(np.uint8).reshape(-1, step.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    step = np.ascontiguousarray(raw.reshape(size, -1).T).view(kind)[:, 0]
    return np.cumsum(step, dtype=kind)


def pack(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row (bucket, c0, c1, ...) for each bucket; the first column holds
    hashes and is left as it is, the others are squeezed in given order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1])
    stops = [*starts[1:].tolist(), len(ordered)]
    arrays = [pa.array(ordered[starts].astype(np.int32))]
    for n, c in enumerate(columns):
        c = np.ascontiguousarray(c[order])
        put = squeeze if n else bytes
        arrays.append(
            pa.array([put(c[a:b]) for a, b in zip(starts.tolist(), stops)], pa.binary())
        )
    yield pa.RecordBatch.from_arrays(arrays, ["bucket"] + [f"c{n}" for n in range(len(columns))])


def pack_together(
    pieces: Iterator[tuple[np.ndarray, list[np.ndarray]]], rows: int
) -> Iterator[pa.RecordBatch]:
    """``pack`` over (bucket, columns) of several slices, until they hold
    ``rows`` hashes: slices may be small without more rows being written."""
    held, n = [], 0

    def done() -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*(columns for _, columns in held))]
        yield from pack(np.concatenate([bucket for bucket, _ in held]), columns)

    for bucket, columns in pieces:
        held.append((bucket, columns))
        n += len(bucket)
        if n >= rows:
            yield from done()
            held, n = [], 0
    if held:
        yield from done()


def schema(n: int) -> str:
    return "bucket int, " + ", ".join(f"c{i} binary" for i in range(n))


def unpack(
    batches: Iterator[pa.RecordBatch], kinds: list[str]
) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of one bucket after another, from rows sorted by bucket."""
    now, parts = None, [[] for _ in kinds]
    for batch in batches:
        for i in range(batch.num_rows):
            b = batch.column(0)[i].as_py()
            if b != now:
                if now is not None:
                    yield now, [np.concatenate(p) for p in parts]
                now, parts = b, [[] for _ in kinds]
            for n, kind in enumerate(kinds):
                cell = batch.column(n + 1)[i].as_py()
                parts[n].append(unsqueeze(cell, kind) if n else np.frombuffer(cell, dtype=kind))
    if now is not None:
        yield now, [np.concatenate(p) for p in parts]


def by_bucket(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Bring the rows of a bucket together, buckets one after another."""
    tasks = max(parallelism(rows.sparkSession), n_buckets // 2)
    return rows.repartition(tasks, "bucket").sortWithinPartitions("bucket")


def joined(rows: DataFrame, found: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """Left join on (_id, _tag) with at most one packed row (_id, _tag, _at):
    broadcast while both counts show it is small, else by shuffle."""
    n, size = found.agg(F.count("*"), F.sum(F.octet_length("_at"))).first()
    side = F.broadcast(found) if n <= max_rows and (size or 0) <= max_bytes else found
    return rows.join(side, ["_id", "_tag"], "left")


def gathered(places: DataFrame, n_buckets: int) -> DataFrame:
    """From packed (bucket of the id; c0 ids, c1 tags, c2 positions) to a row
    for each document: _id, _tag, _at (sorted distinct positions, squeezed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, tags, at) in unpack(batches, ["<i8", "<i8", "<u4"]):
            order = np.lexsort((at, tags, ids))
            ids, tags, at = ids[order], tags[order], at[order]
            new = np.ones(len(ids), dtype=bool)
            new[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])
            keep = new.copy()
            keep[1:] |= at[1:] != at[:-1]
            ids, tags, at, new = ids[keep], tags[keep], at[keep], new[keep]
            starts = np.flatnonzero(new)
            stops = [*starts[1:].tolist(), len(ids)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[starts]),
                    pa.array(tags[starts]),
                    pa.array(
                        [squeeze(at[a:b].copy()) for a, b in zip(starts.tolist(), stops)],
                        pa.binary(),
                    ),
                ],
                ["_id", "_tag", "_at"],
            )

    return by_bucket(places, n_buckets).mapInArrow(run, "_id long, _tag long, _at binary")

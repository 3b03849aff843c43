"""Balanced contiguous shards from global prefix sums of byte sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import stored

ROW_BYTES = 16


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a sorted partition: bytes and rows before each row."""
    part = TaskContext.get().partitionId()
    rows = size = 0
    for batch in batches:
        sizes = np.asarray(batch.column(1), dtype=np.int64)
        ends = size + np.cumsum(sizes)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns,
                pa.array(np.full(n, part, dtype=np.int32)),
                pa.array(ends - sizes),
                pa.array(rows + np.arange(n, dtype=np.int64)),
            ],
            ["doc_id", "size", "text_crc32", "_part", "_bytes", "_rows"],
        )
        rows += n
        size = int(ends[-1]) if n else size


def shard_by_bytes(docs: DataFrame, n_shards: int) -> DataFrame:
    """Cut ``docs`` (doc_id, text) into contiguous shards of equal bytes.

    Rows are ordered by (doc_id, text crc, size), null ids first. A row of
    UTF-8 length b weighs b + 16 (a null text: 16). Shard k takes the rows
    whose middle byte lies in the k-th of ``n_shards`` equal parts of all
    bytes, so a shard differs from the target by at most one row at each end;
    a row longer than a target leaves the shards that it covers empty.
    Repeated rows are rows of their own; other columns are left out. Only
    sizes are shuffled: partition totals give every partition its base.

    Returns doc_id, size, text_crc32, shard, slot.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    running = stored(
        sizes.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(
            _running,
            "doc_id long, size long, text_crc32 long, _part int, _bytes long, _rows long",
        ),
        "shard-sizes",
    )
    # one row per partition: their number is set by the cluster, not the data
    totals = (
        running.groupBy("_part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .orderBy("_part")
        .collect()
    )
    total = sum(t["bytes"] for t in totals) or 1
    bases, n_bytes, n_rows = [], 0, 0
    for t in totals:
        bases.append((t["_part"], n_bytes, n_rows))
        n_bytes += t["bytes"]
        n_rows += t["rows"]
    base = docs.sparkSession.createDataFrame(bases, "_part int, _base long, _base_rows long")
    # integers: 2 * bytes * shards stays below 2^63 up to 10^17 bytes in 40 shards
    middle = f"2 * (_base + _bytes) + size"
    placed = running.join(F.broadcast(base), "_part").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("_base_rows") + F.col("_rows")).alias("_row"),
        F.expr(f"cast(({middle}) * {n_shards}L div {2 * total}L as int)").alias("shard"),
    )
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )

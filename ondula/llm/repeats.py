"""Repeated passages across documents, by fixed-block anchors.

Every document is indexed by its non-overlapping blocks of BLOCK words and
probed with every rolling window of BLOCK words. WINDOW words in a row hold a
whole block, since WINDOW >= 2 * BLOCK - 1, so a window that repeats an
earlier document's is hit by one of that document's blocks. A hit extends to
the windows around it, in both documents; equal windows then meet, and runs of
them are the maximal repeats.

Hashes: a hit is found by 24 bits besides those of its bucket, so some hits
are chance; windows are compared by 64 bits besides those of their bucket,
which stand for the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.llm import packed
from ondula.llm.common import stored, text_slices
from ondula.llm.words import Words, runs_hash, words_in

WINDOW = 13
BLOCK = 7
# Packed positions per document are broadcast up to these bounds.
BROADCAST_ROWS = 300_000
BROADCAST_BYTES = 64 << 20


def _fitting(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where k words fit into their text: word index, text, place in text."""
    counts = np.diff(words.edges)
    of = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(of)) - np.repeat(words.edges[:-1], counts)
    fits = np.flatnonzero(at + k <= np.repeat(counts, counts))
    return fits, of[fits], at[fits]


def _column(part: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(part.column(part.schema.get_field_index(name)))


def _probes(n_buckets: int):
    """All rolling windows of BLOCK words: hash, id, tag, place * 2 + is block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            words = words_in(part.column(part.schema.get_field_index("text")))
            fits, of, at = _fitting(words, BLOCK)
            g = runs_hash(words.hashes(), BLOCK)[fits]
            yield from packed.pack(
                (g >> np.uint64(24)) % np.uint64(n_buckets),
                [
                    g.view(np.uint8).reshape(-1, 8)[:, :3],
                    _column(part, "_id")[of],
                    _column(part, "_tag")[of],
                    (at * 2 + (at % BLOCK == 0)).astype(np.uint32),
                ],
            )

    return run


def _id_bucket(ids: np.ndarray, n_buckets: int) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32)) % np.uint64(n_buckets)


def _hits(n_buckets: int):
    """Probes that meet a block of an earlier document, and those blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (raw, ids, tags, mark) in packed.unpack(batches, ["u1", "<i8", "<i8", "<u4"]):
            wide = np.zeros((len(ids), 4), dtype=np.uint8)
            wide[:, :3] = raw.reshape(-1, 3)
            h = wide.view("<u4")[:, 0]
            order = np.lexsort((ids, h))
            h, ids, tags, mark = h[order], ids[order], tags[order], mark[order]
            block = (mark & 1).astype(bool)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1])
            group = np.cumsum(np.concatenate([[0], np.diff(h) != 0]))
            # ids ascend within a group: its last id, and its first block's
            last = ids[np.concatenate([starts[1:], [len(h)]]) - 1]
            high = np.iinfo(np.int64).max
            first = np.minimum.reduceat(np.where(block, ids, high), starts)
            hit = (ids > first[group]) | (block & (ids < last[group]))
            yield from packed.pack(
                _id_bucket(ids[hit], n_buckets), [ids[hit], tags[hit], mark[hit] >> 1]
            )

    return run


def _around(places: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of the windows that hold a hit block."""
    starts = (places.astype(np.int64)[:, None] - np.arange(WINDOW - BLOCK + 1)).ravel()
    return np.unique(starts[(starts >= 0) & (starts <= n_words - WINDOW)])


def _candidates(n_buckets: int):
    """The windows around the hits of every document: hash, id, tag, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            words = words_in(part.column(part.schema.get_field_index("text")))
            g = runs_hash(words.hashes(), WINDOW, seed=1)
            index, of, at = [], [], []
            found = part.column(part.schema.get_field_index("_at")).to_pylist()
            for row, data in enumerate(found):
                lo, hi = words.edges[row], words.edges[row + 1]
                starts = _around(packed.unsqueeze(data, "<u4"), hi - lo)
                index.append(lo + starts)
                of.append(np.full(len(starts), row))
                at.append(starts)
            index, of, at = (np.concatenate(x).astype(np.int64) for x in (index, of, at))
            g = g[index]
            yield from packed.pack(
                runs_hash(words.hashes(), WINDOW, seed=2)[index] % np.uint64(n_buckets),
                [g, _column(part, "_id")[of], _column(part, "_tag")[of], at.astype(np.uint32)],
            )

    return run


def _repeated(n_buckets: int):
    """Windows that also start in a document with a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (h, ids, tags, at) in packed.unpack(batches, ["<u8", "<i8", "<i8", "<u4"]):
            order = np.lexsort((ids, h))
            h, ids, tags, at = h[order], ids[order], tags[order], at[order]
            starts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
            first = np.repeat(ids[starts], np.diff(np.append(starts, len(h))))
            later = ids > first
            yield from packed.pack(
                _id_bucket(ids[later], n_buckets), [ids[later], tags[later], at[later]]
            )

    return run


def repeated_windows(rows: DataFrame) -> DataFrame:
    """For identified rows (_id, _tag, text): _id, _tag, _at, the packed starts
    of the windows whose words also start in a row with a smaller id."""
    n = packed.bucket_count(rows)
    texts = rows.select("_id", "_tag", "text")
    probes = texts.mapInArrow(_probes(n), packed.schema(4))
    hits = packed.by_bucket(probes, n).mapInArrow(_hits(n), packed.schema(3))
    places = stored(packed.gathered(hits, n), "block-hits")
    near = packed.joined(texts, places, BROADCAST_ROWS, BROADCAST_BYTES).where("_at IS NOT NULL")
    windows = near.mapInArrow(_candidates(n), packed.schema(4))
    later = packed.by_bucket(windows, n).mapInArrow(_repeated(n), packed.schema(3))
    return stored(packed.gathered(later, n), "repeated-windows")


def _spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of words that the windows cover."""
    if not len(starts):
        return starts, starts
    fresh = np.concatenate([[True], starts[1:] > starts[:-1] + WINDOW])
    ends = np.concatenate([fresh[1:], [True]])
    return starts[fresh], starts[ends] + WINDOW


def _cut(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            words = words_in(part.column(part.schema.get_field_index("text")))
            found = part.column(part.schema.get_field_index("_at")).to_pylist()
            kept, removed, spans = [], [], []
            for row, data in enumerate(found):
                lo, hi = words.edges[row], words.edges[row + 1]
                starts = packed.unsqueeze(data, "<u4").astype(np.int64) if data else np.zeros(0, int)
                a, b = _spans(starts)
                spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(a, b)])
                removed.append(int((b - a).sum()))
                stay = np.ones(hi - lo, dtype=bool)
                for x, y in zip(a, b):
                    stay[x:y] = False
                at = lo + np.flatnonzero(stay)
                kept.append(
                    b" ".join(
                        [
                            words.data[s:e].tobytes()
                            for s, e in zip(words.starts[at].tolist(), words.stops[at].tolist())
                        ]
                    )
                )
            last = [hashlib.sha256(k).hexdigest() for k in kept] if digest else kept
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(part.schema.get_field_index("doc_id")),
                    pa.array(np.diff(words.edges)),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, _SPANS),
                    pa.array(last, pa.string()) if digest else pa.array(last).cast(pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "spans", "kept_sha256" if digest else "kept"],
            )

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """Remove every word that a repeated window covers.

    A window is 13 consecutive words; it is repeated if its words also start
    in a document with a smaller doc_id (a null id is the smallest; rows of
    one id don't remove each other's words). Windows are judged on the input.
    A null or empty text and one of under 13 words lose nothing. Repeated rows
    each get a row; other columns are left out.

    Returns doc_id, n_words, n_removed, spans (maximal removed runs of words)
    and kept (words joined by a blank), or kept_sha256 with ``digest``.
    """
    rows = packed.identified(docs)
    marked = packed.joined(rows, repeated_windows(rows), BROADCAST_ROWS, BROADCAST_BYTES)
    last = "kept_sha256" if digest else "kept"
    return marked.select("doc_id", "text", "_at").mapInArrow(
        _cut(digest),
        "doc_id long, n_words long, n_removed long, "
        f"spans array<struct<start:bigint,stop:bigint>>, {last} string",
    )

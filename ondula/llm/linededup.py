"""Lines that many documents share, kept in one of them; reversible.

A :class:`LineIndex` holds, as tables in the shared folder,

``refs``     the exact references: key of a line, document that holds it;
``counts``   the exact reference counts: documents and last document of a key;
``filters``  a cuckoo filter per shard of keys, over the keys that stand in at
             least ``min_docs`` documents.

Documents are inserted and deleted in any order: counts and filters follow, so
an index after a deletion answers as if the documents had never been there.
Lines of documents are screened by the filter of their shard, and only those
that pass meet the exact counts.

Keys are 64-bit hashes of lines without the white space around them, with A-Z
lower-cased; only lines of at least ``MIN_CHARS`` code points have one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ondula.llm.common import stored, text_slices
from ondula.llm.cuckoo import Cuckoo
from ondula.llm.packed import NO_ID, bucket_count, identified
from ondula.llm.words import Words, text_bytes
from ondula.session import broadcast_if_small

MIN_CHARS = 20
MIN_DOCS = 3
GROUP_ROWS = 1_000_000  # references of a shard that one task screens at a time
HEAVY_KEYS = 50_000  # keys in more than 1 / HEAVY_KEYS of all references
STASH_SHARE = 0.02  # stashed keys of a shard beyond which its filter is built anew

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Lines:
    """The lines of a block of texts: bytes data[starts[i]:ends[i]]; those of
    text t are edges[t] to edges[t + 1]. ``keyed`` lines have a key."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    edges: np.ndarray
    keyed: np.ndarray
    keys: np.ndarray


def lines_in(texts: pa.Array, min_chars: int = MIN_CHARS) -> Lines:
    """Split texts at newlines; a null or empty text has one empty line."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    breaks = np.flatnonzero(data == 0x0A)
    owner = np.searchsorted(offsets, breaks, side="right") - 1
    counts = np.bincount(owner, minlength=n) + 1
    edges = np.concatenate([[0], np.cumsum(counts)])
    starts = np.empty(edges[-1], np.int64)
    first = np.zeros(edges[-1], bool)
    first[edges[:-1]] = True
    starts[first] = offsets[:-1]
    starts[~first] = breaks + 1
    last = np.zeros(edges[-1], bool)
    last[edges[1:] - 1] = True
    ends = np.empty(edges[-1], np.int64)
    ends[last] = offsets[1:]
    ends[~last] = breaks
    # the ink of each line, from its first to its last
    ink = np.flatnonzero(~_SPACE[data])
    a, b = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
    some = b > a
    left, right = np.zeros_like(starts), np.zeros_like(starts)
    left[some], right[some] = ink[a[some]], ink[b[some] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    keyed = np.flatnonzero(points[right] - points[left] >= min_chars)
    words = Words(data, offsets, left[keyed], right[keyed], np.zeros(0, np.int64))
    return Lines(data, starts, ends, edges, keyed, words.hashes(lower=True).view(np.int64))


def _refs_of(rows: DataFrame, shards: int) -> DataFrame:
    """Distinct (key, shard, _id, _tag) of identified rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            lines = lines_in(part.column(2))
            owner = np.searchsorted(lines.edges, lines.keyed, side="right") - 1
            order = np.lexsort((lines.keys, owner))
            key, of = lines.keys[order], owner[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            key, of = key[new], pa.array(of[new])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key),
                    pa.array((key.view(np.uint64) % np.uint64(shards)).astype(np.int32)),
                    part.column(0).take(of),
                    part.column(1).take(of),
                ],
                ["key", "shard", "_id", "_tag"],
            )

    return rows.select("_id", "_tag", "text").mapInArrow(
        run, "key long, shard int, _id long, _tag long"
    )


def _counted(refs: DataFrame) -> DataFrame:
    """Documents and last document of every key; rows of one id are one
    document. Both steps combine map-side, so a key in a third of all
    documents never meets in one task."""
    pairs = refs.groupBy("key", "shard", "_id").agg(F.lit(1).alias("_one"))
    return pairs.groupBy("key", "shard").agg(
        F.count("*").alias("n_docs"), F.max("_id").alias("last_id")
    )


def _bytes_of(a: pd.Series) -> np.ndarray:
    return a.to_numpy(dtype=np.int64).view(np.uint64)


_FILTER = "shard int, size long, slots binary, stash binary"


def _update(filters: DataFrame, changes: DataFrame) -> DataFrame:
    """Filters after ``changes`` (shard, key, up): keys to insert or delete.

    A shard's changes and its filter meet in one task; their number is that
    of the shard's frequent keys, however often these occur.
    """

    def run(key: tuple, old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        up = _bytes_of(change["key"][change["up"]])
        down = _bytes_of(change["key"][~change["up"]])
        if len(old):
            row = old.iloc[0]
            cuckoo, size = Cuckoo.of_bytes(row["slots"], row["stash"]), int(row["size"])
            cuckoo.delete(down)
        else:
            cuckoo, size = Cuckoo.of_size(2 * len(up)), 0
        cuckoo.insert(up)
        table, stash = cuckoo.to_bytes()
        return pd.DataFrame(
            {"shard": [key[0]], "size": [size + len(up) - len(down)], "slots": [table], "stash": [stash]}
        )

    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(run, _FILTER)


@dataclass(frozen=True)
class LineIndex:
    """A state of the index; insertions and deletions return the next one."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = MIN_DOCS

    @staticmethod
    def empty(spark: SparkSession, shards: int = 64, min_docs: int = MIN_DOCS) -> LineIndex:
        def table(schema: str) -> DataFrame:
            return spark.createDataFrame([], schema)

        return LineIndex(
            table("key long, shard int, _id long, _tag long"),
            table("key long, shard int, n_docs long, last_id long"),
            table(_FILTER),
            shards,
            min_docs,
        )

    def _next(self, refs: DataFrame, touched: DataFrame) -> LineIndex:
        """The state with these references; ``touched`` (key, shard) are the
        keys whose references have changed."""
        keys = ["key", "shard"]
        changed = stored(
            touched.join(
                _counted(refs.join(touched, keys, "left_semi")), keys, "left"
            ).select(*keys, F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "last_id"),
            "line-changes",
        )
        return self._with(refs, changed)

    def _with(self, refs: DataFrame, changed: DataFrame) -> LineIndex:
        """The state whose counts are replaced by ``changed`` where it has them."""
        before = self.counts.select("key", F.col("n_docs").alias("_was"))
        crossed = (
            changed.join(before, "key", "left")
            .select(
                "shard",
                "key",
                (F.col("n_docs") >= self.min_docs).alias("up"),
                (F.coalesce("_was", F.lit(0)) >= self.min_docs).alias("_up"),
            )
            .where("up <> _up")
            .drop("_up")
        )
        filters = stored(_update(self.filters, crossed), "line-filters")
        counts = stored(
            self.counts.join(changed, "key", "left_anti").unionByName(
                changed.where("n_docs > 0")
            ),
            "line-counts",
        )
        return replace(self, refs=refs, counts=counts, filters=filters)._repaired()

    def _repaired(self) -> LineIndex:
        """Filters with too long a stash are built anew, with room to grow."""
        full = self.filters.where(
            F.octet_length("stash") / 8 > 8 + STASH_SHARE * F.col("size")
        ).select("shard")
        if full.isEmpty():
            return self
        keys = self.counts.where(F.col("n_docs") >= self.min_docs).join(full, "shard", "left_semi")
        none = self.filters.limit(0)
        again = _update(none, keys.select("shard", "key", F.lit(True).alias("up")))
        kept = self.filters.join(full, "shard", "left_anti")
        return replace(self, filters=stored(kept.unionByName(again), "line-filters"))

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents (doc_id, text). A document that is already there
        gains the lines that are new; all rows with a null id are one document
        that comes before the others."""
        fresh = stored(_refs_of(identified(docs), self.shards), "line-refs")
        if self.refs.isEmpty():  # nothing to compare with: counts are the batch's
            return self._with(fresh, stored(_counted(fresh), "line-changes"))
        again = ["key", "shard", "_id", "_tag"]
        own = self.refs.join(fresh.select("_id").distinct(), "_id", "left_semi")
        fresh = fresh.join(own, again, "left_anti")
        refs = stored(self.refs.unionByName(fresh), "line-refs")
        return self._next(refs, fresh.select("key", "shard").distinct())

    def delete(self, ids: DataFrame) -> LineIndex:
        """Take out the documents whose ids are in ``ids`` (doc_id)."""
        gone = ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id")).distinct()
        touched = self.refs.join(gone, "_id", "left_semi").select("key", "shard").distinct()
        refs = stored(self.refs.join(gone, "_id", "left_anti"), "line-refs")
        return self._next(refs, touched)

    def screened(self, refs: DataFrame) -> DataFrame:
        """Those of ``refs`` that the filter of their shard lets pass.

        A shard with many references is cut by document into groups of about
        ``GROUP_ROWS``, each beside a copy of the shard's filter.
        """
        parts = refs.groupBy("shard").agg(
            F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("_parts")
        )
        parts = broadcast_if_small(stored(parts, "line-parts"))  # a row per shard
        salted = refs.join(parts, "shard").selectExpr(
            "key", "_id", "_tag", "shard", "CAST(pmod(xxhash64(_id, _tag), _parts) AS int) AS _part"
        )
        copies = self.filters.join(parts, "shard").selectExpr(
            "slots", "stash", "shard", "explode(sequence(0, _parts - 1)) AS _part"
        )

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            kept = left.select(["key", "_id", "_tag"])
            if not right.num_rows:
                return kept.slice(0, 0)
            row = right.slice(0, 1).to_pylist()[0]
            cuckoo = Cuckoo.of_bytes(row["slots"], row["stash"])
            keys = kept.column("key").combine_chunks().to_numpy(zero_copy_only=False)
            return kept.filter(pa.array(cuckoo.contains(keys.view(np.uint64))))

        return (
            salted.groupBy("shard", "_part")
            .cogroup(copies.groupBy("shard", "_part"))
            .applyInArrow(run, "key long, _id long, _tag long")
        )

    def dropped(self, refs: DataFrame) -> DataFrame:
        """Keys that rows lose (_id, _tag, _drops): those in at least
        ``min_docs`` documents, of which theirs isn't the last."""
        passed = stored(self.screened(refs), "line-hits")
        known = self.counts.where(F.col("n_docs") >= self.min_docs).select("key", "n_docs", "last_id")
        total = self.refs.count()
        # at most HEAVY_KEYS keys can have more references than this
        heavy = F.col("n_docs") > max(1, total // HEAVY_KEYS)
        heavy_keys = F.broadcast(known.where(heavy).drop("n_docs"))
        light_keys = known.where(~heavy).drop("n_docs")
        found = passed.join(heavy_keys, "key").unionByName(
            passed.join(heavy_keys.select("key"), "key", "left_anti").join(light_keys, "key")
        )
        return (
            found.where("_id <> last_id")
            .groupBy("_id", "_tag")
            .agg(F.collect_list("key").alias("_drops"))
        )


def _cut_lines(rows: DataFrame, digest: bool) -> DataFrame:
    """Remove from the text of each row the lines whose key is in ``_drops``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            lines = lines_in(part.column(1))
            drops = part.column(2)
            gone = np.zeros(len(lines.starts), bool)
            owner = np.searchsorted(lines.edges, lines.keyed, side="right") - 1
            own = np.searchsorted(owner, np.arange(part.num_rows + 1))
            marked = np.flatnonzero(np.asarray(drops.is_valid()))
            for t in marked.tolist():
                a, b = own[t], own[t + 1]
                gone[lines.keyed[a:b]] = np.isin(lines.keys[a:b], drops[t].values.to_numpy())
            total = np.concatenate([[0], np.cumsum(gone)])
            n_dropped = total[lines.edges[1:]] - total[lines.edges[:-1]]
            raw, out = lines.data.tobytes(), []
            for t in range(part.num_rows):
                a, b = int(lines.edges[t]), int(lines.edges[t + 1])
                if n_dropped[t]:
                    kept = (np.flatnonzero(~gone[a:b]) + a).tolist()
                    text = b"\n".join(raw[lines.starts[i] : lines.ends[i]] for i in kept)
                else:
                    text = raw[lines.starts[a] : lines.ends[b - 1]]
                out.append(hashlib.sha256(text).hexdigest() if digest else text)
            last = pa.array(out) if digest else pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.diff(lines.edges)),
                    pa.array(n_dropped.astype(np.int64)),
                    last,
                ],
                names,
            )

    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256" if digest else "kept"]
    return rows.select("doc_id", "text", "_drops").mapInArrow(
        run, f"doc_id long, n_lines long, n_dropped long, {names[-1]} string"
    )


def clean(
    docs: DataFrame, index: LineIndex, digest: bool = False, refs: DataFrame | None = None
) -> DataFrame:
    """The texts of ``docs``, all of them in ``index``, without the lines that
    a later document keeps: doc_id, n_lines, n_dropped, kept.

    A null or empty text is one empty line; repeated rows each get a row;
    other columns are left out. With ``digest`` the last column is the
    SHA-256 of the kept text, ``kept_sha256``. ``refs`` are the references of
    ``docs`` if they are at hand.
    """
    rows = identified(docs)
    drops = index.dropped(_refs_of(rows, index.shards) if refs is None else refs)
    return _cut_lines(rows.join(drops, ["_id", "_tag"], "left"), digest)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, digest: bool = False) -> DataFrame:
    """Index all of ``docs`` and clean them by it (see ``clean``)."""
    index = LineIndex.empty(docs.sparkSession, bucket_count(docs), min_docs).insert(docs)
    return clean(docs, index, digest, index.refs)

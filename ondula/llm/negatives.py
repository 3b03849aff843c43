"""Hard negatives by inner product, over cover trees of the candidates.

Rows are dealt into blocks of one label and about ``BLOCK`` rows, near ones
together where there are many; every block is stored with a cover tree of its
norm-augmented vectors. Anchors are taken in groups of at most ``GROUP`` that
every task holds; a task descends the trees of its blocks with them, and keeps
only the best rows of each anchor so far, which also bounds what it opens in
the next tree.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import stored
from ondula.llm.covertree import Tree, augmented, build, descend
from ondula.session import parallelism

BLOCK = 2048  # rows of an index block
GROUP = 16_384  # anchors that a task holds at a time (8 MB at 64 dimensions)
CELLS = 64  # parts of space that each label is dealt into, at most
SAMPLE = 2_000  # rows, by the hash of their id, that the centres of cells come from
SCALE = 256
EXACT = float(1 << 53)
NONE = -np.inf


def candidates(embeddings: DataFrame) -> DataFrame:
    """Rows that take part: vec_id, label, v (floor(256 x) of each component).

    A null id, label, vector or component, or one that isn't finite, keeps a
    row out. Where vec_id is divisible by 7, the label is the next of ten. Of
    rows with one vec_id, the one with the least (label, vector) counts.
    Vectors of differing lengths are filled up with zeros. Products of more
    than 63 bits are an error.
    """
    rows = embeddings.where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT exists("
        "embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))"
    ).selectExpr(
        "CAST(vec_id AS long) AS vec_id",
        "CAST(IF(vec_id % 7 = 0, (label + 1) % 10, label) AS int) AS label",
        f"transform(embedding, x -> CAST(floor({SCALE}D * CAST(x AS double)) AS double)) AS v",
    )
    if rows.groupBy("vec_id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_r")).select(
            "vec_id", "_r.label", "_r.v"
        )
    return stored(rows, "candidates")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of doubles as rows of ``dims`` columns, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lens = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < lens[:, None]] = column.flatten().to_numpy()
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a and b."""
    top = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if top < EXACT:
        return a @ b.T
    exact = np.array([[int(v) for v in r] for r in a], dtype=object)
    other = np.array([[int(v) for v in r] for r in b], dtype=object)
    return exact @ other.T


def _centres(rows: DataFrame, dims: int, count: int) -> np.ndarray:
    """Rows of a bounded sample, each the furthest from those before."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    x = _matrix(sample.column("v"), dims)
    chosen = [0]
    dist = np.square(x - x[0]).sum(axis=1)
    while len(chosen) < min(count, len(x)) and dist.max() > 0:
        chosen.append(int(dist.argmax()))
        dist = np.minimum(dist, np.square(x - x[chosen[-1]]).sum(axis=1))
    return x[chosen]


def index(rows: DataFrame) -> DataFrame:
    """The blocks of all candidate rows, stored: label, n, block (bytes).

    Blocks of one label are bounded in size, however many rows share a vector,
    a cell or a label.
    """
    n, dims, labels, norm = rows.agg(
        F.count("*"),
        F.max(F.size("v")),
        F.approx_count_distinct("label"),
        F.max(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)")),
    ).first()
    if not n:
        return rows.selectExpr("label", "0L AS n", "CAST(NULL AS binary) AS block").limit(0)
    norm = float(np.sqrt(norm)) * (1 + 1e-12)
    cells = int(max(1, min(CELLS, n // (BLOCK * max(1, labels)))))
    dealt = rows.withColumn("cell", F.lit(0))
    if cells > 1:
        centres = _centres(rows, dims, cells)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(2), dims)
                near = np.square(centres).sum(axis=1)[None, :] - 2 * (x @ centres.T)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(near.argmin(axis=1).astype(np.int32))],
                    ["vec_id", "label", "v", "cell"],
                )

        dealt = stored(
            rows.select("vec_id", "label", "v").mapInArrow(
                deal, "vec_id long, label int, v array<double>, cell int"
            ),
            "dealt",
        )
    sizes = dealt.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n"))
    parted = dealt.join(sizes, ["label", "cell"]).withColumn(
        "part", F.pmod(F.xxhash64("vec_id"), F.col("_n")).cast("int")
    )

    def plant(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False)
        order = np.argsort(ids)
        x = _matrix(table.column("v"), dims)[order]
        tree = build(augmented(x, norm))
        aug = augmented(x, norm)[:, -1]
        data = pickle.dumps((ids[order], x.astype(np.float32) if np.abs(x).max(initial=0) < 1 << 24 else x, aug, tree))
        return pa.table(
            {
                "label": table.column("label").combine_chunks().slice(0, 1),
                "n": pa.array([len(ids)], pa.int64()),
                "block": pa.array([data], pa.binary()),
            }
        )

    blocks = parted.groupBy("label", "cell", "part").applyInArrow(
        plant, "label int, n long, block binary"
    )
    return stored(blocks, "cover-trees")


class Best:
    """The ``k`` first rows of each of some searches, by (score descending, id)."""

    def __init__(self, searches: int, k: int):
        self.scores = np.full((searches, k), NONE)
        self.ids = np.full((searches, k), np.iinfo(np.int64).max)

    def offer(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores (one row per search, NONE where a row is no candidate) of
        rows with ascending ids."""
        k = self.scores.shape[1]
        if scores.shape[1] > k:
            # the k-th best of the offer; ties beyond it are kept by position
            kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
            keep = scores > kth
            tied = (scores == kth) & (kth > NONE)
            room = k - keep.sum(axis=1, keepdims=True)
            keep |= tied & (np.cumsum(tied, axis=1) <= room)
            first = np.argsort(~keep, axis=1, kind="stable")[:, :k]
            ids = ids[first]
            scores = np.take_along_axis(np.where(keep, scores, NONE), first, axis=1)
        else:
            ids = np.broadcast_to(ids, scores.shape)
        ids = np.where(scores > NONE, ids, np.iinfo(np.int64).max)
        both = np.concatenate([self.scores[which], scores], axis=1)
        names = np.concatenate([self.ids[which], ids], axis=1)
        order = np.lexsort((names, -both), axis=1)[:, :k]
        self.scores[which] = np.take_along_axis(both, order, axis=1)
        self.ids[which] = np.take_along_axis(names, order, axis=1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, x, aug, tree = pickle.loads(batch.column(2)[i].as_py())
            yield batch.column(0)[i].as_py(), ids, x.astype(np.float64), aug, tree


def _search(
    blocks: DataFrame, groups: list[DataFrame], dims: int, k: int, same: bool
) -> DataFrame:
    """The first ``k`` rows of each search: anchor_id, at, id, score.

    An anchor has one search for the rows of its label (``same``), or one for
    each window (at, lo, hi) over the rows of other labels. ``groups`` hold
    bounded numbers of anchors: vec_id, label, v, windows.
    """
    out = []
    for group in groups:
        table = group.toArrow()  # at most GROUP rows
        ids = table.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False)
        labels = table.column("label").combine_chunks().to_numpy(zero_copy_only=False)
        q = _matrix(table.column("v"), dims)
        windows = table.column("windows").to_pylist()
        width = max([len(w) for w in windows], default=0)
        lo = np.full((len(ids), width), np.inf)
        hi = np.full((len(ids), width), -np.inf)
        for i, w in enumerate(windows):
            for j, (a, b) in enumerate(w):
                lo[i, j], hi[i, j] = a, b
        shared = blocks.sparkSession.sparkContext.broadcast((ids, labels, q, lo, hi))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, labels, q, lo, hi = shared.value
            width = lo.shape[1]
            best = [Best(len(ids), k) for _ in range(width)]
            for label, rows, x, aug, tree in _blocks(batches):
                mine = np.flatnonzero((labels == label) == same)
                if not len(mine):
                    continue
                points = np.column_stack([x, aug])
                asked = np.column_stack([q[mine], np.zeros(len(mine))])

                def open_for(who, low, high):
                    own = mine[who]
                    wanted = np.zeros(len(who), bool)
                    for j in range(width):
                        worst = np.maximum(best[j].scores[own, -1], lo[own, j])
                        wanted |= (high >= worst) & (low <= hi[own, j])
                    return wanted

                def visit(who, at):
                    own = mine[who]
                    scores = _products(q[own], x[at]).astype(np.float64)
                    if same:  # an anchor isn't its own positive
                        scores[ids[own][:, None] == rows[at][None, :]] = NONE
                    for j in range(width):
                        fit = (scores >= lo[own, j : j + 1]) & (scores <= hi[own, j : j + 1])
                        some = fit.any(axis=1)
                        if some.any():
                            best[j].offer(
                                own[some], np.where(fit[some], scores[some], NONE), rows[at]
                            )

                descend(tree, points, asked, open_for, visit)
            for j in range(width):
                one, two = np.nonzero(best[j].scores > NONE)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[one]),
                        pa.array(np.full(len(one), j, np.int32)),
                        pa.array(best[j].ids[one, two]),
                        pa.array(best[j].scores[one, two].astype(np.int64)),
                    ],
                    ["anchor_id", "at", "id", "score"],
                )

        found = blocks.mapInArrow(run, "anchor_id long, at int, id long, score long")
        first = F.slice(
            F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))), 1, k
        )
        out.append(
            stored(
                # a search meets at most k rows from each task
                found.groupBy("anchor_id", "at").agg(first.alias("_f")).select(
                    "anchor_id", "at", F.posexplode("_f").alias("place", "_r")
                ).select(
                    "anchor_id", "at", "place", F.col("_r.id").alias("id"),
                    (-F.col("_r.less")).alias("score"),
                ),
                "found",
            )
        )
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def hard_negatives(
    embeddings: DataFrame, anchors_every: int = 50, positives: int = 5, negatives: int = 3,
    low_percent: int = 50, high_percent: int = 95,
) -> DataFrame:
    """Negatives of every anchor and positive of ``embeddings`` (vec_id,
    embedding, label), which score almost as high as the positive.

    Anchors are rows whose id is divisible by ``anchors_every``; positives the
    first other rows of the same label, negatives the first rows of other
    labels whose score is between the percentages of the positive's. Scores
    are integer inner products with the anchor, higher first, ties by smaller
    id. See ``candidates`` for the rows that take part; other columns are left
    out; a table without candidates gives no row, and neither does a positive
    without a negative.

    Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.
    """
    rows = candidates(embeddings)
    blocks = index(rows)
    spread = blocks.repartition(parallelism(rows.sparkSession))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    every = rows.where(F.col("vec_id") % anchors_every == 0)
    count = every.count()
    n_groups = max(1, -(-count // GROUP))

    def groups(anchors: DataFrame) -> list[DataFrame]:
        number = F.pmod(F.xxhash64("vec_id"), F.lit(n_groups))
        return [anchors.where(number == g) for g in range(n_groups)]

    open_window = F.array(F.struct(F.lit(NONE).alias("lo"), F.lit(np.inf).alias("hi")))
    anchors = every.withColumn("windows", open_window)
    found = _search(spread, groups(_listed(anchors)), dims, positives, True)
    # whole bounds: 100 s between low * p and high * p
    least, most = f"(-score * {low_percent})", f"(score * {high_percent})"
    chosen = stored(
        found.select(
            F.col("anchor_id").alias("vec_id"), F.col("place").alias("at"),
            F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
            F.expr(f"CAST(-(({least} - pmod({least}, 100)) DIV 100) AS double) AS lo"),
            F.expr(f"CAST(({most} - pmod({most}, 100)) DIV 100 AS double) AS hi"),
        ),
        "positives",
    )
    windows = chosen.groupBy("vec_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("at", "lo", "hi"))),
            lambda w: F.struct(w["lo"].alias("lo"), w["hi"].alias("hi")),
        ).alias("windows")
    )
    asked = every.join(windows, "vec_id")
    met = _search(spread, groups(_listed(asked)), dims, negatives, False)
    return met.join(
        chosen.select(F.col("vec_id").alias("anchor_id"), "at", "positive_id", "positive_score"),
        ["anchor_id", "at"],
    ).select(
        "anchor_id",
        "positive_id",
        (F.col("place") + 1).cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def _listed(anchors: DataFrame) -> DataFrame:
    """Windows as lists of two doubles."""
    return anchors.select(
        "vec_id",
        "label",
        "v",
        F.transform("windows", lambda w: F.array(w["lo"], w["hi"])).alias("windows"),
    )

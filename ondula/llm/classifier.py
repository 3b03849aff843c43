"""Quality scores by regularised quadratic discriminant analysis."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import released, stored, text_slices
from ondula.llm.words import words_in

FOLDS = 5
SHRINKAGE = 0.2  # weight of the pooled diagonal in each class covariance
RIDGE = 1e-4
THRESHOLD = 0.3
SLICE_BYTES = 1 << 18  # bytes of text whose features are made at a time

# Counted bytes; each group gives a share of the text's bytes.
_GROUPS = {
    "upper": [*range(0x41, 0x5B)],
    "digit": [*range(0x30, 0x3A)],
    "stop": [ord(c) for c in ".?;:"],
    "comma": [ord(",")],
    "shout": [ord("!")],
    "bar": [ord(c) for c in "|/\\_="],
    "symbol": [ord(c) for c in "#*$%&<>@^~+"],
    "space": [0x20],
    "line": [0x0A],
}
FEATURES = [*_GROUPS, "length", "word_bytes", "repeats", "distinct"]


def features(texts: pa.Array) -> np.ndarray:
    """Transformed statistics of each text, one row each: square roots of
    shares, logarithms of sizes. An empty text is all zeros."""
    words = words_in(texts)
    n = len(texts)
    sizes = np.diff(words.offsets).astype(float)
    counts = np.diff(words.edges).astype(float)
    some, worded = np.maximum(sizes, 1), np.maximum(counts, 1)
    columns = []
    for group in _GROUPS.values():
        member = np.zeros(256, dtype=np.uint8)
        member[group] = 1
        total = np.concatenate([[0], np.cumsum(member[words.data], dtype=np.int64)])
        columns.append(np.sqrt(np.diff(total[words.offsets]) / some))
    of = np.repeat(np.arange(n), np.diff(words.edges))
    h = words.hashes(exact=False)
    again = np.zeros(n)
    if len(h) > 1:
        same = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        again = np.bincount(of[1:][same], minlength=n).astype(float)
    order = np.lexsort((h, of))
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    kinds = np.bincount(of[order][first], minlength=n).astype(float)
    inked = np.bincount(of, weights=words.stops - words.starts, minlength=n)
    columns += [
        np.log1p(sizes) / 8,
        np.log1p(inked / worded) * (counts > 0),
        np.sqrt(again / worded),
        np.log1p(kinds) / np.maximum(np.log1p(counts), 1),
    ]
    return np.column_stack(columns)


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors and constants; classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """A logistic of the difference of the log densities per feature: the
        features depend on each other, so the plain sum is overconfident."""
        logs = [
            c - 0.5 * np.square((x - m) @ f.T).sum(axis=1)
            for m, f, c in zip(self.means, self.factors, self.constants)
        ]
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / x.shape[1], -500, 500)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class of a partition: rows, sums and sums of products."""
    d = len(FEATURES)
    totals = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    for batch in batches:
        x = np.stack(batch.column(0).to_pylist()) if batch.num_rows else np.zeros((0, d))
        y = np.asarray(batch.column(1))
        for k, total in totals.items():
            own = x[y == k]
            total += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    yield pa.RecordBatch.from_arrays(
        [pa.array([0, 1], pa.int32()), pa.array(list(totals.values()), pa.list_(pa.float64()))],
        ["quality", "sums"],
    )


def fit(described: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Fit on the described texts (doc_id, features) that have a label.

    Labels are distinct (doc_id, quality) pairs with quality 0 or 1; others
    are left out. Sums of all rows come from Spark, one pair per partition;
    covariances are shrunk towards the pooled diagonal and factorised once.
    None if a class has no row.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        .where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .distinct()
    )
    d = len(FEATURES)
    parts = (
        described.join(known, "doc_id")
        .select("features", F.col("quality").cast("int").alias("quality"))
        .mapInArrow(_sums, "quality int, sums array<double>")
        .select("quality", F.posexplode("sums").alias("at", "value"))
        .groupBy("quality", "at")
        .agg(F.sum("value").alias("value"))
        .collect()  # 2 * (1 + d + d * d) rows
    )
    total = np.zeros((2, 1 + d + d * d))
    for row in parts:
        total[row["quality"], row["at"]] = row["value"]
    n = total[:, 0]
    if not n.all():
        return None
    means = total[:, 1 : d + 1] / n[:, None]
    covs = total[:, d + 1 :].reshape(2, d, d) / n[:, None, None]
    covs = covs - means[:, :, None] * means[:, None, :]
    pooled = np.diag(np.diag((covs * n[:, None, None]).sum(axis=0) / n.sum()))
    shrunk = (1 - SHRINKAGE) * covs + SHRINKAGE * pooled + RIDGE * np.eye(d)
    roots = np.linalg.cholesky(shrunk)
    factors = np.linalg.inv(roots)
    logs = np.log(np.diagonal(roots, axis1=1, axis2=2)).sum(axis=1)
    return Discriminant(means, factors, np.log(n / n.sum()) - logs)


def describe(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The features of every text beside the columns ``keep`` of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "_text", SLICE_BYTES):
            x = features(part.column(0))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(list(x), pa.list_(pa.float64()))],
                [*part.schema.names[1:], "features"],
            )

    kept = docs.select(F.col("text").alias("_text"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[1:])
    return kept.mapInArrow(released(run), f"{fields}, features array<double>")


def scored(described: DataFrame, model: Discriminant | None) -> DataFrame:
    """Add ``score`` and ``predicted`` to described texts; without a model
    every score is 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column(batch.num_columns - 1).to_pylist())
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(score),
                    pa.array((score >= THRESHOLD).astype(np.int32)),
                ],
                [*batch.schema.names[:-1], "score", "predicted"],
            )

    kept = [c for c in described.columns if c != "features"]
    fields = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in described.select(kept).schema
    )
    return described.select(*kept, "features").mapInArrow(
        run, f"{fields}, score double, predicted int"
    )


def held_out():
    """Whether a document is kept out of fitting, by its id alone."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(crc % FOLDS == 0, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text) for quality.

    Fitted on labelled documents whose crc32(doc_id) mod 5 isn't 0. A null
    text counts as empty; a null id is never labelled and not held out;
    repeated rows each get a row (and count once each in fitting). Other
    columns of ``docs`` are left out.

    Returns doc_id, held_out, score, predicted.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = stored(describe(ids, ["doc_id"]), "quality-features")
    model = fit(described.where(~held_out()), labels)
    return scored(described, model).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted"
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, with all their
    columns. Fitted as ``quality`` is; without labels of both classes all
    rows stay."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(describe(ids.where(~held_out()), ["doc_id"]), labels)
    if model is None:
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each text is held once; features and scores of a slice at a time
        for part in text_slices(batches, "text", SLICE_BYTES):
            score = model.score(features(part.column(at)))
            yield part.filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(released(run), docs.schema)

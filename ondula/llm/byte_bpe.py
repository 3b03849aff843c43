"""Byte-level BPE by replaying merges over the distinct pieces of a block.

A block is what a task has read: its distinct pieces are laid end to end, an
inverted index leads from each token pair to the places where it stands, and
the merges are applied in rank order to all places at once, touching only
neighbours. Blocks are independent, so texts are never shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ondula.llm.common import Numbered, Ragged, is_latin, ragged_take, released, text_slices

# Distinct chunks, and their characters, that a Python worker remembers; beyond
# either it starts anew, which changes no result.
CACHE_CHUNKS = 700_000
CACHE_CHARS = 16_000_000
# Chunks that a worker of the pipeline still remembers when a task is done; the
# next one may belong to another stage, which has no use for them.
KEPT_CHUNKS = 100_000
# Bytes of text whose new pieces are merged together.
BLOCK_BYTES = 12 << 20
# White space other than blank and newline.
OTHER_SPACE = re.compile(
    r"[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]"
)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: base64 bytes and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Merges:
    """Ranks, and the rank of every pair of tokens whose bytes join to one."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.dead = max(ranks.values(), default=0) + 1  # id of merged-away symbols
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = sorted(
            (ranks[t[:i]] << 32 | ranks[t[i:]], rank)
            for t, rank in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        )
        self.keys = np.array([p[0] for p in pairs] + [2**62], dtype=np.int64)
        self.values = np.array([p[1] for p in pairs] + [self.NONE], dtype=np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], self.NONE)


def replay(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces end to end, and how many each piece has.

    All pieces share one array of symbols, linked by ``after`` and ``before``.
    ``places`` is the inverted index from the rank of a pair to the positions
    of its left symbols; ``pair`` holds the rank that a position has now, so a
    place that has changed since it was filed is known. All places of a rank
    are merged at once, the left one of two that overlap. Where a merge makes a
    pair of a lower rank, that pair goes first in its piece: then only
    the first place of the rank is merged, and the rest wait.
    """
    none, dead = merges.NONE, merges.dead
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    n = len(data)
    symbol = np.append(merges.bytes[data], np.int32(dead))
    ends = np.cumsum(sizes)
    full = sizes > 0
    after = np.arange(1, n + 2)
    before = np.arange(-1, n)
    after[ends[full] - 1] = n  # the place n stands for both ends
    before[(ends - sizes)[full]] = n
    before[n] = after[n] = n
    pair = merges.rank(symbol, symbol[after])
    places: dict[int, list[np.ndarray]] = {}

    def file(at: np.ndarray) -> list[int]:
        """Index places by rank; returns the ranks that were not there."""
        ranks = pair[at]
        some = ranks != none
        at, ranks = at[some], ranks[some]
        if not len(at):
            return []
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        new = []
        starts = [0, *cuts.tolist()]
        for r, x, y in zip(ranks[starts].tolist(), starts, [*starts[1:], len(at)]):
            if r in places:
                places[r].append(at[x:y])
            else:
                places[r] = [at[x:y]]
                new.append(r)
        return new

    heap = file(np.arange(n))
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        todo = places.pop(rank)
        p = todo[0] if len(todo) == 1 else np.unique(np.concatenate(todo))
        p = p[pair[p] == rank]
        if not len(p):
            continue
        q, standing = after[p], p
        if len(p) > 1:
            hit = q[:-1] == p[1:]
            if hit.any():  # of a run of overlapping places, every other one
                head = np.concatenate([[True], ~hit])
                index = np.arange(len(p))
                p = p[(index - np.maximum.accumulate(np.where(head, index, 0))) % 2 == 0]
                q = after[p]
        h, k = before[p], after[q]
        own = np.full(len(p), rank, dtype=np.int32)
        lowest = min(
            merges.rank(symbol[h], own).min(),
            merges.rank(own, symbol[k]).min(),
            merges.rank(own[:1], own[:1])[0],
        )
        if lowest < rank and len(standing) > 1:
            file(standing[1:])
            heapq.heappush(heap, rank)
            p, q, k, own = p[:1], q[:1], k[:1], own[:1]
        symbol[p] = own
        symbol[q] = dead
        pair[q] = none
        after[p] = k
        before[k] = p
        h = before[p]
        before[n] = after[n] = n
        pair[p] = merges.rank(own, symbol[k])
        pair[h] = merges.rank(symbol[h], own)
        pair[n] = none
        for r in file(np.unique(np.concatenate([p, h]))):
            heapq.heappush(heap, r)
    alive = symbol[:n] != dead
    total = np.concatenate([[0], np.cumsum(alive)])
    return symbol[:n][alive].astype(np.uint32), total[ends] - total[ends - sizes]


class Encoder:
    """Encodes texts through tables of the chunks met so far.

    A text is cut where no piece of the pattern can straddle: before a blank
    or newline that follows a visible character, and behind a newline that
    precedes one. Texts with other white space, or with runs of it, are cut by
    the pattern itself.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges = Merges(ranks)
        self.split = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.fresh: list[tuple[str, str]] = []
        number = [0]
        self.first = Numbered("", self.fresh, number)
        self.later = Numbered(" ", self.fresh, number)
        self.pieces: dict[str, int] = {}
        self.held = 0
        self.of_piece = Ragged()
        self.of_chunk = Ragged()

    def _cut(self, lead: str, chunk: str) -> list[str]:
        """The pieces of a chunk; plain words need no pattern."""
        if chunk and is_latin(chunk):
            if chunk.isalpha():
                return [lead + chunk]
            if chunk[-1] in ",." and chunk[:-1].isalpha():
                return [lead + chunk[:-1], chunk[-1]]
        return self.split(lead + chunk)

    def _learn(self) -> None:
        """Encode the chunks that have been numbered since the last time."""
        cut = [self._cut(lead, chunk) for lead, chunk in self.fresh]
        new = list({p for ps in cut for p in ps if p not in self.pieces})
        self.held += sum(len(c) for _, c in self.fresh) + sum(map(len, new))
        self.fresh.clear()
        self.pieces.update(zip(new, range(len(self.pieces), len(self.pieces) + len(new))))
        data = [p.encode() for p in new]
        whole = np.array([self.merges.ranks.get(p, -1) for p in data], dtype=np.int64)
        ids, lens = replay([b"" if w >= 0 else p for p, w in zip(data, whole)], self.merges)
        # a piece that is a token stays whole
        lens = np.where(whole >= 0, 1, lens)
        flat = np.empty(int(lens.sum()), dtype=np.uint32)
        single = np.zeros(len(flat), dtype=bool)
        single[(np.cumsum(lens) - lens)[whole >= 0]] = True
        flat[single] = whole[whole >= 0]
        flat[~single] = ids
        self.of_piece.add(flat, lens)
        index = np.array([self.pieces[p] for ps in cut for p in ps], dtype=np.int64)
        counts = np.array([len(ps) for ps in cut], dtype=np.int64)
        flat, lens = self.of_piece.take(index)
        total = np.concatenate([[0], np.cumsum(lens)])
        ends = np.cumsum(counts)
        self.of_chunk.add(flat, total[ends] - total[ends - counts])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each text."""
        if len(self.of_chunk.lens) > CACHE_CHUNKS or self.held > CACHE_CHARS:
            self.forget()
        index: list[int] = []
        sizes = []
        first, later = self.first.__getitem__, self.later.__getitem__
        for text in texts:
            size = len(index)
            lines = text.split("\n") if text else []
            if text and (
                "" in lines
                or "  " in text
                or " \n" in text
                or "\n " in text
                or text[0] == " "
                or text[-1] == " "
                or OTHER_SPACE.search(text)
            ):
                index.extend(map(first, self.split(text)))
            else:
                for k, line in enumerate(lines):
                    if k:
                        index.append(first("\n"))
                    chunks = line.split(" ")
                    index.append(first(chunks[0]))
                    del chunks[0]
                    index.extend(map(later, chunks))
            sizes.append(len(index) - size)
        if self.fresh:
            self._learn()
        ids, lens = self.of_chunk.take(np.array(index, dtype=np.int64))
        ends = np.concatenate([[0], np.cumsum(lens)])
        edges = ends[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
        return ids, np.diff(edges)


class Decoder:
    """Token ids back to bytes, by one table of all tokens' bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        words = [b""] * size
        for token, rank in ranks.items():
            words[rank] = token
        self.lens = np.array([len(w) for w in words], dtype=np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(words), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        return ragged_take(self.flat, self.starts[ids], self.lens[ids]).tobytes()


_MADE: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


def codec(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """The encoder and decoder of this Python worker."""
    if (path, pattern) not in _MADE:
        ranks = read_ranks(path)
        _MADE[path, pattern] = Encoder(ranks, pattern), Decoder(ranks)
    return _MADE[path, pattern]


def _per_text(
    docs: DataFrame, path: str, pattern: str, schema: str, make: Callable
) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = codec(path, pattern)
        for part in text_slices(batches, "text", BLOCK_BYTES):
            ids, counts = encoder.encode([t or "" for t in part.column(1).to_pylist()])
            cuts = np.cumsum(counts)[:-1]
            columns = make(np.split(ids, cuts), decoder)
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(
        run, schema
    )


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token ids of every text: doc_id, ids (array of int).

    ``docs`` has doc_id and text; other columns are left out. A null or empty
    text has no ids. Repeated rows each give a row. ``path`` names the rank
    file, which every executor must have; ``pattern`` cuts texts into pieces
    (letters together, an optional blank before them, marks apart).
    """
    return _per_text(
        docs,
        path,
        pattern,
        "doc_id long, ids array<int>",
        lambda ids, _: [_lists(ids)],
    )


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *[len(x) for x in ids]]).astype(np.int32)
    flat = np.concatenate(ids) if ids else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Bytes of every row of ``encode``: doc_id, bytes. A null array is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(read_ranks(path))
        for batch in batches:
            data = [
                decoder.decode(np.array(x or [], dtype=np.int64))
                for x in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(data, pa.binary())], ["doc_id", "bytes"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def encode_checked(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As ``encode``, with n_tokens and exact, whether decoding the ids gives
    the text's bytes again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = codec(path, pattern)
        for part in text_slices(batches, "text", BLOCK_BYTES):
            texts = [t or "" for t in part.column(1).to_pylist()]
            flat, counts = encoder.encode(texts)
            ids = np.split(flat, np.cumsum(counts)[:-1])
            exact = [decoder.decode(x) == t.encode() for x, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts), pa.array(exact), _lists(ids)],
                ["doc_id", "n_tokens", "exact", "ids"],
            )
        if len(encoder.of_chunk.lens) > KEPT_CHUNKS:
            encoder.forget()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(
        released(run), "doc_id long, n_tokens long, exact boolean, ids array<int>"
    )


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256 (ids as
    little-endian unsigned 32-bit integers), decoded_sha256."""

    def digest(ids: list[np.ndarray], decoder: Decoder) -> list[pa.Array]:
        return [
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
            pa.array([hashlib.sha256(decoder.decode(x)).hexdigest() for x in ids]),
        ]

    return _per_text(
        docs,
        path,
        pattern,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        digest,
    )

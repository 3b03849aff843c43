"""Documents whose shingle sets are nearly equal, by token-combination prefixes.

Tokens (shingles) have one global order: rare ones by hash, then the rest by
hash. A set of n tokens that may miss e of them in a partner is indexed by a
prefix of that order: e + 1 rare tokens, each a signature of its own; where
there are fewer, the prefix is extended into the frequent tokens, which fall
into CLASSES classes by hash and are indexed by pairs of one class. A prefix
with c tokens of a class survives the loss of c - 2 with a pair left, so it is
extended until r + sum(c - 1) reaches e + l; then two sets that link share a
pair, or at least l rare tokens (l grows with the set, see _shared). Candidates
are pruned by the sizes of sets and of their hashed parts, which bound the
overlap, and verified on the sets.

A signature with more than GROUP members isn't paired out. Its sets are
compared by their parts in pairs of blocks of about BLOCK sets, each pair of
blocks apart from the others, and those of one component not at all: first a
forest of pairs that may link leaves every pair of blocks and is verified, then
every pair that may link and that the forest's links leave apart.

Rare and frequent: how many different sets hold a token is counted for all
tokens in the lower part of the hash range (RANGE); those in more than GROUP
sets are frequent, as are, unseen, all above that range. At most MAX_FREQUENT
of the counted ones, the most frequent, are told to the tasks; any choice is
right, since all tasks share it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.llm import packed
from ondula.llm.common import bounded_batches, released, stored, text_slices
from ondula.llm.components import components
from ondula.llm.words import mixed, runs_hash, words_in
from ondula.session import broadcast_if_small

RANGE = int(0.3 * 2**64)
GROUP = 16  # members of a signature that are paired with each other at once
BLOCK = 1024  # members of larger signatures that are compared in one piece
CLASSES = 8
SMALL = 40  # sets up to this size have plain prefixes; see _signatures
PARTS = 256  # hashed parts of a set whose sizes, up to 255, bound an overlap
COARSE = 32
MAX_SHARED = 8
MAX_FREQUENT = 200_000
BROADCAST_ROWS = 500_000
SLICE_BYTES = 1 << 18  # bytes of text whose sets a task holds at a time
PACKED_ROWS = 50_000  # tokens or signatures that a task packs at a time


class Sets:
    """The distinct tokens of every text of a slice, by text, then hash."""

    def __init__(self, part: pa.RecordBatch, k: int):
        words = words_in(part.column(part.schema.get_field_index("text")))
        counts = np.diff(words.edges)
        h = words.hashes(lower=True)
        of = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(of)) - np.repeat(words.edges[:-1], counts)
        whole = np.flatnonzero(at + k <= np.repeat(counts, counts))
        tokens, owner = [runs_hash(h, k)[whole]], [of[whole]]
        for short in range(1, k):  # fewer words: all of them are one shingle
            rows = np.flatnonzero(counts == short)
            tokens.append(runs_hash(h, short, seed=short)[words.edges[rows]])
            owner.append(rows)
        g, of = np.concatenate(tokens), np.concatenate(owner)
        order = np.lexsort((g, of))
        g, of = g[order], of[order]
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
        self.g, self.of = g[new], of[new]
        self.sizes = np.bincount(self.of, minlength=len(counts))
        self.edges = np.concatenate([[0], np.cumsum(self.sizes)])
        # a set is known by a sum over its tokens
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(self.g + np.uint64(77)))])
        sums = total[self.edges[1:]] - total[self.edges[:-1]]
        self.ids = mixed(sums + self.sizes.astype(np.uint64)).view(np.int64)

    def distinct(self) -> np.ndarray:
        """The first row of each different set that has tokens."""
        _, first = np.unique(self.ids, return_index=True)
        return first[self.sizes[first] > 0]


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            sets = Sets(part, k)
            part_of = (sets.g >> np.uint64(8)) % np.uint64(PARTS) + sets.of.astype(np.uint64) * np.uint64(PARTS)
            parts = np.bincount(part_of.astype(np.int64), minlength=part.num_rows * PARTS)
            parts = np.minimum(parts, 255).astype(np.uint8).reshape(-1, PARTS)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    part.column(2),
                    pa.array(sets.sizes.astype(np.int64)),
                    pa.array(sets.ids),
                    pa.array([p.tobytes() for p in parts], pa.binary()),
                ],
                ["_id", "_tag", "doc_id", "n", "sid", "parts"],
            )

    return run


def _counts(k: int, n_buckets: int):
    """How many different sets of a slice hold each token of the lower range."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            sets = Sets(part, k)
            chosen = np.zeros(part.num_rows, dtype=bool)
            chosen[sets.distinct()] = True
            g = sets.g[chosen[sets.of] & (sets.g < np.uint64(RANGE))]
            g, n = np.unique(g, return_counts=True)
            yield g % np.uint64(n_buckets), [g, n.astype(np.uint32)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed.pack_together(counted(batches), PACKED_ROWS)

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, (g, n) in packed.unpack(batches, ["<u8", "<u4"]):
        g, at = np.unique(g, return_inverse=True)
        n = np.bincount(at, weights=n).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(g[n > GROUP].view(np.int64)), pa.array(n[n > GROUP])], ["g", "n"]
        )


def _misses(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n tokens may be missing in a partner."""
    return n - (percent * n + 99) // 100


def _shared(n: np.ndarray) -> np.ndarray:
    """How many rare tokens a set of n tokens shares with a partner within its
    prefix, unless they share a pair. Of two sets, the lesser number holds."""
    return np.minimum(MAX_SHARED, 1 + n // 40)


def _prefix_pairs(tokens: np.ndarray, need: int) -> list[int]:
    """Pairs within classes of the shortest prefix of frequent tokens that can
    lose need - 1 tokens and keep a pair in a class."""
    held: dict[int, list[int]] = {}
    got = 0
    for t in tokens.tolist():
        own = held.setdefault(t % CLASSES, [])
        got += bool(own)
        own.append(t)
        if got >= need:
            break
    return [
        (a * 0x9E3779B97F4A7C15 ^ b) % (1 << 64) for own in held.values() for a, b in combinations(own, 2)
    ]


def _signatures(k: int, percent: int, frequent, n_buckets: int):
    """Signatures of all different sets of a slice.

    Sets of up to SMALL tokens may have too few for enough pairs; they, and
    those large enough to link with them, also have plain prefixes, apart from
    the others' signatures. A pair of larger sets meets in the others.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        common = frequent.value
        for part in text_slices(batches, "text", SLICE_BYTES):
            sets = Sets(part, k)
            chosen = np.zeros(part.num_rows, dtype=bool)
            chosen[sets.distinct()] = True
            n = sets.sizes
            need = _misses(n, percent) + 1
            wide = _misses(n, percent) + _shared(n)
            small = chosen & (100 * SMALL >= percent * n)
            large = chosen & (n > SMALL)
            rare = sets.g < np.uint64(RANGE)
            if len(common):
                at = np.minimum(np.searchsorted(common, sets.g), len(common) - 1)
                rare &= common[at] != sets.g
            # rank in the global order: rare tokens first, both by hash
            total = np.concatenate([[0], np.cumsum(rare)])
            start = total[sets.edges[:-1]]
            n_rare = total[sets.edges[1:]] - start
            seen = total[:-1] - start[sets.of]
            place = np.arange(len(rare)) - sets.edges[:-1][sets.of]
            rank = np.where(rare, seen, n_rare[sets.of] + place - seen)
            single = rare & large[sets.of] & (rank < wide[sets.of])
            plain = small[sets.of] & (rank < need[sets.of])
            sigs = [mixed(sets.g[single]), mixed(sets.g[plain] ^ np.uint64(0x5DEECE66D))]
            rows = [sets.of[single], sets.of[plain]]
            strong = [np.zeros(len(rows[0]), bool), np.ones(len(rows[1]), bool)]
            for row in np.flatnonzero(large & (n_rare < wide)).tolist():
                lo, hi = sets.edges[row], sets.edges[row + 1]
                pairs = _prefix_pairs(sets.g[lo:hi][~rare[lo:hi]], int(wide[row] - n_rare[row]))
                sigs.append(mixed(np.array(pairs, dtype=np.uint64) + np.uint64(1)))
                rows.append(np.full(len(pairs), row))
                strong.append(np.ones(len(pairs), bool))
            sig, row = np.concatenate(sigs), np.concatenate(rows).astype(np.int64)
            order = np.argsort(row, kind="stable")
            sig, row, own = sig[order], row[order], np.concatenate(strong)[order]
            yield (
                (sig >> np.uint64(32)) % np.uint64(n_buckets),
                [
                    sig.view(np.uint8).reshape(-1, 8)[:, :4],
                    sets.ids[row],
                    (n[row] * 2 + own).astype(np.uint32),
                ],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed.pack_together(signed(batches), PACKED_ROWS)

    return run


def _groups(percent: int):
    """Pairs of sets of one signature, or its members if it has many: sig, a,
    b, times (signatures of this bucket that both have), enough (how many are
    needed, 0 if one shared pair of tokens does); b is null for a member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (raw, ids, n) in packed.unpack(batches, ["u1", "<i8", "<u4"]):
            sig = raw.reshape(-1, 4).copy().view("<u4")[:, 0]
            order = np.lexsort((ids, n, sig))
            sig, ids, n = sig[order], ids[order], n[order].astype(np.int64)
            new = np.ones(len(sig), dtype=bool)
            new[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
            sig, ids, n = sig[new], ids[new], n[new]
            strong, n = (n & 1).astype(bool), n >> 1
            starts = np.concatenate([[0], np.flatnonzero(np.diff(sig.astype(np.int64))) + 1])
            sizes = np.diff(np.append(starts, len(sig)))
            few = np.repeat(sizes, sizes) <= GROUP
            rows = []
            for step in range(1, GROUP):  # members of a group, ``step`` apart
                i = np.flatnonzero(few[:-step] & (sig[:-step] == sig[step:]))
                if not len(i):
                    break
                i = i[100 * n[i] >= percent * n[i + step]]
                enough = np.where(strong[i] | strong[i + step], 0, _shared(n[i]))
                x, y = ids[i], ids[i + step]
                rows.append(np.column_stack([np.minimum(x, y), np.maximum(x, y), enough]))
            pairs = np.concatenate(rows or [np.zeros((0, 3), np.int64)])
            pairs, times = np.unique(pairs, axis=0, return_counts=True)
            many = np.flatnonzero(~few)
            none = np.zeros(len(many), np.int64)
            lone = np.arange(len(pairs) + len(many)) >= len(pairs)
            names = (np.int64(bucket) << 32) + sig[many].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(len(pairs), np.int64), names])),
                    pa.array(np.concatenate([pairs[:, 0], ids[many]])),
                    pa.array(np.concatenate([pairs[:, 1], none]), mask=lone),
                    pa.array(np.concatenate([times.astype(np.int64), none])),
                    pa.array(np.concatenate([pairs[:, 2], none])),
                ],
                ["sig", "a", "b", "times", "enough"],
            )

    return run


def _may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with these parts, and n tokens in both, may link: the
    differences of parts add up to at most that of the sets."""
    apart = np.abs(x.astype(np.int16) - y.astype(np.int16)).sum(axis=-1, dtype=np.int64)
    # overlap <= (n - apart) / 2, union >= (n + apart) / 2
    fits = 100 * (n - apart) >= percent * (n + apart)
    return fits | (x.max(axis=-1) == 255) | (y.max(axis=-1) == 255)


def _cross(percent: int, forest: bool):
    """Pairs that may link among the rows of each ``pair`` of blocks that share
    a signature and aren't connected yet: all, or a forest that connects the
    same members. Side 0 is compared with side 1, side 2 belongs to both."""

    def compare(sids, roots, n, parts, groups, left, right) -> np.ndarray:
        coarse = parts.reshape(len(parts), COARSE, -1).sum(axis=2, dtype=np.int16)
        full = (parts == 255).any(axis=1)
        at_left, at_right = np.full(len(sids), -1), np.full(len(sids), -1)
        at_right[right] = np.arange(len(right))
        out = []
        step = max(1, (16 << 20) // max(1, len(right)))
        for at in range(0, len(left), step):
            block = left[at : at + step]
            at_left[:] = -1
            at_left[block] = np.arange(len(block))
            near = np.zeros((len(block), len(right)), dtype=bool)
            for g in groups:
                x, y = at_left[g], at_right[g]
                x, y = x[x >= 0], y[y >= 0]
                if len(x) and len(y):
                    near[np.ix_(x, y)] = True
            near &= roots[block][:, None] != roots[right]
            near &= 100 * n[block][:, None] >= percent * n[right]
            near &= 100 * n[right] >= percent * n[block][:, None]
            for i, row in zip(block.tolist(), near):
                j = right[row]
                if forest:
                    j = j[roots[j] != roots[i]]
                both = n[i] + n[j]
                apart = np.abs(coarse[j] - coarse[i]).sum(axis=1, dtype=np.int64)
                j = j[(100 * (both - apart) >= percent * (both + apart)) | full[i] | full[j]]
                j = j[_may_link(parts[j], parts[i], n[i] + n[j], percent)]
                if forest and len(j):  # one pair for each component it meets
                    met, first = np.unique(roots[j], return_index=True)
                    j = j[first]
                    roots[np.isin(roots, met)] = roots[i]
                if len(j):
                    pair = np.sort(np.column_stack([np.full(len(j), sids[i]), sids[j]]), axis=1)
                    out.append(pair)
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)

    def finish(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        side, sid, root, n = (table.column(c).to_numpy() for c in ("side", "sid", "root", "n"))
        sigs = table.column("sigs").combine_chunks()
        sig = sigs.flatten().to_numpy()
        at = np.repeat(np.arange(len(sid)), sigs.value_lengths().to_numpy())
        parts = np.frombuffer(b"".join(table.column("parts").to_pylist()), np.uint8).reshape(-1, PARTS)
        order = np.argsort(sig, kind="stable")
        cuts = np.flatnonzero(np.diff(sig[order])) + 1
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        pairs = compare(sid, root.copy(), n, parts, np.split(at[order], cuts), left, right)
        return pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if key[a] != now and rows:
                    yield finish(rows)
                    rows = []
                now = key[a]
                rows.append(batch.slice(a, b - a))
        if rows:
            yield finish(rows)

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            sets = Sets(part, k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sets.ids),
                    pa.array(
                        [
                            sets.g[a:b].tobytes()
                            for a, b in zip(sets.edges[:-1].tolist(), sets.edges[1:].tolist())
                        ],
                        pa.binary(),
                    ),
                ],
                ["sid", "tokens"],
            )

    return run


def _close(percent: int):
    """Pairs whose parts allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PARTS)
                for c in (4, 5)
            )
            n = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
            yield batch.select(["a", "b"]).filter(pa.array(_may_link(x, y, n, percent)))

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


class _Join:
    """The state of one similarity join."""

    def __init__(self, rows: DataFrame, k: int, percent: int):
        self.k, self.percent = k, percent
        self.texts = rows.select("_id", "_tag", "doc_id", "text")
        self.described = stored(
            self.texts.mapInArrow(
                released(_describe(k)), "_id long, _tag long, doc_id long, n long, sid long, parts binary"
            ),
            "shingle-sets",
        )
        # one row stands for all whose sets are equal
        self.classes = stored(
            self.described.groupBy("sid").agg(
                F.min(F.struct("_id", "_tag", "doc_id")).alias("first"),
                F.first("n").alias("n"),
                F.first("parts").alias("parts"),
            ),
            "set-classes",
        )

    def groups(self) -> DataFrame:
        n = packed.bucket_count(self.texts)
        counted = packed.by_bucket(
            self.texts.mapInArrow(released(_counts(self.k, n)), packed.schema(2)), n
        ).mapInArrow(released(_frequent), "g long, n long")
        top = counted.orderBy(F.desc("n"), "g").limit(MAX_FREQUENT).select("g").collect()
        common = np.sort(np.array([r["g"] for r in top], dtype=np.int64).view(np.uint64))
        told = self.texts.sparkSession.sparkContext.broadcast(common)
        signed = self.texts.mapInArrow(
            released(_signatures(self.k, self.percent, told, n)), packed.schema(3)
        )
        return stored(
            packed.by_bucket(signed, n).mapInArrow(
                released(_groups(self.percent)), "sig long, a long, b long, times long, enough long"
            ),
            "signature-groups",
        )

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) that link."""
        side = self.classes.select("sid", "n", "parts")
        left = side.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("parts").alias("pa"))
        right = side.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("pb"))
        close = stored(
            pairs.join(left, "a")
            .join(right, "b")
            .where(
                f"100 * na >= {self.percent} * nb AND 100 * nb >= {self.percent} * na"
            )
            .select("a", "b", "na", "nb", "pa", "pb")
            .mapInArrow(released(_close(self.percent)), "a long, b long"),
            "close-pairs",
        )
        used = close.select(F.col("a").alias("sid")).union(close.select("b")).distinct()
        first = used.join(self.classes, "sid").select("first._id", "first._tag", F.lit(1).alias("_used"))
        first = broadcast_if_small(first, BROADCAST_ROWS)
        sets = stored(
            self.texts.join(first, ["_id", "_tag"])
            .select("text")
            .mapInArrow(released(_sets(self.k)), "sid long, tokens binary"),
            "token-sets",
        ).dropDuplicates(["sid"])
        left = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta"))
        right = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
        return stored(
            close.join(left, "a")
            .join(right, "b")
            .select("a", "b", "ta", "tb")
            .mapInArrow(released(_verify(self.percent)), "a long, b long"),
            "links",
        )

    def run(self) -> DataFrame:
        """All links that matter for components: every pair that shares a
        signature is linked, known not to link, or already connected."""
        groups = self.groups()
        pairs = (
            groups.where("b IS NOT NULL")
            .groupBy("a", "b")
            .agg(F.sum("times").alias("times"), F.min("enough").alias("enough"))
            .where("times >= enough")
            .select("a", "b")
        )
        many = groups.where("b IS NULL").select("sig", F.col("a").alias("sid"))
        links = self.verified(pairs)
        if not many.limit(1).count():
            return links
        for forest in (True, False):
            apart = self._apart(many, links)
            pairs = (
                self._paired(apart)
                .repartition("pair")
                .sortWithinPartitions("pair")
                .mapInArrow(released(_cross(self.percent, forest)), "a long, b long")
                .distinct()
            )
            links = stored(links.union(self.verified(stored(pairs, "crossed"))), "links")
        return links

    def _paired(self, apart: DataFrame) -> DataFrame:
        """The members of signatures, once for every pair of blocks that they
        are compared in: pair, side, sid, root, n, sigs, parts.

        Signatures that have the same least member come together, so that a
        pair that several of them hold is compared once. Members outside the
        commonest component are compared with all. Where there are more than
        BLOCK, blocks are cut by that, by size and by hash; sets in sizes
        that aren't next to each other can't link."""
        members = stored(
            apart.groupBy("key", "sid")
            .agg(F.collect_set("sig").alias("sigs"), F.first("root").alias("root"))
            .join(self.classes.select("sid", "n", "parts"), "sid"),
            "open-members",
        )
        roots = members.groupBy("key", "root").agg(F.count("*").alias("held"))
        keys = roots.groupBy("key").agg(
            F.max_by("root", F.struct("held", "root")).alias("commonest"), F.sum("held").alias("members")
        )
        ratio = math.log(100 / self.percent) + 1e-6
        placed = stored(
            members.join(keys, "key").select(
                *members.columns,
                "members",
                (F.col("root") != F.col("commonest")).alias("minor"),
                F.floor(F.log("n") / ratio).alias("band"),
            ),
            "placed-members",
        )
        out = ["pair", "side", "sid", "root", "n", "sigs", "parts"]
        whole = placed.where(F.col("members") <= BLOCK)
        whole = whole.withColumn("pair", F.col("key")).withColumn("side", F.when(F.col("minor"), 2).otherwise(1))
        many = placed.where(F.col("members") > BLOCK)
        of = ["key", "minor", "band"]
        counts = stored(
            many.groupBy(of).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "block-counts"
        )
        cut = many.join(counts, of).withColumn("block", F.pmod(F.xxhash64("sid"), "blocks"))
        blocks = counts.select(*of, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        left = blocks.where("minor").select("key", F.col("band").alias("band1"), F.col("block").alias("block1"))
        pairs = blocks.join(left, "key").where(
            "abs(band - band1) <= 1 AND (NOT minor OR struct(band1, block1) <= struct(band, block))"
        )
        same = F.expr("minor AND band = band1 AND block = block1")
        pairs = pairs.select(
            "*", same.alias("same"), F.xxhash64("key", "band1", "block1", "minor", "band", "block").alias("pair")
        )
        first = pairs.select(
            "pair",
            F.when(F.col("same"), 2).otherwise(0).alias("side"),
            "key",
            F.lit(True).alias("minor"),
            F.col("band1").alias("band"),
            F.col("block1").alias("block"),
        )
        second = pairs.where("NOT same").select("pair", F.lit(1).alias("side"), *of, "block")
        dealt = cut.join(first.union(second), [*of, "block"])
        return whole.select(out).union(dealt.select(out))

    def _apart(self, many: DataFrame, links: DataFrame) -> DataFrame:
        """Members of signatures whose members are not all connected; ``key``
        is the least member."""
        roots = components(links)
        placed = many.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
            "root", F.coalesce("root", "sid")
        )
        open_ = placed.groupBy("sig").agg(
            F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("sid").alias("key")
        )
        return stored(placed.join(open_.where("lo < hi").select("sig", "key"), "sig"), "apart")


def _placed(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """For identified rows: _id, _tag, doc_id, n, and _least, the first row
    (_id, _tag, doc_id) of the component."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50")
    join = _Join(rows, k, percent)
    roots = components(join.run())
    labelled = join.classes.where("n > 0").join(
        roots.withColumnRenamed("node", "sid"), "sid", "left"
    ).select("sid", F.coalesce("root", "sid").alias("root"), F.col("first").alias("_first"))
    least = labelled.groupBy("root").agg(F.min("_first").alias("_least"))
    named = labelled.join(least, "root").select("sid", "_least")
    row = ["_id", "_tag", "doc_id"]
    empty = join.described.where("n = 0").select(*row, "n", F.struct(*row).alias("_least"))
    full = join.described.where("n > 0").join(named, "sid").select(*row, "n", "_least")
    return empty.union(full)


def similar(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Link documents whose sets of distinct k-word shingles have
    100 * intersection >= percent * union, and number their components.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; a text of fewer than
    k words is one shingle, one without words has an empty set and links with
    nothing. Equal sets are one class and need no pairs. 64-bit hashes stand
    for shingles and for sets. A null id is smaller than all others; rows that
    share an id are texts of their own; other columns are left out.

    Returns doc_id, n_shingles, component_id (the least doc_id reachable).
    """
    bounded_batches(docs.sparkSession)
    return _placed(packed.identified(docs), k, percent).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("_least.doc_id").alias("component_id")
    )


def first_of_each(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``docs`` without the rows that are near copies: of each component the
    row with the least doc_id stays (of several with that id, the one with the
    least text hash; of rows equal in both, one), with all columns. Rows
    without words stay, but for repeated ones."""
    rows = packed.identified(docs.select("doc_id", "text"))
    extra = stored(
        _placed(rows, k, percent)
        .where("_id <> _least._id OR _tag <> _least._tag")
        .select("_id", "_tag")
        .distinct(),
        "near-copies",
    )
    again = packed.repeated(rows)
    kept = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(packed.NO_ID)).alias("_id"),
        (F.xxhash64("text") if again else F.lit(0).cast("long")).alias("_tag"),
        F.struct("*").alias("_row"),
    ).join(broadcast_if_small(extra, BROADCAST_ROWS), ["_id", "_tag"], "left_anti")
    if again:
        kept = kept.dropDuplicates(["_id", "_tag"])
    return kept.select("_row.*")

"""Words that are spelled alike: one edit apart, found by pivotal grams.

Every word has a prefix of its rarest bigrams, and two disjoint ones of them
are its pivots (chosen by dynamic programming, the least frequent pair). One
edit destroys at most one of two disjoint bigrams, so of two near words the
one whose prefix ends with the rarer bigram has a pivot that stands unharmed
in the other's prefix. An edit right of the first pivot leaves all letters up
to and with that pivot in place; any other edit leaves those from the second
pivot to the end. So pivots and prefixes are joined on these letters (which
fix the gram and its position from that side) and on lengths that differ by
one at most, and each pair met is verified.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import stored, text_slices

GRAM = 2
EDITS = 1
# Rarest bigrams that a word's prefix holds. GRAM * EDITS + 1 would do for two
# disjoint ones; with more to choose from, pivots lie further inside the word
# and fewer words share the letters outside them.
PREFIX = 6
MIN_LENGTH = 5
MIN_COUNT = 3
NOISE = 97  # a run whose hash this divides loses a letter
# Letters of runs once A-Z are in lower case: a-z, and U+00C0 to U+00FF, which
# are the UTF-8 bytes C3 80 to C3 BF. There are 90, so 8,100 bigrams at most.
RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_OWN = bytes(
    b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
HELD_WORDS = 400_000  # distinct words that a task counts before it writes them


def _runs(text: bytes) -> list[bytes]:
    """All runs of a text, A-Z in lower case."""
    parts = text.translate(_OWN).split()
    if text.isascii():
        return parts
    runs = [p for p in parts if p.isascii()]
    for p in parts:
        if not p.isascii():
            runs += RUNS.findall(p)
    return runs


def _letters(run: bytes) -> int:
    return len(run) - run.count(b"\xc3")


def _shortened(run: bytes, h: int) -> bytes:
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT
) -> DataFrame:
    """Distinct words of all texts with their occurrences (word, n).

    Words are the maximal runs [A-Za-z\\u00C0-\\u00FF]+ with A-Z lower-cased;
    a run whose crc32 of ``<doc_id>:<run>`` is divisible by 97 loses one
    letter. Null and empty texts have none; a null id reads as empty; repeated
    rows count each; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            kept = [(w, n) for w, n in held.items() if _letters(w) >= min_length]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([w for w, _ in kept], pa.binary()).cast(pa.string()),
                    pa.array([n for _, n in kept], pa.int64()),
                ],
                ["word", "n"],
            )

        for batch in batches:
            for part in text_slices(iter([batch]), "text"):
                texts = part.column(1).cast(pa.large_binary()).to_pylist()
                for key, text in zip(part.column(0).to_pylist(), texts):
                    if not text:
                        continue
                    runs = _runs(text)
                    start = zlib.crc32(b"%s:" % (b"" if key is None else str(key).encode()))
                    noisy = {
                        w: h for w in set(runs) if not (h := zlib.crc32(w, start)) % NOISE
                    }
                    held.update(runs)
                    if noisy:
                        for w, n in Counter(filter(noisy.__contains__, runs)).items():
                            held[w] -= n
                            held[_shortened(w, noisy[w])] += n
                    if len(held) > HELD_WORDS:
                        yield out()
        yield out()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word")
    return counted.agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def pivots(grams: list[tuple[int, list[float]]], k: int = EDITS + 1, q: int = GRAM) -> list[int]:
    """Positions of ``k`` disjoint grams of least total weight, in order.

    ``grams`` are (position, weights), by position; weights[t] counts where
    the gram is chosen as number t. best[j] is the least (weight, positions)
    of a choice of t + 1 grams that ends with gram j; ties go to the earliest
    positions.
    """
    best = [(w[0], (p,)) for p, w in grams]
    for t in range(1, k):
        least, at, longer = (math.inf, ()), 0, []
        for p, w in grams:
            while at < len(grams) and grams[at][0] + q <= p:
                least, at = min(least, best[at]), at + 1
            longer.append((least[0] + w[t], (*least[1], p)))
        best = longer
    return list(min(best)[1])


def _outer_shares(word: str, counts: dict[str, int], letters: dict[str, int]) -> list[list[float]]:
    """For every bigram of a word, the expected share of words that have the
    same letters up to it, and from it on, by the bigrams' frequencies."""
    steps = [counts[word[p : p + GRAM]] for p in range(len(word) - GRAM + 1)]
    heads, share = [], 1.0
    for p, n in enumerate(steps):
        share *= n / (letters[word[p]] if p else letters[""])
        heads.append(share)
    tails, share = [], 1.0
    for p in range(len(steps) - 1, -1, -1):
        share *= steps[p] / (letters[word[p + 1]] if p + 1 < len(steps) else letters[""])
        tails.append(share)
    return [list(x) for x in zip(heads, reversed(tails))]


def _signed(words: DataFrame, counts: dict[str, int], most: int) -> DataFrame:
    """Adds to each word its length, the places of its two pivots and of all
    bigrams of its prefix, and two masks: a bit for each letter, a bit for
    each bigram (both hashed)."""
    letters = Counter({"": sum(counts.values())})
    for gram, n in counts.items():
        letters[gram[0]] += n
        letters[gram[1]] += n  # about twice the letter's occurrences
    for c in letters:
        letters[c] = letters[c] if c == "" else max(1, letters[c] // 2)

    def signed(mask: int) -> int:
        return mask - (1 << 64) if mask >> 63 else mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, firsts, seconds, prefixes, bits, pairs = [], [], [], [], [], []
            for w in batch.column(0).to_pylist():
                ranked = sorted(
                    (counts[w[p : p + GRAM]], w[p : p + GRAM], p)
                    for p in range(len(w) - GRAM + 1)
                )
                # all bigrams that rank no later than the last of the prefix
                end = ranked[min(most, len(ranked)) - 1][:2]
                places = sorted(p for n, g, p in ranked if (n, g) <= end)
                shares = _outer_shares(w, counts, letters)
                a, b = pivots([(p, shares[p]) for p in places])
                lengths.append(len(w))
                firsts.append(a)
                seconds.append(b)
                prefixes.append(places)
                one = two = 0
                for x, y in zip(w, w[1:]):
                    one |= 1 << (ord(x) & 63)
                    two |= 1 << ((ord(x) * 31 + ord(y) * 7) & 63)
                bits.append(signed(one | 1 << (ord(w[-1]) & 63)))
                pairs.append(signed(two))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(lengths, pa.int32()),
                    pa.array(firsts, pa.int32()),
                    pa.array(seconds, pa.int32()),
                    pa.array(prefixes, pa.list_(pa.int32())),
                    pa.array(bits, pa.int64()),
                    pa.array(pairs, pa.int64()),
                ],
                ["word", "n", "len", "first", "second", "prefix", "bits", "pairs"],
            )

    return words.select("word", "n").mapInArrow(
        run,
        "word string, n long, len int, first int, second int, prefix array<int>, bits long,"
        " pairs long",
    )


def _head(p: Column, length: Column) -> Column:
    """Key of the letters up to and with the bigram at ``p``."""
    return F.xxhash64(F.lit("head"), F.substr("word", F.lit(1), p + F.lit(GRAM)), length)


def _tail(p: Column, length: Column) -> Column:
    """Key of the letters from the bigram at ``p`` on."""
    return F.xxhash64(F.lit("tail"), F.substr("word", p + F.lit(1)), length)


def near_words(words: DataFrame) -> DataFrame:
    """All pairs of words exactly one edit apart, each in both directions:
    a, n_a, b, n_b.

    ``words`` has distinct (word, n) with at least four letters of the
    alphabet above each. The edit may insert, delete or replace one letter.
    No pair is capped or left out: a key holds words that share a rare bigram
    and all letters on one side of it.
    """
    grams = words.select(
        F.explode(
            F.expr(
                f"transform(sequence(1, char_length(word) - {GRAM - 1}),"
                f" p -> substr(word, p, {GRAM}))"
            )
        ).alias("gram")
    )
    # at most 8,100 rows, by the alphabet
    counts = {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect()}
    signed = stored(_signed(words, counts, PREFIX), "signed-words")
    place = F.col("_p")
    held = signed.select(
        "word", "n", "bits", "pairs", "len", F.explode("prefix").alias("_p")
    ).select(
        F.col("word").alias("b"),
        F.col("n").alias("n_b"),
        F.col("bits").alias("_b"),
        F.col("pairs").alias("_bb"),
        F.explode(F.array(_head(place, F.col("len")), _tail(place, F.col("len")))).alias("_key"),
    )
    lengths = [F.col("len") + F.lit(d) for d in range(-EDITS, EDITS + 1)]
    asked = signed.select(
        F.col("word").alias("a"),
        F.col("n").alias("n_a"),
        F.col("bits").alias("_a"),
        F.col("pairs").alias("_aa"),
        F.explode(
            F.array(
                *[_head(F.col("first"), d) for d in lengths],
                *[_tail(F.col("second"), d) for d in lengths],
            )
        ).alias("_key"),
    )
    # one edit takes at most one letter and two bigrams away, and brings as many
    near = F.expr(
        f"bit_count(_a ^ _b) <= {2 * EDITS} AND bit_count(_aa ^ _bb) <= {2 * GRAM * EDITS}"
        f" AND a <> b AND levenshtein(a, b, {EDITS}) = {EDITS}"
    )
    met = asked.join(held, (asked["_key"] == held["_key"]) & near)
    one = F.col("a") < F.col("b")
    pairs = met.select(
        *[
            F.when(one, F.col(x)).otherwise(F.col(y)).alias(z)
            for x, y, z in (("a", "b", "a"), ("n_a", "n_b", "n_a"), ("b", "a", "b"), ("n_b", "n_a", "n_b"))
        ]
    ).distinct()
    return pairs.select(
        F.explode(
            F.array(
                F.struct("a", "n_a", "b", "n_b"),
                F.struct(
                    F.col("b").alias("a"), F.col("n_b").alias("n_a"),
                    F.col("a").alias("b"), F.col("n_a").alias("n_b"),
                ),
            )
        ).alias("_l")
    ).select("_l.*")


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """The last form of every word that has one (word, root).

    A form occurs at least twice as often as its word, so a chain has at most
    log2(most) steps; each round doubles the steps taken.
    """
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(max(2.0, math.log2(max(2, most))))))):
        roots = stored(roots, "word-roots")
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        roots = roots.join(on, "root", "left").select(
            "word", F.coalesce("_on", "root").alias("root")
        )
    return roots


def spelling_variants(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT
) -> DataFrame:
    """Words of ``docs`` (doc_id, text) grouped by spelling.

    A word's form is its most frequent near word (ties: the smallest in code
    points) if that occurs at least twice as often; its root follows the forms
    to the last. See ``word_counts`` for nulls, repeated rows and other
    columns; an empty table gives no row.

    Returns word, form, root, n, n_near, form_n.
    """
    least = GRAM * (EDITS + 1)
    if min_length < least:
        raise ValueError(f"words need at least {least} letters")
    words = stored(word_counts(docs, min_length, min_count), "words")
    most = words.agg(F.max("n")).first()[0] or 0
    best = F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("b")))
    near = near_words(words).groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), best.alias("_best")
    )
    chosen = (-F.col("_best.n")) >= 2 * F.col("n")
    judged = stored(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(chosen, F.col("_best.b")).alias("form"),
            F.when(chosen, -F.col("_best.n")).alias("form_n"),
        ),
        "judged-words",
    )
    roots = _roots(judged.where("form IS NOT NULL"), most)
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

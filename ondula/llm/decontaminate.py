"""Benchmark passages in documents, found by winnowed fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import ascii_lower, stored
from ondula.session import broadcast_if_small

WINDOW = 10  # words; shorter items are one window
GRAM = 5  # words of a hashed k-gram, or all of a shorter window
# Rows of 16 bytes (fingerprints, document keys) that may be broadcast.
BROADCAST_ROWS = 500_000


def item_words(text: Column) -> Column:
    """The words of a text as an array: A-Z in lower case, then runs of
    letters a-z, digits and everything beyond ASCII. Null has none."""
    words = F.split(
        ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    )
    return F.filter(words, lambda w: w != "")


def _grams(n: int) -> tuple[int, int]:
    """The k-gram length and the number of k-grams in a window of n words."""
    k = min(GRAM, n)
    return k, n - k + 1


def _hashes(n: int) -> Column:
    """Hashes of all k-grams of ``_words`` for windows of n words."""
    k, _ = _grams(n)
    gram = ", ".join(f"_words[i + {j}]" for j in range(k))
    return F.expr(
        f"CASE WHEN size(_words) < {n} THEN cast(array() AS array<bigint>) ELSE "
        f"transform(sequence(0, size(_words) - {k}), i -> xxhash64({gram})) END"
    )


def _minima(n: int) -> Column:
    """The least hash in every window of n words, from ``_h``."""
    _, w = _grams(n)
    return F.expr(
        "CASE WHEN size(_h) = 0 THEN _h ELSE "
        f"transform(sequence(0, size(_h) - {w}), s -> array_min(slice(_h, s + 1, {w}))) END"
    )


def item_windows(benchmark: DataFrame) -> DataFrame:
    """The windows of all items: item_id, n (words), window (words joined by a
    blank), fp (the least k-gram hash, which any equal window has too)."""
    words = benchmark.select("item_id", item_words(F.col("text")).alias("_words"))
    windows = words.where("size(_words) > 0").select(
        "item_id",
        F.expr(f"least({WINDOW}, size(_words))").alias("n"),
        F.expr(
            f"explode(transform(sequence(0, greatest(0, size(_words) - {WINDOW})), "
            f"s -> slice(_words, s + 1, {WINDOW})))"
        ).alias("_words"),
    )
    fp = F.lit(None).cast("long")
    for n in range(1, WINDOW + 1):
        k, w = _grams(n)
        grams = [
            "xxhash64(" + ", ".join(f"_words[{i + j}]" for j in range(k)) + ")" for i in range(w)
        ]
        least = F.expr(f"least({', '.join(grams)})" if w > 1 else grams[0])
        fp = F.when(F.col("n") == n, least).otherwise(fp)
    return windows.select("item_id", "n", F.array_join("_words", " ").alias("window"), fp.alias("fp"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text that tells rows of one id apart, words."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("_th"),
        item_words(F.col("text")).alias("_words"),
    )


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["_th"] == b["_th"])


def fingerprint_runs(words: DataFrame, lengths: list[int]) -> DataFrame:
    """Winnowing: a row for each run of windows with the same least k-gram
    hash: doc_id, _th, n, fp, first and last window of the run."""
    runs = []
    for n in lengths:
        least = words.select("doc_id", "_th", "_words", _hashes(n).alias("_h")).select(
            "doc_id", "_th", _minima(n).alias("_m")
        )
        starts = least.select(
            "*",
            F.expr(
                "CASE WHEN size(_m) > 0 THEN "
                "filter(sequence(0, size(_m) - 1), s -> s = 0 OR _m[s] <> _m[s - 1]) END"
            ).alias("_s"),
        )
        # outer, since a filter on the array would be pushed into the lambdas
        runs.append(
            starts.select("doc_id", "_th", "_m", "_s", F.posexplode_outer("_s").alias("_j", "first")).where("first IS NOT NULL").select(
                "doc_id",
                "_th",
                F.lit(n).alias("n"),
                F.expr("_m[first]").alias("fp"),
                "first",
                F.expr("coalesce(get(_s, _j + 1), size(_m)) - 1").alias("last"),
            )
        )
    out = runs[0]
    for more in runs[1:]:
        out = out.union(more)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Words of every document that stand in a window of a benchmark item.

    A window is 10 consecutive words of an item, or all words of a shorter
    one. Of every window's k-gram hashes the least is its fingerprint, so a
    document window equal to an item window has the same one: the join of
    fingerprints loses none. Hits extend to the windows of their run, and
    these are compared word for word.

    An item with a null id counts for the hit words but isn't listed; items
    of one id are listed once. Null and empty texts have no words; rows of
    ``docs`` each get a row, also repeated ones and those with a null id;
    other columns are left out. Without items nothing is hit.

    Returns doc_id, n_words, n_hit, items (ids as sorted strings), spans of
    hit words (start, stop), _th (the hash that tells rows of one id apart).
    """
    items = stored(item_windows(benchmark), "item-windows")
    lengths = [r["n"] for r in items.select("n").distinct().collect()]  # ten at most
    words = _keyed(docs)
    plain = words.select("doc_id", "_th", F.size("_words").cast("long").alias("n_words"))
    none = "cast(array() AS array<{}>)"
    if not lengths:
        return plain.select(
            "doc_id",
            "n_words",
            F.lit(0).cast("long").alias("n_hit"),
            F.expr(none.format("string")).alias("items"),
            F.expr(none.format("struct<start:int,stop:int>")).alias("spans"),
            "_th",
        )
    prints = broadcast_if_small(items.select("n", "fp").distinct(), BROADCAST_ROWS)
    hits = stored(
        fingerprint_runs(words, sorted(lengths))
        .join(prints, ["n", "fp"], "left_semi")
        .groupBy("doc_id", "_th")
        .agg(F.collect_set(F.struct("n", "first", "last")).alias("_runs")),
        "fingerprint-hits",
    )
    ids = broadcast_if_small(hits.select("doc_id", "_th"), BROADCAST_ROWS)
    near = words.join(ids, _same_row(words, ids), "left_semi")
    # rows that repeat hold the same words: one stands for all
    near = near.dropDuplicates(["doc_id", "_th"]).join(hits, _same_row(near, hits)).select(
        near["doc_id"], near["_th"], "_words", F.explode("_runs").alias("_run")
    )
    windows = near.select(
        "doc_id",
        "_th",
        F.col("_run.n").alias("n"),
        "_words",
        F.explode(F.sequence("_run.first", "_run.last")).alias("start"),
    ).select(
        "doc_id",
        "_th",
        "n",
        "start",
        F.array_join(F.slice("_words", F.col("start") + 1, F.col("n")), " ").alias("window"),
    )
    known = broadcast_if_small(items.select("n", "window").distinct())
    found = stored(windows.join(known, ["n", "window"], "left_semi"), "window-hits")
    spans = found.groupBy("doc_id", "_th").agg(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop"))))
        .alias("_spans")
    )
    listed = (
        found.select("doc_id", "_th", "n", "window")
        .distinct()
        .join(broadcast_if_small(items.select("n", "window", "item_id").distinct()), ["n", "window"])
        .groupBy("doc_id", "_th")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    hit = F.expr(
        "aggregate(_spans, struct(0 AS stop, 0L AS hit), (a, x) -> struct("
        "greatest(a.stop, x.stop) AS stop, a.hit + greatest(0, x.stop - greatest(a.stop, x.start))"
        " AS hit)).hit"
    )
    spans = spans.select("doc_id", "_th", "_spans", hit.alias("n_hit"))
    found_rows = spans.join(listed, _same_row(spans, listed)).select(
        spans["doc_id"], spans["_th"], "_spans", "n_hit", "items"
    )
    return plain.join(found_rows, _same_row(plain, found_rows), "left").select(
        plain["doc_id"],
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.expr(none.format("string"))).alias("items"),
        F.coalesce("_spans", F.expr(none.format("struct<start:int,stop:int>"))).alias("spans"),
        plain["_th"],
    )


def clean_only(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark window, with all columns."""
    hit = stored(
        contamination(docs, benchmark).where("n_hit > 0").select("doc_id", "_th").distinct(),
        "contaminated",
    )
    hit = broadcast_if_small(hit, BROADCAST_ROWS)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("_th"),
        F.struct("*").alias("_row"),
    )
    return rows.join(hit, _same_row(rows, hit), "left_anti").select("_row.*")

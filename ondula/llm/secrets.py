"""Secrets in texts: three patterns, and character Markov models that compare
how random a string looks with how ordinary identifiers are spelt."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed patterns; a match counts if the named group is long enough.
ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
    r"([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
KINDS = ["assign", "access", "hex", "markov"]

# Strings that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
UUID = "[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"  # an id, not a secret
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLE_RANDOM = 3000  # generated random strings of each shape
MIN_RATIO = 0.7  # mean log-likelihood ratio of a step (nats)
PLACEHOLDER = "[SECRET]"

_SPANS = "array<struct<start:bigint,kind:int,stop:bigint>>"
_BLOCK = 256


def prefix_sums(numbers: str) -> str:
    """SQL: for an array of integers, the sum of the elements before each.

    Sums of blocks first, so n elements cost about n * 128 + (n / 256)^2 / 2
    additions and nothing is copied.
    """
    total = "aggregate({}, 0L, (a, x) -> a + x)"
    blocks = (
        f"transform(sequence(0, (size({numbers}) - 1) div {_BLOCK}), b -> "
        + total.format(f"slice({numbers}, b * {_BLOCK} + 1, {_BLOCK})")
        + ")"
    )
    inner = total.format(f"slice(n, (i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK})")
    outer = total.format(f"slice(b, 1, i div {_BLOCK})")
    return (
        f"CASE WHEN size({numbers}) = 0 THEN cast(array() AS array<bigint>) ELSE "
        f"flatten(transform(array(struct({numbers} AS n, {blocks} AS b)), "
        f"s -> transform(s.n, (x, i) -> "
        + inner.replace("slice(n,", "slice(s.n,")
        + " + "
        + outer.replace("slice(b,", "slice(s.b,")
        + "))) END"
    )


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def matches(text: str, pattern: str, group: int = 0) -> str:
    """SQL: the leftmost non-overlapping matches of ``pattern`` in ``text`` as
    an array of (start, stop, value, gap): code points, end exclusive, the
    given group, and where the text since the match before begins.

    The pieces between matches and the matches themselves alternate, so their
    lengths add up to the positions. A last element with a null value stands
    for the end of the text.
    """
    p = _quoted(pattern)
    pieces = f"transform(split({text}, {p}, -1), x -> cast(length(x) AS bigint))"
    found = f"transform(regexp_extract_all({text}, {p}, 0), x -> cast(length(x) AS bigint))"
    values = f"regexp_extract_all({text}, {p}, {group})"
    steps = f"zip_with({pieces}, {found}, (g, m) -> g + coalesce(m, 0L))"
    return (
        f"flatten(transform(array(struct({pieces} AS g, {found} AS m, {values} AS v, "
        f"{steps} AS s)), q -> zip_with("
        f"transform({prefix_sums('q.s')}, (x, i) -> struct(x AS at, x + q.g[i] AS start, "
        f"x + q.g[i] + coalesce(get(q.m, i), 0L) AS stop)), q.v, "
        f"(a, v) -> struct(a.start AS start, a.stop AS stop, v AS value, a.at AS gap))))"
    )


def _spans_sql(found: str, kind: int, least: int) -> str:
    return (
        f"transform(filter({found}, m -> length(m.value) >= {least}), "
        f"m -> struct(m.start AS start, {kind} AS kind, m.stop AS stop))"
    )


def _none() -> Column:
    return F.array().cast(_SPANS)


def base_spans(docs: DataFrame) -> DataFrame:
    """Add ``_base`` (spans by start, then kind) and ``_assign`` (all matches
    of the assignment pattern) to rows with a non-null ``_text``. Only texts
    that contain a match at all are cut into positions."""
    assign = F.when(
        F.col("_text").rlike("(?i)password|passwd|secret|token|api_?key"),
        F.expr(matches("_text", ASSIGN, 2)),
    )
    access = F.when(
        F.col("_text").contains("AKIA"),
        F.expr(_spans_sql(matches("_text", ACCESS), 1, ACCESS_CHARS)),
    )
    # runs are maximal, so a long run is the same match as a long-enough one
    longer = f"[0-9a-f]{{{HEX_CHARS},}}"
    hexes = F.when(
        F.col("_text").rlike(longer),
        F.expr(_spans_sql(matches("_text", longer), 2, HEX_CHARS)),
    )
    marked = docs.withColumns({"_assign": assign, "_access": access, "_hex": hexes})
    own = F.when(
        F.col("_assign").isNotNull(), F.expr(_spans_sql("_assign", 0, ASSIGN_CHARS))
    )
    return marked.withColumn(
        "_base",
        F.sort_array(
            F.concat(
                F.coalesce(own, _none()),
                F.coalesce(F.col("_access"), _none()),
                F.coalesce(F.col("_hex"), _none()),
            )
        ),
    ).drop("_access", "_hex")


# ---- character models


def random_strings(spark: SparkSession) -> DataFrame:
    """Labelled random strings in the usual shapes: hex, base64, base 32."""
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    shapes = F.array(
        F.substring(digest, 1, 40),
        F.substring(F.base64(F.unhex(digest)), 1, 40),
        F.upper(F.substring(F.translate(F.base64(F.unhex(digest)), "+/=", "27"), 1, 24)),
    )
    return spark.range(SAMPLE_RANDOM).select(
        F.explode(shapes).alias("text"), F.lit(1).alias("is_random")
    )


def ordinary_strings(docs: DataFrame) -> DataFrame:
    """Labelled ordinary identifiers: the ASCII words of all documents, without
    those that hold a base secret."""
    words = docs.where("text IS NOT NULL").select(
        F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("text")
    )
    secret = F.col("text").rlike(f"AKIA[A-Z0-9]{{16}}|[0-9a-f]{{12}}|(?i)password|token")
    return words.where(~secret).select("text", F.lit(0).alias("is_random"))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of the steps between characters of ALPHABET, case
    folded, from labelled strings (text, is_random): a table of |ALPHABET|^2
    numbers, row by row. Counts are smoothed by one half."""
    n = len(ALPHABET)
    steps = (
        samples.where("length(text) > 1")
        .select("is_random", F.split(F.lower("text"), "").alias("c"))
        .select(
            "is_random",
            F.explode(F.expr("zip_with(c, slice(c, 2, size(c)), (a, b) -> concat(a, b))")).alias(
                "step"
            ),
        )
        .where("length(step) = 2")
        .groupBy("is_random", "step")
        .count()
        .collect()  # at most 2 * |ALPHABET|^2 rows from ASCII samples
    )
    counts = [[[0.5] * n for _ in range(n)] for _ in range(2)]
    for row in steps:
        a, b = (ALPHABET.find(c) for c in row["step"])
        if a >= 0 and b >= 0:
            counts[row["is_random"]][a][b] += row["count"]
    table = []
    for a in range(n):
        plain, wild = counts[0][a], counts[1][a]
        for b in range(n):
            table.append(
                math.log(wild[b] / sum(wild)) - math.log(plain[b] / sum(plain))
            )
    return table


def ratio(text: str) -> str:
    """SQL: the mean log-likelihood ratio of the steps of an ASCII string; the
    row holds the trained table as ``_table``."""
    n = len(ALPHABET)
    codes = f"transform(split(lower({text}), ''), c -> instr('{ALPHABET}', c) - 1)"
    return (
        f"flatten(transform(array({codes}), q -> array(aggregate(sequence(1, size(q) - 1), 0D, "
        f"(a, i) -> a + _table[q[i - 1] * {n} + q[i]]) / (size(q) - 1))))[0]"
    )


def secret_spans(docs: DataFrame) -> DataFrame:
    """Find secrets in every text of ``docs`` (doc_id, text).

    Base spans come from the patterns. Outside all assignments, strings of 20
    or more of ``A-Za-z0-9+/_=-`` with a letter and a digit that hold no base
    span are scored by the two models and added as kind markov from MIN_RATIO
    up. The models are trained on generated random strings and the words of
    all documents. A null or empty text has no span; repeated
    rows each get a row; other columns are left out.

    Returns doc_id, text, base, spans: arrays of (start, kind, stop) by start,
    then kind (an index of KINDS); code points, end exclusive.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _marked(rows)


def _marked(rows: DataFrame) -> DataFrame:
    """Add base and spans to rows with a column text."""
    table = train(random_strings(rows.sparkSession).unionByName(ordinary_strings(rows)))
    texts = rows.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    based = base_spans(texts).withColumn("_table", F.array(*[F.lit(x) for x in table]))
    # the stretches between assignments, each with its first position
    stretches = (
        "transform(coalesce(_assign, array(struct(cast(length(_text) AS bigint) AS start, "
        "cast(length(_text) AS bigint) AS stop, cast(NULL AS string) AS value, 0L AS gap))), "
        "m -> struct(m.gap AS at, substring(_text, cast(m.gap + 1 AS int), "
        "cast(m.start - m.gap AS int)) AS part))"
    )
    judged = (
        "c.value RLIKE '[A-Za-z]' AND c.value RLIKE '[0-9]' AND NOT c.value RLIKE "
        f"'AKIA[A-Z0-9]{{16}}|[0-9a-f]{{{HEX_CHARS}}}' AND NOT c.value RLIKE '^{UUID}$' AND {ratio('c.value')} >= {MIN_RATIO}D"
    )
    added = (
        f"flatten(transform({stretches}, p -> transform(filter({matches('p.part', CANDIDATE)}, "
        f"c -> c.value IS NOT NULL AND {judged}), "
        "c -> struct(p.at + c.start AS start, 3 AS kind, p.at + c.stop AS stop))))"
    )
    digits = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20}"
    spans = based.withColumn(
        "_added", F.when(F.col("_text").rlike(digits), F.expr(added))
    )
    return spans.select(
        *rows.columns,
        F.col("_base").alias("base"),
        F.sort_array(F.concat("_base", F.coalesce(F.col("_added"), _none()))).alias("spans"),
    )


def spans_text(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(
        f"array_join(transform({spans}, s -> concat_ws(':', array({kinds})[s.kind], "
        "s.start, s.stop)), ',')"
    )


def redact(found: DataFrame) -> DataFrame:
    """Replace the spans of ``secret_spans`` by PLACEHOLDER, overlapping ones
    by one: adds ``redacted`` (null where text is null)."""
    # a span starts a stretch unless an earlier one reaches beyond its start
    merged = (
        "aggregate(spans, cast(array() AS array<struct<start:bigint,stop:bigint>>), (a, s) -> "
        "CASE WHEN size(a) > 0 AND s.start < element_at(a, -1).stop THEN concat("
        "slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start AS start, "
        "greatest(element_at(a, -1).stop, s.stop) AS stop))) "
        "ELSE concat(a, array(struct(s.start AS start, s.stop AS stop))) END)"
    )
    pieces = (
        "transform(sequence(0, size(_merged)), i -> substring(text, "
        "cast(if(i = 0, 0L, _merged[i - 1].stop) + 1 AS int), "
        "cast(if(i = size(_merged), cast(length(text) AS bigint), get(_merged, i).start) "
        "- if(i = 0, 0L, _merged[i - 1].stop) AS int)))"
    )
    marked = found.withColumn("_merged", F.expr(merged))
    return marked.withColumn(
        "redacted",
        F.when(F.size("spans") == 0, F.col("text")).otherwise(
            F.expr(f"array_join({pieces}, '{PLACEHOLDER}')")
        ),
    ).drop("_merged")


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced, and ``n_chars``, if
    there is one, counted anew; all rows and columns stay."""
    rows = docs.select("text", F.struct("*").alias("_row"))
    clean = redact(_marked(rows))
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return clean.select(
        *[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns]
    )

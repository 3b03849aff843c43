"""The queries of the text operators, and their plain SQL where it exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ondula.llm import byte_bpe, classifier, decontaminate, html, linededup, negatives, repeats, rules, secrets, sharding, similar, spelling, tokens

QUERIES = {}
ORACLES: dict[str, str] = {}

SHARDS = 40
END_ID = 2


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_winnowed_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op1_winnowed_contamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n,
         array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s
        FROM b WHERE len(w) > 0)
), ns AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)
), hit AS (
  SELECT dw.doc_id, dw.n, dw.s, bw.item_id FROM dw JOIN bw USING (n, g)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("word_bpe_49k.json"),
        END_ID,
    )


@query
def op3_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


@query
def op4_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))

    def kind(k: int) -> Column:
        n = F.size(F.filter("base", lambda s: s["kind"] == k))
        return n.cast("long").alias(f"n_{secrets.KINDS[k]}")

    return found.select(
        "doc_id",
        *[kind(k) for k in range(3)],
        F.sha2(secrets.spans_text("base"), 256).alias("base_sha256"),
        secrets.spans_text("spans").alias("spans"),
    )


@query
def op5_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), digest=True).drop("spans")


ORACLES["op5_block_anchors"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)
), f AS (
  SELECT doc_id, s, min(doc_id) OVER (PARTITION BY g) AS m FROM g
), r AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM f WHERE m < doc_id
), k AS (
  SELECT t.doc_id, count(r.p) AS n_removed,
         string_agg(t.x, ' ' ORDER BY t.p) FILTER (r.p IS NULL) AS kept
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) t
  LEFT JOIN r USING (doc_id, p) GROUP BY t.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@query
def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.clean_lines(table(spark, sf_dir, "documents")).drop("lost_chars", "cleaned")


ORACLES["op6_line_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), l AS (
  SELECT doc_id, x, length(regexp_replace(x, '\s+', '', 'g')) AS ink
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), f AS (
  SELECT doc_id, x, ink,
         NOT regexp_matches(x, '[.!?…:]["''”’»)\]]*(\s|$)')
         OR len(regexp_extract_all(x, '[!#*$%&|<>=~^]')) * 100 > ink * {marks}
         OR len(regexp_extract_all(x, '\s[|›»•·/]\s')) >= {bars}
         OR regexp_matches(lower(x), '{stock}') AS fails
  FROM l
), n AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines,
         coalesce(sum(ink) FILTER (fails), 0) AS lost
  FROM f GROUP BY doc_id
), g AS (
  SELECT doc_id, s, array_to_string(w[s:s + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) >= 3)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(s, s + 3)) AS p
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1)
  GROUP BY doc_id
), a AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         length(array_to_string(w, '')) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(lost, 0) AS lost
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost <= {lost} * word_chars AS kept
FROM b
""".format(
    marks=rules.MARK_PERCENT,
    bars=rules.BARS,
    stock="|".join(rules.BOILERPLATE),
    lost=rules.LOST_PERCENT,
)


@query
def op7_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


@query
def op8_combination_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar(table(spark, sf_dir, "documents"), 3, 90)


@query
def op9_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return shards.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_byte_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


@query
def op11_pivotal_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query
def op12_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


@query
def op13_cuckoo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"), digest=True)


_KEY = r"translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op13_cuckoo_lines"] = f"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), l AS (
  SELECT doc_id, p, x, {_KEY} AS k
  FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS p FROM d)
), h AS (
  SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= {linededup.MIN_CHARS}
  GROUP BY k HAVING count(DISTINCT doc_id) >= {linededup.MIN_DOCS}
), f AS (
  SELECT doc_id, p, x, coalesce(last <> doc_id, false) AS gone FROM l LEFT JOIN h USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

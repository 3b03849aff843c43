"""Tab-headed numeric text files.

Lines are (source, pos, line), where ``pos`` is any column that orders the
lines of a source. Files are read line by line and split like any text, so one
huge file spreads over many tasks; nothing gathers a file in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ondula.functions.names import natural_key
from ondula.functions.values import data_tokens, has_number, header_tokens, is_number, to_double
from ondula.operators.segments import by_length, with_row_index
from ondula.session import broadcast_if_small, cut

# Rows of a source that one task numbers: they carry all their tokens.
MAX_ROWS = 500_000


def read_lines(spark: SparkSession, base: str, sources: list[str] | str) -> DataFrame:
    """Lines of the listed files below ``base`` (or of a glob pattern).

    ``pos`` is (start of the file split, running id): ids grow along a split,
    and splits are ordered by where they start. The scan of unchanged files is
    the same each time, so the ids are too.
    """
    names = [sources] if isinstance(sources, str) else list(sources)
    if not names:
        raise ValueError("no files listed (V01)")
    base = base.rstrip("/")
    lines = spark.read.option("lineSep", "\n").text([f"{base}/{name}" for name in names])
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    tail = base.split(":")[-1].lstrip("/")
    return lines.select(
        F.substr(path, F.instr(path, tail) + F.lit(len(tail) + 1)).alias("source"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
        ).alias("pos"),
        F.col("value").alias("line"),
    )


def header_ends(lines: DataFrame) -> DataFrame:
    """Per source, the position of the first line with a numeric token, NULL
    when there is none. Lines before it are header lines."""
    return lines.groupBy("source").agg(
        F.min(F.when(has_number(F.col("line")), F.col("pos"))).alias("first_numeric")
    )


def _with_ends(lines: DataFrame, ends: DataFrame | None) -> DataFrame:
    """Lines with the first numeric position of their source. A source has one
    row there, so the small side is broadcast while it is small: lines aren't
    shuffled by source, of which one may hold most of them."""
    if ends is None:
        ends = broadcast_if_small(cut(header_ends(lines)))
    return lines.join(ends, "source")


def columns(lines: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Header names (source, idx, column); successive header lines concatenate.

    Names of sources without any data have no idx: nothing is numbered there.
    """
    located = _with_ends(lines, ends)
    header = located.where(
        F.col("first_numeric").isNull() | (F.col("pos") < F.col("first_numeric"))
    )
    names = header.select(
        "source",
        F.col("pos").alias("_line"),
        F.col("first_numeric").isNotNull().alias("_has_data"),
        F.posexplode(header_tokens(F.col("line"))).alias("_at", "column"),
    )
    order = Window.partitionBy("source").orderBy("_line", "_at")
    numbered = names.where("_has_data").withColumn("idx", F.row_number().over(order) - 1)
    unnumbered = names.where(~F.col("_has_data")).withColumn("idx", F.lit(None).cast("int"))
    return numbered.unionByName(unnumbered).select("source", "idx", "column")


def data_rows(
    lines: DataFrame, drop_first_row: bool = True, ends: DataFrame | None = None
) -> DataFrame:
    """Data lines as tokens (source, pos, tokens).

    The first numeric line is dropped unless ``drop_first_row`` is false.
    """
    located = _with_ends(lines, ends)
    beyond = F.col("pos") > F.col("first_numeric")
    if not drop_first_row:
        beyond = F.col("pos") >= F.col("first_numeric")
    return located.where(beyond).select("source", "pos", data_tokens(F.col("line")).alias("tokens"))


def numbered_rows(rows: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Number the data rows of each source from zero, in ``row``."""
    return by_length(
        rows, ["source"], lambda df: with_row_index(df, ["source"], "row", "pos"), "pos", max_rows
    )


def cells(lines: DataFrame, drop_first_row: bool = True, max_rows: int = MAX_ROWS) -> DataFrame:
    """Long form (source, row, column, value). Each row meets the array of its
    source's names; tokens beyond them have no cell."""
    ends = broadcast_if_small(cut(header_ends(lines)))
    named = (
        columns(lines, ends)
        .where("idx IS NOT NULL")
        .groupBy("source")
        .agg(F.sort_array(F.collect_list(F.struct("idx", "column"))).alias("_c"))
        .select("source", F.col("_c.column").alias("_names"))
    )
    rows = numbered_rows(data_rows(lines, drop_first_row, ends), max_rows)
    tokens = rows.join(broadcast_if_small(cut(named)), "source").select(
        "source",
        "row",
        "_names",
        F.posexplode(F.slice("tokens", F.lit(1), F.size("_names"))).alias("_at", "_token"),
    )
    return tokens.select(
        "source",
        "row",
        F.get("_names", F.col("_at")).alias("column"),
        to_double(F.col("_token")).alias("value"),
    )


def column_catalog(lines: DataFrame) -> DataFrame:
    """Names per source with the key that puts them in natural order."""
    return columns(lines).select("source", "column").distinct().withColumn(
        "natural_key", natural_key(F.col("column"))
    )


def preview(cell_rows: DataFrame, head: int = 3) -> DataFrame:
    """Per column: the first values and the count."""
    first = F.collect_list(F.when(F.col("row") < head, F.struct("row", "value")))
    return cell_rows.groupBy("source", "column").agg(
        F.count(F.lit(1)).alias("n"),
        F.transform(F.sort_array(first), lambda r: r["value"]).alias("first_values"),
    )


def arity_problems(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Numbered rows whose token count differs from the header count."""
    headers = names.groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("n_headers"))
    counted = rows.withColumn("n_tokens", F.size("tokens")).join(headers, "source", "left")
    counted = counted.withColumn("n_headers", F.coalesce("n_headers", F.lit(0)))
    detail = F.format_string("row %s: %s tokens for %s headers", "row", "n_tokens", "n_headers")
    return counted.where(F.col("n_tokens") != F.col("n_headers")).select(
        "source", "row", "n_tokens", "n_headers", detail.alias("detail")
    )


def bad_tokens(rows: DataFrame) -> DataFrame:
    """Tokens of numbered rows that are not numbers."""
    tokens = rows.select("source", "row", F.posexplode("tokens").alias("idx", "token"))
    return tokens.where(~is_number(F.col("token")))


def suspicious_rows(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Data rows with an arity or number problem, found without numbering."""
    headers = names.groupBy("source").agg(F.count(F.lit(1)).alias("n_headers"))
    wrong = F.size("tokens") != F.coalesce("n_headers", F.lit(0))
    bad = F.exists("tokens", lambda t: ~is_number(t))
    return rows.join(headers, "source", "left").where(wrong | bad).drop("n_headers")


def duplicate_headers(names: DataFrame) -> DataFrame:
    """Names that occur more than once in a header."""
    counted = names.groupBy("source", "column").agg(F.count(F.lit(1)).alias("times"))
    return counted.where(F.col("times") > 1)

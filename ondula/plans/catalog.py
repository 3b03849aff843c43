"""The catalog of outputs, and summaries over it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ondula.functions.names import natural_key, output_path, spectrum_stage, x_label, y_label
from ondula.functions.tags import TAG_TYPES, tag_text, tag_type
from ondula.operators.segments import MAX_ROWS, by_length, with_row_index
from ondula.operators.sweep import sweep_bounds, sweep_indices
from ondula.plans.settings import PREPROCESSING, PROCESSING
from ondula.session import broadcast_if_small, cut
from ondula.sinks.stages import stage_folder


def tag_values(tags: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Distinct values per tag key in their natural order, from 0.

    ``tags`` has (key, value, ord), ord giving the order of the records. Values
    sort as integers, floats, natural strings or booleans when all of a key
    have that type, and else stay in first-seen order.
    """
    distinct = cut(tags.groupBy("key", "value").agg(F.min("ord").alias("ord")))
    kind = tag_type(F.col("value"))
    types = distinct.groupBy("key").agg(
        F.min(kind).alias("_low"), F.max(kind).alias("_high")
    )
    common = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise("mixed")
    typed = distinct.join(broadcast_if_small(types.select("key", common.alias("type"))), "key")
    is_type = {t: F.col("type") == t for t in TAG_TYPES}
    rank = F.struct(
        F.when(is_type["int"], F.col("value").try_cast("decimal(38,0)")).alias("as_int"),
        F.when(is_type["float"], F.col("value").try_cast("double")).alias("as_float"),
        F.when(is_type["string"], natural_key(tag_text(F.col("value")))).alias("as_text"),
        F.when(is_type["boolean"], F.col("value") == "true").alias("as_flag"),
        F.when(is_type["mixed"], F.col("ord")).alias("as_seen"),
        F.col("ord").alias("seen"),
    )
    ranked = typed.withColumn("_rank", rank)
    return by_length(
        ranked, ["key"], lambda df: with_row_index(df, ["key"], "position", "_rank"), "_rank", max_rows
    ).select("key", "type", "position", "value")


def explode_tags(files: DataFrame) -> DataFrame:
    """(key, value, ord) rows of files with ``tags`` and ``file_no``."""
    return files.select(F.explode("tags").alias("key", "value"), F.col("file_no").alias("ord"))


def _json_of(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def catalog(
    settings: DataFrame, project: dict, fft: dict | None, store: str | None = None,
    written: DataFrame | None = None,
) -> DataFrame:
    """One row per output of every resolved work item.

    Without a store it is made from the work list alone. With one, paths lead
    to its folders; ``written`` (stage, variable, file) limits it to outputs
    that exist. Where ``settings`` has ``n`` (the grid
    length) and ``x_left``/``x_right`` (the ends of the processed series), they
    fill interpolation_n and fft_domain.
    """
    has = settings.columns
    n = F.col("n") if "n" in has else F.lit(None).cast("bigint")
    none = F.lit(None)
    pre, pro = _json_of(*PREPROCESSING), _json_of(*PROCESSING)

    def output(stage, settings_json=none, length=none, domain=none, condition=F.lit(True)):
        record = F.struct(
            (stage if isinstance(stage, Column) else F.lit(stage)).alias("stage"),
            settings_json.cast("string").alias("settings"),
            length.cast("bigint").alias("interpolation_n"),
            domain.cast("array<double>").alias("fft_domain"),
        )
        return F.when(condition, record)

    resampled = F.col("interpolation").isNotNull()
    outputs = [
        output("unprocessed"),
        output("raw"),
        output("preprocessed", pre),
        output("inverted", condition=F.col("invert_x")),
        output("processed", pro, n, condition=resampled),
    ]
    rows = settings.withColumn("_o", F.explode(F.array_compact(F.array(*outputs))))
    if fft is not None:
        # a row per window, from a sequence: many steps don't make a long plan
        first, last = sweep_indices(fft["sweep"], fft.get("sweep_steps"))
        fft_json = F.to_json(F.struct(*[
            F.lit(fft.get(k)).alias(k)
            for k in ("zero_pad", "center", "hann", "truncate_lower", "truncate_upper",
                      "sweep", "sweep_steps")
            if fft.get(k) is not None
        ]))
        domain = none
        if "x_left" in has:
            lo, hi = sweep_bounds(
                fft["sweep"], fft.get("sweep_steps"), "_i", "x_left", "x_right", "invert_x"
            )
            domain = F.expr(f"array({lo}, {hi})")
        spectral_output = output(
            spectrum_stage(F.lit(fft["sweep"]), F.col("_i")), fft_json, domain=domain
        )
        windows = settings.withColumn("_i", F.explode(F.sequence(F.lit(first), F.lit(last))))
        rows = rows.unionByName(windows.withColumn("_o", spectral_output).drop("_i"))
    csv = project["format"] == "csv"
    fmt = F.lit("csv" if csv else "parquet")
    after_inversion = F.col("invert_x") & F.col("_o.stage").isin("processed")
    spectral = F.col("_o.stage").startswith("fft")
    if written is not None:
        there = written.select(
            F.col("stage").alias("_stage"), F.col("variable").alias("_variable"), F.col("file").alias("_file")
        )
        same = (
            (F.col("_o.stage") == F.col("_stage"))
            & (F.col("variable") == F.col("_variable"))
            & (F.col("dest") == F.col("_file"))
        )
        rows = rows.join(there, same, "left_semi")
    return rows.select(
        F.lit(project["title"]).alias("project"),
        "variable",
        F.col("dest").alias("file"),
        "_o.stage",
        fmt.alias("format"),
        (
            output_path(
                F.lit(project["title"]), F.col("variable"), F.col("_o.stage"), F.col("dest"), fmt
            )
            if store is None
            else stage_folder(store, csv, F.col("_o.stage"), F.col("variable"), F.col("dest"))
        ).alias("path"),
        F.when(spectral, "Frequency")
        .otherwise(x_label(F.col("x_col"), after_inversion))
        .alias("x_label"),
        F.when(spectral, "FFT Amplitude")
        .otherwise(y_label(F.col("variable"), F.col("y_col")))
        .alias("y_label"),
        "tags",
        "_o.settings",
        "_o.interpolation_n",
        "_o.fft_domain",
    )


def summary(stats: DataFrame, variables: list[str], tag_rows: DataFrame, version: str) -> DataFrame:
    """One JSON document: version, variables, grid statistics, ordered tags.

    ``stats`` has a row per variable and ``tag_rows`` one per distinct tag value.
    """
    grid = stats.agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.col("variable").cast("string"), F.col("n_var")))
        ).alias("max_per_variable"),
        F.max("n_var").alias("max"),
    ).select(F.struct("max_per_variable", "max").alias("interpolation_stats"), F.lit(1).alias("_one"))
    by_key = tag_rows.groupBy("key").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", "value"))), lambda r: r["value"]
        ).alias("values")
    )
    tags = by_key.agg(
        F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("tags")
    ).withColumn("_one", F.lit(1))
    document = F.to_json(
        F.struct(
            F.lit(version).alias("version"),
            "interpolation_stats",
            F.array(*[F.lit(v) for v in variables]).alias("variables"),
            "tags",
        )
    )
    return grid.join(tags, "_one").select(document.alias("metadata"))


def summary_lines(stats: DataFrame, variables: list[str], tag_rows: DataFrame, version: str) -> DataFrame:
    """The same as JSON lines, one per variable and one per tag key, so that no
    row holds all of them: section, key, and the value as JSON."""
    spark = stats.sparkSession
    head = spark.createDataFrame(
        [("version", None, json.dumps(version)), *[("variable", v, None) for v in variables]],
        "section string, key string, value string",
    )
    lengths = stats.select(
        F.lit("interpolation").alias("section"), F.col("variable").cast("string").alias("key"),
        F.col("n_var").cast("string").alias("value"),
    )
    top = stats.agg(F.max("n_var").cast("string").alias("value")).select(
        F.lit("interpolation").alias("section"), F.lit(None).cast("string").alias("key"), "value"
    )
    tags = tag_rows.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("position", "value"))).alias("_v")
    ).select(
        F.lit("tag").alias("section"), "key", F.to_json(F.col("_v.value")).alias("value")
    )
    return head.unionByName(lengths).unionByName(top).unionByName(tags)


def read_back(catalog_rows: DataFrame, stored: DataFrame, stage: str, tag: str, value: str) -> DataFrame:
    """Stored rows of one stage whose file carries a tag value."""
    wanted = catalog_rows.where(
        (F.col("stage") == stage) & (F.try_element_at("tags", F.lit(tag)) == value)
    )
    return stored.where(F.col("stage") == stage).join(
        wanted.select("variable", "file", "stage"), ["variable", "file", "stage"], "left_semi"
    )

"""Writing and reading stage outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ondula.operators.segments import MAX_ROWS, SEG, lay_out, segmented

# Samples that one packed row may hold.
PACK_ROWS = 1_000_000


def write_stage(rows: DataFrame, path: str, stage: str, order: str = "x") -> None:
    """Store one stage, as one dataset that any series can be read from.

    Files lie below stage and variable, and are range-partitioned and sorted by
    (file, order), so a reader of one series prunes by row-group statistics and
    a million series don't become a million directories. The range partitioning
    also splits a hot series over several files.
    """
    out = rows.drop(SEG)
    (
        out.repartitionByRange("variable", "file", order)
        .sortWithinPartitions("variable", "file", order)
        .write.mode("overwrite")
        .partitionBy("variable")
        .parquet(f"{path}/stage={stage}")
    )


def write_spectra(rows: DataFrame, path: str) -> None:
    """Store spectra (with a column ``stage``) as stages of their own."""
    (
        rows.drop(SEG)
        .repartitionByRange("stage", "variable", "file", "frequency")
        .sortWithinPartitions("stage", "variable", "file", "frequency")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("stage", "variable")
        .parquet(path)
    )


def read_spectra(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All stored spectra, whatever their stage."""
    stored = spark.read.schema(schema).option("basePath", path).parquet(f"{path}/stage=fft*")
    return stored.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


# The characters that Spark writes as %XX in names of folders.
ESCAPED = "%\"#'*/:=?\\{[]^\x7f"


def folder_name(value: Column) -> Column:
    """A partition value as Spark spells it in a path."""
    for c in ESCAPED:
        value = F.replace(value, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return value


def stage_folder(store: str, csv: bool, stage: Column, variable: Column, file: Column) -> Column:
    """Where one output of a store lies; a Parquet folder holds all files of
    its variable, a CSV folder one."""
    parts = [F.lit(f"{store}/csv" if csv else store), F.concat(F.lit("stage="), folder_name(stage)),
             F.concat(F.lit("variable="), folder_name(variable))]
    if csv:
        parts.append(F.concat(F.lit("file="), folder_name(file)))
    return F.concat_ws("/", *parts)


def read_stage(
    spark: SparkSession, path: str, stage: str, schema: StructType | None = None
) -> DataFrame:
    """Read a stage back. A schema is needed for a stage that may be empty."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    stored = reader.parquet(f"{path}/stage={stage}")
    return stored.withColumn("variable", F.col("variable").cast("string"))


def write_csv(
    rows: DataFrame, path: str, stage: str | None, x: str = "x", y: str = "y"
) -> None:
    """``x,y`` lines without a header, one directory per variable and file
    (and per ``stage`` of the rows if none is given).

    Doubles are written in a spelling that reads back to the same value.
    """
    stages = F.col("stage") if stage is None else F.lit(stage)
    (
        rows.select(
            stages.alias("stage"), "variable", "file", F.col(x).alias("x"), F.col(y).alias("y")
        )
        .repartitionByRange("stage", "variable", "file", "x")
        .sortWithinPartitions("stage", "variable", "file", "x")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("stage", "variable", "file")
        .csv(path, header=False)
    )


def pack_pairs(samples: DataFrame, keys: list[str], max_rows: int = PACK_ROWS) -> DataFrame:
    """Rows (keys, part, x[], y[]) with both arrays ascending in x.

    A series that fits in ``max_rows`` is one row; longer ones are cut into
    several parts, numbered in the order of x, so no row grows without bound.
    """
    short, long = lay_out(samples.drop(SEG), keys, max_rows=min(max_rows, MAX_ROWS))

    def pack(df: DataFrame) -> DataFrame:
        pairs = F.sort_array(F.collect_list(F.struct("x", "y")))
        part = F.col(SEG) if segmented(df) else F.lit(0)
        grouped = df.withColumn("part", part).groupBy(*keys, "part").agg(pairs.alias("_p"))
        return grouped.select(
            *keys,
            "part",
            F.transform("_p", lambda p: p["x"]).alias("x"),
            F.transform("_p", lambda p: p["y"]).alias("y"),
        )

    return pack(short) if long is None else pack(short).unionByName(pack(long))


def unpack_pairs(packed: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse of :func:`pack_pairs`: one row per sample."""
    pairs = F.explode(F.arrays_zip("x", "y")).alias("_p")
    return packed.select(*keys, pairs).select(*keys, "_p.x", "_p.y")

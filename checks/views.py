"""Series seen in the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEYS = ["series"]

# Time zone independent hours since 2024-01-01 of a zoneless timestamp.
_MICROS = (
    "unix_date(to_date(ts)) * 86400000000L + hour(ts) * 3600000000L"
    " + minute(ts) * 60000000L + cast(date_part('SECOND', ts) * 1000000 AS bigint)"
)
HOURS = f"({_MICROS}) / 1e6 / 3600 - 473352"
HOURS_SQL = "epoch_us(ts) / 1e6 / 3600 - 473352"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: one series per user, x in hours."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS series", f"{HOURS} AS x", "value AS y"
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EH: as E, with x cut to whole hours, which repeats some of them."""
    return events(spark, sf_dir).selectExpr("series", "floor(x) + 1.0D AS x", "y")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: one series per return flag and line status, x in days."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('|', l_returnflag, l_linestatus) AS series",
        "CAST(date_diff(to_date(l_shipdate), DATE '1990-01-01') AS double) AS x",
        "l_extendedprice AS y",
    )


E = f"SELECT user_id AS series, {HOURS_SQL} AS x, value AS y FROM events"
EH = f"SELECT series, floor(x) + 1.0 AS x, y FROM ({E})"
L = (
    "SELECT l_returnflag || '|' || l_linestatus AS series,"
    " CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS x,"
    " l_extendedprice AS y FROM lineitem"
)


def unique(view: str) -> str:
    return f"SELECT series, x, avg(y) AS y FROM ({view}) GROUP BY series, x"


def six_sql(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.5) / 1e6"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round to six places, the same way in both engines."""
    return df.selectExpr(
        *[f"floor({c} * 1e6D + 0.5D) / 1e6D AS {c}" if c in columns else c for c in df.columns]
    )

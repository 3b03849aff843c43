"""Session helpers: reliable lineage cuts, parameters, parallelism."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Rows (of some hundred bytes) that every executor may hold a copy of.
BROADCAST_ROWS = 50_000
# Bytes of a record batch that Spark hands to a Python task.
BATCH_BYTES = 4 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    A private folder is made only for a local master (tests, notebooks); on a
    cluster an unset folder is an error, because executors must share it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ondula-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def bounded_batches(spark: SparkSession, max_bytes: int = BATCH_BYTES) -> None:
    """Bound the record batches of Python tasks by bytes, not only by rows,
    for this session: 10,000 texts or series at once may be any size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(max_bytes))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so later recomputation can't change it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a table of narrow rows for broadcast when counting shows it is
    small; a larger one joins by shuffle, where AQE splits hot keys."""
    if df.limit(max_rows + 1).count() > max_rows:
        return df
    return F.broadcast(df)


def observed(observation: Observation, name: str):
    """An observed metric, or None where the plan was so empty that nothing
    was observed."""
    try:
        return observation.get[name]
    except (Py4JJavaError, KeyError):
        return None


def sql_value(value, dtype: str = "double") -> str:
    """SQL for a parameter: a Python value, ``None``, or a SQL expression over
    the columns of the series (most often just a column name)."""
    if value is None:
        return f"CAST(NULL AS {dtype})"
    if isinstance(value, str):
        return f"CAST({value} AS {dtype})"
    if isinstance(value, bool):
        return str(value).lower()
    return f"CAST('{value!r}' AS {dtype})"


def parallelism(spark: SparkSession) -> int:
    """Tasks for a shuffle whose size says little about the work behind it."""
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, spark.sparkContext.defaultParallelism)

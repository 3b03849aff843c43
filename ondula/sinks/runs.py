"""Runs that become visible at once.

Every run writes below a folder of its own, ``<root>/runs/<id>``; its row in
``<root>/manifest`` is appended last, as one file that appears by a rename.
Readers start from the newest row, so a run that stopped halfway is never
seen, and the catalog of the one before it stays valid.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run bigint, id string, folder string, outputs bigint"


def published(spark: SparkSession, root: str) -> DataFrame:
    """The manifest: a row for each finished run, none before the first."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def current(spark: SparkSession, root: str) -> dict | None:
    """The newest finished run; two that finish as the same number are told
    apart by their ids."""
    rows = published(spark, root).orderBy(F.desc("run"), F.desc("id")).take(1)
    return rows[0].asDict() if rows else None


def publish(spark: SparkSession, root: str, run: Callable[[str], DataFrame]) -> dict:
    """Call ``run`` with a new folder, write the catalog that it returns there,
    and make the run the current one. If anything fails, nothing changes."""
    before = current(spark, root)
    name = uuid.uuid4().hex
    folder = f"{root}/runs/{name}"
    catalog = run(folder)
    catalog.write.parquet(f"{folder}/published")
    outputs = spark.read.parquet(f"{folder}/published").count()
    row = (before["run"] + 1 if before else 1, name, folder, outputs)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(
        f"{root}/manifest"
    )
    return dict(zip(("run", "id", "folder", "outputs"), row))


def open_catalog(spark: SparkSession, root: str) -> DataFrame:
    """The catalog of the current run."""
    run = current(spark, root)
    if run is None:
        raise FileNotFoundError(f"no finished run below {root}")
    return spark.read.parquet(f"{run['folder']}/published")

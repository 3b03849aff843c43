"""Queries over text files that are written from the tables first."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import functions as F

from checks.config import _DIRTY, _HEADERS, _NUMBER, _line
from checks.core import register
from checks.views import table
from ondula.operators.columns import locate_pairs
from ondula.session import cut, parallelism, shared_folder
from ondula.sources.tabbed import checked_samples, file_names, file_rows, row_violations

# Events per file: a file of one type holds those of so many consecutive ids.
FILE_EVENTS = 2000
_FILE = "event_type || '_' || CAST(event_id {div} {n} AS {s})"
_PAIRS = [("V", "time (h)", "value"), ("U", "event id", "user"), ("W", "time (h)", "absent")]
SPLIT = 10_000


def written_files(spark, d, tail=_DIRTY):
    """Write the events as files of text below a new shared folder; returns
    the folder and the names of the files."""
    e = table(spark, d, "events").withColumn(
        "file", F.expr(_FILE.format(div="DIV", n=FILE_EVENTS, s="string"))
    )
    data = e.selectExpr("file", "10 + event_id AS pos", f"{_line(tail, chr(9), 'spark')} AS line")
    header = ", ".join(f"struct({i}L AS pos, '{h}' AS line)" for i, h in enumerate(_HEADERS))
    heads = e.select("file").distinct().selectExpr(
        "file", f"inline(array({header})) AS (pos, line)"
    )
    folder = shared_folder(spark, "text-files")
    (
        heads.unionByName(data)
        .repartition(parallelism(spark), "file")
        .sortWithinPartitions("file", "pos")
        .select("file", "line")
        .write.partitionBy("file")
        .text(folder)
    )
    files, root = fs.FileSystem.from_uri(folder.replace("file:/", "/", 1) if folder.startswith("file:/") else folder)
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    names = [i.path[len(root) + 1 :] for i in found if i.path.endswith(".txt")]
    return folder, sorted(names)


def file_of(column):
    return F.regexp_extract(column, "file=([^/]+)/", 1)


def judged(spark, d):
    folder, names = written_files(spark, d)
    work = spark.createDataFrame(
        [(n, v, x, y) for n in names for v, x, y in _PAIRS],
        "source string, variable string, x_col string, y_col string",
    ).withColumn("file", file_of("source"))
    located = locate_pairs(work, cut(file_names(spark, folder, names)))
    rows = file_rows(spark, folder, names, split_bytes=SPLIT)
    return checked_samples(rows, located, ["variable", "file"])


def _rows_sql():
    """Data rows of every file, with the offsets of their lines."""
    name = _FILE.format(div="//", n=FILE_EVENTS, s="varchar")
    heads = " UNION ALL ".join(
        f"SELECT DISTINCT {name} AS file, {i} AS pos, '{h}' AS line FROM events"
        for i, h in enumerate(_HEADERS)
    )
    return f"""
      SELECT file, byte AS "offset", string_split_regex(trim(line), '[ \\t]+') AS tokens
      FROM (SELECT *, min(CASE WHEN pos >= 10 THEN pos END) OVER (PARTITION BY file) AS first
            FROM (SELECT *, CAST(sum(octet_length(encode(line)) + 1)
                            OVER (PARTITION BY file ORDER BY pos) AS BIGINT)
                            - octet_length(encode(line)) - 1 AS byte
                  FROM (SELECT {name} AS file, 10 + event_id AS pos,
                               {_line(_DIRTY, chr(9), 'duck')} AS line FROM events
                        UNION ALL {heads})))
      WHERE pos > first"""


def _cell(i: int) -> str:
    token = f"tokens[{i}]"
    return f"CASE WHEN regexp_matches({token}, '{_NUMBER}') THEN CAST({token} AS DOUBLE) END"


register(
    "file_samples",
    f"""WITH r AS ({_rows_sql()})
        SELECT 'V' AS variable, file, "offset", {_cell(1)} AS x, {_cell(2)} AS y FROM r
        UNION ALL SELECT 'U', file, "offset", {_cell(4)}, {_cell(3)} FROM r""",
    lambda spark, d: judged(spark, d).where("variable IS NOT NULL").select(
        "variable", "file", "offset", "x", "y"
    ),
)
register(
    "file_problems",
    f"""WITH r AS ({_rows_sql()})
        SELECT file, 'V04' AS code, 'error' AS severity,
               'byte ' || "offset" || ': ' || len(tokens) || ' tokens for 5 names' AS detail
        FROM r WHERE len(tokens) <> 5
        UNION ALL SELECT file, 'V05', 'error', 'byte ' || "offset" || ': token ' || token
        FROM (SELECT file, "offset", unnest(tokens) AS token FROM r)
        WHERE NOT regexp_matches(token, '{_NUMBER}')""",
    lambda spark, d: row_violations(judged(spark, d).where("variable IS NULL")).select(
        file_of("key").alias("file"), "code", "severity", "detail"
    ),
)

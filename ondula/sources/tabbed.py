"""Tab-headed text files as a Spark data source.

``spark.read.format("tabbed")`` cuts every file into byte ranges. A range owns
the lines that begin in it; its task also reads the file's header, so each row
knows where it stands (file and byte offset) and how many names the header has.
A task takes as many ranges, of several files, as make up its share of bytes.
Nothing is joined or numbered, rows are the same for any size of the ranges,
and one pass gives the samples and what is wrong with them.

Options: ``files`` (a JSON list of names), ``base`` (a folder or URI that
pyarrow opens), ``split_bytes``, ``tasks`` (at least so many, if there are as
many ranges), and ``part``: ``rows`` for the data lines
(source, offset, line, n_headers, first) or ``header`` for the names
(source, idx, column), which reads no more than the heads of the files.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ondula.functions.values import DECIMAL, LINE_SPACE, SPECIAL, data_tokens, is_number, to_double
from ondula.operators.quality import check
from ondula.session import broadcast_if_small, cut, parallelism

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT_BYTES = 64 << 20
READ_BYTES = 4 << 20  # bytes that a task takes from a file at a time
HEAD_BYTES = 64 << 10
OPEN_BYTES = 256 << 10  # bytes that could be read while a file is opened
SCHEMAS = {
    "rows": "source string, offset bigint, line string, n_headers int, first boolean",
    "header": "source string, idx int, column string",
}
_INNER_SPACE = LINE_SPACE.replace("\t", "")
# the pattern of values.has_number, in Python's spelling
_NUMBER = re.compile(
    rf"(?:^|\t)[{_INNER_SPACE}]*(?:{DECIMAL}|[+-]?(?:nan|inf|infinity))[{_INNER_SPACE}]*(?:\t|\Z)",
    re.IGNORECASE,
)


@dataclass
class Range:
    source: str
    start: int
    stop: int


@dataclass
class Ranges(InputPartition):
    ranges: list[Range]


def _dealt(ranges: list[Range], tasks: int) -> list[Ranges]:
    """Ranges that follow one another, together up to the bytes of a task."""
    costs = [OPEN_BYTES + r.stop - r.start for r in ranges]
    share = min(SPLIT_BYTES + OPEN_BYTES, max(OPEN_BYTES, sum(costs) // max(1, tasks)))
    out: list[Ranges] = []
    held = share
    for one, cost in zip(ranges, costs):
        if held + cost > share:
            out.append(Ranges([]))
            held = 0
        out[-1].ranges.append(one)
        held += cost
    return out


def _opened(base: str, name: str):
    """A file below a folder or URI, for reading at any place."""
    place = f"{base.rstrip('/')}/{name}" if base else name
    if re.match(r"file:/(?!/)", place):  # as Spark spells local paths
        place = place.removeprefix("file:")
    files, path = fs.FileSystem.from_uri(place)
    return files, path


def _blocks(file, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Whole lines that begin in [start, stop), some MB at a time, each block
    with the offset of its first byte."""
    at = start
    if start:
        file.seek(start - 1)
        at, rest = start - 1, b""
        while True:  # to the first line that begins here
            more = file.read(HEAD_BYTES)
            cut = more.find(b"\n")
            if not more or cut >= 0:
                break
            at += len(more)
        if not more or at + cut + 1 >= stop:
            return
        rest, at = more[cut + 1 :], at + cut + 1
    else:
        file.seek(0)
        rest = b""
    while at < stop:
        more = file.read(READ_BYTES)
        block = rest + more
        end = len(block) if not more else block.rfind(b"\n") + 1
        if at + end > stop:
            # the last line is the one that holds the last owned byte
            last = block.find(b"\n", stop - at - 1)
            end = last + 1 if last >= 0 else (len(block) if not more else 0)
        if end:
            yield at, block[:end]
            at += end
        rest = block[end:]
        if not more:
            return


def _lines_of(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every line of a block of whole lines."""
    ends = np.flatnonzero(np.frombuffer(block, np.uint8) == 0x0A) + 1
    if not len(ends) or ends[-1] < len(block):
        ends = np.append(ends, len(block))
    return np.concatenate([[0], ends[:-1]]), ends


def _head(file, stop: int) -> tuple[list[str], int | None]:
    """Names of the header lines before the first line with a number, and the
    offset of that line; None where no line that begins before ``stop`` has one."""
    names: list[str] = []
    for at, block in _blocks(file, 0, stop):
        starts, ends = _lines_of(block)
        for a, b in zip(starts.tolist(), ends.tolist()):
            line = block[a:b].decode("utf-8", "replace").strip(LINE_SPACE)
            if _NUMBER.search(line):
                return names, at + a
            names += [n for n in (t.strip(LINE_SPACE) for t in line.split("\t")) if n]
    return names, None


class TabbedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.base = options.get("base", "")
        self.files = json.loads(options["files"])
        self.part = options.get("part", "rows")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.tasks = int(options.get("tasks", 1))

    def partitions(self) -> list[Ranges]:
        out = []
        for name in self.files:
            files, path = _opened(self.base, name)
            info = files.get_file_info(path)
            if info.type != fs.FileType.File:
                raise FileNotFoundError(f"no file {name} below {self.base}")
            if self.part == "header":  # no more than the head is read
                out.append(Range(name, 0, info.size))
                continue
            out += [
                Range(name, a, min(a + self.split, info.size))
                for a in range(0, max(1, info.size), max(1, self.split))
            ]
        return _dealt(out, self.tasks)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for one in partition.ranges:
            yield from self.read_range(one)

    def read_range(self, range: Range) -> Iterator[pa.RecordBatch]:
        files, path = _opened(self.base, range.source)
        with files.open_input_file(path) as file:
            names, first = _head(file, range.stop)
            if self.part == "header":
                idx = [None if first is None else i for i, _ in enumerate(names)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "source": pa.array([range.source] * len(names), pa.string()),
                        "idx": pa.array(idx, pa.int32()),
                        "column": pa.array(names, pa.string()),
                    }
                )
                return
            if first is None:
                return
            for at, block in _blocks(file, max(range.start, first), range.stop):
                starts, ends = _lines_of(block)
                n = len(starts)
                edges = np.append(starts, ends[-1]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([range.source], pa.string()).take(pa.array(np.zeros(n, np.int32))),
                        pa.array(at + starts),
                        # lines keep their newline, which counts as white space
                        pa.StringArray.from_buffers(n, pa.py_buffer(edges), pa.py_buffer(block)),
                        pa.array(np.full(n, len(names), np.int32)),
                        pa.array(at + starts == first),
                    ],
                    ["source", "offset", "line", "n_headers", "first"],
                )


class TabbedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tabbed"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("part", "rows")]

    def reader(self, schema) -> TabbedReader:
        return TabbedReader(dict(self.options))


def _load(spark: SparkSession, base: str, sources: list[str], part: str, split: int) -> DataFrame:
    if not sources:
        raise ValueError("no files listed (V01)")
    spark.dataSource.register(TabbedText)
    return (
        spark.read.format("tabbed")
        .option("base", base)
        .option("files", json.dumps(list(dict.fromkeys(sources))))
        .option("part", part)
        .option("split_bytes", split)
        .option("tasks", parallelism(spark))
        .load()
    )


def file_names(spark: SparkSession, base: str, sources: list[str]) -> DataFrame:
    """Header names (source, idx, column) from the heads of the files; names
    of files without any data have no idx."""
    return _load(spark, base, sources, "header", SPLIT_BYTES)


def file_rows(
    spark: SparkSession, base: str, sources: list[str], drop_first_row: bool = True,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Data lines of the listed files: source, offset, tokens, n_headers.

    The first numeric line is dropped unless ``drop_first_row`` is false.
    """
    rows = _load(spark, base, sources, "rows", split_bytes)
    if drop_first_row:
        rows = rows.where(~F.col("first"))
    return rows.select("source", "offset", data_tokens(F.col("line")).alias("tokens"), "n_headers")


def checked_samples(rows: DataFrame, located: DataFrame, keys: list[str]) -> DataFrame:
    """Samples and problems in one pass over the rows of :func:`file_rows`.

    Rows (source, offset, n_tokens, n_headers, bad, keys, x, y): one for each
    work item of the row's source, and one with null keys for each row that is
    at fault: whose tokens aren't as many as the header's names, or aren't all
    numbers (``bad`` lists those).
    """
    wanted = cut(
        located.where("x_idx IS NOT NULL AND y_idx IS NOT NULL")
        .groupBy("source")
        .agg(F.collect_list(F.struct(*keys, "x_idx", "y_idx")).alias("_items"))
    )
    judged = rows.select(
        "source",
        "offset",
        "tokens",
        F.size("tokens").alias("n_tokens"),
        "n_headers",
        F.filter("tokens", lambda t: ~is_number(t)).alias("bad"),
    )
    wrong = (F.col("n_tokens") != F.col("n_headers")) | (F.size("bad") > 0)
    nothing = F.struct(
        *[F.lit(None).cast("string").alias(k) for k in keys],
        *[F.lit(None).cast("int").alias(c) for c in ("x_idx", "y_idx")],
    )
    items = F.concat(
        F.coalesce("_items", F.array().cast(wanted.schema["_items"].dataType)),
        F.when(wrong, F.array(nothing)).otherwise(F.array().cast(wanted.schema["_items"].dataType)),
    )
    return judged.join(broadcast_if_small(wanted), "source", "left").select(
        "source", "offset", "n_tokens", "n_headers", "bad", "tokens", F.explode(items).alias("_i")
    ).select(
        "source",
        "offset",
        "n_tokens",
        "n_headers",
        "bad",
        *[F.col(f"_i.{k}").alias(k) for k in keys],
        to_double(F.get("tokens", F.col("_i.x_idx"))).alias("x"),
        to_double(F.get("tokens", F.col("_i.y_idx"))).alias("y"),
    )


def row_violations(judged: DataFrame) -> DataFrame:
    """V04 and V05 from the rows with a source, an offset, their numbers of
    tokens and names, and the tokens that are no numbers."""
    at = F.concat(F.lit("byte "), F.col("offset"), F.lit(": "))
    counted = F.concat(at, F.col("n_tokens"), F.lit(" tokens for "), F.col("n_headers"), F.lit(" names"))
    tokens = judged.select("source", "offset", F.explode("bad").alias("token"))
    return check(judged, ["source"], [("V04", F.col("n_tokens") != F.col("n_headers"), counted)]).unionByName(
        check(tokens, ["source"], [("V05", F.lit(True), F.concat(at, F.lit("token "), F.col("token")))])
    )

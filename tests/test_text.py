import inspect
import json
import math

import pytest
from conftest import collect

from ondula.functions.names import natural_key, sanitise_name
from ondula.functions.values import format_length, parse_length, to_double
from ondula.operators.columns import extract_pairs, locate_pairs, rename_columns
from ondula.sources import tabbed, text
from pyspark.sql import functions as F

FILES = {
    "plain.dat": "Pos(mm)\tch_a\tch_b\n0\t0\t0\n1\t2 3\n4 5\t6\n7 8 9\n",
    "spaced.dat": "Depth (km)\t ch x \r\n\r\nmore\n9\t9 9\n1 2 3\n-.5 +1e1 inf\n",
    "headeronly.dat": "a\tb\nc\n",
    "short.dat": "a\tb\n0\t0\n1 2\n3\n4 5 6\n",
    "blank.dat": "a\tb\n0\t0\n\n1 2\n",
    "bad.dat": "a\tb\n0\t0\n1.5f 2\nabc 3\n",
    "dup.dat": "a\tb\ta\n0\t0 0\n1 2 3\n",
}


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("text files")
    for name, content in FILES.items():
        (base / name).write_text(content, newline="")
    return text.read_lines(spark, str(base), list(FILES)).cache()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("text files")
    for name, content in FILES.items():
        (base / name).write_text(content, newline="")
    (base / "empty.dat").write_text("")
    long = "\n".join(f"{i}\t{i} {'9' * (i % 400)}" for i in range(3000))
    (base / "long.dat").write_text("a\tb\n" + "deep\t" * 30_000 + "\n\n" + long)
    return str(base)


@pytest.mark.parametrize("split", [1, 3, 7, 64, 1000, 1 << 20])
def test_ranges_of_any_size_give_the_same_rows(spark, lines, folder, split):
    names = [*FILES, "empty.dat"]
    rows = tabbed.file_rows(spark, folder, names, split_bytes=split)
    got = sorted((r["source"], r["tokens"]) for r in rows.collect())
    assert got == sorted((r["source"], r["tokens"]) for r in text.data_rows(lines).collect())
    every = tabbed.file_rows(spark, folder, names, False, split)
    for r in every.collect():
        rest = FILES[r["source"]].encode()[r["offset"] :].decode()
        assert rest.split("\n")[0].split() == r["tokens"]


def test_long_files_and_heads(spark, folder):
    for split in (5000, 100_000, 64 << 20):
        rows = tabbed.file_rows(spark, folder, ["long.dat"], split_bytes=split).collect()
        assert len(rows) == 2999 and {r["n_headers"] for r in rows} == {30_002}
        assert len({r["offset"] for r in rows}) == 2999
    names = tabbed.file_names(spark, folder, list(FILES))
    with pytest.raises(ValueError, match="V01"):
        tabbed.file_rows(spark, folder, [])
    with pytest.raises(Exception, match="nosuch.dat"):
        tabbed.file_rows(spark, folder, ["nosuch.dat"]).collect()
    assert names.where("source = 'headeronly.dat' AND idx IS NULL").count() == 3


def test_names_by_either_scan(spark, lines, folder):
    got = tabbed.file_names(spark, folder, list(FILES))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        map(tuple, text.columns(lines).collect()), key=repr
    )


def test_one_pass_gives_samples_and_problems(spark, folder):
    names = ["short.dat", "bad.dat", "plain.dat"]
    work = spark.createDataFrame(
        [("short.dat", "s", "v", "a", "b"), ("bad.dat", "t", "v", "b", "a"), ("bad.dat", "t", "w", "b", "b")],
        "source string, file string, variable string, x_col string, y_col string",
    )
    located = locate_pairs(work, tabbed.file_names(spark, folder, names))
    judged = tabbed.checked_samples(tabbed.file_rows(spark, folder, names), located, ["variable", "file"])
    samples = judged.where("file IS NOT NULL").select("file", "variable", "offset", "x", "y")
    assert collect(samples, "file", "variable", "offset") == [
        ("s", "v", 8, 1, 2), ("s", "v", 12, 3, None), ("s", "v", 14, 4, 5),
        ("t", "v", 8, 2, None), ("t", "v", 15, 3, None), ("t", "w", 8, 2, 2), ("t", "w", 15, 3, 3),
    ]
    found = tabbed.row_violations(judged.where("file IS NULL"))
    assert collect(found.select("key", "code", "detail"), "code", "detail") == [
        ("short.dat", "V04", "byte 12: 1 tokens for 2 names"),
        ("short.dat", "V04", "byte 14: 3 tokens for 2 names"),
        ("bad.dat", "V05", "byte 15: token abc"),
        ("bad.dat", "V05", "byte 8: token 1.5f"),
    ]


def test_sources_keep_their_names(lines):
    assert {r[0] for r in lines.select("source").distinct().collect()} == set(FILES)


def test_an_empty_list_is_an_error(spark):
    with pytest.raises(ValueError, match="V01"):
        text.read_lines(spark, "/tmp", [])


def test_headers(lines):
    got = {}
    for source, idx, column in collect(text.columns(lines), "source", "idx", "column"):
        got.setdefault(source, []).append((idx, column))
    assert got["plain.dat"] == [(0, "Pos(mm)"), (1, "ch_a"), (2, "ch_b")]
    assert got["spaced.dat"] == [(0, "Depth (km)"), (1, "ch x"), (2, "more")]
    assert got["headeronly.dat"] == [(None, "a"), (None, "b"), (None, "c")]
    assert collect(text.duplicate_headers(text.columns(lines)), "column") == [("dup.dat", "a", 2)]


def test_the_first_numeric_line_is_dropped(lines):
    plain = lines.where("source = 'plain.dat'")
    cells = collect(text.cells(plain), "row", "column")
    assert [c[1:] for c in cells if c[2] == "Pos(mm)"] == [(0, "Pos(mm)", 1), (1, "Pos(mm)", 4), (2, "Pos(mm)", 7)]
    assert text.cells(plain, drop_first_row=False).count() == 12
    preview = {r[1]: tuple(r[2:]) for r in text.preview(text.cells(plain)).collect()}
    assert preview["ch_b"] == (3, [3.0, 6.0, 9.0])


def test_row_numbers_do_not_depend_on_segments(lines):
    rows = text.data_rows(lines.where("source = 'plain.dat'"))
    got = collect(text.numbered_rows(rows, max_rows=1).select("row", "tokens"), "row")
    assert got == [(0, ["1", "2", "3"]), (1, ["4", "5", "6"]), (2, ["7", "8", "9"])]


def test_arity_and_token_problems(lines):
    rows = text.numbered_rows(text.data_rows(lines))
    details = {(r["source"], r["detail"]) for r in text.arity_problems(rows, text.columns(lines)).collect()}
    assert details == {
        ("short.dat", "row 1: 1 tokens for 2 headers"),
        ("short.dat", "row 2: 3 tokens for 2 headers"),
        ("blank.dat", "row 0: 0 tokens for 2 headers"),
    }
    assert {r["token"] for r in text.bad_tokens(rows).collect()} == {"1.5f", "abc"}
    found = text.suspicious_rows(text.data_rows(lines), text.columns(lines))
    assert {r[0] for r in found.select("source").collect()} == {"short.dat", "blank.dat", "bad.dat"}


def test_rename_runs_in_order_and_never_overwrites(lines):
    names = text.columns(lines.where("source = 'plain.dat'"))
    rules = [("Pos(mm)", "Q"), ("Q", "C"), ("ch_a", "C"), ("nosuch", "D"), ("ch_b", "ch_b")]
    got = collect(rename_columns(names, rules).select("idx", "column", "clash"), "idx")
    assert got == [(0, "C", None), (1, "ch_a", "C"), (2, "ch_b", None)]


def test_extract_skips_missing_columns(spark, lines):
    work = spark.createDataFrame(
        [("plain.dat", "f", "u", "Pos(mm)", "ch_b"), ("plain.dat", "f", "v", "Pos(mm)", "zz")],
        "source string, file string, variable string, x_col string, y_col string",
    )
    located = locate_pairs(work, text.columns(lines))
    out = extract_pairs(text.data_rows(lines), located, ["variable", "file"])
    assert collect(out, "x") == [("u", "f", 1, 3), ("u", "f", 4, 6), ("u", "f", 7, 9)]
    assert {r["variable"]: r["y_found"] for r in located.collect()} == {"u": True, "v": False}


def test_numbers(spark):
    tokens = ["1", "-.5", "5.", "+1e-3", "1e", "1.5f", "3D", ".", "", "NaN", "-inf", "Infinity", "0x1", "+nan"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    got = [r[0] for r in df.select(to_double(F.col("t"))).collect()]
    assert got[:9] == [1, -0.5, 5, 1e-3, None, None, None, None, None]
    assert math.isnan(got[9]) and got[10:12] == [-math.inf, math.inf]
    assert got[12] is None and math.isnan(got[13])


def test_names_and_lengths(spark):
    names = ["", "é", ".x", "a/", "a b\t\r\nc", "dir/x", "x\\"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(sanitise_name(F.col("n"))).collect()]
    assert got == [None, None, None, None, "a_b__c", "dir/x", None]
    shown = spark.createDataFrame([("1000",), ("2^10",), ("2^x",), ("-1",)], "n string")
    lengths = shown.select(parse_length(F.col("n")).alias("n"))
    assert [r[0] for r in lengths.collect()] == [1000, 1024, None, None]
    assert [r[0] for r in lengths.select(format_length(F.col("n"))).collect()] == ["1000", "2^10", None, None]
    tags = spark.createDataFrame([(t,) for t in ["12K", "2K", "1p3K", "10p0K", "4.2K"]], "t string")
    order = [r[0] for r in tags.orderBy(natural_key(F.col("t"))).collect()]
    assert order == ["1p3K", "2K", "4.2K", "10p0K", "12K"]


def test_tasks_hold_several_ranges(tmp_path):
    """Many small files make few tasks, which hold every byte once."""
    for i in range(300):
        (tmp_path / f"f{i}.dat").write_text("a\tb\n" + "1\t2\n" * (i + 1))
    names = [f"f{i}.dat" for i in range(300)]
    options = {"base": str(tmp_path), "files": json.dumps(names), "split_bytes": "100", "tasks": "8"}
    reader = tabbed.TabbedReader(options)
    tasks = reader.partitions()
    assert 8 <= len(tasks) <= 17
    ranges = [(r.source, r.start, r.stop) for t in tasks for r in t.ranges]
    assert len(ranges) == len(set(ranges)) > 1500
    for name in names:
        own = sorted((a, b) for n, a, b in ranges if n == name)
        assert own[0][0] == 0 and own[-1][1] == (tmp_path / name).stat().st_size
        assert all(a[1] == b[0] for a, b in zip(own, own[1:]))
    assert sum(b.num_rows for t in tasks for b in reader.read(t)) == 300 * 301 // 2
    assert 8 <= len(tabbed.TabbedReader({**options, "part": "header"}).partitions()) <= 9


def test_a_task_numbers_a_bounded_part_of_a_source():
    """Rows carry their tokens, so fewer fit a task than samples do."""
    for f in (text.numbered_rows, text.cells):
        assert inspect.signature(f).parameters["max_rows"].default <= 500_000

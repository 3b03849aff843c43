import json
import math

import numpy as np
import pytest

import brute
from ondula.operators.quality import QualityError
from ondula.plans.analysis import publish_template, run_template
from ondula.plans.catalog import read_back
from ondula.plans.template import TemplateError, parse_template
from ondula.sinks.runs import current, open_catalog, publish, published
from ondula.sinks.stages import pack_pairs, read_stage, unpack_pairs

TEMPLATE = """
[project]
title = "Deep Water"
format = "csv"
[preprocessing.global]
impulse_filter = 5
masks = [ {left = 5, right = 5.5} ]
trim_left = 3
trim_right = 15
invert_x = true
[preprocessing.Load]
prefactor_y = -2
[preprocessing."site/run_1".Load]
impulse_filter = 0
[processing.global]
interpolation = "linear"
[processing."site/run_1"]
interpolation = "steffen"
interpolation_n = "2^7"
[processing.nosuch]
derivative = 1
[fft]
zero_pad = "2^11"
truncate_upper = 400
sweep = "upper"
sweep_steps = 2
[rename]
"Depth (km)" = "depth"
ch_a = "Drift"
ch_b = "Load"
[extract.Load]
x = "depth"
y = "Load"
[extract.Drift]
x = "depth"
y = "Drift"
[extract.Ghost]
x = "depth"
y = "absent"
[[file]]
source = "f0.dat"
dest = "site/run 0"
salinity = "10p0g"
[[file]]
source = "f1.dat"
dest = "site/run 1"
salinity = "1p3g"
"""


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    base, store = tmp_path_factory.mktemp("in"), tmp_path_factory.mktemp("out")
    data = {}
    rng = np.random.default_rng(5)
    for f in (0, 1):
        x = np.round(np.linspace(2, 16, 150) + rng.uniform(0, 0.02, 150), 6)
        cols = [x, np.round(np.sin(600 / x), 6), np.round(np.cos(400 / x), 6)]
        data[f] = [c[1:] for c in cols]
        body = "\n".join("\t".join(str(v) for v in row) for row in zip(*cols))
        (base / f"f{f}.dat").write_text("Depth (km)\tch_a\tch_b\n" + body + "\n")
    result = run_template(spark, parse_template(TEMPLATE), str(base), str(store), max_rows=60)
    return result, data, str(store)


def expected(data, f, variable):
    x, y = data[f][0], data[f][1 if variable == "Drift" else 2]
    if not (f == 1 and variable == "Load"):
        y = brute.impulse(y, 5, 1.0)
    x, y = brute.trim(*brute.mask(x, y, 5, 5.5), 3, 15)
    return 1 / x[::-1], (y * (-2 if variable == "Load" else 1))[::-1]


def length(x):
    dx = np.sort(np.abs(np.diff(x)))
    return math.ceil((x[-1] - x[0]) / dx[2])


def test_stages_and_spectra_match_brute_force(run):
    result, data, store = run
    pairs = [(f, v) for f in (0, 1) for v in ("Load", "Drift")]
    n = {}
    for v in ("Load", "Drift"):
        # only file 0 has an automatic length
        n[v] = length(expected(data, 0, v)[0])
    stats = {r["variable"]: r["n_var"] for r in result.interp_stats.collect()}
    assert stats == n
    inverted = result.stages["inverted"]
    spectra = result.spectra.cache()
    for f, v in pairs:
        x, y = expected(data, f, v)
        here = f"variable = '{v}' AND file = 'site/run_{f}'"
        got = [(r["x"], r["y"]) for r in inverted.where(here).orderBy("x").collect()]
        np.testing.assert_allclose(got, np.column_stack([x, y]), rtol=1e-12)
        at = brute.grid(x, 128 if f == 1 else max(n.values()))
        value = brute.steffen(x, y, at) if f == 1 else np.interp(at, x, y)
        pl, pr = 1 / at[-1], 1 / at[0]
        for i in (1, 2):
            lo, hi = 1 / (pl + i * (pr - pl) / 2), 1 / pl
            a, b = brute.index_of(at, lo), brute.index_of(at, hi)
            want = brute.spectrum(value[a:b], 2048)
            rows = spectra.where(f"{here} AND sweep_index = {i}").orderBy("frequency").collect()
            dt = at[a + 1] - at[a]
            assert len(rows) == min(math.ceil(400 * dt * 2048), 1025)
            np.testing.assert_allclose(
                [r["amplitude"] for r in rows], want[: len(rows)], atol=1e-9
            )
            np.testing.assert_allclose(
                [r["frequency"] for r in rows], np.arange(len(rows)) / (dt * 2048), rtol=1e-9
            )


def test_violations_are_reported(run):
    found = {(r["code"], r["key"]) for r in run[0].violations.collect()}
    assert ("V33", "nosuch") in found
    assert {k for c, k in found if c == "V06"} == {"Ghost/site/run_0", "Ghost/site/run_1"}
    assert not {c for c, _ in found} & {"V10", "V14", "V20"}


def test_catalog_and_summary(spark, run):
    result, _, store = run
    rows = result.catalog.collect()
    assert len(rows) == 4 * 7
    for r in rows:  # every path leads to an output of its own
        assert r["path"].startswith(f"{store}/csv/stage={r['stage']}/variable={r['variable']}/file=site%2Frun_")
        assert spark.read.csv(r["path"]).count() > 0, r["path"]
    label = {(r["stage"], r["x_label"], r["y_label"]) for r in rows if r["variable"] == "Load"}
    assert ("processed", "1/depth", "Load (Load)") in label and ("raw", "depth", "Load (Load)") in label
    document = json.loads(result.summary.first()[0])
    assert document["tags"] == {"salinity": ['"1p3g"', '"10p0g"']}
    assert document["variables"] == ["Drift", "Ghost", "Load"]
    stored = read_stage(spark, store, "raw").selectExpr("*", "'raw' AS stage")
    back = read_back(result.catalog, stored, "raw", "salinity", '"1p3g"')
    assert {r[0] for r in back.select("file").distinct().collect()} == {"site/run_1"}
    fft = read_stage(spark, store, "fft_sweep_upper_2").selectExpr("*", "'fft_sweep_upper_2' AS stage")
    back = read_back(result.catalog, fft, "fft_sweep_upper_2", "salinity", '"10p0g"')
    want = result.spectra.where("sweep_index = 2 AND file = 'site/run_0'")
    assert back.count() == want.count() > 0 and back.select("amplitude").exceptAll(want.select("amplitude")).isEmpty()
    csv = spark.read.option("header", False).csv(f"{store}/csv/stage=raw")
    assert csv.count() == read_stage(spark, store, "raw").count()


def test_strict_mode_stops_at_bad_files(spark, tmp_path):
    (tmp_path / "f0.dat").write_text("Depth (km)\tch_a\tch_b\n1\t1 1\n2 2 2\n3 3\n")
    (tmp_path / "f1.dat").write_text("Depth (km)\tch_a\tch_b\n1\t1 1\n2 2 2\n3 x 3\n")
    with pytest.raises(QualityError, match="V04 f0.dat") as error:
        run_template(spark, parse_template(TEMPLATE), str(tmp_path), str(tmp_path / "out"))
    assert "V05 f1.dat" in str(error.value)


def test_lenient_mode_goes_on_without_bad_files(spark, tmp_path):
    good = "\n".join(f"{2 + i / 10}\t{math.sin(i)} {math.cos(i)}" for i in range(150))
    (tmp_path / "f0.dat").write_text("Depth (km)\tch_a\tch_b\n" + good + "\n")
    (tmp_path / "f1.dat").write_text("Depth (km)\tch_a\tch_b\n1\t1 1\n2 2 2\n3 x 3\n")
    result = run_template(spark, parse_template(TEMPLATE), str(tmp_path), str(tmp_path / "out"), strict=False)
    assert {r["file"] for r in result.catalog.collect()} == {"site/run_0"}
    assert {r["code"] for r in result.violations.where("severity = 'error'").collect()} == {"V05"}


def test_lines_of_spaced_numbers_are_headers(spark, tmp_path):
    # only TABs separate header tokens, so this file has no data at all
    for f in (0, 1):
        (tmp_path / f"f{f}.dat").write_text("Depth (km)\tch_a\tch_b\n1 1 1\n2 2 2\n")
    with pytest.raises(QualityError, match="V07"):
        run_template(spark, parse_template(TEMPLATE), str(tmp_path), str(tmp_path / "out"))


@pytest.mark.parametrize(
    "old,new,code",
    [
        ('title = "Deep Water"', 'title = ".x"', "V22"),
        ('dest = "site/run 1"', 'dest = "site/run_0"', "V21"),
        ('zero_pad = "2^11"', 'zero_pad = "1000"', "V20"),
        ("sweep_steps = 2", "sweep_steps = 1", "V23"),
        ("sweep_steps = 2", "", "V23"),
        ('interpolation_n = "2^7"', 'interpolation_n = "2^x"', "V23"),
        ("derivative = 1", "derivative = 3", None),
        ('ch_b = "Load"', "ch_b = 1", "V30"),
        ('y = "absent"', "", "V30"),
        ("[project]", "[projects]", "V30"),
        ("impulse_filter = 5", "impulse_tuning = -1", "V23"),
    ],
)
def test_template_errors(old, new, code):
    with pytest.raises(TemplateError) as error:
        parse_template(TEMPLATE.replace(old, new, 1))
    assert code is None or error.value.code == code


def test_templates_without_files_or_extracts():
    head, _, _ = TEMPLATE.partition("[[file]]")
    with pytest.raises(TemplateError, match="V01"):
        parse_template(head)
    with pytest.raises(TemplateError, match="V30"):
        parse_template(TEMPLATE.replace("[extract.", "[extracted."))


def test_override_levels():
    got = {(o["dest"], o["variable"]): o for o in parse_template(TEMPLATE).overrides}
    assert got[("site/run_1", "Load")]["impulse_filter"] == 0
    assert got[(None, "Load")]["prefactor_y"] == -2.0
    assert got[("site/run_1", None)]["interpolation"] == "steffen"
    assert got[("nosuch", None)]["derivative"] == 1


def test_packing_cuts_long_series(series):
    x = np.arange(50.0)
    df = series({"a": (x, x * 2), "b": ([1, 0], [5, 6])})
    packed = pack_pairs(df, ["k"], max_rows=12)
    parts = packed.where("k = 'a'").orderBy("x").collect()
    assert len(parts) > 3 and sum([list(p["x"]) for p in parts], []) == list(x)
    assert packed.where("k = 'b'").first()["y"] == [6, 5]
    assert unpack_pairs(packed, ["k"]).exceptAll(df).isEmpty()


def test_a_run_that_stops_halfway_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "root")
    assert current(spark, root) is None
    with pytest.raises(FileNotFoundError):
        open_catalog(spark, root)

    def good(names):
        return lambda folder: spark.createDataFrame([(n,) for n in names], "stage string")

    def bad(folder):
        spark.range(3).write.parquet(f"{folder}/stage=raw")
        raise RuntimeError("stopped")

    assert publish(spark, root, good(["raw"]))["run"] == 1
    with pytest.raises(RuntimeError):
        publish(spark, root, bad)
    assert [r[0] for r in open_catalog(spark, root).collect()] == ["raw"]
    done = publish(spark, root, good(["raw", "fft"]))
    assert (done["run"], done["outputs"]) == (2, 2) and current(spark, root)["id"] == done["id"]
    assert open_catalog(spark, root).count() == 2 and published(spark, root).count() == 2


def test_published_templates(spark, tmp_path):
    body = "\n".join(f"{2 + i / 10}\t{math.sin(i)} {math.cos(i)}" for i in range(150))
    for f in (0, 1):
        (tmp_path / f"f{f}.dat").write_text("Depth (km)\tch_a\tch_b\n" + body + "\n")
    root = str(tmp_path / "root")
    result = publish_template(spark, parse_template(TEMPLATE), str(tmp_path), root)
    rows = open_catalog(spark, root)
    assert rows.count() == result.catalog.count() == 4 * 7
    folder = current(spark, root)["folder"]
    about = spark.read.json(f"{folder}/metadata").collect()
    assert {(r["section"], r["key"]) for r in about} >= {("variable", "Ghost"), ("tag", "salinity")}
    (bad := tmp_path / "f1.dat").write_text(bad.read_text() + "1 2\n")
    with pytest.raises(QualityError, match="V04"):
        publish_template(spark, parse_template(TEMPLATE), str(tmp_path), root)
    assert open_catalog(spark, root).drop("tags").exceptAll(rows.drop("tags")).isEmpty()

import numpy as np
import pytest

from ondula.operators import quality
from ondula.operators.spectrum import spectrum, windowed
from ondula.operators.sweep import sweep_domains, sweep_series
from ondula.plans.analysis import Analysis
from ondula.plans.settings import FIELDS
from pyspark.sql import functions as F


def test_a_violation_concerns_its_own_keys(spark):
    rows = spark.createDataFrame([("a/b", "c"), ("a", "b/c"), ("d", "e")], "variable string, file string")
    keys = ["variable", "file"]
    found = quality.check(rows, keys, [("V07", F.col("variable") == "a/b", "few")])
    kept = quality.drop_failed(rows, found, keys)
    assert {tuple(r) for r in kept.collect()} == {("a", "b/c"), ("d", "e")}
    deeper = quality.check(
        rows.withColumn("sweep_index", F.lit(3)), [*keys, "sweep_index"],
        [("V32", F.col("variable") == "d", "few")],
    )
    assert {r["variable"] for r in quality.drop_failed(rows, deeper, keys).collect()} == {"a/b", "a"}


def test_every_window_is_listed(series):
    x = [0, 0.1, 0.2, 0.3, 5, 9.9, 10]
    df = series({"s": (x, np.arange(7))})
    got = {r["sweep_index"]: (r["n_data"], r["dt"]) for r in sweep_domains(df, ["k"], "windows", 9).collect()}
    assert sorted(got) == list(range(9))
    for i, (n, dt) in got.items():
        inside = [v for v in x if i <= v < min(i + 2, 10)]
        assert n == len(inside)
        assert dt == (pytest.approx(inside[1] - inside[0]) if n > 1 else None)
    codes = quality.spectrum_violations(sweep_domains(df, ["k"], "windows", 9), ["k"], 16)
    assert codes.where("code = 'V32'").count() == sum(n < 2 for n, _ in got.values()) > 0


@pytest.mark.parametrize("method", ["bins", "grouped", "split"])
def test_negative_cutoff_is_zero(series, method):
    x = np.linspace(0, 1, 17)
    df = series({"s": (x, np.sin(9 * x))})
    prepared = windowed(sweep_series(df, ["k"]).withColumnRenamed("k", "key"), ["key"])
    low = spectrum(prepared, ["key"], 16, -2.0, 4.0, method).select("k", "amplitude").orderBy("k").collect()
    zero = spectrum(prepared, ["key"], 16, None, 4.0, method).select("k", "amplitude").orderBy("k").collect()
    assert [r["k"] for r in low] == [r["k"] for r in zero] and low[0]["k"] == 0
    np.testing.assert_allclose([r["amplitude"] for r in low], [r["amplitude"] for r in zero])


def test_settings_are_checked_in_every_run(spark):
    samples = spark.createDataFrame([("v", "f", float(i), float(i % 3)) for i in range(9)], "variable string, file string, x double, y double")
    chosen = {f: "array()" if d == [] else "NULL" if d is None else repr(d) for f, (_, d) in FIELDS.items()}
    chosen["derivative"] = "3"
    settings = samples.select("variable", "file").distinct().selectExpr(
        "*", *[f"CAST({chosen[f]} AS {dtype}) AS {f}" for f, (dtype, _) in FIELDS.items()]
    )
    with pytest.raises(quality.QualityError, match="V23"):
        Analysis().run(samples, settings)

"""The registered text queries against their SQL, and the pipeline as a whole."""

import glob
import os

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from test_filters import brute_hits
from test_pairs import brute_similar

import __spark_entry__ as entries
from ondula.llm import byte_bpe, classifier, queries, secrets
from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = entries.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(columns).collect()]
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, rows)) == sorted(map(repr, want)) and rows


def test_all_ten_are_registered():
    names = set(entries.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert "pipeline" in names


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    good = {
        r["doc_id"] for r in classifier.quality(docs, labels).collect() if r["predicted"] == 1
    }
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    groups = brute_similar(texts.items(), 5, 80)
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    want = {
        i for i in texts if groups[i][1] == i and not brute_hits(texts[i], items)[1]
    }
    assert set(got) == want
    assert want > {r["doc_id"] for r in labels.where("quality = 1").collect()} & want
    kept = docs.where(F.col("doc_id").isin(sorted(want)))
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding(
        "t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    for r in secrets.redact(secrets.secret_spans(kept)).collect():
        own = got[r["doc_id"]]
        assert own["exact"] and own["n_tokens"] == len(own["ids"])
        assert own["ids"] == library.encode_ordinary(r["redacted"])


def test_stages_take_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, score long"
    rows = [(1, None, None, None, None, "a", 1), (None, "", "en", "s", 0, "b", 2), (1, None, None, None, None, "a", 1),
            (2, "word " * 3000, "en", "s", 9, "c", 3), (3, "x", "en", None, 1, None, None)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.dtypes == docs.dtypes and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()

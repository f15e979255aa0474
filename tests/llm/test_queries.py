"""The registered queries over the smallest tables, and the pipeline's stages."""

import os

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({Q.oracle_sql()[name]})").fetchall())


def test_held_out_accuracy(spark):
    found = Q.op7_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.93


def test_stages_with_odd_rows_and_columns(spark):
    en = "the house of the old man was near the river and the trees"
    texts = [*(f"{en} {i}\na line of every document, longer than twenty" for i in range(30)), en + " 3", None, "", "12 !", "Zx", f"{en} " * 3000 + "use Zx8Qp2Lk9Vw3Rt7Yb5Nm1Hc6Jd4Fg0S here", "tie word", "tie word"]
    rows = [(None if i == 34 else 5 if i in (36, 37) else i, t, "en" if i < 30 else None, "s", len(t or ""), "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _found string, _tidemark_found long")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, ""), name)
        assert docs.columns == columns and docs.where("_found = 'x' AND n_chars = length(text)").count() == docs.count() <= before
        before = docs.count()
    left = {r["_tidemark_found"]: r for r in docs.collect()}
    assert 34 in left and len(left.keys() & {36, 37}) == 1 and not left.keys() & {31, 32, 33}
    assert left[35]["text"].endswith("use [SECRET] here") and sum("every document" in r["text"] for r in left.values()) == 1
    assert corpus_pipeline.pack(spark, docs, "").select("doc_id").distinct().count() == len({r["doc_id"] for r in left.values()})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_any_columns_of_a_result(spark, name):
    """Whatever part of a query's result is read, it has as many rows."""
    if name == "pipeline":
        pytest.skip("its stages are written out")
    df = Q.queries()[name](spark, SF)
    n = df.count()
    assert n > 0
    for column in df.columns[:4]:
        assert len(df.select(column).collect()) == n
    assert df.groupBy(df.columns[-1]).count().agg({"count": "sum"}).head()[0] == n


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == before
    assert not docs.where("text rlike 'AKIA[A-Z0-9]{16}'").count()

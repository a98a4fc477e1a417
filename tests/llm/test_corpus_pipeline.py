"""The pipeline, stage by stage, against brute force on the smallest tables; the query's SQL."""

import os
import re

import pytest

duckdb = pytest.importorskip("duckdb")
pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from kymo.llm import catalog  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not mounted")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_match_their_sql(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = db.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = want.select(*columns).fetchall()
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, rows))


def test_stages(spark):
    from test_decontaminate import brute
    from test_dedup import brute_components, normal

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], DATA).cache())
        assert kept[-1].columns == docs.columns
    rows = [[(r.doc_id, r.text) for r in x.collect()] for x in kept]
    toxic = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & {i for i, _ in rows[1]}) <= len(toxic) // 3
    assert len(rows[0]) - len(rows[1]) <= 2 * len(toxic) + 10
    first = {}
    for i, t in sorted(rows[1]):
        first.setdefault(normal(t), i)
    assert sorted(i for i, _ in rows[2]) == sorted(first.values())
    assert sorted(i for i, _ in rows[3]) == sorted(r[0] for r in brute_components(rows[2]) if r[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaked = {i for i, _ in brute(rows[3], items)}
    assert sorted(i for i, _ in rows[4]) == sorted(i for i, _ in rows[3] if i not in leaked)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[-1], DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {i for i, _ in rows[4]}


def test_stage_names_and_modules():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    names = [re.match(r"op(\d+)_", n) for n in catalog.queries() if n != "pipeline"]
    assert sorted(int(m[1]) for m in names) == list(range(1, 14))


@pytest.mark.parametrize("rows", ["messy", "empty"])
def test_all_stages_on_messy_and_empty_tables(spark, tmp_path, request, rows):
    """NULLs in every column, blanks, a very long text, copies, repeated rows, no rows at all, and
    columns with the names that stages use inside."""
    docs = request.getfixturevalue(rows)
    ids = [r.doc_id for r in docs.collect()]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in ids if i is not None][:20] + [(None, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None), (None, " ")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, kept, str(tmp_path))
        assert left.columns == docs.columns, name
        left.write.parquet(f"{tmp_path}/{name}")
        before, kept = {(r.doc_id, r.text) for r in kept.collect()}, spark.read.parquet(f"{tmp_path}/{name}")
        assert {(r.doc_id, r.text) for r in kept.collect()} <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.select("doc_id").collect()}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == len(packed)

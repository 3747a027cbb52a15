"""The pipeline stage by stage against plain versions, and the registration of all queries."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as pipeline
from lithospark.llm import quality, queries
from lithospark.llm.textkernel import CHUNK
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_one_by_one(spark, documents, tmp_path):
    assert [name for name, _ in pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "packing"]
    columns, docs, before = documents.columns, documents, {r.doc_id: r.text for r in documents.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            out = docs.toPandas()
            assert sorted(out.doc_id) == sorted(before) and not out.duplicated(["bucket", "batch", "slot"]).any()
            continue
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality classifier":
            gone = set(before) - set(after)
            assert gone and sum(labels.get(i, 0) == 0 for i in gone if i in labels) >= 0.9 * sum(i in labels for i in gone)
            assert sum(labels[i] == 1 for i in labels if i in after) >= 0.97 * sum(v == 1 for v in labels.values())
        elif name == "n-gram Jaccard join":
            assert set(after) == {i for i, _, c in brute.jaccard_components(sorted(before.items())) if i == c}
        elif name == "substring dedup":
            assert after == {i: kept for i, (_, _, kept) in brute.substring(list(before.items())).items()}
        else:
            assert set(after) == {i for i, n, hit, _ in brute.contamination(list(before.items()), items) if not (hit and 20 * hit >= n)}
        before = after


def test_run_and_empty_documents(spark, documents):
    assert pipeline.run(spark, SF).count() > 0
    none = documents.limit(0)
    for _, stage in pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_runs_over_its_whole_table(spark, name):
    df = queries.queries()[name](spark, SF)
    table = {"op3_quotation_linking": "conversations", "op10_html_extraction": "pages", "op7_nearest_neighbours": None}.get(name, "documents")
    if table:
        assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    else:
        assert df.count() == 20 * spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in sorted(df.columns)]
    assert sorted([repr([r[c] for c in sorted(df.columns)]) for r in df.collect()]) == sorted(repr([r[k] for k in order]) for r in found.fetchall())


@pytest.mark.parametrize("k", range(len(pipeline.STAGES)))
def test_stages_hand_small_batches_to_python(spark, documents, k):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 9000, numPartitions=1).selectExpr("repeat('word ', 400) as text")  # 18 MB
    try:
        for least in ("1m", None):  # a lower limit stays
            spark.conf.unset(limit) if least is None else spark.conf.set(limit, least)
            pipeline.STAGES[k][1](spark, documents.limit(0), SF)
            found = texts.mapInArrow(sizes, "rows long, bytes long").collect()
            assert sum(r.rows for r in found) == 9000 and max(r.bytes for r in found) <= (CHUNK if least is None else 1.1 * 2**20)
    finally:
        spark.conf.unset(limit)


def test_classifier_takes_statistics_of_little_text_at_once():
    texts = pa.array(["Some words, and some more of them. " * 120] * 1000)  # 4 MB
    model = SimpleNamespace(value=quality.Trees(0.0, np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0))))
    tracemalloc.start()
    try:
        scored = list(quality._score(model, "text")(iter([pa.RecordBatch.from_pydict({"text": texts})])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(b.num_rows for b in scored) == 1000 and peak < 60e6

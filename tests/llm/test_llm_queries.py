"""The registered queries against their SQL, and the pipeline's stages against each other's input."""

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from conftest import SMALL
from helpers import duck_bag, frame_bag
from supplyplan.llm import decontaminate, queries
from supplyplan.llm.scratch import stored


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_statement(name, spark, duck):
    expected, columns = duck_bag(duck, queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SMALL)
    assert sorted(df.columns) == columns
    assert frame_bag(df) == expected


def test_all_are_registered():
    names = entry_points.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SMALL), "stage")
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert seen[name] <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "benchmark decontamination":
            bad = decontaminate.contamination(before, spark.read.parquet(f"{SMALL}/benchmark.parquet")).filter("contaminated")
            assert seen[name] == seen["near-duplicates"] - {r.doc_id for r in bad.collect()}
    assert seen["best-fit packing"] == seen["benchmark decontamination"]
    toxic = spark.read.parquet(f"{SMALL}/labels.parquet").filter("toxic = 1").select("doc_id").collect()
    assert sum(r.doc_id in seen["quality classifier"] for r in toxic) <= 0.1 * len(toxic)

"""The pipeline against its own rules, stage by stage, and the SQL of the operator queries."""

import collections
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.run import TABLES, compare
from scenelake.llm import decontaminate, queries, simhash


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, small, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    ok, note = compare(queries.QUERIES[name](spark, small), con, queries.ORACLES[name])
    assert ok, note


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """Input and output of every stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs, found = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = os.path.join(folder, name)
        stage(spark, docs, small).write.parquet(path)
        found[name] = docs, spark.read.parquet(path)
        docs = found[name][1]
    return found


def ids(frame):
    return collections.Counter(r[0] for r in frame.select("doc_id").collect())


def test_all_but_the_last_keep_the_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
        assert not ids(after) - ids(before) or name == "mixing"


def test_near_duplicates_leave_one_of_each_class(stages):
    before, after = stages["near_duplicates"]
    classes = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
    assert ids(after) == {i: 1 for i in classes}


def test_decontamination_takes_exactly_the_contaminated(spark, small, stages):
    before, after = stages["decontamination"]
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    bad = {r["doc_id"] for r in decontaminate.search(before, benchmark).collect()
           if decontaminate.contaminated(r["n_words"], r["spans"])}
    assert set(ids(before)) - set(ids(after)) == bad


def test_mixing_repeats_rows_up_to_three_times(stages):
    before, after = stages["mixing"]
    assert max(ids(after).values()) <= 3 and set(ids(after)) <= set(ids(before))


def test_sharding_places_every_row(stages):
    before, after = stages["sharding"]
    assert ids(before) == ids(after)
    assert after.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("ok")).where("not ok").count() == 0


def test_run_equals_the_stages(spark, small, stages):
    found = corpus_pipeline.run(spark, small)
    wanted = stages["sharding"][1]
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.select(found.columns).collect()))


def test_stages_take_empty_tables_and_odd_rows(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0),
                                 (2, "word " * 5000, None, None, 1)], documents.schema)
    for docs in (documents.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, small).count() <= 3 * 4

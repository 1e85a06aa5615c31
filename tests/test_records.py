"""Records of turns carry their whole text as summary: what a query finds there counts in both fields."""

import pytest

from sediment import catalog
from sediment.operators import search
from sediment.plans.memory_queries import PROJECT, RECORD_QUERY

from .oracle import rows_of, rows_of_sql

TURNS = [(1, 1, "user", "x " * 200 + "aié une"), (1, 2, "assistant", "here is a good\n hit: aié une"), (2, 1, "user", None), (3, 1, "user", "nothing")]


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("turns"))
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{at}/conversations.parquet")
    return at


def sql(turns, name):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{turns}/conversations.parquet/*.parquet'")
    return rows_of_sql(con, catalog.oracle_sql()[name])[0]


def scored(spark, summary):
    fields = "text string, summary string, title string, project string, tags array<string>"
    one = spark.createDataFrame([(TURNS[0][3], summary, "user", "p1", ["user", "les turn-1"])], fields)
    return search.score_records(one, RECORD_QUERY, search.context_terms(PROJECT)).first()["score"]


def test_record_scores_read_whole_summaries(spark, turns):
    rows, whole = catalog.queries()["record_scores"](spark, turns), scored(spark, TURNS[0][3])
    # turn 2 talks of search results, across a line break
    assert [(r["conv_id"], r["turn"], r["score"]) for r in rows.collect()] == [(1, 1, whole)]
    assert whole > scored(spark, TURNS[0][3][:80]) and whole > scored(spark, "said by user in p1")
    assert rows_of(rows)[0] == sql(turns, "record_scores")


def test_context_package_reads_whole_summaries(spark, turns):
    rows = catalog.queries()["context_package"](spark, turns)
    others = [(r["id"], r["score"]) for r in rows.collect() if r["kind"] == "index"]
    assert others == [("r1-1", scored(spark, TURNS[0][3]) + search.INDEX_BONUS)]
    assert rows_of(rows)[0] == sql(turns, "context_package")

"""Every registered query against its SQL in DuckDB at the smallest scale."""

import datetime as dt
import os

import duckdb
import pandas as pd
import pytest

from strandbook.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in os.listdir(SMALL):
        con.sql(f"create view {p.removesuffix('.parquet')} as select * from '{SMALL}/{p}'")
    return con


def rows(df: pd.DataFrame) -> list:
    def text(v):
        return "" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SMALL).toPandas()
    want = duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["compaction_outcomes", "compaction_leaves"])
def test_a_commit_that_reaches_over_a_bucket(spark, tmp_path, name):
    """A commit of versions 0 to 24 leaves no commit in bucket 10, which is sealed."""
    at, moment = str(tmp_path / "events.parquet"), dt.datetime(2024, 1, 1)
    ids = [3 * i if i < 25 else 3 * i + 1 for i in range(41)]
    rows = [(k, moment + dt.timedelta(seconds=i), 2, "view", 1.0, "{}") for i, k in enumerate(ids)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(at)
    same_as_sql(spark, tmp_path, name)


def test_a_chunk_that_lost_all_its_events(spark, tmp_path):
    """Bucket 10 has one commit of one event (61), which is lost in its chunk; the tail still has it."""
    at, moment = str(tmp_path / "events.parquet"), dt.datetime(2024, 1, 1)
    ids = [3 * i if i < 19 else 61 if i == 19 else 3 * i + 4 for i in range(41)]
    rows = [(k, moment + dt.timedelta(seconds=i), 2, "view", 1.0, "{}") for i, k in enumerate(ids)]
    assert len(set(ids)) == 41
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(at)
    same_as_sql(spark, tmp_path, "storage_invariant_compacted")


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    want = rows(con.sql(catalogue.oracle_sql()[name]).df())
    assert rows(catalogue.queries()[name](spark, str(folder)).toPandas()) == want and want


@pytest.mark.parametrize("name", ["compaction_outcomes", "compaction_leaves"])
def test_a_compaction_step_makes_its_commits_once(spark, name):
    """The result is made of stored commits, not of the events again for each table of the step."""
    files = catalogue.queries()[name](spark, SMALL).inputFiles()
    assert files and not any("events.parquet" in f for f in files)

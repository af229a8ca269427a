"""Registered queries against their SQL; a few by default, all with TIDALGRID_ALL=1."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidalgrid.plans import all_queries
from tools.compare import canonical

DEFAULT = [
    "daily_panel_deviation", "joined_layer_panel", "exponential_means", "first_wins_documents", "missing_order_days",
    "daily_stance_shares", "target_scope", "rater_agreement", "spearman_pairs", "density_noise", "mobility_events", "streamed_rollup",
    "staged_csv_one_folder", "staged_json_mixed_types", "file_inventory_with_empty_file", "panel_conservation", "value_densities", "structure_screen", "ranked_tail_screen", "item_contexts",
]
CHECKED = [q for q in all_queries() if q.sql and (os.environ.get("TIDALGRID_ALL") or q.name in DEFAULT)]


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{small_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("q", CHECKED, ids=lambda q: q.name)
def test_query_equals_its_sql(spark, con, small_dir, q):
    got, want = q.build(spark, small_dir).toPandas(), con.execute(q.sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_survey_operator_has_a_query():
    covered = {c for q in all_queries() for c in q.covers}
    assert covered == {f"O-{i:02d}" for i in range(1, 100)} | {f"O-{i}" for i in range(100, 167)}


def test_contract():
    names, sql = set(entry.queries()), entry.oracle_sql()
    assert set(sql) <= names and "daily_panel_deviation" in names


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "trip_count_deviation_z" in df.columns


def test_inventory_counts_every_written_file(spark, tmp_path):
    q = next(q for q in all_queries() if q.name == "file_inventory_with_empty_file")
    spark.range(600_001).selectExpr("id AS event_id", "CAST(id AS DOUBLE) AS value").write.parquet(f"{tmp_path}/events.parquet")
    got = q.build(spark, str(tmp_path)).first().asDict()
    assert got == {"dataset": "events", "file_count": 4, "empty_count": 1, "row_count": 600_001, "column_count": 2}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert canonical(q.build(spark, str(tmp_path)).toPandas()) == canonical(c.execute(q.sql).df())

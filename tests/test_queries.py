"""Registered domain queries against their SQL on the smallest tables; the whole set runs in the driver's check."""

import os

import duckdb
import pytest

from slopewatch.plans import catalog

SF = "/root/testdata/sf0.001"
SOME = ["e4_event_candidates", "e6_label_response", "e1_align_rain", "m6_forecast_context", "m4_source_balanced_validation", "g1_terrain_edges", "r10_neighbour_gate", "v9_strict_protocol", "a18_bootstrap_by_site"]
SOME += ["e14_lag_screen", "r5_rolling_search", "r13_threshold_sweep", "v10_teacher_grid", "c7_region_clusters", "r18_distillation_weights", "v1_event_subsets", "v3_segment_audit", "s9_artifact_round_trip", "s9_completeness", "s12_prediction_csv"]


def comparable(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: "~" if v is None or v != v else repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:10] if hasattr(v, "year") else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = catalog.queries()[name](spark, SF)
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert comparable([tuple(r) for r in df.collect()], df.columns) == comparable(cur.fetchall(), names)


def test_every_oracle_belongs_to_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_stream_gives_daily_means(spark):
    got = catalog.queries()["x1_rain_stream"](spark, SF)
    assert got.count() > 1000 and got.groupBy("site_id", "date").count().where("count > 1").count() == 0

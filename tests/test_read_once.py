"""Cells take what belongs to their origin from one pass over the panel: no second read of the lines, no join of cells."""

import datetime

import pytest
from pyspark.sql import functions as F

from slopewatch.operators import experts, learned, rain
from slopewatch.operators import panel as p
from slopewatch.plans import catalog
from slopewatch.plans.bindings import HIS, PRED, Tables

SF = "/root/testdata/sf0.001"


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def ring(t):
    """Edges of each node to itself and the next two; the last node has none."""
    s = t.sites.withColumn("src", F.explode(F.array(*[F.lit(n).cast("long") for n in range(11)]))).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    return s.select("site_id", "src", ((F.col("src") + F.col("k")) % 12).alias("dst"), (1.0 / (F.col("k") + 1)).alias("weight"))


def test_neighbours_values_equal_the_smoothing(spark):
    t = Tables(spark, SF)
    by = ["site_id", "node_index", "t"]
    want = p.graph_smooth(t.panel.select(*by, "disp"), ring(t), ["t"], "disp", 1.0).select(*by, F.col("disp").alias("d0"), (F.col("smooth") - F.col("disp")).alias("n0"))
    got = p.with_near(t.panel, ring(t)).join(want, by, "full")
    assert got.count() == t.panel.count()
    assert got.where("near is null or n0 is null or d0 != disp or abs(near - n0) > 1e-9").count() == 0


def test_values_of_a_node_may_be_missing(spark):
    panel = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 0, None), (1, 2, 0, 4.0)], "site_id long, node_index long, t long, disp double")
    edges = spark.createDataFrame([(1, 0, 2, 1.0), (1, 0, 1, 3.0), (1, 9, 0, 1.0)], "site_id long, src long, dst long, weight double")
    assert sorted((r.node_index, r.disp) for r in p.with_near(panel, edges).collect()) == [(0, 1.0), (1, None), (2, 4.0)]


def test_cells_with_neighbours_read_the_panel_once(spark):
    t = Tables(spark, SF)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # as registered queries do
    d = t.cells_of(p.with_near(t.panel, ring(t)), "near")
    assert plan(d).count("l_shipdate#") and len([x for x in plan(d).splitlines() if "FileScan" in x and "l_quantity" in x]) == 1
    assert not [x for x in plan(d).splitlines() if "Exchange hashpartitioning(site_id" in x and "node_index" in x]
    want = learned.residual_regressor(t.cells, t.panel, ring(t)).orderBy("horizon").collect()
    got = learned.corrected_errors(d).orderBy("horizon").collect()
    assert [tuple(r) for r in got] == [pytest.approx(tuple(r)) for r in want]


def test_cells_skip_windows_with_a_gap(spark):
    rows = [(1, 0, t, None if t == 17 else float(t), 10 * t) for t in range(24)]
    d = experts.expert_cells(spark.createDataFrame(rows, "site_id long, node_index long, t long, disp double, mark long"), HIS, PRED, ["mark"])
    got = {(r.start, r.horizon, r.mark) for r in d.where("persistence is not null").collect()}
    assert got == {(s, h, 10 * (s + HIS - 1)) for s in (0, 1, 7) for h in range(1, PRED + 1) if s != 6 and s + HIS - 1 + PRED < 24 and not s + HIS <= 17 <= s + HIS - 1 + PRED}


def test_rolling_search_reads_the_lines_once_and_joins_no_cells(spark):
    p = plan(catalog.queries()["r5_rolling_search"](spark, SF))
    assert len([x for x in p.splitlines() if "FileScan" in x and "l_quantity" in x]) == 1
    assert "SortMergeJoin" not in p and "_cells#" in p


def test_events_are_chosen_without_keeping_or_joining_candidates(spark):
    p = plan(catalog.queries()["e5_select_events"](spark, SF))
    assert "pre45" not in p and "max_roll" not in p and p.count("SortMergeJoin") == 1 and "ExistingRDD" not in p


def test_events_keep_all_columns_of_their_candidates(spark):
    day = lambda n: datetime.date(2000, 1, n)
    days = spark.createDataFrame([(s, day(n), float(n % 4)) for s in (1, 2) for n in range(1, 29)], "site_id long, date date, rain_mm double")
    cand = spark.createDataFrame([(1, day(5), 3.0, 1.0, None), (1, day(12), 3.0, 1.0, "tie of day 5"), (1, day(13), 3.0, 1.0, "b"), (2, day(9), 1.0, None, "c")], "site_id long, date date, rain_mm double, event_selection_score double, mark string")
    got = {(r.site_id, r.date.day, r.mark, r.event_id, r.spell_start.day, r.spell_end.day, r.spell_rain_sum) for r in rain.select_events(cand, days).collect()}
    total = lambda a, b: float(sum(n % 4 for n in range(a, b + 1)))
    assert got == {(1, 5, None, "E001", 1, 11, total(1, 12)), (1, 13, "b", "E002", 6, 19, total(6, 20)), (2, 9, "c", "E001", 2, 15, total(2, 16))}

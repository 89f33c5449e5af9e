"""Tables that grow out of a site's row are neither broadcast nor shuffled again; sums of long windows equal those of plain ones."""

import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from slopewatch.operators import rain
from slopewatch.plans import catalog
from slopewatch.plans.bindings import Tables

SF = "/root/testdata/sf0.001"


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a27_missing_issues_per_year", "e9_threshold_events", "m10_climatology_fill", "e4_event_candidates", "e5_select_events", "a2_scope_metrics", "r8_monotone_projection", "s9_completeness"])
def test_no_table_of_a_site_is_broadcast(spark, name):
    assert "BroadcastExchange" not in plan(catalog.queries()[name](spark, SF))


def test_predictions_are_shuffled_as_lines_only(spark):
    p = plan(catalog.queries()["a2_scope_metrics"](spark, SF))
    assert not [x for x in p.splitlines() if "Exchange hashpartitioning" in x and "node_index#" in x]


def test_sites_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    from slopewatch.plans import bindings

    monkeypatch.setattr(bindings, "SITES_OF_A_TASK", 1)
    t = Tables(spark, SF)
    assert t.parts == t.lines.select("site_id").distinct().count()
    assert t.daily_rain.groupBy("site_id").agg(F.count("*").alias("n")).where("n != 2499").count() == 0
    assert t.panel.groupBy("site_id").agg(F.count("*").alias("n")).where("n != 996").count() == 0


def test_background_equals_plain_windows(spark):
    first = datetime.date(2000, 1, 1)
    rows = [(s, first + datetime.timedelta(days=i), ((i * 37 + s * 11) % 23) * 0.1 if (i * s) % 3 else 0.0) for s in (1, 2) for i in range(75 if s == 1 else 4)]
    d = rain.rain_background(spark.createDataFrame(rows, "site_id long, date date, rain_mm double"))
    w = lambda a, b: Window.partitionBy("site_id").orderBy("date").rowsBetween(a, b)
    wet = (F.col("rain_mm") >= 1).cast("int")
    plain = {f"pre{n}_rain_sum": F.coalesce(F.sum("rain_mm").over(w(-n, -1)), F.lit(0.0)) for n in (3, 7, 15, 30, 45, 60)}
    plain |= {f"pre{n}_rainy_days": F.coalesce(F.sum(wet).over(w(-n, -1)), F.lit(0)) for n in (3, 7, 15, 30, 45, 60)}
    plain |= {f"pre{n}_p90_days": F.coalesce(F.sum((F.col("rain_mm") >= F.col("P90")).cast("int")).over(w(-n, -1)), F.lit(0)) for n in (30, 60)}
    plain |= {f"post{n}_rain_sum": F.when(F.count("*").over(w(1, n)) >= n - 1, F.coalesce(F.sum("rain_mm").over(w(1, n)), F.lit(0.0))).otherwise(0.0) for n in (3, 7, 15, 30)}
    plain |= {f"max_roll{n}_before": F.max(f"pre{n}_rain_sum").over(w(-29, 0)) for n in (7, 15, 30)}
    wrong = d.select(*[F.sum((F.abs(c - F.col(n)) > 1e-9).cast("int")).over(w(0, 0)).alias(n) for n, c in plain.items()])
    assert wrong.agg(*[F.sum(n) for n in plain]).first() == (0,) * len(plain)


def test_table_rounds_as_printf(spark):
    from slopewatch.sources.sinks import result_table

    values = [3.6245, 0.1235, 0.0025, 2.0, 7.00049]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(9, None)], "k int, mae double")
    got = [r["mae"] for r in result_table(d, [F.asc("k")], ["mae"]).orderBy("rank").collect()]
    assert got == ["%.3f" % v for v in values] + ["nan"]


def test_weights_of_seeds_do_not_gather_a_seed_in_a_task(spark):
    p = plan(catalog.queries()["r16_teacher_weights"](spark, SF))
    assert not [x for x in p.splitlines() if "Exchange hashpartitioning(seed#" in x and "keys=[seed" not in p.splitlines()[p.splitlines().index(x) + 1]]
    assert p.count("BroadcastHashJoin [seed") >= 2


def test_interpolation_reads_no_frame_to_the_end_for_each_row(spark):
    assert "unboundedfollowing" not in plan(catalog.queries()["s2_interpolated_climate"](spark, SF)).lower()

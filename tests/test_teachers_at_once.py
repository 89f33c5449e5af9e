"""The groups of features of a teacher search are settings of one pass over the cells."""

import pytest

from slopewatch.functions import common
from slopewatch.operators import search
from slopewatch.plans import catalog

SF = "/root/testdata/sf0.001"


def test_settings_may_have_a_name(spark):
    cells = spark.createDataFrame([(1, 5, n, "all", float(n), n + 1.0, None if n == 2 else n - 3.0) for n in range(4)], "site_id long, key long, node_index long, scope string, y_true double, a double, b double")
    gates = spark.createDataFrame([(1, 5, g, s, [1 - s, s]) for g in ("y", "x") for s in (0.0, 0.5)], "site_id long, key long, name string, share double, gate array<double>")
    gates = gates.selectExpr("site_id", "key", "name", "share", "transform(gate, x -> if(name = 'y', x, 1 - x)) AS gate")
    d = search.teacher_grid(cells, gates, ["site_id"], ["scope"], ["a", "b"], "a", [(g, s) for g in ("y", "x") for s in (0.0, 0.5)], ["name", "share"])
    got = {(r.name, r.share): (r.n, r.baseline_mae, r.teacher_mae) for r in d.collect()}
    # the unknown error of node 2 counts as none
    assert got == {("y", 0.0): (4, 1.0, pytest.approx(3 / 4)), ("y", 0.5): (4, 1.0, pytest.approx(3 / 4)), ("x", 0.0): (4, 1.0, pytest.approx(9 / 4)), ("x", 0.5): (4, 1.0, pytest.approx(3 / 4))}


def test_cells_are_packed_once_and_not_kept(spark, monkeypatch):
    kept, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda d: kept.append(d.columns) or cut(d))
    d = catalog.queries()["v10_teacher_grid"](spark, SF)
    assert len(kept) == 1 and "horizon" not in kept[0]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 2  # the grid and the baseline it is joined with
    assert d.columns[-1] == "feature_group"


def test_packed_gates_are_the_nested_ones_in_order(spark):
    pool = spark.createDataFrame([(s, k, float(k * k % 7), 0.1 * k, 1.0 / (k + 1)) for s in (1, 2) for k in range(6 if s == 1 else 2)], "site_id long, key long, f double, l_a double, l_b double")
    ask = spark.createDataFrame([(1, 20, 0.5), (1, 21, 3.0), (2, 22, 1.0), (3, 23, 1.0)], "site_id long, key long, f double")
    how = (["site_id"], ["f"], ["a", "b"], (5, 1, 3), (0.9, 0.3), (0.5, 0.0))
    rows = search.nested_gates(ask, pool, *how).collect()
    want = {}
    for r in sorted(rows, key=lambda r: (r.neighbours, r.temperature, r.share)):
        want.setdefault((r.site_id, r.key), []).extend(r.gate)
    got = {(r.site_id, r.key): r._g for r in search.packed_gates(ask, pool, *how).collect()}
    assert got == want and len(got) == 3 and all(len(g) == 3 * 2 * 2 * 2 for g in got.values())

"""What all groups share is made once: drawn windows and orders, cells with a column for each expert, gates of a sample."""

import numpy as np
import pandas as pd

from slopewatch.operators import evaluate as ev
from slopewatch.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_windows_are_drawn_once_for_groups_of_a_size():
    ev.drawn_days.cache_clear()
    c = pd.DataFrame({"day": [-3, 5, 40, 99, 130], "profile": ["strict"] * 5, "node_index": [0, 0, 1, 1, 1]})
    got = [ev.drawn_hits(np.array(b), c, 7, 100, 50, 7) for b in ([1, 30, 60], [2, 38, 90])]
    assert ev.drawn_days.cache_info().misses == 1
    assert got[0]["observed"].tolist() == [1, 0] and got[1]["observed"].tolist() == [1, 1]
    # days that no window can hold are never hit
    assert got[0]["_sum"].tolist() == ev.drawn_hits(np.array([4, 5, 6]), c[c["day"].between(0, 99)], 7, 100, 50, 7)["_sum"].tolist()


def test_change_points_are_not_repeated_for_levels_and_lags(spark):
    p = plan(catalog.queries()["e10_node_response"](spark, SF)).splitlines()
    at = next(i for i, x in enumerate(p) if "FlatMapCoGroupsInPandas" in x)
    assert "threshold_level" not in p[at].split("[", 1)[1].split("]")[0]


def test_orders_are_drawn_once_for_responses_of_a_length():
    from slopewatch.operators import screen

    screen.drawn_orders.cache_clear()
    x, r = np.arange(40.0).reshape(20, 2) % 7, np.random.default_rng(3)
    for _ in range(3):
        screen.rank_screen(x, r.normal(size=20), 30, 7)
    assert screen.drawn_orders.cache_info().misses == 1
    y = r.normal(size=20)
    assert all((a == b).all() for a, b in zip(screen.contrasts(x, y), screen.contrasts(x, y, parts=screen.high_low(x)), strict=True))


def test_teachers_cells_travel_with_their_sample(spark):
    from slopewatch.operators import search

    cells = spark.createDataFrame([(1, 5, 0, n, "all", float(n), n + 1.0, n - 3.0) for n in range(130)] + [(1, 6, 0, 0, "all", 1.0, 2.0, 1.0)], "site_id long, key long, seed int, node_index long, scope string, y_true double, a double, b double")
    settings = [(1, 0.5, 0.0), (1, 0.5, 1.0)]
    gates = spark.createDataFrame([(1, k, 1, 0.5, s, [0.25, 0.75] if s else [1.0, 0.0]) for k in (5, 6) for s in (0.0, 1.0)], "site_id long, key long, neighbours int, temperature double, share double, gate array<double>")
    d = search.teacher_grid(cells, gates, ["site_id"], ["seed", "scope"], ["a", "b"], "a", settings)
    got = {r.share: (r.n, r.baseline_mae, r.teacher_mae) for r in d.collect()}
    assert got[0.0] == (131, 1.0, 1.0) and got[1.0][0] == 131 and abs(got[1.0][2] - (130 * 2.0 + 0.25) / 131) < 1e-12
    assert "_cells#" in plan(d)


def test_gates_are_not_broadcast(spark):
    assert "BroadcastHashJoin [site_id" not in plan(catalog.queries()["v10_teacher_grid"](spark, SF))


def test_cells_of_the_experts_are_not_put_together_again(spark):
    for name in ("r12_source_switch", "a30_equal_experts", "a29_oracle_bound"):
        p = plan(catalog.queries()[name](spark, SF))
        assert not [x for x in p.splitlines() if "Aggregate(keys=[" in x and "horizon#" in x], name


def test_strict_protocol_keeps_sums_and_not_cells(spark, monkeypatch):
    from slopewatch.functions import common

    kept, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda d: kept.append(cut(d)) or kept[-1])
    assert catalog.queries()["v9_strict_protocol"](spark, SF).count() == 1
    assert [d.count() for d in kept] == [3 * 2 * 3 * 2]  # seeds, sources, experts, splits

"""The spread of trust goes on to its limit, also around cycles."""

import numpy as np
import pytest

from slopewatch.llm import url_filter


def test_spread_around_cycles_reaches_the_exact_solution(spark):
    hosts = ["a", "b", "c", "d"]
    edges = {(0, 1): 2, (1, 2): 1, (2, 0): 3, (1, 0): 1, (3, 0): 1}
    trust, doubt = np.array([0.1, 0.0, 0.0, 0.5]), np.array([0.0, 0.08, 0.08, 0.0])
    out, into = np.zeros((4, 4)), np.zeros((4, 4))
    for (i, j), n in edges.items():
        out[j, i] = n / sum(m for (x, _), m in edges.items() if x == i)
        into[i, j] = n / sum(m for (_, y), m in edges.items() if y == j)
    want = np.linalg.solve(np.eye(4) - 0.85 * out, trust), np.linalg.solve(np.eye(4) - 0.85 * into, doubt)
    s = spark.createDataFrame([(h, float(t), float(d)) for h, t, d in zip(hosts, trust, doubt, strict=True)], "host string, trust double, distrust double")
    e = spark.createDataFrame([(hosts[i], hosts[j], n) for (i, j), n in edges.items()], "src string, dst string, n long")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.spread(s, e, tolerance=1e-4).collect()}
    for i, h in enumerate(hosts):
        assert got[h] == pytest.approx((want[0][i], want[1][i]), abs=6e-4)


def test_ring_of_partly_blocked_hosts_is_blocked(spark):
    # 2 of 25 pages of each host are blocked: distrust is 0.08 / 0.15 = 0.53 in the limit, 0.47 after 12 rounds
    link = {"a": "b", "b": "c", "c": "a"}
    rows = [(100 * k + i, f"http://{h}.com/{'bad' if i < 2 else 'page'}/{i}", f'<a href="http://{link[h]}.com/">x</a>') for k, h in enumerate("abc") for i in range(25)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame([("com", "/bad/", "block")], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.judge(p, rules).collect()} == {"block"}

"""Queries of the lag screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopewatch.operators import evaluate as ev
from slopewatch.operators import rain, screen
from slopewatch.plans.evaluation_queries import _DRAW, _SCOPE
from slopewatch.plans.rain_queries import _AL, _ALIGN
from slopewatch.plans.registry import query

#: Permutations of each combination, as many as the survey's screen takes by default.
PERMUTATIONS = 100

#: Features and responses are rounded on both sides, so that the order in which an engine adds doesn't break ties.
_RX = "9"


def _features(t):
    d = rain.align_rain(t.daily_rain, t.acquisitions).select("site_id", "date", *[F.round(n, 9).alias(n) for n in _AL])
    return d.join(t.acquisitions, ["site_id", "date"])


def _responses(t):
    return screen.motion_responses(t.panel, ev.scopes(t.susceptibility)).withColumn("y", F.round("y", 9))


_RESP = f"""{_SCOPE}, ic AS (SELECT site_id, node_index, t, disp - lag(disp) OVER (PARTITION BY site_id, node_index ORDER BY t) AS d FROM panel),
im AS (SELECT i.site_id, scope, t, avg(abs(d)) AS a, avg(d) AS s FROM ic i JOIN sc ON sc.site_id = i.site_id AND sc.node_index = i.node_index WHERE d IS NOT NULL GROUP BY 1, 2, 3),
ia AS (SELECT *, coalesce(a - lag(a) OVER (PARTITION BY site_id, scope ORDER BY t), 0) AS c FROM im),
re AS MATERIALIZED (SELECT site_id, scope, v.response, t, round(CASE v.response WHEN 'abs_increment' THEN a WHEN 'signed_increment' THEN s ELSE c END, 9) AS y FROM ia, (VALUES ('abs_increment'), ('signed_increment'), ('abs_increment_change')) v(response))"""


def _screen_sql(features: str, responses: str, lags: int, permutations: int, least: int) -> str:
    """features: a statement of (site_id, t, feature, x); responses: the name of a table like `re`. Ranks are doubled and centred whole numbers."""
    rank = lambda v, by: f"2 * (rank() OVER (PARTITION BY {by} ORDER BY {v})) + count(*) OVER (PARTITION BY {by}, {v}) - 1 - (count(*) OVER (PARTITION BY {by}) + 1)"
    key = "site_id, scope, response, lag"
    return f"""fx AS MATERIALIZED ({features}), lg AS (SELECT range AS lag FROM range({lags})),
ft AS (SELECT DISTINCT site_id, t FROM fx),
yl AS MATERIALIZED (SELECT r.site_id, scope, response, lag, r.t, y, row_number() OVER (PARTITION BY r.site_id, scope, response, lag ORDER BY r.t) AS i, count(*) OVER (PARTITION BY r.site_id, scope, response, lag) AS n FROM {responses} r, lg, ft WHERE ft.site_id = r.site_id AND ft.t = r.t - lag),
yr AS MATERIALIZED (SELECT *, {rank("y", key)} AS ry FROM yl WHERE n >= {least}),
xs AS MATERIALIZED (SELECT DISTINCT site_id, lag, t FROM yl WHERE n >= {least}),
xr AS MATERIALIZED (SELECT fx.site_id, lag, feature, xs.t, x, {rank("x", "fx.site_id, lag, feature")} AS rx FROM fx JOIN xs ON xs.site_id = fx.site_id AND fx.t = xs.t - lag),
xq AS (SELECT site_id, lag, feature, list(CAST(rx AS DOUBLE) ORDER BY t) AS lx, list(x ORDER BY t) AS vx, quantile_cont(x, 0.9) AS hi, quantile_cont(x, 0.5) AS lo, sum(rx * rx) AS sx, stddev_pop(x) AS dx FROM xr GROUP BY 1, 2, 3),
yq AS (SELECT {key}, any_value(n) AS n, list(CAST(ry AS DOUBLE) ORDER BY t) AS ly, list(y ORDER BY t) AS vy, sum(ry * ry) AS sy, stddev_pop(y) AS dy FROM yr GROUP BY 1, 2, 3, 4),
yp AS (SELECT {key}, p, list(CAST(ry AS DOUBLE) ORDER BY d, i) AS lp FROM (SELECT {key}, p.range AS p, i, ry, {_DRAW("p.range", "i", "65521")} AS d FROM yr, range(1, {permutations + 1}) p) GROUP BY 1, 2, 3, 4, 5),
ow AS (SELECT y.*, feature, lx, sx, dx, list_dot_product(lx, ly) AS own, list_avg(list_transform(list_filter(list_zip(vx, vy), lambda z: z[1] >= hi), lambda z: z[2])) AS high, list_avg(list_transform(list_filter(list_zip(vx, vy), lambda z: z[1] <= lo), lambda z: z[2])) AS low FROM yq y JOIN xq ON xq.site_id = y.site_id AND xq.lag = y.lag),
pm AS (SELECT o.site_id, o.scope, o.response, o.lag, feature, count(*) FILTER (WHERE abs(list_dot_product(lx, lp)) >= abs(own)) AS reached FROM ow o JOIN yp ON yp.site_id = o.site_id AND yp.scope = o.scope AND yp.response = o.response AND yp.lag = o.lag GROUP BY 1, 2, 3, 4, 5),
sn AS (SELECT o.site_id, o.scope, o.response, CAST(o.lag AS INTEGER) AS lag, o.feature, n, CASE WHEN dx >= 1e-9 AND dy >= 1e-9 THEN own / sqrt(sx * sy) END AS rho, CASE WHEN dx >= 1e-9 AND dy >= 1e-9 THEN (reached + 1) / {permutations + 1}.0 END AS p, high, low, high - low AS delta, CASE WHEN low > 1e-9 THEN high / low END AS lift
  FROM ow o JOIN pm ON pm.site_id = o.site_id AND pm.scope = o.scope AND pm.response = o.response AND pm.lag = o.lag AND pm.feature = o.feature)"""


_FEATURES = f"SELECT a.site_id, q.t, u.feature, u.x FROM al a JOIN (SELECT DISTINCT site_id, date, t FROM panel) q ON q.site_id = a.site_id AND q.date = a.date, unnest([{', '.join(f'struct_pack(feature := {n!r}, x := round(CAST({n} AS DOUBLE), 9))' for n in _AL)}]) v(u)"


@query("e14_lag_screen", f"WITH {_ALIGN}, {_RESP}, {_screen_sql(_FEATURES, 're', 7, PERMUTATIONS, 8)} SELECT site_id, scope, response, lag, feature, n, round(rho, 6) AS rho, round(p, 6) AS p, round(delta, 6) AS delta, round(lift, 6) AS lift FROM sn")
def _(t):
    """All rain features at lags 0 to 6 against the three responses of all three scopes of nodes."""
    return screen.lag_screen(_features(t), _AL, _responses(t), range(7), PERMUTATIONS).drop("high", "low")

"""Queries that write the domain's files from the given tables, and read them by the readers of `sources`."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopewatch.functions import common as c
from slopewatch.operators import evaluate as ev
from slopewatch.plans.registry import query
from slopewatch.sources import tables as src

_BAD = "(site_id * 3 + node_index) % 11 = 0"


@query("s3_daily_rain_files", f"""SELECT site_id, CAST(d AS DATE) AS date, round(avg(CASE WHEN {_BAD} THEN 0 ELSE q END), 6) AS rain_mm, round(avg(q / 2) FILTER (WHERE NOT ({_BAD})), 6) AS soil_moisture
FROM (SELECT l_suppkey AS site_id, l_partkey % 12 AS node_index, CAST(l_shipdate AS DATE) AS d, CAST(l_quantity AS DOUBLE) AS q FROM lineitem) GROUP BY 1, 2""")
def _(t):
    """CSV of all rows, some with values that are no numbers: bad rain counts as 0, other bad values are null; days are averaged."""
    path = c.fresh_path(t.spark, "rain-csv")
    q = F.col("l_quantity").cast("double")
    text = lambda v: F.when(F.expr(_BAD), "n/a").otherwise(v.cast("string"))
    t.lines.select("site_id", "date", text(q).alias("rain_mm"), text(q / 2).alias("soil_moisture")).write.option("header", True).csv(path)
    return src.read_daily_rain(t.spark, path, ("soil_moisture",))


@query("s4_forecast_files", "SELECT site_id, issue_date, valid_date, round(forecast_rain_mm, 6) AS forecast_rain_mm, source FROM forecast WHERE issue_no % 7 <> 0")
def _(t):
    """CSV under other names; rows with dates that are none are dropped."""
    path = c.fresh_path(t.spark, "forecast-csv")
    issued = F.when(F.col("issue_no") % 7 == 0, "unknown").otherwise(F.col("issue_date").cast("string"))
    t.forecast.select("site_id", issued.alias("issued"), F.col("valid_date").alias("target_date"), F.col("forecast_rain_mm").alias("precip_mm"), "source").write.option("header", True).csv(path)
    return src.read_forecast(t.spark, path)


@query("s7_appended_days", "SELECT site_id, date, round(rain_mm, 6) AS rain_mm FROM daily_rain")
def _(t):
    """Ingest in three steps that overlap: each day is appended once, the first one also to a missing table."""
    path = c.fresh_path(t.spark, "appended")
    for last in ("1997-06-30", "1999-12-31", "2001-11-04"):
        src.append_new_days(t.spark, t.daily_rain.where(F.col("date") <= F.lit(last).cast("date")), path)
    return t.spark.read.parquet(path)


_SUM = "SELECT model, horizon, avg(abs(y_pred - y_true)) AS mae, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse, count(*) AS n FROM predictions GROUP BY 1, 2"


@query("s11_gathered_metrics", f"""WITH m AS ({_SUM})
SELECT 'exp_' || model AS experiment, horizon, round(mae, 6) AS mae, CASE WHEN model <> 'damped' THEN round(rmse, 6) END AS rmse, CASE WHEN model = 'damped' THEN n END AS n FROM m""")
def _(t):
    """Metrics of three experiments, in files whose columns differ in kind and order."""
    path = c.fresh_path(t.spark, "metrics")
    m = c.cut(ev.error_table(t.predictions, ["model", "horizon"]))
    shapes = {"persistence": ("horizon", "mae", "rmse"), "trend": ("rmse", "horizon", "mae"), "damped": ("mae", "n", "horizon")}
    for model, names in shapes.items():
        m.where(F.col("model") == model).select(*names).write.option("header", True).csv(f"{path}/exp_{model}")
    kinds = {"horizon": "long", "mae": "double", "rmse": "double", "n": "long"}
    return src.gathered_metrics(t.spark, f"{path}/*/*.csv").select("experiment", *[F.col(n).cast(k).alias(n) for n, k in kinds.items()])

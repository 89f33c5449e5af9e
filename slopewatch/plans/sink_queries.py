"""Queries that write results to files, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopewatch.functions import common as c
from slopewatch.operators import evaluate as ev
from slopewatch.plans.bindings import MONTHS
from slopewatch.plans.registry import query
from slopewatch.sources import sinks, tables


@query("s1_panel_csv", "SELECT site_id, node_index, t, 'T' || lpad(CAST(t AS VARCHAR), 3, '0') AS label, CASE WHEN (node_index + t) % 13 <> 0 THEN round(disp, 6) END AS disp FROM panel")
def _(t):
    """A wide CSV file of the panel with a column for each acquisition, some values being no numbers, read as a long one."""
    path = c.fresh_path(t.spark, "panel-csv")
    value = F.when((F.col("node_index") + F.col("t")) % 13 == 0, "-").otherwise(F.col("disp").cast("string"))
    label = F.concat(F.lit("T"), F.lpad(F.col("t").cast("string"), 3, "0"))
    wide = t.panel.select("site_id", "node_index", label.alias("label"), value.alias("v")).groupBy("site_id", "node_index").pivot("label", [f"T{k:03d}" for k in range(MONTHS)]).agg(F.first("v"))
    wide.write.option("header", True).csv(path)
    return sinks.read_panel(t.spark, path, ("site_id", "node_index")).withColumns({k: F.col(k).cast("long") for k in ("site_id", "node_index")})


_CELLS = "SELECT site_id, date, CAST(g.i AS BIGINT) AS row, CAST(h.i AS BIGINT) AS col, CASE WHEN (day(date) + g.i + h.i) % 7 <> 0 THEN rain_mm * (1 + g.i + 2 * h.i) END AS rain_mm FROM daily_rain, (VALUES (0), (1)) g(i), (VALUES (0), (1), (2)) h(i) WHERE day(date) = 15"


def _cells(t):
    d = t.daily_rain.where("day(date) = 15").withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long")))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return d.withColumn("rain_mm", F.when((F.dayofmonth("date") + F.col("row") + F.col("col")) % 7 != 0, F.col("rain_mm") * (1 + F.col("row") + 2 * F.col("col"))))


@query("s6_grid_files", f"""WITH ce AS ({_CELLS}), da AS (SELECT site_id, date, avg(rain_mm) AS rain_mm FROM ce GROUP BY 1, 2)
SELECT m.*, d.days, d.total FROM (SELECT site_id, min(row) AS row_min, max(row) AS row_max, min(col) AS col_min, max(col) AS col_max, min(date) AS first_day, max(date) AS last_day, count(*) AS cells, count(*) FILTER (WHERE rain_mm IS NULL) AS missing FROM ce GROUP BY 1) m
JOIN (SELECT site_id, count(*) AS days, round(sum(rain_mm), 6) AS total FROM da GROUP BY 1) d ON d.site_id = m.site_id""")
def _(t):
    """Cells by date, daily means and metadata, read back from the files. The grid has the middle of every month."""
    path = c.fresh_path(t.spark, "grid")
    sinks.write_grid(_cells(t), path)
    about = t.spark.read.schema("site_id long, row_min long, row_max long, col_min long, col_max long, first_day date, last_day date, cells long, missing long").json(f"{path}/metadata")
    daily = t.spark.read.parquet(f"{path}/daily").groupBy("site_id").agg(F.count("*").alias("days"), F.sum("rain_mm").alias("total"))
    return about.join(daily, "site_id")


@query("s8_missing_log", "SELECT s.site_id, CAST(DATE '1995-01-02' + to_days(CAST(12 * i.range AS INTEGER)) AS DATE) AS issue_date, CASE WHEN (i.range + s.site_id) % 5 = 0 THEN 'no rows' ELSE 'no values' END AS reason FROM sites s, range(208) i WHERE (i.range + s.site_id) % 5 = 0 OR i.range % 9 = 0")
def _(t):
    """Issues that the upserted forecast lacks, or has without values."""
    kept = t.forecast.withColumn("forecast_rain_mm", F.when(F.col("issue_no") % 9 != 0, F.col("forecast_rain_mm")))
    every = t.sites.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(207)))).withColumn("issue_date", F.date_add(F.lit("1995-01-02").cast("date"), F.col("n") * 12))
    return sinks.missing_log(tables.upsert(kept, kept, ["site_id", "issue_date", "valid_date", "source"]), every)


@query("s12_prediction_csv", "SELECT site_id, model, horizon, count(*) AS n, round(avg(y_true), 6) AS truth, round(avg(abs(y_pred - y_true)), 6) AS mae FROM predictions WHERE split = 'test' GROUP BY 1, 2, 3", places=9)
def _(t):
    """Scaled predictions written as CSV rows in millimetres with their errors, and summed up from the file."""
    path = c.fresh_path(t.spark, "prediction-csv")
    d = c.with_stats(t.predictions.where("split = 'test'"), ["site_id"], _m=F.avg("y_true"), _s=F.stddev_pop("y_true"))
    std = c.safe_std(F.col("_s"))
    d = d.withColumns({x: c.z_score(F.col(x), F.col("_m"), std) for x in ("y_true", "y_pred")})
    sinks.write_prediction_rows(d, path, F.col("_m"), std)
    kinds = {"site_id": "long", "model": "string", "horizon": "long", "y_true": "double", "abs_error": "double"}
    back = tables.csv(t.spark, path).select(*[F.col(n).cast(k).alias(n) for n, k in kinds.items()])
    return back.groupBy("site_id", "model", "horizon").agg(F.count("*").alias("n"), F.avg("y_true").alias("truth"), F.avg("abs_error").alias("mae"))


@query("s14_result_table", """WITH e AS (SELECT model, split, round(avg(abs(y_pred - y_true)), 4) AS mae, count(*) AS n FROM predictions GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY mae, model, split) AS rank FROM e)
SELECT -1 AS rank, '| model | split | mae | n |' AS line UNION ALL SELECT 0, '| --- | --- | --- | --- |' UNION ALL SELECT CAST(rank AS INTEGER), '| ' || model || ' | ' || split || ' | ' || printf('%.3f', round(mae + 0.00001, 4)) || ' | ' || n || ' |' FROM r""")
def _(t):
    """Errors of models and splits, best first, as the lines of a Markdown table."""
    d = ev.error_table(t.predictions, ["model", "split"]).select("model", "split", F.round("mae", 4).alias("mae"), "n")
    return sinks.markdown(sinks.result_table(d.withColumn("mae", F.round(F.col("mae") + 0.00001, 4)), [F.asc("mae"), F.asc("model"), F.asc("split")], ["mae"]))


@query("s15_metrics_log", "SELECT model, horizon, round(avg(abs(y_pred - y_true)), 6) AS mae, count(*) AS n FROM predictions GROUP BY 1, 2", places=9)
def _(t):
    """One row after the other for each experiment in a log that is made by the first, in files that all have the header."""
    path = c.fresh_path(t.spark, "log")
    m = c.cut(ev.error_table(t.predictions, ["model", "horizon"]).select("model", "horizon", "mae", "n"))
    for model, names in (("persistence", ["model", "horizon", "mae", "n"]), ("damped", ["n", "mae", "horizon", "model"]), ("trend", ["model", "n", "horizon", "mae"])):
        sinks.append_log(m.where(F.col("model") == model).select(*names), path)
    kinds = {"model": "string", "horizon": "long", "mae": "double", "n": "long"}
    return tables.csv(t.spark, path).select(*[F.col(n).cast(k).alias(n) for n, k in kinds.items()])

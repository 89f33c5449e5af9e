"""Files of results: what is written is what is read, and what doesn't fit is refused."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from slopewatch.sources import sinks

DAY = dt.date(2001, 1, 1)


def test_panel_files(spark, tmp_path):
    head = ["site_id", "node_index", *[f"D{k}" for k in range(20)]]
    (tmp_path / "p.csv").write_text("\n".join([",".join(head), ",".join(["1", "2", *map(str, range(20))]), ",".join(["1", "3", "x", *["7"] * 19])]))
    got = sinks.read_panel(spark, f"file://{tmp_path}/p.csv", ("site_id", "node_index")).collect()
    assert len(got) == 40 and {(r.node_index, r.t, r.label, r.disp) for r in got if r.t < 2} == {("2", 0, "D0", 0.0), ("2", 1, "D1", 1.0), ("3", 0, "D0", None), ("3", 1, "D1", 7.0)}
    with pytest.raises(ValueError, match="columns are missing"):
        sinks.read_panel(spark, f"file://{tmp_path}/p.csv")
    with pytest.raises(ValueError, match="20 acquisitions, 21 are needed"):
        sinks.read_panel(spark, f"file://{tmp_path}/p.csv", ("site_id", "node_index"), 21)


def test_grid_and_its_metadata(spark, tmp_path):
    g = spark.createDataFrame([(1, DAY, 0, 0, 2.0), (1, DAY, 0, 1, 4.0), (1, DAY + dt.timedelta(days=1), 3, 1, None)], "site_id long, date date, row long, col long, rain_mm double")
    sinks.write_grid(g, f"file://{tmp_path}/g")
    about = spark.read.json(f"file://{tmp_path}/g/metadata").first()
    assert (about.row_min, about.row_max, about.col_max, about.cells, about.missing, about.last_day) == (0, 3, 1, 3, 1, "2001-01-02")
    assert {(r.date, r.rain_mm) for r in spark.read.parquet(f"file://{tmp_path}/g/daily").collect()} == {(DAY, 3.0), (DAY + dt.timedelta(days=1), None)}
    assert spark.read.parquet(f"file://{tmp_path}/g/cells").count() == 3


def test_missing_log(spark):
    f = spark.createDataFrame([(1, DAY, 2.0), (1, DAY + dt.timedelta(days=1), None)], "site_id long, issue_date date, forecast_rain_mm double")
    want = spark.createDataFrame([(1, DAY + dt.timedelta(days=k)) for k in (0, 1, 2, 2)], "site_id long, issue_date date")
    assert {(r.issue_date.day, r.reason) for r in sinks.missing_log(f, want).collect()} == {(2, "no values"), (3, "no rows")}


def test_prediction_rows(spark, tmp_path):
    d = spark.createDataFrame([("m", 1, 0, 1, 0, 0.5, 1.0)], "model string, site_id long, start long, horizon long, node_index long, y_true double, y_pred double")
    sinks.write_prediction_rows(d, f"file://{tmp_path}/r", F.lit(10.0), F.lit(2.0))
    r = spark.read.option("header", True).csv(f"file://{tmp_path}/r").first().asDict()
    assert (r["model"], r["y_true"], r["y_pred"], r["abs_error"]) == ("m", "11.0", "12.0", "1.0")


def test_result_tables(spark):
    d = spark.createDataFrame([("b", 1.23456), ("a", None), ("c", 1.0)], "name string, mae double")
    t = sinks.result_table(d, [F.asc_nulls_last("mae")], ["mae"], 2)
    assert [tuple(r) for r in t.orderBy("rank").collect()] == [(1, "c", "1.00"), (2, "b", "1.23"), (3, "a", "nan")]
    assert sinks.result_table(d, [F.asc_nulls_last("mae")], ["mae"], top=1).count() == 1
    assert [r.line for r in sinks.markdown(t).orderBy("rank").collect()] == ["| name | mae |", "| --- | --- |", "| c | 1.00 |", "| b | 1.23 |", "| a | nan |"]


def test_logs_keep_their_columns(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    one = spark.createDataFrame([("x", 1)], "name string, n long")
    for d in (one, one.select("n", "name")):
        sinks.append_log(d, path)
    assert [tuple(r) for r in spark.read.option("header", True).csv(path).collect()] == [("x", "1"), ("x", "1")]
    with pytest.raises(ValueError, match="the log has the columns"):
        sinks.append_log(one.withColumn("more", F.lit(1)), path)

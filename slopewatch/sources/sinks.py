"""Files that results are written to: wide panels, grids with metadata, prediction rows, tables of results, logs."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slopewatch.functions.common import de_normalised
from slopewatch.sources.tables import csv, required, site_daily_mean


def read_panel(spark: SparkSession, path: str, ids: Sequence[str] = ("site_id", "node_index", "lon", "lat", "elevation"), least: int = 20) -> DataFrame:
    """(ids, t, label, disp) of a wide CSV file with a column for each acquisition, t counting them in the order of the header.

    A missing id column or fewer than `least` acquisitions is a ValueError; values that are no numbers become null.
    """
    d = required(csv(spark, path), ids)
    labels = [c for c in d.columns if c not in ids]
    if len(labels) < least:
        raise ValueError(f"{len(labels)} acquisitions, {least} are needed")
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("t"), F.lit(c).alias("label"), F.col(f"`{c}`").try_cast("double").alias("disp")) for k, c in enumerate(labels)]))
    return d.select(*ids, each.alias("x")).select(*ids, "x.*")


def write_grid(grid: DataFrame, path: str) -> None:
    """Cells by date, the sites' daily means beside them, and a row of metadata for each site: rows, columns, days, cells without rain."""
    grid.write.partitionBy("date").parquet(f"{path}/cells")
    site_daily_mean(grid).write.parquet(f"{path}/daily")
    about = grid.groupBy("site_id").agg(F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count("*").alias("cells"), F.count(F.when(F.col("rain_mm").isNull(), 1)).alias("missing"))
    about.write.json(f"{path}/metadata")


def missing_log(forecast: DataFrame, expected: DataFrame, keys: Sequence[str] = ("site_id", "issue_date")) -> DataFrame:
    """(keys, reason) of the expected issues that have no row, or none with a value."""
    have = forecast.groupBy(*keys).agg(F.count("forecast_rain_mm").alias("_n"))
    d = expected.select(*keys).distinct().join(have, list(keys), "left")
    return d.where(F.coalesce("_n", F.lit(0)) == 0).select(*keys, F.when(F.col("_n").isNull(), "no rows").otherwise("no values").alias("reason"))


def write_prediction_rows(d: DataFrame, path: str, mean: Column, std: Column, true: str = "y_true", predicted: str = "y_pred") -> None:
    """A CSV row for each cell, with the values put back to millimetres and the absolute error of the prediction."""
    back = {c: de_normalised(F.col(c), mean, std) for c in (true, predicted)}
    keys = [c for c in ("run", "seed", "fold", "split", "model", "site_id", "start", "horizon", "node_index") if c in d.columns]
    d.select(*keys, *[v.alias(c) for c, v in back.items()], F.abs(back[predicted] - back[true]).alias("abs_error")).write.option("header", True).csv(path)


def fixed_places(c: Column, places: int) -> Column:
    """Text with `places` decimals of a double's exact value, as printf gives it; Spark's format_string rounds its shortest
    decimals, so that 3.6245, which is a little less as a double, would go up."""
    def text(v: pd.Series) -> pd.Series:
        return v.map(lambda x: f"{x:.{places}f}", na_action="ignore")

    return F.pandas_udf(text, "string")(c)


def result_table(d: DataFrame, order: Sequence[Column], numbers: Sequence[str], places: int = 3, top: int | None = None) -> DataFrame:
    """(rank, the columns as text): numbers with `places` decimals, nan where null. A table of results, so its rows are ranked in one task."""
    ranked = d.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    text = lambda c: F.when(F.col(c).isNotNull(), fixed_places(F.col(c).cast("double"), places)).otherwise("nan") if c in numbers else F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = ranked.select("rank", *[text(c).alias(c) for c in d.columns])
    return out if top is None else out.where(F.col("rank") <= top)


def markdown(table: DataFrame) -> DataFrame:
    """(rank, line) of a Markdown table, the head having the ranks -1 and 0."""
    names = [c for c in table.columns if c != "rank"]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(f"`{c}`") for c in names]), F.lit(" |"))
    head = F.explode(F.array(F.struct(F.lit(-1).alias("rank"), F.lit("| " + " | ".join(names) + " |").alias("line")), F.struct(F.lit(0).alias("rank"), F.lit("| " + " | ".join(["---"] * len(names)) + " |").alias("line")))).alias("x")
    return table.sparkSession.range(1).select(head).select("x.*").unionByName(table.select("rank", row.alias("line")))


def append_log(rows: DataFrame, path: str) -> None:
    """Appends rows to the CSV log at path. The first write fixes its columns; later rows must have the same, in any order."""
    try:
        known = rows.sparkSession.read.option("header", True).csv(path).columns
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = rows.columns
    if sorted(known) != sorted(rows.columns):
        raise ValueError(f"the log has the columns {json.dumps(known)}, the rows {json.dumps(rows.columns)}")
    rows.select(*known).write.mode("append").option("header", True).csv(path)

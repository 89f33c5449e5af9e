"""Readers and writers of the domain's files. Schemas are explicit; NaN and sentinels become null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names under which forecasts come, by the name used here.
ALIASES: Mapping[str, Sequence[str]] = {
    "issue_date": ("issue_date", "issued", "forecast_date"),
    "valid_date": ("valid_date", "target_date", "date"),
    "forecast_rain_mm": ("forecast_rain_mm", "precip_mm_mean", "rain_mm", "precip_mm"),
    "source": ("source",),
}


def required(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df


def resolved(df: DataFrame, aliases: Mapping[str, Sequence[str]], optional: Mapping[str, object] = {}) -> DataFrame:  # noqa: B006
    """df with each name taken from the first of its aliases that is there; optional names may be a default value."""
    out = []
    for name, known in aliases.items():
        have = next((a for a in known if a in df.columns), None)
        if have is None and name not in optional:
            raise ValueError(f"none of {list(known)} is there for {name}")
        out.append((F.col(have) if have else F.lit(optional[name])).alias(name))
    return df.select(*[c for c in df.columns if c == "site_id"], *out)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, to be cast one by one: bad values become null, not an error."""
    return spark.read.option("header", True).csv(path)


def read_daily_rain(spark: SparkSession, path: str, optional: Sequence[str] = ("soil_moisture", "runoff", "evapotranspiration", "temperature")) -> DataFrame:
    """(site_id, date, rain_mm, ...): mean of a day's rows; bad rain counts as 0, other bad values are null."""
    d = required(csv(spark, path), ["date", "rain_mm"])
    site = F.col("site_id").try_cast("long") if "site_id" in d.columns else F.lit(0).cast("long")
    more = [c for c in optional if c in d.columns]
    d = d.select(site.alias("site_id"), F.col("date").try_cast("date").alias("date"), F.coalesce(F.col("rain_mm").try_cast("double"), F.lit(0.0)).alias("rain_mm"), *[F.col(c).try_cast("double").alias(c) for c in more])
    return d.where("date is not null").groupBy("site_id", "date").agg(*[F.avg(c).alias(c) for c in ["rain_mm", *more]])


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    """(site_id, issue_date, valid_date, forecast_rain_mm, source): aliases resolved, rows with bad dates dropped."""
    d = csv(spark, path)
    if "site_id" not in d.columns:
        d = d.withColumn("site_id", F.lit(0))
    d = resolved(d, ALIASES, {"source": ""})
    return d.select(F.col("site_id").try_cast("long").alias("site_id"), *[F.col(c).try_cast("date").alias(c) for c in ("issue_date", "valid_date")], F.col("forecast_rain_mm").try_cast("double").alias("forecast_rain_mm"), F.coalesce("source", F.lit("")).alias("source")).na.drop(subset=["issue_date", "valid_date"])


def read_susceptibility(nodes: DataFrame, table: DataFrame) -> DataFrame:
    """A value for each node, by node_index: clipped to [0, 1], missing ones and absent nodes 0."""
    v = F.col("rain_susceptibility").try_cast("double")
    t = required(table, ["site_id", "node_index", "rain_susceptibility"]).select("site_id", "node_index", F.when(~F.isnan(v), v).alias("_v"))
    return nodes.select("site_id", "node_index").join(t, ["site_id", "node_index"], "left").select("site_id", "node_index", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_v", F.lit(0.0)))).alias("rain_susceptibility"))


def crop_grid(grid: DataFrame, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """Cells within the window; values below -9000 mark missing rain."""
    d = grid.where(F.col("row").between(*rows) & F.col("col").between(*columns))
    return d.withColumn("rain_mm", F.when(F.col("rain_mm") >= -9000, F.col("rain_mm")))


def cell_centres(grid: DataFrame, cell: float = 0.05, west: float = -180.0, north: float = 50.0) -> DataFrame:
    return grid.withColumn("lon", west + (F.col("col") + 0.5) * cell).withColumn("lat", north - (F.col("row") + 0.5) * cell)


def site_daily_mean(grid: DataFrame) -> DataFrame:
    return grid.groupBy("site_id", "date").agg(F.avg("rain_mm").alias("rain_mm"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both; new ones replace old ones with the same keys."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), *[c for c in old.columns if c not in keys]))
    return both.withColumn("_r", first).where("_r = 1").drop("_new", "_r")


def append_new_days(spark: SparkSession, new: DataFrame, path: str, keys: Sequence[str] = ("site_id", "date")) -> DataFrame:
    """The rows whose days aren't in the table at path yet; they are appended. A missing table counts as empty."""
    from pyspark.errors import AnalysisException

    try:
        old = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        fresh = new
    else:
        fresh = new.join(old.select(*keys), list(keys), "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def complete(predictions: DataFrame, by: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Groups that lack rows of a model: (by, model, n, expected); empty if all is there."""
    n = predictions.groupBy(*by, "model").agg(F.count("*").alias("n"))
    want = predictions.groupBy(*by).agg(F.count_distinct("start", "horizon", "node_index").alias("expected")).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return want.join(n, [*by, "model"], "left").fillna({"n": 0}).where("n != expected")


def gathered_metrics(spark: SparkSession, pattern: str) -> DataFrame:
    """CSV files of metrics with differing columns, by their names, and the experiment's name from the folder of each.

    Each file's header is read first; files of one header are read together. Columns that a file lacks are null.
    All columns are text; files without a line are left out, and without any file a ValueError is raised.
    """
    lines = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.substring_index(F.regexp_replace("value", "\r", ""), "\n", 1).alias("header"))
    groups = lines.where("header != ''").groupBy("header").agg(F.collect_list("path").alias("paths")).orderBy("header").collect()  # names of small files
    if not groups:
        raise ValueError(f"no metrics in {pattern}")
    parts = [spark.read.option("header", True).csv(g["paths"]).withColumn("experiment", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)) for g in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_packs(panel: DataFrame, path: str) -> None:
    """A row for each site and node: its dates and displacements in order. A node's series is bounded; a site's nodes aren't."""
    point = F.struct("t", "date", "disp")
    panel.groupBy("site_id", "node_index").agg(F.array_sort(F.collect_list(point)).alias("points")).write.parquet(path)


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """(site_id, node_index, t, date, disp) of the packs at path."""
    return spark.read.parquet(path).select("site_id", "node_index", F.explode("points").alias("p")).select("site_id", "node_index", "p.*")

"""Streaming ingest of landed rain rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopewatch.functions.common import fresh_path

SCHEMA = "site_id long, ts timestamp, rain_mm double"


def daily_means(stream: DataFrame, late: str = "3 days") -> DataFrame:
    """(site_id, date, rain_mm): mean of a site's day; a day is final once rows `late` after its end have come."""
    g = stream.withWatermark("ts", late).groupBy("site_id", F.window("ts", "1 day")).agg(F.avg("rain_mm").alias("rain_mm"))
    return g.select("site_id", F.to_date("window.start").alias("date"), "rain_mm")


def ingest(spark: SparkSession, landed: str, out: str, checkpoint: str, late: str = "3 days") -> None:
    """All files that have landed since the last run; each day is appended once. State lives in `checkpoint`."""
    rows = spark.readStream.schema(SCHEMA).parquet(landed)
    q = daily_means(rows, late).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def streamed_daily_means(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The final days of `rows`, sent through the stream once; what is still open at the end isn't there."""
    base = fresh_path(spark, "rain")
    rows.write.parquet(f"{base}/landed")
    ingest(spark, f"{base}/landed", f"{base}/days", f"{base}/state")
    return spark.read.schema("site_id long, date date, rain_mm double").parquet(f"{base}/days")

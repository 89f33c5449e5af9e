"""Regions of nodes: many small k-means at once, and the change points and their density of every region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.functions.common import cut, draw
from slopewatch.operators.panel import NODE, binary_segmentation, cpd_signal


def _nearest(point: Column, centres: Column) -> Column:
    """(distance squared, region) of the nearest of the centres; ties go to the smaller region."""
    squared = lambda c: F.aggregate(F.zip_with(point, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return F.array_min(F.transform(centres, lambda c: F.struct(F.round(squared(c["c"]), 12).alias("d"), c["region"].alias("region"))))


def site_kmeans(nodes: DataFrame, features: Sequence[str], k: int = 12, starts: int = 4, rounds: int = 40, seed: int = 7, tolerance: float = 1e-12) -> DataFrame:
    """(site_id, node_index, region): k-means of each site's nodes, all sites and all starts in the same rounds.

    Each start takes the k nodes with the least numbers drawn for it as its first centres. A round assigns every node to
    the nearest centre of its site (a list of k centres for each site and start, so no node is repeated k times) and
    takes the means, summed up before the exchange; a centre without nodes stays. Rounds end when no centre moves by
    more than `tolerance`, after `rounds` at the latest; the start with the least squared distance is kept. Sites with
    fewer than k nodes have fewer regions; null features count as 0.
    """
    p = nodes.select(*NODE, F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]).alias("x"))
    p = cut(p.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(starts - 1).cast("long")))))
    key = ["site_id", "start"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(draw(F.col("start"), F.col("node_index"), seed, 65521), "node_index"))
    centres = cut(p.withColumn("region", first).where(F.col("region") <= k).select(*key, (F.col("region") - 1).alias("region"), F.col("x").alias("c")))
    for _ in range(rounds):
        packed = centres.groupBy(*key).agg(F.collect_list(F.struct("region", "c")).alias("_c"))  # k centres each
        assigned = p.join(packed, key).select(*key, "node_index", "x", _nearest(F.col("x"), F.col("_c")).alias("n"))
        means = assigned.groupBy(*key, F.col("n.region").alias("region")).agg(F.array(*[F.avg(F.col("x")[i]) for i in range(len(features))]).alias("m"))
        moved = cut(centres.join(means, [*key, "region"], "left").select(*key, "region", F.coalesce("m", "c").alias("c"), F.array_max(F.zip_with(F.coalesce("m", "c"), "c", lambda a, b: F.abs(a - b))).alias("_s")))
        centres = moved.drop("_s")
        if (moved.agg(F.max("_s")).first()[0] or 0.0) <= tolerance:
            break
    packed = centres.groupBy(*key).agg(F.collect_list(F.struct("region", "c")).alias("_c"))
    assigned = cut(p.join(packed, key).select(*key, "node_index", _nearest(F.col("x"), F.col("_c")).alias("n")))
    cost = assigned.groupBy(*key).agg(F.round(F.sum("n.d"), 12).alias("cost")).groupBy("site_id").agg(F.min_by("start", F.struct("cost", "start")).alias("start"))
    return assigned.join(cost, key).select(*NODE, F.col("n.region").cast("long").alias("region"))


def region_changes(panel: DataFrame, regions: DataFrame, breaks: int = 4, least: int = 10, jump: int = 1) -> DataFrame:
    """(site_id, region, t): the change points of each region's mixed signal by binary segmentation, all regions at once."""
    d = panel.join(regions, NODE).withColumn("site_id", F.struct("site_id", "region"))
    found = binary_segmentation(cpd_signal(d), ["site_id"], "mix", breaks, least, jump)
    return found.select(F.col("site_id.site_id").alias("site_id"), F.col("site_id.region").alias("region"), "t")


def change_density(changes: DataFrame, regions: DataFrame, times: DataFrame, reach: int = 1) -> DataFrame:
    """(site_id, t, density): the share of a site's regions with a change point within `reach` steps, 0 where there is none. times: site_id, t."""
    n = regions.groupBy("site_id").agg(F.count_distinct("region").alias("_n"))
    near = changes.withColumn("t", F.explode(F.sequence(F.col("t") - reach, F.col("t") + reach))).groupBy("site_id", "t").agg(F.count_distinct("region").alias("_h"))
    d = times.select("site_id", "t").distinct().join(n, "site_id", "left").join(near, ["site_id", "t"], "left")
    return d.select("site_id", "t", (F.coalesce("_h", F.lit(0)) / F.greatest(F.coalesce("_n", F.lit(1)), F.lit(1))).alias("density"))

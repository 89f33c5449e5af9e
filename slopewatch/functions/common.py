"""Column helpers and small DataFrame patterns that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

By = Sequence[str]


def cols(*names) -> list[str]:
    return [n for x in names for n in ([x] if isinstance(x, str) else x)]


def with_stats(df: DataFrame, by: By, few: bool = False, **aggs: Column) -> DataFrame:
    """df with aggregates of its groups. Summed up before the shuffle and joined back, so a large group may be split.
    Groups that are `few`, as seeds are, go to all tasks, since a shuffle would lay df into as few of them."""
    if not by:
        return df.join(F.broadcast(df.agg(*[a.alias(n) for n, a in aggs.items()])))  # a single row
    stats = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])
    return df.join(F.broadcast(stats) if few else stats, list(by))


def beside(df: DataFrame, by: By, **aggs: Column) -> DataFrame:
    """df with aggregates of its groups as with_stats(), in one pass over df: for groups that a task holds whole anyway."""
    return df.dropna(subset=list(by)).withColumns({n: a.over(Window.partitionBy(*by)) for n, a in aggs.items()})


def quantile(c: Column | str, q: float) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(c, F.lit(q))


def positive_quantile(c: str, q: float) -> Column:
    """Quantile over positive values only; null if there are none."""
    return quantile(F.when(F.col(c) > 0, F.col(c)), q)


def clip(c: Column, low: float | None, high: float | None) -> Column:
    if low is not None:
        c = F.greatest(c, F.lit(low))
    return c if high is None else F.least(c, F.lit(high))


def z_score(c: Column, mean: Column, std: Column) -> Column:
    return (c - mean) / std


def de_normalised(c: Column, mean: Column, std: Column) -> Column:
    return c * std + mean


def safe_std(std: Column, least: float = 1e-6) -> Column:
    """1 where the deviation is missing or nearly zero."""
    return F.when(std >= least, std).otherwise(F.lit(1.0))


def min_max(df: DataFrame, by: By, source: str, out: str) -> DataFrame:
    """Scaled to [0, 1] within each group; constant groups become 0."""
    d = with_stats(df, by, _lo=F.min(source), _hi=F.max(source))
    scaled = F.when(F.col("_hi") - F.col("_lo") < 1e-6, 0.0).otherwise((F.col(source) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return d.withColumn(out, scaled).drop("_lo", "_hi")


def robust_scales(df: DataFrame, by: By, sources: Sequence[str], prefix: str = "scaled_") -> DataFrame:
    """(x - q25) / max(q75 - q25, 1e-6), not below 0, of several columns within each group, in one pass for all of them."""
    d = beside(df, by, **{f"_q_{c}": F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))) for c in sources})
    low, high = lambda c: F.col(f"_q_{c}")[0], lambda c: F.col(f"_q_{c}")[1]
    scaled = {prefix + c: clip((F.col(c) - low(c)) / F.greatest(high(c) - low(c), F.lit(1e-6)), 0.0, None) for c in sources}
    return d.withColumns(scaled).drop(*[f"_q_{c}" for c in sources])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only in local mode, where that setting is absent, a temporary folder is taken.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, kept in the checkpoint folder that all executors share: later steps neither repeat nor lose it."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def robust_z(df: DataFrame, by: By, source: str, out: str) -> DataFrame:
    """Deviation from the median over 1.4826 median absolute deviations; over the population deviation where that is 0."""
    d = with_stats(df, by, _m=quantile(source, 0.5), _s=F.stddev_pop(source))
    d = d.withColumn("_d", F.abs(F.col(source) - F.col("_m")))
    d = with_stats(d, by, _mad=quantile("_d", 0.5))
    scale = F.when(F.col("_mad") * 1.4826 >= 1e-6, F.col("_mad") * 1.4826).otherwise(safe_std(F.col("_s")))
    return d.withColumn(out, (F.col(source) - F.col("_m")) / scale).drop("_m", "_s", "_d", "_mad")


def sparsify(df: DataFrame, by: By, source: str, out: str, q: float = 0.75) -> DataFrame:
    """Below the q-quantile of positive values 0, the rest scaled to [0, 1]; unchanged where nothing is positive or all is equal."""
    d = with_stats(df, by, _cut=positive_quantile(source, q), _hi=F.max(source))
    span = F.col("_hi") - F.col("_cut")
    keep = F.col("_cut").isNull() | (span < 1e-6)
    return d.withColumn(out, F.when(keep, F.col(source)).otherwise(clip((F.col(source) - F.col("_cut")) / span, 0.0, 1.0))).drop("_cut", "_hi")


def asof_last(left: DataFrame, right: DataFrame, by: By, left_on: str, right_on: str, payload: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """left with the payload of the last row of right, of the same group, whose right_on isn't after left_on.

    Both sides are laid into one sorted stream for each group, so no pair of rows is formed. Of equal times the row
    last in `order` wins. Left rows without such a row get nulls.
    """
    packed = F.struct(right_on, *payload)
    r = right.select(*by, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], packed.alias("_p"))
    left = left.withColumn("_row", F.struct(*left.columns))
    ls = left.select(*by, F.col(left_on).alias("_at"), F.lit(1).alias("_side"), "_row")
    both = r.unionByName(ls, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_at", "_side", *[f"_o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_found", F.last("_p", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_row.*", F.col(f"_found.{right_on}").alias(f"asof_{right_on}"), *[F.col(f"_found.{c}").alias(f"asof_{c}") for c in payload])


def range_by_day(left: DataFrame, right: DataFrame, by: By, start: str, end: str, day: str) -> DataFrame:
    """Rows of left and right, of the same group, with right.day from left.start to left.end (dates, both included).

    Each left row is repeated for the days of its interval, so the join is on equal days; intervals must be short.
    """
    days = left.where(F.col(start) <= F.col(end)).withColumn(day, F.explode(F.sequence(F.col(start), F.col(end))))
    return days.join(right, cols(by, day))


def top_k(df: DataFrame, by: By, order: Sequence, k: int | Column) -> DataFrame:
    """The first k rows of each group; the order should be total."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def draw(perm: Column, item: Column, seed: int, span: Column | int) -> Column:
    """A number from 0 to span - 1 by fixed arithmetic, the same in any engine."""
    span = F.lit(span) if isinstance(span, int) else span
    return F.pmod(perm * 7919 + item * 104729 + seed * 31 + (perm * item) % 8191 * 131, span)


def drawn(perm, item, seed: int, span: int):
    """The same number as draw(), of NumPy's integers."""
    return (perm * 7919 + item * 104729 + seed * 31 + (perm * item) % 8191 * 131) % span


def rounded(df: DataFrame, places: int = 6, nudge: float = 0.0) -> DataFrame:
    """All doubles rounded, after `nudge` is added; -0.0 becomes 0.0."""
    return df.select(*[(F.round(F.col(c) + nudge, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def interpolated(df: DataFrame, by: By, position: str, value: str) -> DataFrame:
    """Nulls (and NaN) filled linearly between the nearest values of the group, edges by the nearest one; groups without a value get 0."""
    v = F.when(~F.isnan(value), F.col(value))
    # what lies ahead is looked up backwards: a frame to the group's end is read anew for each row
    back, ahead = (Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0) for order in (F.asc(position), F.desc(position)))
    p = F.when(v.isNotNull(), F.col(position))
    d = df.withColumn("_v0", F.last(v, True).over(back)).withColumn("_v1", F.last(v, True).over(ahead)).withColumn("_p0", F.last(p, True).over(back)).withColumn("_p1", F.last(p, True).over(ahead))
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(position) - F.col("_p0")) / (F.col("_p1") - F.col("_p0"))
    filled = F.when(F.col("_p0") == F.col("_p1"), F.col("_v0")).otherwise(F.coalesce(between, F.col("_v0"), F.col("_v1"), F.lit(0.0)))
    return d.withColumn(value, filled).drop("_v0", "_v1", "_p0", "_p1")

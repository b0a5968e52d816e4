"""Running counts and exact quantiles of groups of any size.

Equal values are counted first. The distinct values are dealt out by ranges of group and value, each range is
summed, and ranks are running sums within a range on top of the sums of the ranges before it: a group of any
size spans as many tasks as it has ranges, and none sorts or buffers it as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrant.sources.tables import cut


def cumulative(values: DataFrame, keys: list[str], order: list[str], counts: list[str]) -> DataFrame:
    """``values`` with upto_c (sum of c over the rows of the group up to this one by ``order``) and n_c (the group's) for
    each column c of ``counts``. Rows of a group differ in ``order``; null keys are a group."""
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(values.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    group = F.struct(*keys) if keys else F.lit(0)
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range at most
    sums = placed.groupBy(group.alias("_g"), "_part").agg(*[F.sum(c).alias(f"_s_{c}") for c in counts])
    sums = sums.select("_g", "_part", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in counts], *[F.sum(f"_s_{c}").over(Window.partitionBy("_g")).alias(f"n_{c}") for c in counts])
    inside = Window.partitionBy("_g", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("_g", group).join(sums, ["_g", "_part"])
    return rows.select(*values.columns, *[(F.col(f"_b_{c}") + F.sum(c).over(inside)).alias(f"upto_{c}") for c in counts], *[f"n_{c}" for c in counts])


#: Groups with at most so many distinct values are ranked in one task each; larger ones over ranges.
LARGE = 100_000


def by_size(values: DataFrame, keys: list[str], small, large) -> DataFrame:
    """``small(rows)`` of the groups of ``values`` with at most LARGE rows, and ``large(rows)`` of the others. ``values`` is a
    written table (:func:`cut`) with a row per distinct value of a group."""
    group = F.struct(*keys) if keys else F.lit(0)  # without keys all rows are one group
    sizes = values.groupBy(group.alias("_g")).agg(F.count(F.lit(1)).alias("_d"))
    if (sizes.agg(F.max("_d")).first()[0] or 0) <= LARGE:
        return small(values)
    if not keys:
        return large(values)
    big = cut(sizes.where(F.col("_d") > LARGE).select("_g"), "large-groups")
    tagged = values.withColumn("_g", group)
    return small(tagged.join(big, "_g", "left_anti").drop("_g")).unionByName(large(tagged.join(big, "_g", "left_semi").drop("_g")))


def interpolated(x: str, upto: str, n: str, q: float) -> Column:
    """The aggregate over :func:`cumulative` rows that is the linearly interpolated quantile ``q``."""
    at = (F.col(n) - 1) * F.lit(q)
    low = F.min(F.when(F.col(upto) > F.floor(at), F.col(x)))
    high = F.min(F.when(F.col(upto) > F.ceil(at), F.col(x)))
    below, above = F.max(at - F.floor(at)), F.max(F.ceil(at) - at)
    return F.when(F.max(n) > 0, F.when(below == 0, low).otherwise(above * low + below * high))


def counted(df: DataFrame, keys: list[str], x: str | Column, weight: Column | None = None) -> DataFrame:
    """keys, _x, _c (and _w, the sum of ``weight``): the distinct values of ``x`` that aren't null, with how often they occur."""
    rows = df.select(*keys, (F.col(x) if isinstance(x, str) else x).alias("_x"), (F.lit(0.0) if weight is None else weight).alias("_w")).where(F.col("_x").isNotNull())
    return rows.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"), *([] if weight is None else [F.sum("_w").alias("_w")]))


def percentiles(at: dict[str, float], count: str = "_c") -> list[Column]:
    """Aggregates over the :func:`counted` values of groups of bounded size: the quantiles ``at``, by name."""
    q = F.percentile(F.col("_x").cast("double"), F.array(*map(F.lit, at.values())), F.col(count))
    return [F.get(q, F.lit(i)).alias(name) for i, name in enumerate(at)]


def ranged(values: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """keys and the quantiles ``at`` of :func:`counted` values, over ranges of values."""
    c = cumulative(values.withColumn("_x", F.col("_x").cast("double")), keys, ["_x"], ["_c"])
    return c.groupBy(*keys).agg(*[interpolated("_x", "upto__c", "n__c", q).alias(name) for name, q in at.items()])


def quantiles(df: DataFrame, keys: list[str], x: str, at: dict[str, float]) -> DataFrame:
    """keys and one column per entry of ``at``: the exact quantiles of the values of ``x`` that aren't null. A group without any has no row;
    without keys there is always one."""
    by = cut(counted(df, keys, x), "counted")
    return by_size(by, keys, lambda rows: rows.groupBy(*keys).agg(*percentiles(at)), lambda rows: ranged(rows, keys, at))


def away(by: DataFrame, middle: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`counted` distances of counted values from their group's median."""
    return beside(by, middle, keys).groupBy(*keys, F.abs(F.col("_x") - F.col("median")).alias("_x")).agg(F.sum("_c").alias("_c"))


def deviations(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, median and mad (the median distance from it) of the values of ``x`` that aren't null. Distances are taken of the
    distinct values with their counts, so that no group is gathered for either rank."""
    mid, mad = {"median": 0.5}, {"mad": 0.5}

    def small(by: DataFrame) -> DataFrame:
        middle = by.groupBy(*keys).agg(*percentiles(mid))
        return beside(middle, away(by, middle, keys).groupBy(*keys).agg(*percentiles(mad)), keys)

    def large(by: DataFrame) -> DataFrame:
        middle = cut(ranged(by, keys, mid), "medians")
        return beside(middle, ranged(away(by, middle, keys), keys, mad), keys)

    return by_size(cut(counted(df, keys, x), "counted"), keys, small, large)


def first_reaching(values: DataFrame, keys: list[str], reached) -> DataFrame:
    """keys, value, total and plain of :func:`counted` values with weights: the least value for which ``reached(sum of _w up to
    it, sum of all)`` holds, null where there is none; the sum of all; the median without weights."""
    pick = lambda upto, all_: [F.min(F.when(reached(F.col(upto), F.col(all_)), F.col("_x"))).alias("value"), F.max(all_).alias("total")]

    def small(by: DataFrame) -> DataFrame:
        run = by.withColumn("_u", F.sum("_w").over(Window.partitionBy(*keys).orderBy("_x"))).withColumn("_t", F.sum("_w").over(Window.partitionBy(*keys)))
        return run.groupBy(*keys).agg(*pick("_u", "_t"), *percentiles({"plain": 0.5}))

    def large(by: DataFrame) -> DataFrame:
        return cumulative(by, keys, ["_x"], ["_w", "_c"]).groupBy(*keys).agg(*pick("upto__w", "n__w"), interpolated("_x", "upto__c", "n__c", 0.5).alias("plain"))

    return by_size(cut(values, "weighed"), keys, small, large)


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of ``right``, which has at most one row per group; null keys meet; without keys both have a row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # a row each
    other = right.select(F.struct(*keys).alias("_g"), *[c for c in right.columns if c not in keys])
    return left.withColumn("_g", F.struct(*keys)).join(other, "_g", "left").drop("_g")

"""Review queues, decision logs and the expansion of state spaces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.functions.scalars import hash_id


def outlier_queue(oof: DataFrame, decisions: DataFrame, key: str, threshold: float) -> DataFrame:
    """rows (id, key, y, p) with an error over the threshold, ranked within their key (ties by id), with the current
    decision as status, else pending."""
    e = F.abs(F.col("y") - F.col("p"))
    q = oof.withColumn("error", e).where(F.col("error") > threshold).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("error").desc(), "id")))
    return q.join(decisions.select(key, F.col("decision").alias("status")), key, "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def one_worst(df: DataFrame, entity: str, order: list[Column]) -> DataFrame:
    """the first row of each entity in the given total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(entity).orderBy(*order))).where("_r = 1").drop("_r")


def failure_table(scopes: dict[str, DataFrame], context: DataFrame, on: list[str]) -> DataFrame:
    """the scopes' predictions with signed and absolute error and their context."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("scope", F.lit(n)) for n, df in scopes.items()])
    return u.withColumn("signed_error", F.col("p") - F.col("y")).withColumn("abs_error", F.abs(F.col("p") - F.col("y"))).join(context, on, "left")


def plausibility_rank(df: DataFrame, group: str, item: str, x: str, reference: str, best_below: float = 8.0, margin: float = 5.0) -> DataFrame:
    """group, item, delta, winner: the candidate nearest to its reference wins when it is near enough and clear of
    the next."""
    w = Window.partitionBy(group).orderBy("delta", item)
    t = df.withColumn("delta", F.abs(F.col(x) - F.col(reference))).withColumn("_n", F.lead("delta").over(w)).withColumn("_r", F.row_number().over(w))
    clear = F.col("_n").isNull() | (F.col("_n") - F.col("delta") >= margin)
    return t.select(group, item, "delta", ((F.col("_r") == 1) & (F.col("delta") < best_below) & clear).alias("winner"))


def conflict_queue(df: DataFrame, status: str, z: str) -> DataFrame:
    """conflicts and reviews, the largest z first, nulls last."""
    return df.where(F.col(status).isin("conflict", "review")).orderBy(F.col(z).desc_nulls_last())


def top_label_counts(df: DataFrame, label: str, n: int) -> DataFrame:
    """one row, top: JSON of the n most frequent labels (ties by label)."""
    top = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), label).limit(n)
    packed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(label).alias("k"), "n"))).alias("r"))
    return packed.select(F.to_json(F.map_from_entries(F.transform("r", lambda x: F.struct(x["k"], x["n"])))).alias("top"))


def reopen_decisions(current: DataFrame, still_valid: DataFrame, key: str, decision: str) -> DataFrame:
    """F8: decisions whose candidate is no longer valid become ``defer``; previous and reopened tell the history."""
    ok = still_valid.select(key).distinct().withColumn("_ok", F.lit(True))
    j = current.join(ok, key, "left").withColumn("previous", F.col(decision)).withColumn("reopened", F.col("_ok").isNull())
    return j.withColumn(decision, F.when(F.col("reopened"), "defer").otherwise(F.col(decision))).drop("_ok")


def merge_queues(key: str, order: list[str], **queues: DataFrame) -> DataFrame:
    """queues united by priority (the order they are given in), one row per review id."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [q.withColumn("queue", F.lit(n)).withColumn("_p", F.lit(i)) for i, (n, q) in enumerate(queues.items())])
    return u.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_p", *order))).where("_r = 1").drop("_r", "_p")


def tagged_queue(df: DataFrame, tags: dict[str, Column], reviewed: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """rows with one tag or more (joined by pipes), without those already reviewed."""
    t = df.withColumn("tags", F.concat_ws("|", *[F.when(c, n) for n, c in tags.items()])).where("tags <> ''")
    return t if reviewed is None else t.join(reviewed.select(*key).distinct(), key, "left_anti")


def example_selector(df: DataFrame, strict: Column, order: list[Column], n: int) -> DataFrame:
    """the first n rows, those of the strict filter before all others."""
    return df.orderBy(F.coalesce(strict, F.lit(False)).desc(), *order).limit(n)


def class_examples(df: DataFrame, label: str, structure: str, order: list[str], n: int) -> DataFrame:
    """the first n distinct structures of each class."""
    first = df.withColumn("_d", F.row_number().over(Window.partitionBy(label, structure).orderBy(*order))).where("_d = 1").drop("_d")
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def history_merge(history: DataFrame, new: DataFrame, key: list[str], newest: list[str]) -> DataFrame:
    """History and new rows, the last one per key."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in newest])
    return history.unionByName(new).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def expand_states(df: DataFrame, key: str, levels: str, cap: int = 4096) -> DataFrame:
    """Key, truncated, state: all combinations of levels 0..n-1 by mixed-radix decoding. The number of states is
    checked before anything is expanded; over ``cap`` the entity has one row with truncated set and no state, as has one with an empty coordinate, not truncated."""
    total = F.aggregate(levels, F.lit(1).cast("long"), lambda t, n: F.when((t > cap) & (n > 0), t).otherwise(t * n))  # no further than the cap
    t = df.select(key, F.col(levels).alias("_l"), total.alias("_t")).withColumn("truncated", F.col("_t") > cap)
    radix = lambda i: F.aggregate(F.slice("_l", i + 2, F.size("_l")), F.lit(1).cast("long"), lambda a, n: a * n)
    one = lambda s: F.transform("_l", lambda n, i: F.floor(s / radix(i)) % n)
    every = F.when(~F.col("truncated") & (F.col("_t") > 0), F.transform(F.sequence(F.lit(0).cast("long"), F.col("_t") - 1), one))
    return t.select(key, "truncated", F.explode_outer(every).alias("state"))


def consistency_queue(measured: DataFrame, states: DataFrame, measurement: str, entity: str, call: str, implied: str, state: str, form: str, population: str, prefix: str = "rev_") -> DataFrame:
    """a row per measurement whose ``call`` disagrees with the ``implied`` form: entity, call, implied, the best state given the implied form (largest
    population, ties by state; null where no state has it), its population, and a stable review_id. ``states``: entity, state, form, population."""
    bad = measured.where(F.col(implied).isNotNull() & F.col(call).isNotNull() & (F.col(implied) != F.col(call)))
    top = states.groupBy(entity, F.col(form).alias(implied)).agg(F.max(population).alias("_p"))
    best = states.withColumnRenamed(form, implied).join(top, [entity, implied]).where(F.col(population) == F.col("_p")).groupBy(entity, implied).agg(F.min(state).alias("best_state"), F.first("_p").alias("best_population"))
    t = bad.join(best, [entity, implied], "left")
    return t.select(measurement, entity, call, implied, "best_state", "best_population", hash_id(prefix, F.col(measurement).cast("string"), F.col(entity).cast("string")).alias("review_id"))

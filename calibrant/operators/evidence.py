"""Evidence tables: routing, robust summaries, lineage, overrides and logs.

Every operator states its total order for ties. Nulls group as a value of their own unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.functions.scalars import first_failing
from calibrant.operators import ranks


def route_quarantine(df: DataFrame, *rules: tuple[Column, str, Column | str]) -> DataFrame:
    """``df`` with reason and detail of the first failing rule (null: accepted). Split it with
    ``where("reason is null")`` and its complement; persist or write it first if both are read."""
    reason = first_failing(*[(cond, name) for cond, name, _ in rules])
    detail = F.coalesce(*[F.when(cond, (d if isinstance(d, Column) else F.lit(d)).cast("string")) for cond, _, d in rules])
    return df.withColumn("reason", reason).withColumn("detail", detail)


def funnel(df: DataFrame, **gates: Column) -> DataFrame:
    """One row: rows and how many pass each gate and all before it."""
    passed, aggs = F.lit(True), [F.count(F.lit(1)).alias("rows")]
    for name, cond in gates.items():
        passed = passed & F.coalesce(cond, F.lit(False))
        aggs.append(F.count_if(passed).alias(name))
    return df.agg(*aggs)


def group_summary(df: DataFrame, key: str, x: str) -> DataFrame:
    """N, mean, median, sd (sample), min, max, q1, q3, iqr by key; null keys are left out."""
    rows = df.where(F.col(key).isNotNull())
    g = rows.groupBy(key).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"))
    t = ranks.beside(g, ranks.quantiles(rows.select(key, F.col(x).alias("_v")), [key], "_v", {"median": 0.5, "q1": 0.25, "q3": 0.75}), [key])
    return t.select(key, "n", "mean", "median", "sd", "min", "max", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"))


def weighted_median(df: DataFrame, keys: list[str], x: str, w: str) -> DataFrame:
    """Keys, weighted_median: the least x whose running weight reaches half; negative and null weights are 0;
    all zero: the plain median. Equal values are summed first; a group with many of them is ranked over value ranges."""
    by = ranks.counted(df, keys, x, F.greatest(F.coalesce(F.col(w).cast("double"), F.lit(0.0)), F.lit(0.0)))
    half = ranks.first_reaching(by, keys, lambda upto, total: (total > 0) & (upto >= total / 2))
    return half.select(*keys, F.when(F.col("total") > 0, F.col("value").cast("double")).otherwise(F.col("plain")).alias("weighted_median"))


def weighted_quantile(df: DataFrame, keys: list[str], x: str, w: str, q: float) -> DataFrame:
    """The first x whose cumulative share of weight reaches q (to 12 places); rows without a positive weight don't count."""
    by = ranks.counted(df.where(F.col(w) > 0), keys, x, F.col(w).cast("double"))
    return ranks.first_reaching(by, keys, lambda upto, total: F.round(upto / total, 12) >= q).select(*keys, F.col("value").alias("quantile"))


def mode_tiebreak(df: DataFrame, keys: list[str], x: str, out: str = "mode") -> DataFrame:
    """D3: the most frequent value, of equally frequent ones the first in order; blanks don't count."""
    n = df.where(F.trim(F.col(x).cast("string")) != "").groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(F.min_by(x, F.struct(-F.col("_n"), F.col(x))).alias(out))


def mad_sigma(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Median, mad, sigma (1.4826 mad), range by key."""
    spread = df.groupBy(*keys).agg((F.max(x) - F.min(x)).alias("range"))
    return ranks.beside(spread, ranks.deviations(df, keys, x), keys).select(*keys, "median", "mad", "range", (1.4826 * F.col("mad")).alias("sigma"))


def censored_summary(obs: DataFrame, key: str) -> DataFrame:
    """One row per entity of observations (value, relation, lower, upper, is_exact, is_censored, quality, id).

    Exact values: their weighted median and quartiles. Otherwise the interval of the bounds and its middle, or a
    conflict when they contradict or leave one side open. Exact against bounds and a spread over 6 conflict too.
    """
    med = weighted_median(obs.where("is_exact"), [key], "value", "quality")
    quarters = {"q1": 0.25, "q3": 0.75}
    exactly = ranks.quantiles(obs.where("is_exact"), [key], "value", {f"x{q}": at for q, at in quarters.items()})
    every = ranks.quantiles(obs, [key], "value", quarters)
    centre = obs.groupBy(key).agg(
        F.stddev_pop("value").alias("sd"), (F.max("value") - F.min("value")).alias("max_gap"),
        F.count(F.lit(1)).alias("n"), F.count_if("is_exact").alias("n_exact"), F.count_if("is_censored").alias("n_censored"),
        F.max(F.when(F.col("is_censored"), F.col("lower"))).alias("_lo"), F.min(F.when(F.col("is_censored"), F.col("upper"))).alias("_hi"),
        F.array_join(F.array_sort(F.collect_set(F.col("id").cast("string"))), "|").alias("ids"),
    )
    t = centre
    for part in (every, exactly, med, ranks.deviations(obs, [key], "value").select(key, "mad"), mode_tiebreak(obs, [key], "relation", "dominant_relation")):
        t = t.join(part, key, "left")
    exact, bounded = F.col("n_exact") > 0, F.col("_lo").isNotNull() | F.col("_hi").isNotNull()
    closed = F.coalesce(F.col("_lo") <= F.col("_hi"), F.lit(False))
    value = F.when(exact, F.col("weighted_median")).when(closed, (F.col("_lo") + F.col("_hi")) / 2)
    against = exact & (F.coalesce(F.col("weighted_median") < F.col("_lo"), F.lit(False)) | F.coalesce(F.col("weighted_median") > F.col("_hi"), F.lit(False)))
    open_ = ~exact & bounded & ~closed
    note = F.when(open_, "inconsistent_censored_bounds").when(against, "exact_vs_censored_disagreement").when(F.col("max_gap") > 6, "wide_value_spread").otherwise("")
    return t.select(
        key, value.alias("value"), F.when(exact, "exact_weighted_median").when(closed, "censored_interval").when(bounded, "censored_conflict").otherwise("").alias("method"),
        F.when(exact, F.col("xq1")).otherwise(F.col("_lo")).alias("low"), F.when(exact, F.col("xq3")).otherwise(F.col("_hi")).alias("high"),
        "n", "n_exact", "n_censored", (F.col("q3") - F.col("q1")).alias("iqr"), "mad", "sd", "max_gap", (note != "").alias("conflict"), note.alias("note"), "dominant_relation", "ids",
    )


def independent_measurements(df: DataFrame, document: str, assay: str, x: str, tier: str, order: list[str], *keys: str) -> DataFrame:
    """Copies collapse to the best tier, then the first by ``order``: same document, assay and value, or the
    same value where no document is known."""
    doc = F.trim(F.coalesce(F.col(document).cast("string"), F.lit("")))
    known = (doc != "") & (F.lower(doc) != "nan")
    lineage = F.when(known, F.concat_ws("\x1f", doc, F.coalesce(F.col(assay).cast("string"), F.lit("")), F.round(x, 6).cast("string"))).otherwise(F.concat(F.lit("\x1e"), F.round(x, 6).cast("string")))
    rank = F.when(F.col(tier) == "gold", 2).when(F.col(tier) == "silver", 1).otherwise(0)
    w = Window.partitionBy(*keys, "_lineage").orderBy(rank.desc(), *order)
    return df.withColumn("_lineage", lineage).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_lineage")


def lineage_duplicates(df: DataFrame, key: list[Column], ids: str, sources: str) -> DataFrame:
    """Lineage, n, ids, sources (JSON lists) of lineages with two rows or more."""
    lineage = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in key])
    g = df.groupBy(lineage.alias("lineage")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(ids)).alias("i"), F.sort_array(F.collect_set(sources)).alias("s")).where("n >= 2")
    return g.select("lineage", "n", F.to_json("i").alias("ids"), F.to_json("s").alias("sources"))


def replicate_target(df: DataFrame, key: str, x: str, tier: str, confidence: str, max_range: float | None = None) -> DataFrame:
    """Robust target per key: median, mad, sigma, mean, sd (population), min, max, range, n, tier (gold only if
    all are), medium_fraction, sources of weight (B14 adds it)."""
    mad = mad_sigma(df, [key], x).select(key, F.col("median").alias("target"), "mad", "sigma")
    g = df.groupBy(key).agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n"),
        F.every(F.col(tier) == "gold").alias("_gold"), F.avg((F.col(confidence) == "medium").cast("double")).alias("medium_fraction"),
    )
    out = g.join(mad, key).withColumn("range", F.col("max") - F.col("min")).withColumn("tier", F.when(F.col("_gold"), "gold").otherwise("silver")).drop("_gold")
    return out if max_range is None else out.where(F.col("range") <= max_range)


def count_fraction(df: DataFrame, *keys: str) -> DataFrame:
    """Keys, n and share of all rows; the total comes from the counts, not from the rows."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_t")))).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def exploded_counts(df: DataFrame, items: Column) -> DataFrame:
    """Item, n and share of rows that hold it."""
    return count_fraction(df.select(F.explode(F.array_distinct(items)).alias("item")), "item")


def combination_counts(df: DataFrame, items: Column) -> DataFrame:
    """Combination (sorted items, pipe-joined), n and share."""
    return count_fraction(df.select(F.array_join(F.array_sort(F.array_distinct(F.filter(items, lambda x: x != ""))), "|").alias("combination")), "combination")


def exclusive_items(df: DataFrame, item: str, source: str) -> DataFrame:
    """Items that one source alone holds, with that source."""
    return df.groupBy(item).agg(F.min(source).alias("source"), F.max(source).alias("_z")).where("source = _z").drop("_z")


def source_contribution(df: DataFrame, source: str, key: str, x: str, **flags: Column) -> DataFrame:
    """Rows, distinct keys, count and rate of each flag, mean and median by source."""
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"), F.avg(x).alias("mean")]
    for name, c in flags.items():
        aggs += [F.count_if(c).alias(name), F.avg(c.cast("double")).alias(f"{name}_rate")]
    return ranks.beside(df.groupBy(source).agg(*aggs), ranks.quantiles(df, [source], x, {"median": 0.5}), [source])


def weighted_family_prior(df: DataFrame, family: str, n: str = "n", mean: str = "mean", median: str = "median") -> DataFrame:
    """Family, mean weighted by count, median of the label with most rows (ties: larger median), count."""
    return df.groupBy(family).agg((F.sum(F.col(mean) * F.col(n)) / F.sum(n)).alias("mean"), F.max_by(median, F.struct(n, median)).alias("median"), F.sum(n).alias("count"))


def conflict_check(df: DataFrame, key: list[str], x: str) -> DataFrame:
    """Keys that map to more than one value, null counting as one."""
    return df.groupBy(*key).agg((F.count_distinct(x) + F.max(F.col(x).isNull().cast("int"))).alias("n_values")).where("n_values > 1")


def shared_weight(df: DataFrame, key: str, total: float = 0.5) -> DataFrame:
    """weight = total over the rows that share the key."""
    return df.withColumn("weight", total / F.count(F.lit(1)).over(Window.partitionBy(key)))


def weight_cap(df: DataFrame, cohort: str, weight: str, canonical: str, fraction: float) -> DataFrame:
    """Scale each cohort but the canonical one to at most ``fraction`` of the canonical weight."""
    sums = df.groupBy(cohort).agg(F.sum(weight).alias("raw"))
    base = sums.where(F.col(cohort) == canonical).select(F.col("raw").alias("canonical_raw"))
    scale = sums.crossJoin(F.broadcast(base)).select(cohort, "raw", F.when((F.col(cohort) == canonical) | (F.col("raw") <= 0), 1.0).otherwise(F.least(F.lit(1.0), fraction * F.col("canonical_raw") / F.col("raw"))).alias("scale"))
    return df.join(scale, cohort).withColumn("capped_weight", F.col(weight) * F.col("scale"))


def weight_budget(df: DataFrame, cohort: str, weight: str, canonical: str, order: list[str], fraction: float, apart: dict[str, float] | None = None) -> DataFrame:
    """Cohorts share one budget of ``fraction`` of the canonical weight: in ``order`` each is scaled to what those
    before it left. Those in ``apart`` have a budget of their own (their fraction). Adds scale and capped_weight; the
    canonical cohort and those not named keep their weight, weightless ones have scale 0."""
    sums = df.groupBy(cohort).agg(F.sum(weight).alias("raw"))  # a row per cohort
    base = sums.agg(F.coalesce(F.sum(F.when(F.col(cohort) == canonical, F.col("raw"))), F.lit(0.0)).alias("_base"))
    place = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i)])
    own = F.create_map(*[F.lit(x) for c, f in (apart or {"": 0.0}).items() for x in (c, f)])
    s = sums.crossJoin(F.broadcast(base)).withColumn("_at", place[F.col(cohort)]).withColumn("_own", own[F.col(cohort)])
    earlier = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    shared = s.where("_at is not null").withColumn("_left", F.greatest(F.lit(0.0), fraction * F.col("_base") - F.coalesce(F.sum("raw").over(earlier), F.lit(0.0))))
    rest = s.where("_at is null").withColumn("_left", F.col("_own") * F.col("_base"))
    scale = shared.unionByName(rest).select(F.col(cohort).alias("_c"), F.when(F.col("_left").isNull(), 1.0).when(F.col("raw") > 0, F.least(F.lit(1.0), F.col("_left") / F.col("raw"))).otherwise(0.0).alias("scale"))
    return df.join(scale, F.col(cohort).eqNullSafe(F.col("_c"))).drop("_c").withColumn("capped_weight", F.col(weight) * F.col("scale"))


def strict_training_filter(df: DataFrame, strict: Column, required: list[str], value: str, key: list[str], order: list[str], method: tuple[str, str] | None = None, sane: str | None = None, low: float = -5.0, high: float = 20.0) -> DataFrame:
    """The rows fit for training: ``strict`` (a single site, or for pairs the right mode and form) holds, the required
    columns are there, the method (column, name; case and outer space ignored) and the sanity flag agree where asked for,
    the value is a number within [low, high]; of rows alike in ``key`` the first by ``order`` stays. Nulls fail."""
    ok = F.coalesce(strict, F.lit(False))
    for c in required:
        ok = ok & F.col(c).isNotNull()
    if method:
        ok = ok & F.coalesce(F.lower(F.trim(F.col(method[0]).cast("string"))) == method[1].strip().lower(), F.lit(False))
    if sane:
        ok = ok & F.coalesce(F.col(sane).cast("boolean"), F.lit(False))
    ok = ok & F.coalesce(F.col(value).try_cast("double").between(low, high), F.lit(False))
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.where(ok).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(first).select("_row.*")


def latest_wins(log: DataFrame, key: list[str], *newest: str) -> DataFrame:
    """``log`` with is_current: the last row per key by ``newest`` (descending, total order)."""
    return log.withColumn("is_current", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in newest])) == 1)


def priority_dedupe(df: DataFrame, key: list[str], score: Column, value: str, order: list[str]) -> DataFrame:
    """The best row per key, and disagree: whether equally good rows hold different values (callers reject them)."""
    scored = df.withColumn("_s", score)
    best = scored.withColumn("_b", F.max("_s").over(Window.partitionBy(*key))).where("_s = _b")
    w = Window.partitionBy(*key)
    tagged = best.withColumn("disagree", F.min(value).over(w) != F.max(value).over(w)).withColumn("_r", F.row_number().over(w.orderBy(*order)))
    return tagged.where("_r = 1").drop("_s", "_b", "_r")


def carry_forward(df: DataFrame, key: list[str], order: list[str], is_main: Column, what: Column, out: str) -> DataFrame:
    """Each row with ``what`` of the last main row up to it."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.when(is_main, what), True).over(w))


def distinct_on(df: DataFrame, keys: list[str], order: list[str], records: str) -> DataFrame:
    """First row per key by ``order`` with n_copies and the sorted list of ``records``."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    g = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(first, F.count(F.lit(1)).alias("n_copies"), F.sort_array(F.collect_list(records)).alias("records"))
    return g.select("_row.*", "n_copies", "records")


def apply_overrides(df: DataFrame, overrides: DataFrame, key: list[str], column: str, newest: list[str]) -> DataFrame:
    """``column`` replaced where an override with the same key (nulls equal) is not blank, the last by ``newest``
    winning; auto_<column> keeps the automatic value, overridden says which."""
    o = latest_wins(overrides.where(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) != ""), key, *newest).where("is_current")
    o = o.select(*[F.col(k).alias(f"_o_{k}") for k in key], F.col(column).alias("_new"))
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in key])
    j = df.join(o, cond, "left")
    return j.withColumn(f"auto_{column}", F.col(column)).withColumn(column, F.coalesce("_new", F.col(column))).withColumn("overridden", F.col("_new").isNotNull()).drop("_new", *[f"_o_{k}" for k in key])


def audit_overrides(overrides: DataFrame, facts: DataFrame, key: list[str], column: str, newest: list[str]) -> DataFrame:
    """``overrides`` with a reason: stale_key, numeric_label, conflicting_duplicates, superseded (null: usable)."""
    known = facts.select(*key).distinct().withColumn("_known", F.lit(True))
    w = Window.partitionBy(*key)
    o = overrides.join(known, key, "left").withColumn("_two", F.min(column).over(w) != F.max(column).over(w))
    o = latest_wins(o, key, *newest)
    reason = first_failing((F.col("_known").isNull(), "stale_key"), (F.col(column).rlike(r"^[-+]?[0-9.]+$"), "numeric_label"), (F.coalesce("_two", F.lit(False)), "conflicting_duplicates"), (~F.col("is_current"), "superseded"))
    return o.withColumn("reason", reason).drop("_known", "_two", "is_current")


def wildcard_rules(df: DataFrame, rules: DataFrame, id_col: str, scopes: dict[str, str], value: str, tolerance: float = 1e-8) -> DataFrame:
    """Id and the first (by rule_id) matching rule of each row. ``rules``: rule_id, scope, key (text), value (null:
    any), reason; ``scopes`` names the column that each scope compares. One equality join per scope, never an OR."""
    parts = [
        df.select(id_col, F.col(c).cast("string").alias("_k"), F.col(value).alias("_v")).join(rules.where(F.col("scope") == s), F.col("_k") == F.col("key"))
        for s, c in scopes.items()
    ]
    hit = reduce(DataFrame.unionByName, parts).where(F.col("value").isNull() | (F.abs(F.col("value") - F.col("_v")) < tolerance))
    return hit.groupBy(id_col).agg(F.min_by(F.struct("rule_id", "reason"), "rule_id").alias("r")).select(id_col, "r.*")


def overlay(template: DataFrame, responses: DataFrame, key: str, mutable: list[str], enabled: str) -> DataFrame:
    """The template's rows; response values win in ``mutable`` unless the template row is enabled."""
    r = responses.select(key, *[F.col(c).alias(f"_r_{c}") for c in mutable], F.lit(True).alias("_has"))
    j = template.join(r, key, "left")
    for c in mutable:
        j = j.withColumn(c, F.when(F.col("_has") & ~F.coalesce(F.col(enabled), F.lit(False)), F.coalesce(f"_r_{c}", c)).otherwise(F.col(c)))
    return j.withColumn("source", F.when(F.col(enabled), "template").when(F.col("_has"), "response").otherwise("unanswered")).drop("_has", *[f"_r_{c}" for c in mutable])


def slot_unpivot(df: DataFrame, key: str, slots: list[tuple[str, str]], low: float, high: float, classes: list[str]) -> DataFrame:
    """(value, class) slots to rows, with the reason a slot is rejected (null: accepted); empty slots are left out."""
    stack = ", ".join(f"{i}, cast({v} as string), cast({c} as string)" for i, (v, c) in enumerate(slots, 1))
    long = df.selectExpr(key, f"stack({len(slots)}, {stack}) as (slot, raw, class)").where("raw is not null and trim(raw) <> ''")
    n = F.col("raw").try_cast("double")
    return long.withColumn("value", n).withColumn("reason", first_failing((n.isNull(), "not_numeric"), ((n < low) | (n > high), "out_of_range"), (~F.coalesce(F.col("class").isin(*classes), F.lit(False)), "unknown_class")))


def candidate_explode(df: DataFrame, key: str, listed: Column, chosen: str) -> DataFrame:
    """Key, candidate_id (label#place), label, is_true: one row per listed candidate; of several alike the first
    is the true one. Keys without a true candidate are found by summing is_true."""
    e = df.select(key, F.col(chosen).alias("_c"), F.posexplode(listed).alias("_i", "label"))
    first = F.row_number().over(Window.partitionBy(key, "label").orderBy("_i")) == 1
    return e.select(key, F.concat("label", F.lit("#"), "_i").alias("candidate_id"), "label", ((F.col("label") == F.col("_c")) & first).cast("int").alias("is_true"))

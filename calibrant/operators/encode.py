"""Categories as sparse features: joins with vocabulary tables, so that a vocabulary may be of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.operators import ranks


def tokens_of(x: str | Column, sep: str = "|") -> Column:
    """The distinct parts of a separated list that aren't empty; null: none."""
    c = F.col(x) if isinstance(x, str) else x
    return F.filter(F.array_distinct(F.split(F.coalesce(c.cast("string"), F.lit("")), "\\Q" + sep + "\\E")), lambda t: t != "")


def vocabulary(df: DataFrame, tokens: Column) -> DataFrame:
    """token and index: the distinct tokens in order, numbered from 0."""
    each = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("_one"))
    return ranks.cumulative(each.select("token", "_one"), [], ["token"], ["_one"]).select("token", (F.col("upto__one") - 1).cast("long").alias("index"))


def multi_hot(df: DataFrame, key: str, tokens: Column, words: DataFrame) -> DataFrame:
    """H: key and indices: the sorted places of the row's tokens that are in the vocabulary (those columns of the multi-hot
    vector that are 1). Keys are unique; rows without known tokens have an empty list."""
    each = df.select(key, F.explode(tokens).alias("token")).join(words, "token").groupBy(key).agg(F.array_sort(F.collect_set("index")).alias("indices"))
    return df.select(key).join(each, key, "left").select(key, F.coalesce("indices", F.array().cast("array<bigint>")).alias("indices"))


def one_hot(df: DataFrame, category: str, words: DataFrame, unknown: str = "unknown") -> DataFrame:
    """H: ``df`` with index, the place of its category (null counts as ``unknown``) in the vocabulary, null if it has none."""
    named = words.select(F.col("token").alias("_t"), "index")
    return df.join(named, F.coalesce(F.col(category).cast("string"), F.lit(unknown)) == F.col("_t"), "left").drop("_t")


def class_by_margin(df: DataFrame, category: str, margin: str, words: DataFrame, size: int) -> DataFrame:
    """H: ``df`` with features, the pairs (place, value) of the row that aren't zero: 1 at the category's place and its margin
    at that place plus ``size``, the interaction of both."""
    hot = one_hot(df, category, words)
    pair = lambda i, v: F.struct(i.cast("long").alias("place"), v.cast("double").alias("value"))
    both = F.array(pair(F.col("index"), F.lit(1.0)), pair(F.col("index") + size, F.coalesce(F.col(margin), F.lit(0.0))))
    return hot.withColumn("features", F.when(F.col("index").isNotNull(), F.filter(both, lambda p: p["value"] != 0)).otherwise(F.array().cast("array<struct<place:bigint,value:double>>"))).drop("index")

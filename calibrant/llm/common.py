"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.sources.tables import cut, drop_path, shared_dir

__all__ = ["cut", "drop_path", "shared_dir"]

#: White space of the corpus contracts: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"
LOWEST = -(1 << 63)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that :func:`cut` returned; it can't be read any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)


HOT_SHARE = 1000  # a key with over a thousandth of all rows is hot: there are fewer than so many


def join_hot(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row a key) where a key may hold any share of the rows.

    ``counts``: the key and n, its rows. Keys with over one HOT_SHARE-th of all rows, of which there are fewer than
    HOT_SHARE, take their rows of ``table`` by broadcast and stay where they are; the others meet in an exchange.
    """
    least = (counts.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE
    hot = F.broadcast(cut(counts.where(F.col("n") > least).select(key), "hot-keys"))
    told = F.broadcast(cut(table.join(hot, key, "left_semi"), "hot-rows"))
    return rows.join(hot, key, "left_anti").join(table, key, "left").unionByName(rows.join(hot, key, "left_semi").join(told, key, "left"))


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: others, whatever their names, can't clash with an operator's own.

    Raises ValueError when one is missing.
    """
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def filled(c: Column | str) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))

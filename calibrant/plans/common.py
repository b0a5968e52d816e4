"""What the registered queries share: tables, the driver-table mapping, and its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six places, and no negative zero, so that two engines agree on doubles."""
    return F.round(c, 6) + F.lit(0.0)


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with rn, their place in the order (line numbers repeat in the data)."""
    return lines.withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))


#: The same in SQL.
NUMBERED = f"(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS rn FROM lineitem)"

"""Outputs that are built again only where their inputs changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.sources.tables import drop_path


def content_digests(df: DataFrame, key: str) -> DataFrame:
    """Key, rows and digest of each key's rows; the digest hangs on their values and not on their order. A null key is one."""
    named = df.select(key, F.xxhash64(*[c for c in df.columns if c != key]).cast("decimal(38,0)").alias("_h"))
    return named.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.sum("_h").cast("string").alias("digest"))


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _lying(spark: SparkSession, data: str) -> DataFrame:
    """name, rows and digest of what lies in the partitions."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(data)
    if files.select("path").isEmpty():
        return spark.createDataFrame([], "name string, rows long, digest string")
    return content_digests(spark.read.parquet(data).drop("name").withColumnRenamed("_input", "name"), "name")


def refresh_outputs(spark: SparkSession, path: str, inputs: DataFrame, build: Callable[[DataFrame], DataFrame], settings: str = "") -> DataFrame:
    """Bring the outputs below ``path`` up to date with ``inputs`` (name, digest) and return name and status of every input.

    Outputs lie in partitions by input; read them from ``path``/data. ``build`` gets the names to make (name) and returns their rows, with name
    among the columns. An input is *reused* only if the manifest of the last run holds the same digest and ``settings`` and the rows that lie there
    still have the digest that was written; else it is built again: *new*, *changed*, *settings_changed* or *output_mismatch*. Outputs of inputs
    that are *gone* are deleted. The manifest is written last, so that what a broken run leaves behind is a mismatch in the next. Names aren't null.
    """
    root = path.rstrip("/")
    data, manifest, plan_path = f"{root}/data", f"{root}/manifest", f"{root}/plan"
    first = not (_there(spark, manifest) and _there(spark, data))
    now = inputs.select(F.col("name").cast("string").alias("name"), F.col("digest").cast("string").alias("digest"))
    if first:
        plan = now.withColumn("status", F.lit("new"))
    else:
        then = spark.read.parquet(manifest).select("name", F.col("input").alias("_in"), F.col("settings").alias("_settings"), F.col("rows").alias("_rows"), F.col("output").alias("_out"))
        whole = (F.coalesce("rows", F.lit(0)) == F.col("_rows")) & F.col("_lies").eqNullSafe(F.col("_out"))
        status = (
            F.when(F.col("digest").isNull(), "gone").when(F.col("_in").isNull(), "new").when(F.col("digest") != F.col("_in"), "changed")
            .when(F.col("_settings") != settings, "settings_changed").when(~whole, "output_mismatch").otherwise("reused")
        )
        lies = _lying(spark, data).withColumnRenamed("digest", "_lies")
        plan = now.join(then, "name", "full_outer").join(lies, "name", "left").select("name", "digest", status.alias("status"))
    plan.write.mode("overwrite").parquet(plan_path)
    plan = spark.read.schema(plan.schema).parquet(plan_path)
    todo = plan.where("status not in ('reused', 'gone')").select("name")
    for row in plan.where("status not in ('reused', 'new')").select("name").toLocalIterator():  # folders only, no data
        drop_path(spark, f"{data}/name={_escaped(spark, row.name)}")
    if first or not todo.isEmpty():
        build(todo).withColumn("_input", F.col("name").cast("string")).write.mode("overwrite" if first else "append").partitionBy("name").parquet(data)
    lies = _lying(spark, data).withColumnRenamed("digest", "output")
    kept = plan.where("status <> 'gone'").join(lies, "name", "left").select("name", F.col("digest").alias("input"), F.lit(settings).alias("settings"), F.coalesce("rows", F.lit(0)).alias("rows"), "output")
    kept.write.mode("overwrite").parquet(manifest)  # the plan and the data are read, not the manifest
    return plan.select("name", "status")


def _escaped(spark: SparkSession, name: str) -> str:
    """``name`` as Spark writes it into the path of a partition."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)

"""The batch call: one written core of graphs with populations, and the tables that are read from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from calibrant.functions.scalars import state_call
from calibrant.operators import states as st

#: Why a graph or a site asks for a second look.
UNAVAILABLE, CLOSE_STATES, BORDERLINE_SITE = "state_space_over_cap", "dominant_state_not_clear", "site_near_half"


def batch_tables(core: DataFrame, close: float = 0.1, near: float = 0.05) -> dict[str, DataFrame]:
    """The tables of a batch from its ``core``, the rows of :func:`states.with_core`:

    *sites*: graph_id, site_id, p_acid, call. *states*: graph_id, n_states, available, dominant, population (the dominant state's), gap, entropy,
    effective. *alternatives*: graph_id, rank, state, population, cumulative: the ``top`` states by population (to 9 places; ties: the smaller). *warnings*: graph_id,
    site_id (null for those of a graph), warning, value: over the cap; two states within ``close``; a site's share within ``near`` of a half.
    """
    share = F.explode(F.arrays_zip(F.transform("sites", lambda s: s["site_id"]).alias("site_id"), F.col("shares").alias("p_acid")))
    sites = core.where("available").select("graph_id", share.alias("m")).select("graph_id", "m.site_id", "m.p_acid").withColumn("call", state_call("p_acid"))
    graphs = core.select("graph_id", "n_states", "available", "dominant", F.get("top", F.lit(0))["p"].alias("population"), "gap", "entropy", "effective")
    each = core.where("available").select("graph_id", F.col("top").alias("_t")).select("graph_id", "_t", F.posexplode("_t").alias("_i", "_x"))
    upto = F.aggregate(F.slice("_t", F.lit(1), F.col("_i") + 1), F.lit(0.0), lambda t, x: t + x["p"])
    alternatives = each.select("graph_id", (F.col("_i") + 1).alias("rank"), F.col("_x.state").alias("state"), F.col("_x.p").alias("population"), upto.alias("cumulative"))
    none = F.lit(None).cast(dict(sites.dtypes)["site_id"]).alias("site_id")
    over = core.where("not available").select("graph_id", none, F.lit(UNAVAILABLE).alias("warning"), F.col("n_sites").cast("double").alias("value"))
    unclear = core.where(F.col("available") & (F.col("n_states") > 1) & (F.round("gap", 9) < close)).select("graph_id", none, F.lit(CLOSE_STATES).alias("warning"), F.col("gap").alias("value"))
    half = sites.where(F.round(F.abs(F.col("p_acid") - 0.5), 9) < near).select("graph_id", "site_id", F.lit(BORDERLINE_SITE).alias("warning"), F.col("p_acid").alias("value"))
    return {"sites": sites, "states": graphs, "alternatives": alternatives, "warnings": over.unionByName(unclear).unionByName(half)}


def run_batch(path: str, sites: DataFrame, level: float, coupling=None, pairs: DataFrame | None = None, cap: int = st.CAP, top: int = 3) -> dict[str, int]:
    """Write the core of ``sites`` (see :func:`states.graphs`) and its tables below ``path``; return the rows of each table, counted while it is
    written. The core is computed once; tables read the columns that they need."""
    spark = sites.sparkSession
    root = path.rstrip("/")
    st.with_core(st.graphs(sites, coupling=coupling, pairs=pairs, cap=cap), level, top).write.mode("overwrite").parquet(f"{root}/core")
    counts = {}
    for name, table in batch_tables(spark.read.parquet(f"{root}/core")).items():
        seen = Observation(name)
        table.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{root}/{name}")
        counts[name] = seen.get["rows"]
    return counts

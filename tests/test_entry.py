"""The registry: each query runs on the smallest tables, and SQL exists only for registered queries."""

import __spark_entry__ as entry
from calibrant.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["graph_id", "site_id", "p_acid"] and df.where("p_acid < 0 or p_acid > 1").isEmpty() and not df.isEmpty()


def test_same_result_for_one_and_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name in ("site_marginals", "censored_summary", "label_folds"):
            rows = []
            for n in ("1", "8"):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                rows.append(sorted(map(str, registry.QUERIES[name](spark, SMALL).collect())))
            assert rows[0] == rows[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

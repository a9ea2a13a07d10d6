import math

import duckdb
import pytest

from panelspark.plans import metric_queries as registry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


#: Queries whose slices share no dates at the smallest scale.
WIDE = {"slice_pairwise": "/root/testdata/sf0.01"}


def sql(query, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(query).df()


def normal(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return str(bool(x))
    return round(float(x), 6) + 0.0 if isinstance(x, int | float) or type(x).__module__ == "numpy" and hasattr(x, "item") and not isinstance(x.item(), str) and type(x).__name__ != "datetime64" else str(x)


def rows(pdf):
    return sorted([tuple(map(normal, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    sf_dir = WIDE.get(name, SF_DIR)
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), sql(registry.ORACLES[name], sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


@pytest.mark.parametrize("name", ["evaluate_individual", "evaluate_events", "evaluate_common", "evaluate_single_asset", "inspect_data", "metrics_summary", "greedy_forward_selection", "slice_period_pairwise"])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF_DIR).count() > 0


def test_registry_is_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0

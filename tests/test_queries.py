"""Every registered query of the analytics library against its SQL twin, on the smallest tables."""

import math
from pathlib import Path

import pytest

from ampgraph.plans import analytics

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(analytics.ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    df = analytics.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=key)
    cursor = duck.execute(analytics.ORACLE[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=key)
    assert sorted(names) == columns
    assert got == want


SLOW = {"el_detection_table", "el_mag_dur", "el_mag_dur_cell", "el_advantage", "el_rates", "el_sliding_eval", "el_sliding_known", "el_radii", "el_tau", "el_individual", "el_group_size"}


@pytest.mark.parametrize("name", sorted(set(analytics.QUERIES) - set(analytics.ORACLE) - SLOW))
def test_queries_without_sql_give_rows(spark, name):
    rows = analytics.QUERIES[name](spark, SF).collect()
    assert rows


@pytest.mark.parametrize("name", sorted(SLOW))
def test_experiments_give_rates(spark, name, monkeypatch):
    """Every grid, with fewer trials."""
    from ampgraph.operators import experiments

    grid = experiments.grid
    monkeypatch.setattr(experiments, "grid", lambda s, **axes: grid(s, **(axes | {"trials": [40]})))
    rows = analytics.QUERIES[name](spark, SF).collect()
    assert rows
    for r in rows:
        assert all(0 <= r[c] <= 1 for c in ("scan_rate", "meter_rate", "rate", "auc", "f1") if c in r.asDict())


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

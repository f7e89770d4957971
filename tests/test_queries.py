"""Every registered query of the library against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.plans import flights, models, registry

DATA = "/root/testdata/sf0.001"
registry.load()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v else "0"
    return "null" if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    if name == "exact_sample":
        pytest.skip("the smallest tables have as many rows as the sample at most")
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["logistic_cross_validation", "feature_tests", "forest_holdout", "boosted_importances", "components_by_variance", "feature_vectors", "automatic_vectors", "automatic_features", "logistic_odds"])
def test_joins_once(spark, monkeypatch, name):
    """Fits and tests take many passes; the join that they start from is made in one of them only."""
    made, joined = spark.sparkContext.accumulator(0), models.late_items

    def counts(_):
        made.add(1)
        return True

    met = F.udf(counts, "boolean").asNondeterministic()
    monkeypatch.setattr(models, "late_items", lambda s, d: joined(s, d).filter(met("l_orderkey")))
    registry.QUERIES[name](spark, DATA).collect()
    assert made.value == joined(spark, DATA).count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["boosted_run_cells", "model_run_cells", "pipeline_features"])
def test_prepares_once(spark, monkeypatch, name):
    """Flights are prepared in one pass; observations are read for their stations and months, and once more to be prepared."""
    read = {}
    for side in ("flights", "weather"):
        read[side] = spark.sparkContext.accumulator(0)

        def counted(s, d, side=side, table=getattr(flights, side)):
            met = F.udf(lambda _, n=read[side]: n.add(1) or True, "boolean").asNondeterministic()
            df = table(s, d)
            return df.filter(met(df.columns[0]))

        monkeypatch.setattr(flights, side, counted)
    registry.QUERIES[name](spark, DATA).collect()
    monkeypatch.undo()
    assert {side: n.value for side, n in read.items()} == {"flights": flights.flights(spark, DATA).count(), "weather": 2 * flights.weather(spark, DATA).count()}

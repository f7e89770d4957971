"""Distinct counts, sketches and quantile proofs against brute force, and their plans."""

import math
import random

import pytest

from tidewater.operators import profiling

COLUMNS = ["n", "d", "t", "a b", "column", "empty"]


def table(spark, n, seed=1):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["x", "y", None]), rnd.choice([None, 1, 2, 3]), rnd.choice([None, 0.0, -0.0, float("nan"), 2.5]), rnd.choice(["", "q", "Q", None]), rnd.randrange(500), rnd.choice([True, False, None]), None) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "g string, n int, d double, t string, `a b` long, column boolean, empty string")


def counts(rows, i):
    values = [r[i] for r in rows]
    return len(values), sum(v is not None for v in values), len({"nan" if isinstance(v, float) and math.isnan(v) else v for v in values if v is not None})


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_distinct_counts(spark, n):
    rows, df = table(spark, n)
    want = {c: counts(rows, i) for i, c in enumerate(COLUMNS, 1)} if n else {}
    found = {r["column"]: tuple(r)[1:] for r in profiling.distinct_exact(df, COLUMNS).collect()}
    assert found == want
    groups = {(g, c): counts([r for r in rows if r[0] == g], i) for g in ({r[0] for r in rows}) for i, c in enumerate(COLUMNS, 1)}
    assert {(r["g"], r["column"]): tuple(r)[2:] for r in profiling.distinct_exact(df, COLUMNS, ["g"]).collect()} == groups
    meta = {r["column"]: (r["kind"], r["completeness"], r["n_distinct"]) for r in profiling.column_metadata(df.select(*[f"`{c}`" for c in COLUMNS]), {"n": "category"}).collect()}
    kinds = dict(zip(COLUMNS, ["category", "numeric", "textual", "numeric", "other", "textual"], strict=True))
    assert meta == {c: (kinds[c], want[c][1] / n if n else None, want[c][2] if n else 0) for c in COLUMNS}
    assert {r["column"]: r["n_distinct"] for r in profiling.column_metadata(df.select(*[f"`{c}`" for c in COLUMNS]), approximate=True).collect()}.keys() == set(COLUMNS)
    assert sorted((r["g"] or "", r["n_distinct"]) for r in profiling.distinct_by(df, ["g"], "n").collect()) == sorted((g or "", len({r[1] for r in rows if r[0] == g} - {None})) for g in {r[0] for r in rows})


def test_no_row_is_multiplied_in_an_aggregate(spark):
    _, df = table(spark, 5)
    for x in (profiling.column_metadata(df), profiling.cardinalities(df, ["n", "t", "g"]), profiling.column_metadata(df, approximate=True)):
        assert "Expand" not in x._jdf.queryExecution().executedPlan().toString()


def test_sketches_merge(spark):
    df = spark.range(60_000).selectExpr("id % 7 AS day", "id % 20011 AS a", "CAST(id AS STRING) AS b", "CAST(id % 3 AS DOUBLE) AS c", "CAST(NULL AS INT) AS e")
    names, true = ["a", "b", "c", "e"], {"a": 20011, "b": 60_000, "c": 3, "e": 0}
    kept = profiling.distinct_sketches(df, names, ["day"])
    found = {r["column"]: r for r in profiling.distinct_from(kept, names).collect()}
    for c, n in true.items():
        assert abs(found[c]["n_distinct"] - n) <= 4 * profiling.sketch_error() * n and found[c]["n"] == 60_000 and found[c]["n_full"] == (0 if c == "e" else 60_000)
    some = {r["column"]: r["n_distinct"] for r in profiling.distinct_from(kept.filter("day < 2"), names).collect()}
    exact = {r["column"]: r["n_distinct"] for r in profiling.distinct_exact(df.filter("day < 2"), names).collect()}
    assert all(abs(some[c] - exact[c]) <= 4 * profiling.sketch_error() * exact[c] for c in names)
    assert [(r["n"], r["n_full"], r["n_distinct"]) for r in profiling.distinct_from(profiling.distinct_sketches(df.limit(0), ["a"]), ["a"]).collect()] == [(0, 0, 0)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quantile_ranks(spark, seed):
    rnd = random.Random(seed)
    values = [float(rnd.choice([1, 1, 5, rnd.randrange(1000)])) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 9, "v double")
    shares = [0.0, 0.1, 0.5, 0.5, 0.99, 1.0]
    found = profiling.quantile_ranks(df, "v", profiling.quantiles(df, "v", shares)).collect()
    assert sorted(r["p"] for r in found) == shares
    for r in found:
        assert (r["n"], r["below"], r["upto"]) == (2000, sum(v < r["value"] for v in values), sum(v <= r["value"] for v in values)) and r["within"]
    wrong = spark.createDataFrame([(0.5, 1000.5), (0.5, -1.0)], "p double, value double")
    assert [(r["below"], r["rank_error"], r["within"]) for r in profiling.quantile_ranks(df, "v", wrong).orderBy("value").collect()] == [(0, 0.5, False), (2000, 0.5, False)]
    assert profiling.quantile_ranks(df.limit(0), "v", profiling.quantiles(df.limit(0), "v", [0.5])).count() == 0

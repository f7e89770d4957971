"""Cleaning, joins, windows, samples and schema functions on small frames."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import clean, joins, profiling, ranks, sampling, schema, windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dirty_numbers(spark):
    df = spark.createDataFrame([("",), (" ",), ("M",), ("T",), ("s",), ("NULL",), (" 24",), ("-5.0",), ("0.02s",), (None,)], "t string")
    got = [tuple(r) for r in df.select(clean.precipitation("t").alias("a"), clean.marked_missing("t").alias("b"), clean.code_number("t").alias("c")).collect()]
    assert [g[0] for g in got] == [None, None, None, 0.0, None, None, 24.0, -5.0, 0.02, None]
    assert [g[1] for g in got] == [None, None, None, None, None, None, 24.0, -5.0, None, None]
    assert got[6][2] == 24 and got[2][2] is None


def test_first_per_key_is_stable(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (2, "x"), (None, "n")], "k int, v string")
    for n in (1, 4):
        assert set(map(tuple, clean.first_per_key(df.repartition(n), ["k"]).collect())) == {(1, "a"), (2, None), (None, "n")}


def test_flagged_and_sane(spark):
    df = spark.createDataFrame([(0.0, None, 900, 1, 2), (1.0, 0.0, 900, 1, 2), (0.0, 0.0, 2400, 1, 2), (0.0, 0.0, 900, 1, 1), (0.0, 0.0, 0, 0, 2)], "c double, d double, t int, o int, e int")
    assert clean.sane_rows(clean.drop_flagged(df, ["c", "d"]), ["t"], ["o", "e"], ("o", "e")).count() == 1


def test_guard_and_report(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "ARR_DELAY_NEW int, label_x int, label_y int, FL_DATE int")
    assert clean.guard_leakage(df, "label_x", ["ARR_DELAY_NEW"]).columns == ["label_x", "FL_DATE"]
    ok, found = clean.leakage_report(df, "label_x", ["ARR_DELAY_NEW"], ["FL_DATE"])
    assert not ok and len(found) == 3


def test_look_back_over_midnight(spark):
    obs = spark.createDataFrame([("a", 23, 1.0), ("a", 23, 5.0), ("a", 22, 2.0), ("a", 13, 3.0), ("b", 24, 9.0), (None, 1, 1.0), ("a", None, 1.0)], "k string, h long, v double")
    facts = spark.createDataFrame([(1, "a", 24), (2, "a", 25), (3, "c", 24), (4, None, 24), (5, "a", None)], "id int, k string, h long")
    got = joins.look_back(facts, obs, "k", "h", "k", "h", ["v"], 11)
    assert got.count() == 2  # never more rows than facts
    by = {r["id"]: [r[f"h{i}"].v if r[f"h{i}"] else None for i in range(1, 12)] for r in got.collect()}
    assert by[1] == [1.0, 2.0] + [None] * 8 + [3.0] and by[2] == [None, 1.0, 2.0] + [None] * 8
    assert joins.look_back(facts, obs, "k", "h", "k", "h", ["v"], 11, how="left").count() == 5
    assert joins.look_back(facts, obs, "k", "h", "k", "h", ["v"], 0) is facts
    offsets = joins.look_back_by_offsets(facts, obs, "id", "k", "h", "k", "h", ["v"], 11)
    assert offsets.count() == 5


def test_look_back_plan(spark):
    obs, facts = spark.range(100).selectExpr("id % 7 AS k", "id AS h", "id AS v"), spark.range(100).selectExpr("id AS i", "id % 7 AS k", "id AS h")
    plan = joins.look_back(facts, obs, "k", "h", "k", "h", ["v"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_coverage_sums_to_all(spark):
    obs = spark.sql("SELECT 1 AS k, timestamp'2024-01-01 10:05:00' AS t")
    facts = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 10:50:00'), (1, timestamp'2024-01-01 11:00:00'), (1, timestamp'2024-01-02 10:00:00'), (2, timestamp'2024-01-01 10:00:00') AS (k, t)")
    got = {r["reason"]: r["pct"] for r in joins.coverage_report(joins.coverage(facts, obs, "k", "t", "k", "t")).collect()}
    assert got == {"matched": 25.0, "missing_hour": 25.0, "missing_date": 25.0, "missing_station": 25.0}


def test_padded_keys(spark):
    a = spark.createDataFrame([("3011",), (" 03012 ",), ("",), (None,)], "k string")
    got = [r[0] for r in a.select(joins.padded_key("k")).collect()]
    assert got == ["03011", "03012", None, None]


def test_trailing_equals_self_join(spark):
    df = spark.range(400).selectExpr("id", "id % 5 AS k", "(id * 7919) % 86400 AS s", "CAST(id % 13 AS DOUBLE) AS v")
    a = windows.trailing_statistics(df, "k", "s", "v", 7200, 21600, [5.0]).select("id", "trailing_count", F.round("trailing_avg", 6))
    b = joins.range_statistics(df, "k", "s", "v", "id", 7200, 21600).select("id", "range_n", F.round(F.coalesce("range_avg", F.lit(0.0)), 6))
    assert rows(a) == rows(b)


def test_turnaround_around_midnight(spark):
    df = spark.createDataFrame([(30, 2350, 0.0), (1000, 900, 50.0), (1000, None, None)], "dep int, prev int, late double")
    got = [r[0] for r in df.select(windows.turnaround("dep", "prev", "late")["turnaround_buffer"]).collect()]
    assert got == [40.0, 10.0, 0.0]


@pytest.mark.parametrize("n", [1, 7])
def test_balanced_split(spark, n):
    df = spark.range(103).selectExpr("id", "CAST(id < 100 AS INT) AS y").repartition(n)
    train, test = sampling.balanced_train_test(df.withColumn("y", 1 - F.col("y")), "y", ["id"])
    assert train.groupBy("y").count().collect() != [] and {r["y"]: r["count"] for r in train.groupBy("y").count().collect()} == {1: 2, 0: 2}
    assert {r["y"]: r["count"] for r in test.groupBy("y").count().collect()} == {1: 1, 0: 1}
    assert train.join(test, "id").count() == 0
    again, _ = sampling.balanced_train_test(df.withColumn("y", 1 - F.col("y")).repartition(3), "y", ["id"])
    assert rows(train.select("id")) == rows(again.select("id"))


def test_balanced_split_by_ranks(spark):
    """Against ranks by one sort, with bounds within a bucket (equal keys have one hash) and classes that count nowhere; each
    side of the split reads the rows once, and both together twice more."""
    read = spark.sparkContext.accumulator(0)
    met = F.udf(lambda _: read.add(1) or True, "boolean").asNondeterministic()
    data = [(i // 7, i % 3 if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, y int").filter(met("id")).repartition(3)
    train, test = sampling.balanced_train_test(df, "y", ["id"], 0.6)
    got = {part: sorted(map(tuple, x.collect())) for part, x in (("train", train), ("test", test))}
    assert read.value == 4 * len(data)
    u = {r["id"]: r["u"] for r in spark.range(3000).select("id", sampling.hashed(["id"], 42).alias("u")).collect()}
    ranked = {y: sorted((r for r in data if r[1] == y), key=lambda r: (u[r[0]], r[0])) for y in (0, 1)}
    p, n = len(ranked[1]), len(ranked[0])
    k = int(p * 0.6)
    assert got["train"] == sorted(ranked[1][:k] + ranked[0][:k]) and got["test"] == sorted(ranked[1][k:] + ranked[0][k : min(p, n)])
    k = min(p, n)
    assert sorted(map(tuple, sampling.balanced(df, "y", ["id"]).collect())) == sorted(ranked[1][:k] + ranked[0][:k])


def test_partition_counts_of_the_frame_itself(spark):
    read = spark.sparkContext.accumulator(0)
    met = F.udf(lambda _: read.add(1) or True, "boolean").asNondeterministic()
    df = spark.range(60).selectExpr("id", "id % 2 AS a", "id % 3 AS b", "nullif(id % 5, 0) AS c").filter(met("id"))
    got = windows.partition_counts(df, {"na": "a", "nb": "b", "nc": "c", "nab": ["a", "b"]}).collect()
    assert len(got) == 60 and {tuple(r)[4:] for r in got} == {(30, 20, 12, 10)}
    assert read.value == 5 * 60  # once for the rows and once for each key


def test_balanced_without_a_class(spark):
    df = spark.range(10).selectExpr("id", "0 AS y")
    train, test = sampling.balanced_train_test(df, "y", ["id"])
    assert train.count() == 0 and test.count() == 0


def test_exact_sample_is_stable(spark):
    df = spark.range(1000)
    assert rows(sampling.sample_n(df.repartition(3), 17, ["id"])) == rows(sampling.sample_n(df.repartition(8), 17, ["id"]))
    assert sampling.sample_n(df, 5000, ["id"]).count() == 1000


def test_folds_cover_all(spark):
    got = {r["fold"]: r["count"] for r in sampling.with_fold(spark.range(5000), 5, ["id"]).groupBy("fold").count().collect()}
    assert sorted(got) == list(range(5)) and min(got.values()) > 800


def test_schema_functions(spark):
    df = spark.sql("SELECT 1 AS feature_carrier_id, 1 AS is_late, 'x' AS name, true AS flag, date'2024-01-01' AS day, 1.5D AS v")
    assert schema.column_types(df)["numeric"] == ["feature_carrier_id", "is_late", "v"]
    named = schema.column_types_by_name(df)
    assert named["text"] == ["name", "feature_carrier_id"] and named["boolean"] == ["flag", "is_late"]
    assert schema.validate(spark.sql("SELECT 'a' AS is_x")) and not schema.validate(df)
    with pytest.raises(ValueError):
        schema.require(df, {"v": "int"})
    assert dict(schema.normalize(spark.sql("SELECT true AS b, '20240131' AS my_date")).dtypes) == {"b": "int", "my_date": "date"}


def test_profiles_of_empty_frames(spark):
    df = spark.createDataFrame([], "a int, t string, v double")
    assert profiling.column_metadata(df).count() == 3
    assert profiling.missing_counts(df).agg(F.sum("n_missing")).first()[0] == 0
    assert profiling.text_profile(df, ["t"]).first()["n_null"] == 0
    assert profiling.step_counts(df, {"x": F.col("a") > 0}).first()["kept"] is None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_ranks(spark, monkeypatch, seed):
    """Brackets are narrowed to the value of each rank, ties and two heavy values included."""
    import random

    monkeypatch.setattr(ranks, "MAX_ORDERED", 20)
    monkeypatch.setattr(ranks, "ACCURACY", 50)
    rnd = random.Random(seed)
    values = [rnd.choice([1.0, 2.0]) for _ in range(400)] if seed == 1 else [float(rnd.randint(0, 10 ** rnd.randint(0, 6))) for _ in range(900)] + [7.0] * 300
    df = spark.createDataFrame([(x,) for x in values] + [(None,)] * 5, "x double")
    order = sorted(values)
    at = [0, 1, len(order) // 3, len(order) // 2, len(order) - 2, len(order) - 1]
    assert ranks.values_at(df, "x", ranks=at) == {r: order[r] for r in at}
    place = 0.3 * (len(order) - 1)
    low = order[int(place)]
    assert ranks.values_at(df, "x", shares=[0.3])[0.3] == pytest.approx(low + (order[int(place) + 1] - low) * (place - int(place)))
    assert ranks.values_at(df.limit(0), "x", shares=[0.5]) == {} and clean.within_iqr(df.limit(0), "x").count() == 0


@pytest.mark.parametrize("small_bytes", [0, 64 << 20])
def test_windows_cut_at_buckets(spark, monkeypatch, small_bytes):
    monkeypatch.setattr(windows, "SMALL_BYTES", small_bytes)
    rnd = random.Random(9)
    rows = [(k, rnd.choice([1, 1, 1, 2, None]), rnd.choice([None, *range(0, 3000, 7)]), rnd.choice([None, float(rnd.randrange(9))])) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, k int, s long, v double")
    bucket = windows.bucket_of(df, "s", 100)
    plain = lambda x: sorted(map(str, x.collect()))
    assert plain(clean.fill_along(df, ["v"], ["k"], ["s", "id"], bucket)) == plain(clean.fill_along(df, ["v"], ["k"], ["s", "id"]))
    assert plain(windows.deltas(df, ["v"], ["k"], ["s", "id"], bucket=bucket)) == plain(windows.deltas(df, ["v"], ["k"], ["s", "id"]))
    # as-of over spans of a week against brute force, with keys and times that are null
    week = 7 * 86_400
    obs = [(rnd.choice([1, 2, None]), rnd.choice([None, *range(0, 9 * week, week // 3)]), n) for n in range(12)]
    facts = [(n, rnd.choice([1, 2, 3, None]), rnd.choice([None, *[rnd.randrange(9 * week)] * 5])) for n in range(60)]
    got = joins.as_of(spark.createDataFrame(facts, "id int, k int, t long"), spark.createDataFrame(obs, "k int, t long, n int"), "k", "t", "k", "t", ["n"])
    want = {i: max(((t, n) for j, t, n in obs if None not in (k, at, t) and j == k and t <= at), default=None) for i, k, at in facts}
    assert {r["id"]: r["as_of"] and tuple(r["as_of"]) for r in got.collect()} == want


def test_as_of_without_an_observations_time(spark):
    facts = spark.createDataFrame([(1, 1, 10), (2, 1, None), (3, None, 10)], "id int, k int, t long")
    obs = spark.createDataFrame([(1, None, 5), (None, 3, 6)], "k int, t long, v int")
    assert [(r["id"], r["as_of"]) for r in joins.as_of(facts, obs, "k", "t", "k", "t", ["v"]).orderBy("id").collect()] == [(1, None), (2, None), (3, None)]


@pytest.mark.parametrize("keys", [[1], [1, 2, 3, None]])
def test_joins_over_time_against_pairs(spark, keys):
    """Nearest within an interval, range statistics and hour lists, against every pair; one key with all rows too,
    equal times, times at the ends of spans, nulls in keys, times and values, and rows that are equal."""
    rnd = random.Random(len(keys))
    week = 7 * 86_400
    times = [None, *[w * week + d for w in (1, 2) for d in (-1801, -1800, -1, 0, 1, 1799, 1800, 5000, 9000)], *range(0, 40_000, 700)]
    facts = [(n // 2, rnd.choice(keys), rnd.choice(times), rnd.choice([None, float(rnd.randrange(50))])) for n in range(150)]
    obs = [(rnd.choice(keys), rnd.choice(times), rnd.randrange(40), rnd.randrange(9)) for n in range(120)]
    f = spark.createDataFrame(facts, "id int, k int, s long, v double").withColumn("t", F.timestamp_seconds("s"))
    o = spark.createDataFrame(obs, "k int, s long, n int, x int").withColumn("t", F.timestamp_seconds("s"))
    text = lambda x: sorted(map(str, x))
    same = lambda a, b: None not in (*a, *b) and a[0] == b[0]

    got = joins.within_interval(f, o, "k", "t", "id", "k", "t", "n", 30, ["x"]).select("id", "k", "s", "v", "near_distance", "near_id", "x")
    want = [(i, k, s, v, *min(((abs(s - u), n, x) for j, u, n, x in obs if same((k, s), (j, u)) and abs(s - u) <= 1800), default=(None,) * 3)) for i, k, s, v in facts]
    assert text(map(tuple, got.collect())) == text(want)

    got = joins.range_statistics(f, "k", "s", "v", "id", 700, 5600).select("id", "k", "s", "v", "range_n", F.round("range_avg", 6))
    want = []
    for i, k, s, v in facts:
        inside = [w for _, j, u, w in facts if same((k, s), (j, u)) and s - 5600 <= u <= s - 700]
        full = [w for w in inside if w is not None]
        want.append((i, k, s, v, len(inside), round(sum(full) / len(full), 6) if full else None))
    assert text(map(tuple, got.collect())) == text(want)

    got = joins.day_lists(f, o, "k", "t", "k", "t", ["n"], 3).select("id", "k", "s", "observations")
    want = [(i, k, s, sorted((u // 3600, n) for j, u, n, _ in obs if same((k, s), (j, u)) and s // 3600 - 3 <= u // 3600 <= s // 3600) or None) for i, k, s, _ in facts]
    assert text((r["id"], r["k"], r["s"], r["observations"] and [tuple(x) for x in r["observations"]]) for r in got.collect()) == text(want)


def test_no_pairs_in_the_plans(spark):
    f = spark.range(10).selectExpr("id", "1 AS k", "id AS s", "1.0D AS v", "timestamp_seconds(id) AS t")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(joins.range_statistics(f, "k", "s", "v", "id", 1, 5))
    assert "Join" not in plan(joins.within_interval(f, f.withColumnRenamed("id", "n"), "k", "t", "id", "k", "t", "n"))


def test_nearest_and_coverage(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 2]), rnd.randrange(2 * 86_400), n) for n in range(90)]
    df = spark.createDataFrame(rows, "k int, s long, n int").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["k"], str(r["day"]), r["hour"]): (r["distance"], r["n"]) for r in joins.nearest_to_hours(df, "k", "ts", "n").collect()}
    for (k, day, hour), found in got.items():
        low = 86_400 * (day == "1970-01-02")
        assert found == min((abs(low + hour * 3600 - s), n) for j, s, n in rows if j == k and low <= s < low + 86_400)
    assert len(got) == 96
    facts = spark.createDataFrame([(1, k, f"2024-01-0{d} {h}:30:00") for k, d, h in ((1, 1, 10), (1, 1, 11), (1, 2, 10), (9, 1, 10))], "id int, k int, t string").withColumn("t", F.to_timestamp("t"))
    seen = spark.createDataFrame([(1, "2024-01-01 10:05:00")], "k int, t string").withColumn("t", F.to_timestamp("t"))
    assert [r["reason"] for r in joins.coverage(facts, seen, "k", "t", "k", "t").orderBy("k", "t").collect()] == ["matched", "missing_hour", "missing_date", "missing_station"]

"""Clock algebra, flags and code functions on hand-made edge rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.functions import clock, codes, flags


def one(spark, rows, schema, columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_hhmm(spark):
    rows = [(v,) for v in (0, 5, 59, 100, 1430, 2329, 2330, 2359, 2400, -1, 1270, None)]
    got = one(spark, rows, "t int", [clock.hhmm_to_minutes("t").alias("m"), clock.round_to_hour("t").alias("r"), clock.round_to_hour("t", as_hour=True).alias("h")])
    assert [g[0] for g in got] == [0, 5, 59, 60, 870, 1409, 1410, 1439, None, None, None, None]
    assert [g[1] for g in got[:8]] == [0, 0, 100, 100, 1500, 2300, 0, 0]
    assert [g[2] for g in got[:8]] == [0, 0, 1, 1, 15, 23, 0, 0]


def test_utc_carry(spark):
    d = dt.date
    rows = [(d(2012, 12, 31), 2355, -5), (d(2012, 1, 1), 5, 10), (d(2012, 2, 28), 2300, -1), (d(2012, 3, 1), 0, 0), (d(2012, 3, 1), None, 0)]
    made = clock.to_utc("d", "t", "o")
    got = one(spark, rows, "d date, t int, o int", [made["utc_time"].alias("a"), made["utc_date"].alias("b")])
    assert got == [("0455", d(2013, 1, 1)), ("1405", d(2011, 12, 31)), ("0000", d(2012, 2, 29)), ("0000", d(2012, 3, 1)), (None, None)]


def test_duration_over_midnight(spark):
    made = clock.add_duration("d", "t", "m")
    got = one(spark, [(dt.date(2012, 12, 31), 2330, 45.0), (dt.date(2012, 12, 31), 2330, 3000.0)], "d date, t int, m double", [made[k].alias(k) for k in ("arr_time", "arr_date", "arr_crosses_midnight", "arr_days_span")])
    assert got == [("0015", dt.date(2013, 1, 1), 1, 1), ("0130", dt.date(2013, 1, 3), 1, 3)]


def test_dates_in_several_formats(spark):
    got = one(spark, [("2012-01-31",), ("20120131",), ("01/31/2012",), ("x",), (None,)], "t string", [clock.parse_date("t").alias("d")])
    assert [g[0] for g in got] == [dt.date(2012, 1, 31)] * 3 + [None, None]


def test_hours_of_text(spark):
    got = one(spark, [("0015",), ("23:59",), ("905",), ("2400",), (None,)], "t string", [clock.hour_of("t").alias("h")])
    assert [g[0] for g in got] == [0, 23, 9, 0, None]


def test_flags_are_never_null(spark):
    made = flags.dataset_flags("t", "w", "n")
    rows = [(None, None, None), (15.0, 15.0, None), (60.0, None, 60.0), (30.0, 10.0, 20.05), (0.0, 0.0, 0.0), (90.0, 0.0, 14.99)]
    got = one(spark, rows, "t double, w double, n double", [made[k].alias(k) for k in ("D1", "D2_15", "D2_60", "D3", "D4")])
    assert got == [(0, 0, 0, 0, 0), (1, 1, 1, 1, 1), (1, 1, 1, 1, 1), (1, 1, 1, 1, 1), (0, 0, 0, 0, 0), (0, 0, 0, 1, 1)]


def test_horizontal_slope_is_chronological(spark):
    got = one(spark, [(3.0, 2.0, 1.0), (None, None, None)], "a double, b double, c double", [flags.horizontal(["a", "b", "c"], m).alias(m) for m in ("slope", "sum", "std", "range")])
    assert got[0][0] == 1.0 and got[0][1] == 6.0 and got[0][2] == pytest.approx((2 / 3) ** 0.5) and got[1] == (0.0, 0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        flags.horizontal(["a"], "mode")


def test_sky(spark):
    made = codes.sky_features("s")
    rows = [(None,), ("CLR",), ("FEW025 SCT040 BKN100",), ("OVC005",), ("VV002",), ("BKN",)]
    got = one(spark, rows, "s string", [made[k].alias(k) for k in ("most_critical_sky", "num_cloud_layers", "lowest_cloud_height", "ceiling", "has_low_ceiling")])
    assert got == [("UNKNOWN", 0, 99999, 99999, 0), ("CLR", 1, 99999, 99999, 0), ("BKN", 3, 2500, 10000, 0), ("OVC", 1, 500, 500, 1), ("VV", 1, 99999, 0, 1), ("BKN", 1, 99999, 99999, 0)]


def test_visibility_of_dirty_text(spark):
    made = codes.visibility_features("v")
    got = one(spark, [(" 10.00",), ("M",), ("",), (None,), ("0.25",), ("2.9",)], "v string", [made[k].alias(k) for k in ("visibility_miles", "visibility_category")])
    assert got == [(10.0, "VFR_HIGH")] * 4 + [(0.25, "LIFR"), (2.9, "IFR")]


def test_icing(spark):
    made = codes.icing_features("w", "t", "d")
    rows = [("FZRA", 10.0, 0.0), ("-SN BR", -5.0, -6.0), (None, 1.0, 0.0), (None, None, None), ("RA", 20.0, 19.0)]
    got = one(spark, rows, "w string, t double, d double", [made[k].alias(k) for k in made])
    assert got == [(1, 3), (1, 2), (1, 1), (0, 0), (0, 0)]


def test_lookup_default(spark):
    made = codes.present_weather("c")
    got = one(spark, [("61",), ("999",), ("x",), (None,)], "c string", [made["weather_type"].alias("t")])
    assert [g[0] for g in got] == ["Rain", "Clear_or_Other", "Clear_or_Other", "Clear_or_Other"]


def test_quantile_bins_fit_elsewhere(spark):
    train = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    bins = codes.QuantileBins(1e-4).fit(train, "x")
    got = one(spark, [(0.0,), (30.0,), (60.0,), (1000.0,), (None,)], "x double", [bins.column("x").alias("b")])
    assert [g[0] for g in got] == ["low", "moderate", "high", "very_high", "low"]


def test_exact_quantile_bins_cut_at_values(spark):
    for x in ([1.0, 2.0, 3.0, 10.0], [5.0], [1.0, 1.0, 1.0, 2.0, 7.0], list(map(float, range(1000)))):
        order = sorted(x)
        cuts = codes.QuantileBins(None).fit(spark.createDataFrame([(v,) for v in x] + [(None,)], "x double"), "x").cuts
        assert cuts == [order[max(0, -(-len(x) * k // 4) - 1)] for k in (1, 2, 3)]
    assert codes.QuantileBins(None).fit(spark.createDataFrame([(None,)], "x double"), "x").cuts == [0.0, 0.0, 0.0]


def test_fixed_width_never_cuts(spark):
    got = one(spark, [("7",), ("123456",)], "s string", [codes.fixed_width("s", 4).alias("f"), F.lit(1).alias("x")])
    assert [g[0] for g in got] == ["0007", "123456"]


def test_glued_weather_codes(spark):
    texts = {
        None: [], "": [], " ": [], "+": [], "A": [], "+TSRAGR": ["GR", "RA", "TS", "TSRA"], "-shra br": ["BR", "RA", "SH", "SHRA"], "RA +SN": ["RA"], "FZRAPLX": ["FZ", "FZRA", "PL", "RA"],
        "PRFG12": ["FG", "PR", "PRFG"], "RA1SN": ["RA"], "XXTSRA": ["RA", "TS", "XX"], "TS TS": ["TS"],
    }
    df = spark.createDataFrame([(t,) for t in texts], "w string")
    got = {r["w"]: r["c"] for r in df.select("w", codes.weather_code_set("w").alias("c")).collect()}
    assert got == texts
    flags = {r["w"]: r for r in df.withColumns(codes.weather_conditions("w")).collect()}
    assert (flags["+TSRAGR"]["parsed_intensity"], flags["+TSRAGR"]["parsed_thunderstorm"], flags["+TSRAGR"]["parsed_freezing"]) == ("HEAVY", 1, 0)
    assert (flags["FZRAPLX"]["parsed_freezing"], flags[None]["parsed_precipitation"], flags[None]["parsed_intensity"]) == (1, 0, "MODERATE")

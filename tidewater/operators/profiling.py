"""Aggregations and data-quality profiles (AGG-03 to AGG-20). A profile of all columns is one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.ranks import values_at

NUMERIC_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*$"


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, T.StringType):
        return "textual"
    return "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "other"


def rate_by(df: DataFrame, by: list[Column | str], flag: str, ordered: bool = True) -> DataFrame:
    """AGG-03: rows, flagged rows and their share, by a dimension."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(flag).alias("flagged"), F.avg(F.col(flag).cast("double")).alias("rate"))
    return out.orderBy(F.desc("rate"), F.desc("n")) if ordered else out


def class_balance(df: DataFrame, flag: str) -> DataFrame:
    """AGG-04: total, flagged, others, percentage and ratio."""
    t, y = F.count("*"), F.sum(F.when(F.col(flag) == 1, 1).otherwise(0))
    return df.agg(t.alias("total"), y.alias("flagged"), (t - y).alias("others"), F.round(y * 100.0 / t, 2).alias("pct"), F.round((t - y) / F.nullif(y, F.lit(0)), 2).alias("ratio"))


SKETCH_BITS = 12


def sketch_error(bits: int = SKETCH_BITS) -> float:
    """The relative standard error of a distinct count by a sketch of 2^bits registers."""
    return 1.04 / (1 << bits) ** 0.5


def _hashable(df: DataFrame, c: str) -> Column:
    v = F.col(f"`{c}`")
    return v if isinstance(df.schema[c].dataType, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)) else v.cast("string")


def distinct_sketches(df: DataFrame, columns: list[str], by: list[str] | None = None, bits: int = SKETCH_BITS) -> DataFrame:
    """A row per group of ``by`` (such as a day or a partition) with its row count ``n`` and, for each column, how many
    values are full and a sketch of them, to be stored. Sketches merge, so what is kept per partition answers for any
    union of partitions, and a new one is all that is read again."""
    made = [a for i, c in enumerate(columns) for a in (F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.hll_sketch_agg(_hashable(df, c), F.lit(bits)).alias(f"s{i}"))]
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), *made)


def distinct_from(sketches: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, column, n, n_full, n_distinct) from stored sketches of these columns, merged by group: within
    ``sketch_error`` of the true count, as a standard error."""
    made = [a for i in range(len(columns)) for a in (F.sum(f"n{i}").alias(f"n{i}"), F.hll_sketch_estimate(F.hll_union_agg(f"s{i}")).alias(f"d{i}"))]
    met = sketches.groupBy(*(by or [])).agg(F.sum("n").alias("n"), *made)
    rows = [F.struct(F.lit(c).alias("column"), F.col("n"), F.col(f"n{i}").alias("n_full"), F.coalesce(F.col(f"d{i}"), F.lit(0)).alias("n_distinct")) for i, c in enumerate(columns)]
    return met.select(*(by or []), F.explode(F.array(*rows)).alias("r")).select(*(by or []), "r.*").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("n", "n_full")})


def distinct_exact(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, column, n, n_full, n_distinct), exact: rows become (column, value) pairs, which are first counted by pair,
    before and after one shuffle, and then by column. Equal values meet before the shuffle; no column's values are held in one
    task, and no row is multiplied in an aggregate of many distinct counts."""
    some = [F.col(f"`{c}`") for c in by or []]

    def text(c: str) -> Column:
        v, t = F.col(f"`{c}`"), df.schema[c].dataType
        if isinstance(t, T.BinaryType):
            return F.hex(v)
        return (v + F.lit(0.0) if isinstance(t, (T.DoubleType, T.FloatType)) else v).cast("string")  # -0.0 is 0.0

    place = [F.struct(F.lit(i).alias("i"), text(c).alias("v")) for i, c in enumerate(columns)]
    pairs = df.select(*some, F.explode(F.array(*place)).alias("x")).groupBy(*some, "x.i", "x.v").agg(F.count("*").alias("k"))
    per = pairs.groupBy(*some, "i").agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("k"))), F.lit(0)).alias("n_full"), F.count("v").alias("n_distinct"))
    return per.select(*some, F.element_at(F.array(*map(F.lit, columns)), F.col("i") + 1).alias("column"), "n", "n_full", "n_distinct")


def distinct_by(df: DataFrame, by: list[str], c: str, name: str = "n_distinct", approximate: bool = False) -> DataFrame:
    """AGG-05: distinct values per group, most first; ``approximate`` counts by sketches (``sketch_error``)."""
    if approximate:
        found = distinct_from(distinct_sketches(df, [c], by), [c], by).select(*by, F.col("n_distinct").alias(name))
    else:
        found = df.groupBy(*by, c).agg(F.lit(1).alias("_one")).groupBy(*by).agg(F.count(c).alias(name))
    return found.orderBy(F.desc(name), *by)


def frequencies(df: DataFrame, c: str) -> DataFrame:
    """AGG-06: value and count, most frequent first."""
    return df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("value"))


def smoothed_rates(df: DataFrame, by: str, flag: str) -> DataFrame:
    """AGG-07: counts of both classes side by side and the smoothed rate (n1 + 1) / (n + 2)."""
    p = df.groupBy(by).pivot(flag, [0, 1]).agg(F.count(F.lit(1))).na.fill(0)
    return p.select(by, F.col("`0`").alias("n0"), F.col("`1`").alias("n1"), ((F.col("`1`") + 1) / (F.col("`0`") + F.col("`1`") + 2)).alias("smoothed_rate"))


def column_metadata(df: DataFrame, overrides: dict[str, str] | None = None, approximate: bool = False) -> DataFrame:
    """AGG-08, AGG-09: per column its kind (or the one that overrides it), completeness and distinct count.
    ``approximate`` counts distinct values by sketches, for wide tables at scale (``sketch_error``). An empty table
    has no completeness (null) and nothing distinct."""
    columns = df.columns
    found = distinct_from(distinct_sketches(df, columns), columns) if approximate else distinct_exact(df, columns)
    kinds = {c: kind_of(df.schema[c].dataType) for c in columns} | {c: k for c, k in (overrides or {}).items() if c in columns}
    # as many rows as columns, which the exact way has none of for an empty table
    named = df.sparkSession.createDataFrame(list(kinds.items()), "column string, kind string")
    met = named.join(found, "column", "left")
    return met.select("column", "kind", (F.col("n_full") / F.nullif(F.col("n"), F.lit(0))).alias("completeness"), F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"))


def _one_per_column(df: DataFrame, measures: dict[str, dict[str, Column]], extra: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """One scan: ``measures[column][name]`` as a row per column."""
    aggs = [c.alias(f"m{i}_{k}") for i, m in enumerate(measures.values()) for k, c in m.items()]
    rows = [F.struct(F.lit(col).alias("column"), *[F.lit(v).alias(k) for k, v in (extra or {}).get(col, {}).items()], *[F.col(f"m{i}_{k}").alias(k) for k in m]) for i, (col, m) in enumerate(measures.items())]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def missing_counts(df: DataFrame) -> DataFrame:
    """AGG-10: missing values: null, NaN in floats, blank text."""
    def missing(c: str) -> Column:
        t, v = df.schema[c].dataType, F.col(f"`{c}`")
        return v.isNull() | F.isnan(v) if isinstance(t, (T.DoubleType, T.FloatType)) else v.isNull() | (F.trim(v) == "") if isinstance(t, T.StringType) else v.isNull()

    return _one_per_column(df, {c: {"n_missing": count_if(missing(c))} for c in df.columns})


def text_profile(df: DataFrame, columns: list[str], markers: tuple[str, ...] = ("M", "s")) -> DataFrame:
    """AGG-11: null, empty, numeric-like and other values, markers, and the numeric share of the rest."""
    def measures(c: str) -> dict[str, Column]:
        v = F.col(c)
        t, full = F.trim(v), v.isNotNull() & (F.trim(v) != "")
        numeric = full & v.rlike(NUMERIC_TEXT)
        marks = {f"n_{m}": count_if(t == m) for m in markers}
        return {"n_null": count_if(v.isNull()), "n_empty": count_if(t == ""), "n_numeric": count_if(numeric), "n_other": count_if(full & ~v.rlike(NUMERIC_TEXT)), **marks, "numeric_share": F.avg(F.when(full, numeric.cast("double")))}

    return _one_per_column(df, {c: measures(c) for c in columns})


def marker_or_numeric(df: DataFrame, columns: list[str], marker: str = "M") -> DataFrame:
    """AGG-12: whether all full values of a column are the marker or numeric, and how many aren't."""
    def odd(c: str) -> Column:
        return count_if(F.col(c).isNotNull() & (F.trim(c) != marker) & ~F.col(c).rlike(NUMERIC_TEXT))

    return _one_per_column(df, {c: {"n_odd": odd(c)} for c in columns}).withColumn("conforms", F.col("n_odd") == 0)


def format_check(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """AGG-13: text values that aren't of the declared type."""
    measures = {c: {"n_values": F.count(c), "n_invalid": count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast(t).isNull())} for c, t in types.items()}
    return _one_per_column(df, measures, {c: {"type": t} for c, t in types.items()})


def summary(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """AGG-14: count, mean, standard deviation, minimum, quartiles and maximum, a row per column. Exact
    quartiles take some passes over each column; ``exact=False`` sketches them in the one that counts."""
    shares = (0.25, 0.5, 0.75)
    if exact:
        found = {c: values_at(df, c, shares=list(shares)) for c in columns}
        at = lambda c, i: F.lit(found[c].get(shares[i - 1])).cast("double")
    else:
        at = lambda c, i: F.element_at(F.percentile_approx(c, F.array(*map(F.lit, shares)), F.lit(10000)), i).cast("double")
    measures = {c: {"n": F.count(c), "mean": F.avg(c), "std": F.stddev(c), "min": F.min(c).cast("double"), "q1": at(c, 1), "median": at(c, 2), "q3": at(c, 3), "max": F.max(c).cast("double")} for c in columns}
    return _one_per_column(df, measures)


def quantiles(df: DataFrame, c: str, probabilities: list[float], relative_error: float = 1e-3) -> DataFrame:
    """AGG-15: approximate quantiles inside the plan, a row each."""
    found = df.agg(F.percentile_approx(c, F.array(*map(F.lit, probabilities)), F.lit(int(1 / relative_error))).alias("q"))
    return found.select(F.posexplode("q").alias("i", "value")).select(F.element_at(F.array(*map(F.lit, probabilities)), F.col("i") + 1).alias("p"), "value")


def quantile_ranks(df: DataFrame, c: str, found: DataFrame, relative_error: float = 1e-3) -> DataFrame:
    """AGG-15: a proof of quantiles (p, value): how many full values there are (``n``), how many lie ``below`` each
    quantile and how many at it or below (``upto``), and ``rank_error``: how far the rank p * n is outside of these, as
    a share of n; ``within`` tells whether that is the stated error at most. One scan, whatever the number of
    quantiles, which come to the driver; values are counted by the two quantiles they lie between."""
    cuts = found.select("p", "value").orderBy("value", "p").collect()
    values = sorted({r["value"] for r in cuts})
    spark = df.sparkSession
    if not values:
        return spark.createDataFrame([], "p double, value double, n long, below long, upto long, rank_error double, within boolean")
    v = F.col(c)
    bounds = F.array(*map(F.lit, values))
    # 2 j: strictly between the bounds j - 1 and j; 2 j + 1: at the bound j
    place = F.size(F.filter(bounds, lambda b: b < v)) + F.size(F.filter(bounds, lambda b: b <= v))
    counts = {r["place"]: r["n"] for r in df.filter(v.isNotNull()).groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()}
    n, rows = sum(counts.values()), []
    for r in cuts:
        j = values.index(r["value"])
        below = sum(k for at, k in counts.items() if at < 2 * j + 1)
        upto = below + counts.get(2 * j + 1, 0)
        error = max(0.0, below - r["p"] * n, r["p"] * n - upto) / n
        rows.append((r["p"], float(r["value"]), n, below, upto, error, error <= relative_error))
    return spark.createDataFrame(rows, "p double, value double, n long, below long, upto long, rank_error double, within boolean")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-16: correlation of each pair of columns, in one scan."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def consecutive_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-16: mean correlation of neighbouring columns, such as hours of a look-back."""
    pairs = list(zip(columns, columns[1:], strict=False))
    return df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).select((sum(F.col(f"c{i}") for i in range(len(pairs))) / len(pairs)).alias("mean_corr"))


def cardinalities(df: DataFrame, columns: list[str], max_bins: int = 32, approximate: bool = False) -> DataFrame:
    """AGG-17: distinct values of categorical columns, and whether they overflow a tree's bins."""
    found = column_metadata(df.select(*[F.col(f"`{c}`") for c in columns]), approximate=approximate)
    return found.select("column", "n_distinct").withColumn("overflows", F.col("n_distinct") > max_bins)


def month_coverage(facts: DataFrame, date: str, other: DataFrame, other_date: str) -> DataFrame:
    """AGG-18: facts by month, and whether the other frame covers it."""
    months = other.select(F.date_format(other_date, "yyyy-MM").alias("month")).distinct().withColumn("covered", F.lit(True))
    return facts.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(F.count("*").alias("n")).join(months, "month", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def label_statistics(df: DataFrame, severity: str, labels: list[str]) -> DataFrame:
    """AGG-19: rows, share and mean of each label by severity. One row per severity is windowed."""
    out = df.groupBy(severity).agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in labels])
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def step_counts(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """AGG-20: for filters applied in turn, rows before and after each and the share kept, in one scan."""
    passed, aggs, names = F.lit(True), [F.count("*").alias("n0")], list(steps)
    for i, s in enumerate(steps.values(), 1):
        passed = passed & F.coalesce(s, F.lit(False))
        aggs.append(count_if(passed).alias(f"n{i}"))
    rows = [F.struct(F.lit(i).alias("step"), F.lit(k).alias("name"), F.col(f"n{i - 1}").alias("before"), F.col(f"n{i}").alias("after")) for i, k in enumerate(names, 1)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("kept", F.when(F.col("before") > 0, F.col("after") / F.col("before")))

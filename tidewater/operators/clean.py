"""Projection, pruning, null handling, filters and duplicates (PRJ, FLT, NUL, DED)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.ranks import values_at
from tidewater.operators.windows import with_edges


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """PRJ-01: all columns in one projection."""
    return df.withColumns(columns) if columns else df


def convert_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """PRJ-02: casts that give null where the value doesn't fit; absent columns are skipped."""
    return with_columns(df, {c: F.col(c).cast("string").try_cast(t) if dict(df.dtypes)[c] == "string" else F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def prune(df: DataFrame, wanted: list[list[str]], essential: list[str]) -> DataFrame:
    """PRJ-03: the essential columns and the union of the wanted lists, in the frame's order, those that exist."""
    keep = set(essential).union(*wanted)
    return df.select(*[c for c in df.columns if c in keep])


#: Columns known only after the fact.
AFTER_THE_FACT = [
    "DEP_DELAY", "DEP_DELAY_NEW", "ARR_TIME", "ARR_DELAY", "ARR_DELAY_NEW", "CARRIER_DELAY", "WEATHER_DELAY", "NAS_DELAY", "SECURITY_DELAY",
    "LATE_AIRCRAFT_DELAY", "ACTUAL_ELAPSED_TIME", "AIR_TIME", "CANCELLED", "CANCELLATION_CODE", "DIVERTED", "DISTANCE", "feature_arrival_hour_rounded",
    "feature_utc_arrival_hour_rounded", "feature_arrival_hour", "feature_utc_arrival_hour", "UTC_ARR_TIME", "UTC_ARR_DATE",
]


def drop_known_later(df: DataFrame, names: list[str] = AFTER_THE_FACT) -> DataFrame:
    """PRJ-04: without the named columns, the rest sorted by name."""
    return df.select(*sorted(set(df.columns) - set(names)))


def strip_observations(df: DataFrame, array: str, drop: list[str], hour: str | None = None, relative_to: str | None = None, name: str = "hours_before") -> DataFrame:
    """PRJ-05: the array's structs without some fields, and with how many hours before ``relative_to`` each was."""
    fields = [f.name for f in df.schema[array].dataType.elementType.fields if f.name not in drop]
    before = lambda o: [F.pmod(F.col(relative_to) - o[hour], F.lit(24)).alias(name)] if hour and relative_to else []
    return df.withColumn(array, F.transform(array, lambda o: F.struct(*[o[f].alias(f) for f in fields], *before(o))))


def guard_leakage(df: DataFrame, target: str, sources: list[str], label_prefix: str = "label_", forbidden: list[str] | None = None) -> DataFrame:
    """PRJ-06: without the source columns, all labels but the target, and the forbidden identifiers if given."""
    labels = [c for c in df.columns if c.startswith(label_prefix)]
    return df.drop(*[c for c in [*sources, *labels, *(forbidden or [])] if c != target])


def leakage_report(df: DataFrame, target: str, sources: list[str], forbidden: list[str], label_prefix: str = "label_") -> tuple[bool, list[str]]:
    """PRJ-07: whether the schema is clean, and what isn't."""
    found = [f"source column {c}" for c in sources if c in df.columns]
    found += [f"label {c}" for c in df.columns if c.startswith(label_prefix) and c != target]
    found += [f"identifier {c}" for c in forbidden if c in df.columns]
    found += [] if target in df.columns else [f"target {target} is missing"]
    return not found, found


def flatten_structs(df: DataFrame, structs: dict[str, str], fields: list[str], suffixes: dict[str, str] | None = None) -> DataFrame:
    """PRJ-08: each struct column becomes ``<prefix><field><suffix>`` columns, in one projection."""
    flat = [F.col(f"{s}.{f}").alias(f"{p}{f}{(suffixes or {}).get(s, '')}") for s, p in structs.items() for f in fields]
    return df.select(*[c for c in df.columns if c not in structs], *flat)


def drop_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """FLT-01."""
    return df.na.drop(subset=columns)


def drop_flagged(df: DataFrame, flags: list[str]) -> DataFrame:
    """FLT-02: without rows of which any flag isn't 0; null counts as 0."""
    return df.filter(reduce(lambda a, b: a & b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) == 0 for c in flags]))


def sane_rows(df: DataFrame, clock: list[str], ids: list[str], different: tuple[str, str] | None = None) -> DataFrame:
    """FLT-03: times of day within 0 to 2359, ids above 0, two ids that differ."""
    tests = [F.col(c).between(0, 2359) for c in clock] + [F.col(c) > 0 for c in ids] + ([F.col(different[0]) != F.col(different[1])] if different else [])
    return df.filter(reduce(lambda a, b: a & b, tests))


def any_present(df: DataFrame, columns: list[str]) -> DataFrame:
    """FLT-04: rows with at least one of the columns."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns]))


def within_iqr(df: DataFrame, c: str, k: float = 1.5) -> DataFrame:
    """FLT-05: rows within ``k`` interquartile ranges of the exact quartiles; null values go."""
    q = values_at(df, c, shares=[0.25, 0.75])
    if not q:
        return df.limit(0)
    margin = (q[0.75] - q[0.25]) * k
    return df.filter(F.col(c).between(q[0.25] - margin, q[0.75] + margin))


def fill(df: DataFrame, values: dict) -> DataFrame:
    """NUL-01."""
    return df.na.fill(values)


def precipitation(c: str) -> Column:
    """NUL-02: blank is null, a trace (``T``) 0, else the number; with a suffix flag (``s``) the number before it."""
    t = F.trim(F.col(c))
    return F.when(t == "", F.lit(None).cast("double")).when(F.upper(t) == "T", 0.0).otherwise(F.regexp_replace(t, "[sS]$", "").try_cast("double"))


def marked_missing(c: str, marker: str = "M") -> Column:
    """NUL-03."""
    return F.nullif(F.trim(F.col(c)), F.lit(marker)).try_cast("double")


def code_number(c: str, missing: tuple[str, ...] = ("", "NULL", "M")) -> Column:
    """NUL-04: the digits of a dirty code as an integer."""
    t = F.trim(F.col(c))
    return F.when(~F.upper(t).isin(*missing), F.regexp_replace(t, "[^0-9]", "").try_cast("int"))


def with_missing_flag(df: DataFrame, c: str, suffix: str = "_missing", sentinel: float | None = None) -> DataFrame:
    """NUL-05: an indicator of null, and with a sentinel the null replaced."""
    out = {f"{c}{suffix}": F.col(c).isNull().cast("int")}
    return df.withColumns(out | ({c: F.coalesce(F.col(c), F.lit(sentinel))} if sentinel is not None else {}))


class MissingFlags:
    """NUL-06: indicators for every column whose share of nulls reaches a threshold, found by one scan of
    the frame that it is fitted on."""

    def __init__(self, threshold: float = 0.05, exclude: tuple[str, ...] = ()):
        self.threshold, self.exclude, self.columns = threshold, exclude, None

    def fit(self, df: DataFrame) -> MissingFlags:
        names = [c for c in df.columns if c not in self.exclude]
        rates = missing_rates(df, names).first()
        self.columns = [c for c in names if (rates[c] or 0) >= self.threshold]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return with_columns(df, {f"{c}_missing": F.col(c).isNull().cast("int") for c in self.columns})


def missing_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns or df.columns])


def fill_along(df: DataFrame, columns: list[str], by: list[str], order: list[str], bucket: Column | None = None) -> DataFrame:
    """NUL-07: the last known value before, else the first after, within ``by`` in ``order``. With a
    ``bucket`` of time, which must not fall along ``order``, a key's history is a task a bucket."""
    rows, cut, at = df, [], F.struct(*order)
    if bucket is not None:
        known = {c: F.when(F.col(c).isNotNull(), at) for c in columns}
        rows, cut, order = with_edges(df, by, bucket, {c: F.max_by(c, k) for c, k in known.items()}, {c: F.min_by(c, k) for c, k in known.items()}), ["_bucket"], ["_place", *order]
    w = Window.partitionBy(*by, *cut).orderBy(*order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(after)) for c in columns})
    return rows if bucket is None else rows.filter("_place = 0").drop("_place", "_bucket")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str] | None = None) -> DataFrame:
    """DED-01: one row per key: the first in ``order`` (default: all other columns), so always the same.

    ``min`` of a struct combines before the shuffle, so a hot key is no hot task. Nulls sort first."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    first = [(F.col(o) if isinstance(o, str) else o).alias(f"_order{i}") for i, o in enumerate(order or [])]
    best = F.min(F.struct(*first, *others)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, "_r.*").select(*df.columns)

"""Window features of event series (WIN-01 to WIN-09, AGG-02). Orders carry a tie-breaker.

A window over a key's whole history is one task a key. Where a ``bucket`` of time is given, the window is
cut at its bounds and each piece gets what it needs of its neighbours, so a hot key is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.clock import DAY, hhmm_to_minutes
from tidewater.functions.flags import at_least, buckets, flag


SPAN = 7 * 86_400  # seconds of a bucket
SMALL_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The planner's own estimate of a table's size, which for a plan of joins is far above it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_of(df: DataFrame, time: str, seconds: int = SPAN) -> Column:
    """The number of the span of ``seconds`` that a timestamp, date or count of seconds is in."""
    at = F.unix_date(F.col(time)) * 86_400 if dict(df.dtypes)[time] == "date" else F.col(time).cast("double")
    return F.floor(at / seconds)


def with_edges(df: DataFrame, by: list[str], bucket: Column, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``_bucket`` and ``_place`` 0, and for each key and bucket a row of place -1 with the columns
    ``before`` and one of place 1 with ``after``: each aggregate's last value in the key's earlier buckets, or
    first in its later ones, that is not null. The aggregates combine before their shuffle, and the windows
    here hold a row a bucket. A table that the planner puts below ``SMALL_BYTES`` has no long history, so its
    keys stay whole: one bucket, no edges, the same results."""
    if estimated_bytes(df) <= SMALL_BYTES:
        return df.withColumns({"_bucket": F.lit(0).cast("long"), "_place": F.lit(0)})
    df = df.withColumns({"_bucket": bucket, "_place": F.lit(0)})
    out = df
    for place, found, order in ((-1, before, F.asc("_bucket")), (1, after, F.desc("_bucket"))):
        if found:
            w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
            per = df.groupBy(*by, "_bucket").agg(*[c.alias(n) for n, c in found.items()])
            out = out.unionByName(per.select(*by, "_bucket", F.lit(place).alias("_place"), *[F.last(n, ignorenulls=True).over(w).alias(n) for n in found]), allowMissingColumns=True)
    return out


def partition_counts(df: DataFrame, keys: dict[str, str | list[str]]) -> DataFrame:
    """WIN-01: how many rows share each key, as columns. Counts are aggregated and joined back, so a hot
    key is combined before the shuffle. All are of ``df`` itself: a count over the frame that has the counts before it would
    make those again, twice as often with each key."""
    out = df
    for name, key in keys.items():
        on = [key] if isinstance(key, str) else key
        counts = df.groupBy(*on).agg(F.count("*").alias(name))
        same = counts.select(*[F.col(c).alias(f"_{c}") for c in on], name)
        condition = F.lit(True)
        for c in on:
            condition &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        out = out.join(same, condition, "left").drop(*[f"_{c}" for c in on])
    return out


def first_in_hour(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """WIN-02: per key and hour the earliest observation (ties: smallest ``tie``), with ``hour_start``."""
    hour = F.date_trunc("hour", time)
    others = [c for c in df.columns if c != key]
    best = df.groupBy(F.col(key), hour.alias("hour_start")).agg(F.min_by(F.struct(*others), F.struct(time, tie)).alias("_r"))
    return best.select(key, "hour_start", "_r.*")


def _statistics(value: Column | str, thresholds: list[float], prefix: str) -> dict[str, Column]:
    v = F.col(value) if isinstance(value, str) else value
    return {
        f"{prefix}_avg": F.avg(v), f"{prefix}_count": F.count(v), f"{prefix}_std": F.stddev(v), f"{prefix}_max": F.max(v), f"{prefix}_min": F.min(v),
        **{f"{prefix}_share_{i}": F.avg((v >= t).cast("double")) for i, t in enumerate(thresholds, 1)},
    }


def trailing_statistics(df: DataFrame, key: str, seconds: str, value: str, low: int, high: int, thresholds: list[float], prefix: str = "trailing") -> DataFrame:
    """WIN-03: statistics of the key's rows from ``high`` to ``low`` seconds before each row, by a range
    frame. Null statistics become 0 where nothing lies in the frame, but the standard deviation stays null.
    The key's history is cut into spans; a span's last ``high`` seconds are given to the next one too."""
    width = max(SPAN, 8 * high)
    own = F.floor(F.col(seconds) / width)
    near_end = F.col(seconds) - own * width >= width - high
    rows = df.withColumn("_bucket", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(key, "_bucket").orderBy(seconds).rangeBetween(-high, -low)
    found = {k: c.over(w) for k, c in _statistics(value, thresholds, prefix).items()}
    rows = rows.withColumns({k: c if k.endswith("_std") else F.coalesce(c, F.lit(0)) for k, c in found.items()})
    return rows.filter(F.col("_bucket").eqNullSafe(own)).drop("_bucket")


def hour_statistics(df: DataFrame, key: str, seconds: str, value: str, thresholds: list[float], prefix: str = "hour") -> DataFrame:
    """AGG-02: statistics by key and hour bucket."""
    agg = _statistics(value, thresholds, prefix)
    return df.groupBy(key, F.floor(F.col(seconds) / 3600).alias("bucket")).agg(*[c.alias(k) for k, c in agg.items()], F.sum(value).alias(f"{prefix}_sum"))


def rolled_buckets(stats: DataFrame, key: str, first: int, last: int, prefix: str = "hour", name: str = "rolled") -> DataFrame:
    """WIN-04: from the buckets ``first`` to ``last`` hours back (by number, so gaps count): the weighted
    mean, count, maximum and minimum."""
    w = Window.partitionBy(key).orderBy("bucket").rangeBetween(-first, -last)
    n = F.sum(f"{prefix}_count").over(w)
    return stats.select(
        key, "bucket", (F.sum(f"{prefix}_sum").over(w) / n).alias(f"{name}_avg"), F.coalesce(n, F.lit(0)).alias(f"{name}_count"),
        F.max(f"{prefix}_max").over(w).alias(f"{name}_max"), F.min(f"{prefix}_min").over(w).alias(f"{name}_min"),
    )


def previous(df: DataFrame, columns: dict[str, str], by: list[str], order: list[str], bucket: Column | None = None) -> DataFrame:
    """WIN-05, WIN-07: values of the row before, under new names. ``bucket`` must not fall along ``order``;
    without it a key is one task, which suits keys with a day in them."""
    if bucket is None:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumns({new: F.lag(c).over(w) for c, new in columns.items()})
    rows = with_edges(df.withColumn("_row", F.struct(*columns)), by, bucket, before={"_row": F.max_by("_row", F.struct(*order))})
    rows = rows.withColumn("_before", F.lag("_row").over(Window.partitionBy(*by, "_bucket").orderBy("_place", *order))).filter("_place = 0")
    return rows.withColumns({new: F.col("_before")[c] for c, new in columns.items()}).drop("_row", "_before", "_bucket", "_place")


def turnaround(departure: str, previous_arrival: str, previous_delay: str) -> dict[str, Column]:
    """WIN-06 of HHmm times: minutes between the previous arrival (with its delay) and the departure,
    around midnight; 0 without a previous leg."""
    late = F.coalesce(F.col(previous_delay).cast("double"), F.lit(0.0))
    arrived, leaves = hhmm_to_minutes(previous_arrival) + late, hhmm_to_minutes(departure)
    buffer = F.coalesce(F.when(leaves >= arrived, leaves - arrived).otherwise(leaves + DAY - arrived), F.lit(0.0))
    return gap_flags(buffer) | {"is_previous_late": flag(late > 0)}


def gap_flags(buffer: Column) -> dict[str, Column]:
    return {
        "turnaround_buffer": buffer,
        "is_tight": flag(buffer < 30),
        "is_very_tight": flag(buffer < 15),
        "turnaround_category": buckets(buffer, [(15, "very_tight"), (30, "tight"), (60, "normal"), (120, "comfortable")], "very_comfortable", strict=True),
    }


def deltas(df: DataFrame, columns: list[str], by: list[str], order: list[str], suffix: str = "_delta", bucket: Column | None = None) -> DataFrame:
    """WIN-08: value less that of the row before. ``bucket`` as in ``previous``."""
    before = previous(df, {c: f"{c}{suffix}" for c in columns}, by, order, bucket)
    return before.withColumns({f"{c}{suffix}": F.col(c) - F.col(f"{c}{suffix}") for c in columns})


def popularity_of(df: DataFrame, key: str, bounds: list[tuple[float, str]], other: str, name: str) -> DataFrame:
    """WIN-01 and FN-25: a key's row count, and its bucket."""
    return partition_counts(df, {f"{name}_count": key}).withColumn(name, at_least(f"{name}_count", bounds, other))

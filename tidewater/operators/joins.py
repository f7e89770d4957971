"""Joins between facts, dimensions and observations of a time series (JOIN-01 to JOIN-17).

Time is matched by absolute hour numbers or epoch seconds, so midnight needs no special case. The
planner chooses join types; only dimensions whose size is checked are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.clock import parse_date
from tidewater.operators.windows import SPAN, bucket_of, with_edges

MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 500_000, 64 << 20


def maybe_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows of at most ``MAX_BROADCAST_BYTES`` in
    all (text by its characters, all else by 16 bytes a value), else as it is."""
    text = [F.length(F.col(f"`{c}`")) for c, t in df.dtypes if t == "string"]
    width = reduce(lambda a, b: a + F.coalesce(b, F.lit(0)), text, F.lit(16 * len(df.columns)))
    flat = all(not t.startswith(("array", "map", "struct", "binary")) for _, t in df.dtypes)
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if flat and rows <= max_rows and size <= MAX_BROADCAST_BYTES else df


def padded_key(c: str | Column, width: int = 5) -> Column:
    s = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.when(s == "", None).otherwise(F.lpad(s, F.greatest(F.length(s), F.lit(width)), F.lit("0")))


def enrich_roles(facts: DataFrame, dim: DataFrame, dim_key: str, roles: dict[str, str], attributes: dict[str, str], how: str = "inner") -> DataFrame:
    """JOIN-01: join a dimension once per role; ``roles`` maps a fact key to the prefix of its attributes,
    ``attributes`` a dimension column to its new name."""
    for key, prefix in roles.items():
        side = dim.select(F.col(dim_key).alias(f"_{prefix}key"), *[F.col(c).alias(f"{prefix}{n}") for c, n in attributes.items()])
        facts = facts.join(maybe_broadcast(side), F.col(key) == F.col(f"_{prefix}key"), how).drop(f"_{prefix}key")
    return facts


def having_keys(facts: DataFrame, keys: DataFrame, key: str, roles: list[str], pad: int | None = None) -> DataFrame:
    """JOIN-02: facts whose every role key occurs, trimmed and not empty, among ``keys``."""
    clean = padded_key(key, pad) if pad else F.trim(F.col(key).cast("string"))
    known = keys.select(clean.alias("_k")).filter("_k <> ''").distinct()
    for role in roles:
        value = padded_key(role, pad) if pad else F.trim(F.col(role).cast("string"))
        facts = facts.join(known, value == F.col("_k"), "left_semi")
    return facts


def in_covered_months(facts: DataFrame, date: str, other: DataFrame, other_date: str) -> DataFrame:
    """JOIN-03: facts of months that the other frame has."""
    months = other.select(F.date_format(other_date, "yyyy-MM").alias("_m")).distinct()
    return facts.join(months, F.date_format(F.col(date), "yyyy-MM") == F.col("_m"), "left_semi")


def used_by_roles(observations: DataFrame, key: str, facts: DataFrame, roles: list[str]) -> DataFrame:
    """JOIN-04: observations whose key any role of the facts uses."""
    used = facts.select(F.explode(F.array(*[F.col(r) for r in roles])).alias("_k")).filter("_k IS NOT NULL").distinct()
    return observations.join(used, F.col(key) == F.col("_k"), "left_semi")


def look_back(facts: DataFrame, observations: DataFrame, fact_key: str, fact_hour: str, obs_key: str, obs_hour: str, fields: list[str], depth: int,
              prefix: str = "h", how: str = "inner", row_id: str | None = None) -> DataFrame:
    """JOIN-05, AGG-01: each fact with the key's observations of the hours before it, as struct columns
    ``<prefix>1`` (the last hour) to ``<prefix><depth>``; missing hours are null.

    Hours are absolute numbers (hours since the epoch). Observations are gathered in maps of one day of
    hours, each also given to the next day, so one equi-join on (key, day) reaches back over midnight.
    ``observations`` has one row per key and hour, or the first by its fields counts. ``inner`` keeps facts
    whose key has any observation on that day or the day before; ``left`` keeps all. Depth below 1 adds
    nothing. Facts with a null key or hour match nothing."""
    if depth < 1:
        return facts
    if depth > 24:
        raise ValueError("a look-back reaches at most 24 hours")
    obs = observations.filter(F.col(obs_key).isNotNull() & F.col(obs_hour).isNotNull()).groupBy(F.col(obs_key).alias("_k"), F.col(obs_hour).cast("long").alias("_h")).agg(F.min(F.struct(*fields)).alias("_o"))
    day = F.floor(F.col("_h") / 24)
    days = (
        obs.select("_k", F.explode(F.array(day, day + 1)).alias("_d"), "_h", "_o")
        .groupBy("_k", "_d").agg(F.map_from_entries(F.collect_list(F.struct("_h", "_o"))).alias("_m"))
    )
    h = F.col(fact_hour).cast("long")
    joined = facts.join(days, (F.col(fact_key) == F.col("_k")) & (F.floor(h / 24) == F.col("_d")), how)
    return joined.withColumns({f"{prefix}{i}": F.try_element_at("_m", h - i) for i in range(1, depth + 1)}).drop("_k", "_d", "_m")


def look_back_by_offsets(facts: DataFrame, observations: DataFrame, fact_id: str, fact_key: str, fact_hour: str, obs_key: str, obs_hour: str, fields: list[str], depth: int, how: str = "left") -> DataFrame:
    """JOIN-14: facts fanned out to one row per hour offset, joined on (key, hour) and gathered per fact as
    an array of structs with the offset, nearest first. Facts without observations stay with ``left``."""
    fan = facts.select(F.col(fact_id).alias("_id"), F.col(fact_key).alias("_k"), F.col(fact_hour).cast("long").alias("_at"), F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("_o"))
    obs = observations.select(F.col(obs_key).alias("_k"), F.col(obs_hour).cast("long").alias("_h"), *[F.col(f) for f in fields])
    met = fan.join(obs, (fan["_k"] == obs["_k"]) & (fan["_at"] - fan["_o"] == obs["_h"])).groupBy("_id").agg(F.array_sort(F.collect_list(F.struct(F.col("_o").alias("hours_before"), *fields))).alias("observations"))
    return facts.join(met, facts[fact_id] == met["_id"], how).drop("_id")


def unknown_keys(facts: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """JOIN-07: facts whose key the dimension lacks (null keys too)."""
    return facts.join(maybe_broadcast(dim.select(F.col(dim_key).alias("_k")).distinct()), F.col(key) == F.col("_k"), "left_anti")


def coverage(facts: DataFrame, observations: DataFrame, key: str, time: str, obs_key: str, obs_time: str) -> DataFrame:
    """JOIN-08: each fact with ``reason``: matched, missing_hour, missing_date or missing_station."""
    o = observations.select(F.col(obs_key).alias("_k"), F.to_date(obs_time).alias("_d"), F.hour(obs_time).alias("_h")).distinct()
    hours = o.withColumn("_hit", F.lit(1))
    days = o.select("_k", "_d").distinct().withColumn("_day", F.lit(1))
    keys = o.select("_k").distinct().withColumn("_key", F.lit(1))
    f = facts.withColumns({"_fd": F.to_date(time), "_fh": F.hour(time)})
    f = f.join(keys, f[key] == keys["_k"], "left").drop("_k")
    f = f.join(days, (f[key] == days["_k"]) & (f["_fd"] == days["_d"]), "left").drop("_k", "_d")
    f = f.join(hours, (f[key] == hours["_k"]) & (f["_fd"] == hours["_d"]) & (f["_fh"] == hours["_h"]), "left").drop("_k", "_d", "_h")
    reason = F.when(F.col("_hit") == 1, "matched").when(F.col("_day") == 1, "missing_hour").when(F.col("_key") == 1, "missing_date").otherwise("missing_station")
    return f.withColumn("reason", reason).drop("_fd", "_fh", "_hit", "_day", "_key")


def coverage_report(covered: DataFrame) -> DataFrame:
    """Counts and shares by reason; the shares add up to 100. One row per reason is windowed."""
    n = covered.groupBy("reason").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))


def nearest_to_hours(observations: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """JOIN-09: for each key and day of the frame and each of its 24 hours, the observation of that day
    nearest in time; ties go to the smaller ``tie``. Rows without a key or time are left out.

    Only an hour's first and last observation can be nearest to a full hour, so those are aggregated, and
    the 24 hours of a key-day look among 48 of them at most."""
    o = observations.select(key, F.to_date(time).alias("day"), F.unix_timestamp(time).alias("_t"), tie).filter(F.col(key).isNotNull() & F.col("_t").isNotNull())
    o = o.withColumn("_t", F.col("_t") - F.unix_timestamp(F.col("day").cast("timestamp")))
    ends = o.groupBy(key, "day", F.floor(F.col("_t") / 3600).alias("_h")).agg(F.min(F.struct("_t", tie)).alias("_first"), F.min(F.struct((-F.col("_t")).alias("_t"), tie)).alias("_last"))
    ends = ends.select(key, "day", F.explode(F.array("_first", F.struct((-F.col("_last._t")).alias("_t"), F.col(f"_last.{tie}").alias(tie)))).alias("_e"))
    days = ends.groupBy(key, "day").agg(F.collect_list("_e").alias("_e"))
    nearest = lambda h: F.array_min(F.transform("_e", lambda e: F.struct(F.abs(h * 3600 - e["_t"]).alias("distance"), e[tie].alias(tie))))
    return days.select(key, "day", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(23)), nearest)).alias("hour", "_n")).select(key, "day", "hour", "_n.*")


def range_statistics(facts: DataFrame, key: str, seconds: str, value: str, row_id: str, low: int, high: int, names: str = "range") -> DataFrame:
    """JOIN-10: count and mean of the same key's rows ``low`` to ``high`` seconds before each row (0 and null
    without any; null values count as rows). Rows without a key or time have none, and are in nobody's range.

    The range's sums are the difference of two running sums: those up to ``low`` seconds before and those
    before ``high`` seconds before. Both are read off one sorted pass over rows and readings, so a hot key
    costs no pairs. A key's history is cut into spans; a span's last ``high`` seconds are given to the next
    one too, so that sums stay short and a key is many tasks."""
    at, width = F.col(seconds), max(SPAN, 8 * high)
    known = F.col(key).isNotNull() & at.isNotNull()
    own = F.floor(at / width)
    spans = F.explode(F.when(at - own * width >= width - high, F.array(own, own + 1)).otherwise(F.array(own)))
    rows = facts.filter(known).select(F.col(key).alias("_k"), spans.alias("_bucket"), at.cast("long").alias("_at"), F.lit(1).alias("_order"), F.col(value).cast("double").alias("_v"))
    row = F.struct(*[F.col(f"`{c}`") for c in facts.columns])
    # a reading of order 0 comes before rows of its own time, one of order 2 after them
    readings = F.explode(F.array(*[F.struct((at - s).cast("long").alias("at"), F.lit(o).alias("order")) for s, o in ((high, 0), (low, 2))]))
    read = facts.filter(known).withColumn("_n", F.monotonically_increasing_id()).select(F.col(key).alias("_k"), own.alias("_bucket"), row.alias("_f"), "_n", readings.alias("_r"))
    both = rows.unionByName(read.select("_k", "_bucket", F.col("_r.at").alias("_at"), F.col("_r.order").alias("_order"), "_f", "_n"), allowMissingColumns=True)
    w = Window.partitionBy("_k", "_bucket").orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, 0)
    sign = F.col("_order") - 1
    is_row = F.col("_order") == 1
    found = both.select("_k", "_bucket", "_f", "_n", "_order", F.count(F.when(is_row, 1)).over(w).alias("_c"), F.count("_v").over(w).alias("_cv"), F.sum("_v").over(w).alias("_s")).filter(~is_row)
    # both readings of a row are in one task already
    met = found.groupBy("_k", "_bucket", "_n").agg(F.first("_f").alias("_f"), F.sum(sign * F.col("_c")).alias("_c"), F.sum(sign * F.col("_cv")).alias("_cv"), F.sum(sign * F.coalesce("_s", F.lit(0.0))).alias("_s"))
    made = met.select("_f.*", F.col("_c").cast("long").alias(f"{names}_n"), F.when(F.col("_cv") > 0, F.col("_s") / F.col("_cv")).alias(f"{names}_avg"))
    return made.unionByName(facts.filter(~known).withColumns({f"{names}_n": F.lit(0).cast("long"), f"{names}_avg": F.lit(None).cast("double")}))


def day_lists(facts: DataFrame, observations: DataFrame, fact_key: str, fact_time: str, obs_key: str, obs_time: str, fields: list[str], back: int = 12) -> DataFrame:
    """JOIN-11: facts left-joined to the list of observations of the ``back`` hours before and the hour itself,
    oldest first; null where there are none.

    Observations are gathered by key and hour, each once. The hours that facts need are looked up by key and
    hour, once for all facts of one hour, and their lists are joined up; no list of a day is made."""
    hour = lambda c: F.floor(F.unix_timestamp(c) / 3600)
    lists = observations.select(F.col(obs_key).alias("_k"), hour(obs_time).alias("hour"), *fields).filter("_k IS NOT NULL AND hour IS NOT NULL")
    lists = lists.groupBy("_k", F.col("hour").alias("_h")).agg(F.array_sort(F.collect_list(F.struct("hour", *fields))).alias("_l"))
    wanted = facts.select(F.col(fact_key).alias("_k"), hour(fact_time).alias("_at")).filter("_k IS NOT NULL AND _at IS NOT NULL").distinct()
    wanted = wanted.withColumn("_h", F.explode(F.sequence(F.col("_at") - back, F.col("_at"))))
    met = wanted.join(lists, ["_k", "_h"]).groupBy("_k", "_at").agg(F.array_sort(F.collect_list(F.struct("_h", "_l"))).alias("_hours"))
    met = met.select("_k", "_at", F.flatten(F.col("_hours._l")).alias("observations"))
    return facts.join(met, (F.col(fact_key) == F.col("_k")) & (hour(fact_time) == F.col("_at")), "left").drop("_k", "_at")


def reconcile(left: DataFrame, right: DataFrame, keys: dict[str, str], left_date: str, right_date: str) -> DataFrame:
    """JOIN-12: inner join on keys and a date that either side may hold as text in one of several formats."""
    a = left.withColumn("_date", parse_date(F.col(left_date).cast("string")) if dict(left.dtypes)[left_date] == "string" else F.to_date(left_date))
    text = F.regexp_extract(F.col(right_date), r"^\s*(\S+)", 1)
    b = right.select(*[F.col(r).alias(f"_{r}") for r in keys.values()], F.coalesce(parse_date(text), F.try_to_timestamp(text, F.lit("M/d/yyyy")).cast("date")).alias("_right"))
    on = F.col("_date") == F.col("_right")
    for x, y in keys.items():
        on &= F.col(x) == F.col(f"_{y}")
    return a.join(b, on).drop("_date", "_right", *[f"_{r}" for r in keys.values()])


def join_buckets(facts: DataFrame, statistics: DataFrame, key: str, bucket: str) -> DataFrame:
    """JOIN-13: facts with the statistics of their key and bucket, left."""
    return facts.join(statistics, [key, bucket], "left")


def as_of(facts: DataFrame, observations: DataFrame, key: str, time: str, obs_key: str, obs_time: str, fields: list[str], name: str = "as_of") -> DataFrame:
    """JOIN-15: each fact with the last observation at or before it, as a struct with its time; null if
    there is none. Observations without a key or time are nobody's; facts without either have none. One sort
    over the union of both sides, no range join; a tie takes the greatest. A long history of a key is cut into
    spans, each of which gets the last observation before it."""
    lead = [F.col(obs_time).alias("time"), *[F.col(f) for f in fields]]
    kind = observations.select(F.struct(*lead).alias("s")).schema["s"].dataType
    row = F.struct(*[F.col(f"`{c}`") for c in facts.columns])
    known = F.col(key).isNotNull() & F.col(time).isNotNull()
    a = facts.filter(known).select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(1).alias("_late"), row.alias("_f"), F.lit(None).cast(kind).alias("_o"))
    b = observations.filter(F.col(obs_key).isNotNull() & F.col(obs_time).isNotNull())
    b = b.select(F.col(obs_key).alias("_k"), F.col(obs_time).alias("_t"), F.lit(0).alias("_late"), F.lit(None).cast(a.schema["_f"].dataType).alias("_f"), F.struct(*lead).alias("_o"))
    both = a.unionByName(b)
    both = with_edges(both, ["_k"], bucket_of(both, "_t"), before={"_o": F.max("_o")})
    w = Window.partitionBy("_k", "_bucket").orderBy("_place", "_t", "_late", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_last", F.last("_o", ignorenulls=True).over(w))
    met = both.filter("_place = 0 AND _late = 1").select("_f.*", F.col("_last").alias(name))
    return met.unionByName(facts.filter(~known).withColumn(name, F.lit(None).cast(kind)))


def within_interval(facts: DataFrame, observations: DataFrame, key: str, time: str, row_id: str, obs_key: str, obs_time: str, tie: str, minutes: int = 30, fields: list[str] | None = None) -> DataFrame:
    """JOIN-16: each fact with the observation nearest to it within ``minutes`` either way, left (times in whole
    seconds); ties go to the smaller ``tie``. Facts or observations without a key or time match nothing.

    Of a key's observations only the last at or before a fact and the first after it can be nearest, so one
    pass over the union of both sides in time order finds the one, and one in reverse order the other: no fact
    meets more than two observations, however many a key has. A key's history is cut into spans; observations
    near a span's ends are given to the neighbouring span too."""
    near, width = minutes * 60, max(SPAN, 8 * minutes * 60)
    some = [F.col(f) for f in fields or []]
    known = F.col(key).isNotNull() & F.col(time).isNotNull()
    row = F.struct(*[F.col(f"`{c}`") for c in facts.columns])
    at = F.unix_timestamp(time)
    f = facts.filter(known).select(F.col(key).alias("_k"), at.alias("_s"), F.floor(at / width).alias("_bucket"), F.lit(1).alias("_late"), row.alias("_f"))
    o = observations.filter(F.col(obs_key).isNotNull() & F.col(obs_time).isNotNull()).groupBy(F.col(obs_key).alias("_k"), F.unix_timestamp(obs_time).alias("_s")).agg(F.min(F.struct(F.col(tie).alias("near_id"), *some)).alias("_v"))
    own = F.floor(F.col("_s") / width)
    past = F.col("_s") - own * width
    spans = F.concat(F.array(own), F.when(past < near, F.array(own - 1)).otherwise(F.array().cast("array<bigint>")), F.when(past >= width - near, F.array(own + 1)).otherwise(F.array().cast("array<bigint>")))
    o = o.select("_k", "_s", F.explode(spans).alias("_bucket"), F.lit(0).alias("_late"), F.struct(F.col("_s").alias("s"), "_v").alias("_o"))
    both = f.unionByName(o, allowMissingColumns=True)
    seen = lambda *order: F.last("_o", ignorenulls=True).over(Window.partitionBy("_k", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"_before": seen("_s", "_late"), "_after": seen(F.desc("_s"), "_late")}).filter("_late = 1")
    distance = lambda o: F.abs(F.col("_s") - F.col(o)["s"])
    option = lambda o: F.when(distance(o) <= near, F.struct(distance(o).alias("near_distance"), *[F.col(o)["_v"][c].alias(c) for c in ["near_id", *(fields or [])]]))
    made = both.withColumn("_n", F.array_min(F.array_compact(F.array(option("_before"), option("_after"))))).select("_f.*", "_n.*")
    kinds = {c.name: c.dataType for c in made.schema.fields[len(facts.columns) :]}
    return made.unionByName(facts.filter(~known).withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()}))


def interpolate_hours(observations: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """JOIN-17: the value at each whole hour from a key's first to its last observation, linear between
    the one before and the one after. Observations at one time count by their mean."""
    o = observations.groupBy(F.col(key).alias("key"), F.unix_timestamp(time).alias("t")).agg(F.avg(value).alias("v"))
    o = o.withColumn("p", F.struct("t", "v"))
    o = with_edges(o, ["key"], bucket_of(o, "t"), after={"p": F.min("p")})
    ahead = F.lead("p").over(Window.partitionBy("key", "_bucket").orderBy("_place", "t"))
    pieces = o.withColumn("p2", ahead).filter("_place = 0").select("key", "t", "v", F.col("p2.t").alias("t2"), F.col("p2.v").alias("v2"))
    first = F.ceil(F.col("t") / 3600)
    last = F.coalesce(F.ceil(F.col("t2") / 3600) - 1, F.floor(F.col("t") / 3600))  # the next piece begins at its own time
    hours = pieces.filter(first <= last).withColumn("hour", F.explode(F.sequence(first, last)))
    part = (F.col("hour") * 3600 - F.col("t")) / (F.col("t2") - F.col("t"))
    return hours.select(F.col("key").alias(key), "hour", F.when(F.col("hour") * 3600 == F.col("t"), F.col("v")).otherwise(F.col("v") + (F.col("v2") - F.col("v")) * part).alias(value))

"""Order, top-k, samples, splits and set operations (SRT, SMP, SET). Random choices are hashes of a row
key and a seed, so they don't depend on partitions or reruns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.sources import stored

BITS = 60
MAX_TOP = 100_000  # rows of a sample that one task may gather


def hashed(keys: list[str], seed: int, purpose: str = "") -> Column:
    """The first 60 bits of the md5 of the keys' text (null: empty), the purpose and the seed. Choices for
    different purposes don't depend on each other."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(f"{purpose}{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def unit(keys: list[str], seed: int, purpose: str = "") -> Column:
    """A number from 0 to 1 for each key."""
    return hashed(keys, seed, purpose) / F.lit(float(1 << BITS))


def ordered(df: DataFrame, order: list[tuple[str, bool]]) -> DataFrame:
    """SRT-01: by (column, descending), nulls last."""
    return df.orderBy(*[F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order])


def top_k(df: DataFrame, c: str, k: int, tie: str) -> DataFrame:
    """SRT-02."""
    return df.orderBy(F.desc_nulls_last(c), tie).limit(k)


def first_values(df: DataFrame, c: str, k: int = 10) -> DataFrame:
    """SRT-03: the first distinct values, those that aren't numbers first."""
    v = df.select(F.col(c).cast("string").alias("value")).filter("value IS NOT NULL").distinct()
    return v.withColumn("is_number", F.col("value").try_cast("double").isNotNull().cast("int")).orderBy("is_number", "value").limit(k)


def sample_n(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """SMP-01: exactly ``n`` rows (all if there are fewer): the smallest hashes. A small sample is a top-n kept by
    each task; for a large one, a threshold over counts by hash bucket is found and only its bucket is ranked."""
    if n <= MAX_TOP:
        return df.orderBy(hashed(keys, seed), *keys).limit(n)
    return between_ranks(df, hashed(keys, seed), keys, 0, n)


def balanced_train_test(df: DataFrame, label: str, keys: list[str], train_ratio: float = 0.75, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """SMP-02: positives split by ratio, as many negatives to each side; keys of both sides are disjoint.
    Rows rank by hash within a class, found by a threshold over counts by hash bucket, never by one sort."""
    u, group = hashed(keys, seed), _class(label)
    counts = bucket_counts(df, group, u)
    p, n = (class_sizes(counts).get(g, 0) for g in (1, 0))
    n_train = int(p * train_ratio)
    n_test = p - n_train
    neg_train, neg_test = min(n_train, n), min(n_test, max(0, n - n_train))
    sides = [[(1, 0, n_train), (0, 0, neg_train)], [(1, n_train, n_train + n_test), (0, neg_train, neg_train + neg_test)]]
    train, test = parts_by_rank(df, group, u, keys, counts, sides)
    return train, test


def _class(label: str) -> Column:
    return F.when(F.col(label) == 1, 1).when(F.col(label) == 0, 0)


def bucket_counts(df: DataFrame, group: Column, u: Column, bits: int = 16) -> DataFrame:
    """Rows by group and bucket of the hash ``u``, and those of the group's buckets before: one scan. It is read for each
    part that ranks give, so it is stored. Rows of a null group count nowhere."""
    counts = df.groupBy(group.alias("_g"), F.shiftright(u, BITS - bits).alias("_b")).agg(F.count("*").alias("_in")).filter("_g IS NOT NULL")
    before = F.sum("_in").over(Window.partitionBy("_g").orderBy("_b")) - F.col("_in")  # one row per bucket, 65,536 a group at most
    return stored(counts.withColumn("_before", before), "bucket-counts")


def class_sizes(counts: DataFrame) -> dict[int, int]:
    return {r["_g"]: r["n"] for r in counts.groupBy("_g").agg(F.sum("_in").alias("n")).collect()}


def parts_by_rank(df: DataFrame, group: Column, u: Column, keys: list[str], counts: DataFrame, parts: list[list[tuple[int, int, int]]], bits: int = 16) -> list[DataFrame]:
    """For each part the rows whose rank in their group by the hash ``u`` (ties by keys) is in one of the part's ranges
    (group, from, to below). Buckets give most rows; those of buckets in which a range's bound falls are ranked, for all parts
    together, and stored, as they are few. So ``df`` is read once for these and once for each part."""
    ranges = [(i, g, low, high) for i, some in enumerate(parts) for g, low, high in some if high > low]
    if not ranges:
        return [df.limit(0) for _ in parts]

    def part(met) -> Column:
        return F.coalesce(*[F.when((F.col("_g") == g) & met(low, high), i) for i, g, low, high in ranges])

    end = F.col("_before") + F.col("_in")
    found = counts.withColumn("_part", part(lambda low, high: (F.col("_before") >= low) & (end <= high)))
    bounds = found.filter(F.col("_part").isNull() & part(lambda low, high: (F.col("_before") < high) & (end > low)).isNotNull())
    marked = df.withColumns({"_g": group, "_b": F.shiftright(u, BITS - bits)})
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_g", "_b").orderBy(u, *keys)) - 1
    ranked = marked.join(F.broadcast(bounds.drop("_part")), ["_g", "_b"]).withColumn("_r", rank).withColumn("_part", part(lambda low, high: (F.col("_r") >= low) & (F.col("_r") < high)))
    few = stored(ranked.filter("_part IS NOT NULL").select(*df.columns, "_part"), "ranked")
    take = lambda i: marked.join(F.broadcast(found.filter(F.col("_part") == i).select("_g", "_b")), ["_g", "_b"]).select(*df.columns)
    return [take(i).unionByName(few.filter(F.col("_part") == i).select(*df.columns)) for i in range(len(parts))]


def between_ranks(df: DataFrame, u: Column, keys: list[str], low: int, high: int) -> DataFrame:
    """The rows whose rank by the hash ``u`` (ties by keys) is from ``low`` to below ``high``."""
    if high <= low:
        return df.limit(0)
    one = F.lit(0)
    return parts_by_rank(df, one, u, keys, bucket_counts(df, one, u), [[(0, low, high)]])[0]


def balanced(df: DataFrame, label: str, keys: list[str], seed: int = 42) -> DataFrame:
    """SMP-03: as many rows of each of the two classes as the smaller has."""
    u, group = hashed(keys, seed), _class(label)
    counts = bucket_counts(df, group, u)
    sizes = class_sizes(counts)
    k = min(sizes.get(1, 0), sizes.get(0, 0))
    return parts_by_rank(df, group, u, keys, counts, [[(1, 0, k), (0, 0, k)]])[0]


def under_sample(df: DataFrame, label: str, fractions: dict, keys: list[str], seed: int = 42) -> DataFrame:
    """SMP-04: each class by its fraction (1 where none is given), in one pass."""
    rate = F.lit(1.0)
    for value, fraction in fractions.items():
        rate = F.when(F.col(label) == value, F.lit(float(fraction))).otherwise(rate)
    return df.filter(unit(keys, seed, "thin") < rate)


def split(df: DataFrame, ratio: float, keys: list[str], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """SMP-05: two disjoint parts, about ``ratio`` and the rest."""
    u = unit(keys, seed, "split")
    return df.filter(u < ratio), df.filter(u >= ratio)


def with_fold(df: DataFrame, k: int, keys: list[str], seed: int = 42, name: str = "fold") -> DataFrame:
    """SMP-06."""
    return df.withColumn(name, F.pmod(hashed(keys, seed, "fold"), F.lit(k)).cast("int"))


def at_most(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """SMP-07: all rows if there are ``n`` or fewer, else ``n`` of them."""
    return sample_n(df, n, keys, seed)


def union_all(frames: list[DataFrame], by_name: bool = True, missing: bool = False) -> DataFrame:
    """SET-01, SET-02: bag union."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=missing) if by_name else out.union(f)
    return out


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET-03: distinct rows of ``a`` that ``b`` lacks."""
    return a.subtract(b)


def distinct(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """SET-04."""
    return (df.select(*columns) if columns else df).distinct()

"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id and text. Sizes are summed by source and the leading bits; running totals over
those buckets show in which bucket each source's budget is reached; only the rows of that bucket are
summed again by the next bits, and so on down to single hash values. The mix is then the filter
"hash below the source's threshold": no sort, and reruns agree. A budget grown later only adds documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import documents, drop_stored, small_enough, stored, whole_text

WEIGHTS = (3, 1, 2)
BITS = 60
LEVEL_BITS = (15, 15, 15, 15)
MAX_BROADCAST_SOURCES = 20_000

SIZE = r"[^\x20\x09-\x0D]+"


def n_words(text: str | Column = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(SIZE)).cast("long")


def doc_hash(id_col: str, text: str) -> Column:
    """The first 60 bits of the md5 of the id's decimal text, a colon and the text (nulls: empty)."""
    whole = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), whole_text(text))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, size) rows. Sources in code-point order, null last,
    weigh ``weights`` in turn and share ``share`` of all sizes; a target stops at ``most`` times its
    source's size, and the excess is shared again by weight among those below until none is above.

    The fixed point of that has a closed form: ordered by (cap / weight), a prefix of the sources is
    capped and the rest share what is left by weight, so windows over the per-source totals find it.
    The totals are one row per source, a few bytes each."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    turn = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")).withColumn("cap", F.col("source_size") * F.lit(most))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumns({
        "level": (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest),
        "place": F.row_number().over(by_cap),
    })
    # the first source whose cap is at or above the level that holds for it and all after it
    first = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("place"))).over(everything)
    at = F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(everything)
    return per.withColumn("first", first).select(
        "source", "source_size", F.when(F.col("first").isNull() | (F.col("place") < F.col("first")), F.col("cap")).otherwise(F.col("weight") * at).cast("double").alias("target"),
    )


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` (source, source_size, target) with ``copies`` (whole copies of every document) and
    ``threshold``: documents with a hash below it are taken once more. ``sizes``: source, hash, size.

    Each level sums sizes by bucket with partial aggregation; a source has at most 2^15 buckets in a
    level, whatever the data. At the last level a bucket is one hash value, which joins the mix if that
    brings the source nearer to its target."""
    goals = goals.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    state = goals.withColumns({"need": F.col("target") - F.col("copies") * F.col("source_size"), "prefix": F.lit(0).cast("long")})
    shift = BITS
    key = F.col("s.source").eqNullSafe(F.col("g.source"))
    for bits in LEVEL_BITS:
        inside = F.shiftright(F.col("s.hash"), shift) == F.col("g.prefix")
        shift -= bits
        last = shift == 0
        right = spread(state.select("source", "prefix"))
        buckets = sizes.alias("s").join(right.alias("g"), key & inside).groupBy(F.col("s.source").alias("source"), F.shiftright("s.hash", shift).alias("bucket")).agg(F.sum("s.size").alias("size"))
        order = Window.partitionBy("source").orderBy("bucket")
        run = buckets.withColumn("upto", F.sum("size").over(order))
        half = F.col("r.size") / 2 if last else F.lit(0)
        found = (
            run.alias("r").join(spread(state).alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
            # the boundary bucket: the first whose running total reaches past what is needed
            .filter((F.col("r.upto") - half > F.col("g.need")) if last else (F.col("r.upto") > F.col("g.need")))
            .groupBy(F.col("g.source").alias("source"))
            .agg(F.min_by(F.struct("bucket", (F.col("r.upto") - F.col("r.size")).alias("under")), "bucket").alias("b"))
        )
        state = stored(
            state.alias("g").join(found.alias("f"), F.col("g.source").eqNullSafe(F.col("f.source")), "left").select(
                "g.source", "g.source_size", "g.target", "g.copies",
                (F.col("g.need") - F.coalesce(F.col("f.b.under"), F.lit(0))).alias("need"),
                # without a boundary in the bucket (rounding), everything up to its end is taken
                F.coalesce(F.col("f.b.bucket"), F.shiftleft(F.col("g.prefix") + 1, bits)).alias("prefix"),
            ), "mix-level",
        )
    return state.select("source", "source_size", "target", "copies", F.col("prefix").alias("threshold"))


def spread(per_source: DataFrame) -> DataFrame:
    """A per-source table, broadcast if it is proven small; else left to the planner's own choice."""
    return F.broadcast(per_source) if small_enough(per_source, MAX_BROADCAST_SOURCES) else per_source


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words the mix takes, repeats
    counted), hash and threshold.

    Null texts have size 0; null sources are one source, last in order; a source of size 0 has target 0.
    Rows equal in id and text have one hash and are taken together; those that share an id only, or have none,
    are not. Other columns are ignored."""
    sizes = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"), doc_hash(id_col, text).alias("hash")), "mix-sizes")
    goals = stored(targets(sizes, share, most), "mix-goals")
    found = spread(thresholds(sizes, goals))
    times = F.col("g.copies") + (F.col("s.hash") < F.col("g.threshold")).cast("int")
    return sizes.alias("s").join(found.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(
        "s.doc_id", "s.size", "g.source_size", "g.target", (F.col("s.size") * times).cast("long").alias("taken"), times.cast("long").alias("times"),
    )


def mixed_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as ``mix`` takes them. Only the narrow (source, hash,
    size) table is summed; the documents are read once more and filtered in place."""
    sizes = stored(docs.select(F.col(source).alias("source"), n_words(text).alias("size"), doc_hash(id_col, text).alias("hash")), "mix-sizes")
    names = {"source": "__mix_source", "copies": "__mix_copies", "threshold": "__mix_threshold"}
    found = thresholds(sizes, stored(targets(sizes, share, most), "mix-goals")).select(*[F.col(c).alias(n) for c, n in names.items()])
    times = F.col("__mix_copies") + (doc_hash(id_col, text) < F.col("__mix_threshold")).cast("int")
    met = docs.join(spread(found), F.col(source).eqNullSafe(F.col("__mix_source")))
    return met.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), times))).select(*[docs[c] for c in docs.columns])


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op7_source_mix": op7_source_mix}

#: The same mix by a sort: running totals in hash order.
ORACLE_SQL = {
    "op7_source_mix": r"""
WITH RECURSIVE s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS hash FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight
  FROM s GROUP BY source
), c AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, row_number() OVER w AS place,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per WINDOW w AS (ORDER BY source_size * 2.0::DOUBLE / weight, encode(source) NULLS LAST)
), f AS (SELECT min(place) AS first FROM c WHERE cap / weight >= level),
goal AS (
  SELECT source, source_size, CASE WHEN f.first IS NULL OR place < f.first THEN cap ELSE weight * (SELECT level FROM c, f WHERE place = first) END AS target FROM c, f
), g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM goal),
h AS (SELECT source, hash, sum(size) AS size FROM s GROUP BY ALL),
run AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY hash) AS upto FROM h),
stop AS (
  SELECT g.source, min(hash) FILTER (WHERE upto - size / 2.0::DOUBLE > target - copies * source_size) AS threshold
  FROM g LEFT JOIN run ON run.source IS NOT DISTINCT FROM g.source GROUP BY g.source
)
SELECT s.doc_id, s.size, g.source_size, g.target,
       CAST(s.size * (copies + CASE WHEN threshold IS NULL OR hash < threshold THEN CASE WHEN target > copies * source_size THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS taken
FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source JOIN stop ON s.source IS NOT DISTINCT FROM stop.source
""",
}

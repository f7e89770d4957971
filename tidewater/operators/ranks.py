"""Exact quantiles without gathering a column in one task: a sketch brackets each rank, brackets are counted
and narrowed until few rows are left in them, and only those are ordered."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_ORDERED = 1_000_000  # rows of a bracket that one task orders, by distinct value
ACCURACY = 10_000  # of the sketch: a bracket holds about 4 / ACCURACY of the rows before


def values_at(df: DataFrame, c: str, ranks: list[int] | None = None, shares: list[float] | None = None, between: bool = True) -> dict:
    """The value at each rank (from 0, in ascending order without nulls), or, with ``shares``, the quantile at
    each, between two ranks by linear interpolation, or, without ``between``, the least value that at least such a share of
    rows doesn't exceed. Empty without values; NaN counts as the largest."""
    v = df.select(F.col(c).cast("double").alias("v")).filter("v IS NOT NULL")
    n, least, most = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return {}
    if shares is not None and not between:
        at = {p: max(0, math.ceil(p * n) - 1) for p in shares}
        found = values_at_ranks(v, n, least, most, sorted(set(at.values())))
        return {p: found[r] for p, r in at.items()}
    if shares is not None:
        places = {p: p * (n - 1) for p in shares}
        found = values_at_ranks(v, n, least, most, sorted({k for x in places.values() for k in (int(x), min(n - 1, int(x) + 1))}))
        # as between two values, so that equal ones give themselves
        return {p: found[int(x)] + (found[min(n - 1, int(x) + 1)] - found[int(x)]) * (x - int(x)) if found[int(x)] != found[min(n - 1, int(x) + 1)] else found[int(x)] for p, x in places.items()}
    return values_at_ranks(v, n, least, most, sorted(set(ranks or [])))


def values_at_ranks(v: DataFrame, n: int, least: float, most: float, ranks: list[int]) -> dict[int, float]:
    brackets = {r: (least, most, 0, n) for r in ranks}  # low, high, rows below low, rows from low to high
    settled: set[int] = set()  # ranks between two values that many rows share, which no sketch tells apart
    while wide := [r for r, (low, high, _, inside) in brackets.items() if low < high and inside > MAX_ORDERED and r not in settled]:
        sketches = []
        for r in wide:
            low, high, below, inside = brackets[r]
            p, e = (r - below + 0.5) / inside, 2 / ACCURACY
            shares = F.array(F.lit(max(0.0, p - e)), F.lit(min(1.0, p + e)))
            sketches.append(F.percentile_approx(F.when(F.col("v").between(low, high), F.col("v")), shares, F.lit(ACCURACY)).alias(f"r{r}"))
        edges = v.agg(*sketches).first()
        counted = v.agg(*[x for r in wide for x in (F.count(F.when(F.col("v") < edges[f"r{r}"][0], 1)).alias(f"b{r}"), F.count(F.when(F.col("v") < edges[f"r{r}"][1], 1)).alias(f"c{r}"), F.count(F.when(F.col("v") <= edges[f"r{r}"][1], 1)).alias(f"u{r}"))]).first()
        for r in wide:
            low, high, below, inside = brackets[r]
            a, b = edges[f"r{r}"]
            under, upto = counted[f"b{r}"], counted[f"u{r}"]
            if r < under:  # the sketch missed: the rank lies on one side of its bracket
                narrower = (low, a, below, under - below)
            elif r >= upto:
                narrower = (b, high, counted[f"c{r}"], below + inside - counted[f"c{r}"])
            else:
                narrower = (a, b, under, upto - under)
            if narrower[:2] == brackets[r][:2]:
                settled.add(r)
            brackets[r] = narrower
    out = {r: low for r, (low, high, _, _) in brackets.items() if low == high}
    for low, high, below in sorted({brackets[r][:3] for r in ranks if r not in out}):
        wanted = [r for r in ranks if r not in out and brackets[r][:3] == (low, high, below)]
        counts = v.filter(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("k"))
        ends = counts.withColumn("upto", F.sum("k").over(Window.orderBy("v")) + F.lit(below))  # the distinct values of a bracket
        hits = ends.filter(" OR ".join(f"({r} >= upto - k AND {r} < upto)" for r in wanted)).collect()
        out |= {r: next(x["v"] for x in hits if x["upto"] - x["k"] <= r < x["upto"]) for r in wanted}
    return out

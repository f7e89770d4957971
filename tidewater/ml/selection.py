"""Univariate tests of features against a label and the selections made of them (ML-08, ML-09).

Contingency tables and moments by group are grouped aggregates over (column, value) rows, so all columns of both kinds take
one pass of the input and no column is gathered; the groups are stored, since a test reads them more than once. What comes to the driver is one row per column: its statistic and degrees of
freedom, of which the probability is computed there.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.sources import stored


def grouped(df: DataFrame, categorical: list[str], numeric: list[str], label: str) -> DataFrame:
    """(test, column, value, label, n, numbers, mean, variance) of rows with a label, in one pass of them: how often each value of
    each categorical column meets each label (null is a value of its own), and the numbers of each numeric column by label."""
    as_text = [F.struct(F.lit("chi2").alias("test"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"), F.lit(None).cast("double").alias("number")) for c in categorical]
    as_number = [F.struct(F.lit("anova").alias("test"), F.lit(c).alias("column"), F.lit(None).cast("string").alias("value"), F.col(f"`{c}`").cast("double").alias("number")) for c in numeric]
    pairs = df.filter(F.col(label).isNotNull()).select(F.explode(F.array(*as_text, *as_number)).alias("x"), F.col(label).alias("label")).select("x.*", "label")
    return pairs.groupBy("test", "column", "value", "label").agg(F.count("*").alias("n"), F.count("number").alias("numbers"), F.avg("number").alias("mean"), F.var_pop("number").alias("variance"))


def contingency(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, value, label, n): how often each value of each column meets each label."""
    return grouped(df, columns, [], label).select("column", "value", "label", "n")


def chi_square(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, statistic, dof): Pearson's test of independence. A column or label of one value has statistic 0 and no
    freedom. Cells without rows need no row: the sum over all cells is n * (sum of o^2 / (row * column) - 1)."""
    return chi_square_of(stored(contingency(df, columns, label), "cells"))


def chi_square_of(cells: DataFrame) -> DataFrame:
    """The same of a contingency table, which it reads several times."""
    by_value = cells.groupBy("column", F.col("value").alias("_v")).agg(F.sum("n").alias("_r"))
    by_label = cells.groupBy("column", F.col("label").alias("_l")).agg(F.sum("n").alias("_c"))
    met = cells.alias("x").join(by_value.alias("v"), F.expr("x.column = v.column AND x.value <=> v._v"))
    met = met.join(by_label.alias("l"), F.expr("x.column = l.column AND x.label = l._l"))
    o = F.col("x.n").cast("double")
    sums = met.groupBy(F.col("x.column").alias("column")).agg(F.sum(o).alias("n"), F.sum(o * o / (F.col("v._r").cast("double") * F.col("l._c"))).alias("s"))
    freedom = by_value.groupBy("column").agg(F.count("*").alias("rows")).join(by_label.groupBy("column").agg(F.count("*").alias("labels")), "column")
    found = sums.join(freedom, "column")
    return found.select("column", F.greatest(F.lit(0.0), F.col("n") * (F.col("s") - 1)).alias("statistic"), ((F.col("rows") - 1) * (F.col("labels") - 1)).cast("long").alias("dof"))


def anova(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, statistic, dof_between, dof_within): the F statistic of a number by label; null without freedom, infinite
    where groups differ and vary nowhere."""
    return anova_of(stored(grouped(df, [], columns, label), "groups"))


def anova_of(found: DataFrame) -> DataFrame:
    """The same of the groups of ``grouped``, which it reads twice. A null is no number."""
    groups = found.filter("test = 'anova' AND numbers > 0").select("column", "label", F.col("numbers").alias("n"), F.col("mean").alias("m"), F.col("variance").alias("v"))
    whole = groups.groupBy("column").agg(F.sum("n").alias("all"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.count("*").alias("k"))
    sums = groups.join(whole, "column").groupBy("column", "all", "k").agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    dof1, dof2 = (F.col("k") - 1).cast("long"), (F.col("all") - F.col("k")).cast("long")
    ratio = F.when(F.col("within") > 0, (F.col("between") / dof1) / (F.col("within") / dof2)).when(F.col("between") > 0, float("inf"))
    return sums.select("column", F.when((dof1 > 0) & (dof2 > 0), ratio).alias("statistic"), dof1.alias("dof_between"), dof2.alias("dof_within"))


def upper_gamma(a: float, x: float) -> float:
    """The regularized upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # the series of the lower one
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    return scale * _fraction(lambda i: -i * (i - a), lambda i: x + 2 * i + 1 - a)


def _fraction(a, b, most: int = 10_000) -> float:
    """1 / (b0 + a1 / (b1 + a2 / (b2 + ...))), from the front, until it stays the same."""
    tiny = 1e-300
    value = b(0) or tiny
    c, d = value, 0.0
    for i in range(1, most):
        d = 1 / ((b(i) + a(i) * d) or tiny)
        c = (b(i) + a(i) / c) or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 / value


def beta_share(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a

    def part(i: int) -> float:
        m = i // 2
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

    return scale * _fraction(part, lambda i: 1.0)


def chi_square_p(statistic: float, dof: int) -> float:
    return upper_gamma(dof / 2, statistic / 2) if dof > 0 else 1.0


def f_p(statistic: float | None, dof1: int, dof2: int) -> float:
    if statistic is None or dof1 < 1 or dof2 < 1:
        return 1.0
    return 0.0 if math.isinf(statistic) else beta_share(dof2 / 2, dof1 / 2, dof2 / (dof2 + dof1 * statistic))


def tests(df: DataFrame, categorical: list[str], numeric: list[str], label: str) -> DataFrame:
    """(column, test, statistic, p, dof): chi-square for categorical columns, analysis of variance for numeric ones (dof: between
    groups). One pass of ``df`` for all."""
    rows = []
    if categorical or numeric:
        found = stored(grouped(df, categorical, numeric, label), "groups")
    if categorical:
        rows += [(r["column"], "chi2", r["statistic"], chi_square_p(r["statistic"], r["dof"]), r["dof"]) for r in chi_square_of(found.filter("test = 'chi2'").select("column", "value", "label", "n")).collect()]
    if numeric:
        rows += [(r["column"], "anova", r["statistic"], f_p(r["statistic"], r["dof_between"], r["dof_within"]), r["dof_between"]) for r in anova_of(found).collect()]
    return df.sparkSession.createDataFrame(rows, "column string, test string, statistic double, p double, dof long")


def selected(tested: DataFrame, mode: str = "fpr", threshold: float = 0.05) -> DataFrame:
    """The tests with ``selected``: p below the threshold (``fpr``), or below threshold / tests (``fwe``); the step-up of Benjamini
    and Hochberg (``fdr``: all up to the last p, in order, that is at most threshold * rank / tests); or the
    ``numTopFeatures`` or the ``percentile`` (a share) with the smallest p, ties by name. One row per column is windowed."""
    order, every = Window.orderBy("p", "column"), Window.partitionBy()
    ranked = tested.withColumns({"_rank": F.row_number().over(order), "_m": F.count("*").over(every)})
    p, share = F.col("p"), F.lit(float(threshold))
    if mode == "fdr":
        ranked = ranked.withColumn("_last", F.max(F.when(p <= share * F.col("_rank") / F.col("_m"), F.col("_rank"))).over(every))
    rule = {
        "fpr": p < share, "fwe": p < share / F.col("_m"), "numTopFeatures": F.col("_rank") <= int(threshold), "percentile": F.col("_rank") <= F.floor(share * F.col("_m")),
        "fdr": F.coalesce(F.col("_rank") <= F.col("_last"), F.lit(False)) if mode == "fdr" else None,
    }[mode]
    return ranked.withColumn("selected", rule).drop("_rank", "_m", "_last")


def hybrid_columns(df: DataFrame, categorical: list[str], numeric: list[str], label: str, mode: str = "fpr", threshold: float = 0.05, numeric_test: bool = False) -> list[str]:
    """ML-08: the categorical columns that a chi-square test keeps, and the numeric ones: all, or with ``numeric_test`` those
    that an analysis of variance keeps. Each kind is a family of tests of its own."""
    kept = []
    for columns, tested in ((categorical, tests(df, categorical, [], label)), (numeric, tests(df, [], numeric, label) if numeric_test else None)):
        found = set(columns) if tested is None else {r["column"] for r in selected(tested, mode, threshold).filter("selected").collect()}
        kept += [c for c in columns if c in found]
    return kept

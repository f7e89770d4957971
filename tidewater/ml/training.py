"""Models, tuning and evaluation (ML-20 to ML-34)."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators.sampling import unit, with_fold
from tidewater.sources import stored

#: Names of a model.
ALIASES = {"rf": "randomforest", "random_forest": "randomforest", "gradientboostedtrees": "gbt", "gradient_boosted_trees": "gbt", "lr": "logisticregression", "logistic_regression": "logisticregression", "xgb": "xgboost"}

#: Parameters of boosted trees by the names of another library.
BOOST_NAMES = {"num_round": "maxIter", "numRound": "maxIter", "eta": "stepSize", "max_depth": "maxDepth", "maxDepth": "maxDepth", "subsample": "subsamplingRate", "min_child_weight": "minInstancesPerNode", "minChildWeight": "minInstancesPerNode"}


def kind(name: str) -> str:
    n = name.lower()
    n = ALIASES.get(n, n)
    if n not in ("randomforest", "gbt", "logisticregression", "xgboost"):
        raise ValueError(f"unknown model {name!r}")
    return n


def classifier(name: str, seed: int = 42, **params):
    """ML-20 to ML-24: a seeded estimator by name; ``xgboost`` is boosted trees under its parameter names."""
    k = kind(name)
    if k == "logisticregression":
        return LogisticRegression(**{"maxIter": 100, "standardization": True, **params})
    if k == "randomforest":
        return RandomForestClassifier(**{"numTrees": 100, "maxDepth": 5, "maxBins": 64, "cacheNodeIds": True, "seed": seed, **params})
    if k == "xgboost":
        params = {BOOST_NAMES.get(p, p): int(v) if BOOST_NAMES.get(p) in ("maxIter", "maxDepth", "minInstancesPerNode") else v for p, v in params.items()}
    return GBTClassifier(**{"maxIter": 20, "maxDepth": 5, "maxBins": 64, "seed": seed, **params})


def importances(spark: SparkSession, model, names: list[str] | None = None) -> DataFrame:
    """ML-20 to ML-22: feature importances, or coefficients with the intercept; the largest first."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
        rows = [(names[i] if names else f"f{i}", float(v)) for i, v in enumerate(values)]
    else:
        rows = [(names[i] if names else f"f{i}", float(v)) for i, v in enumerate(model.coefficients.toArray())] + [("intercept", float(model.intercept))]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc(F.abs("importance")), "feature")


def confusion(predictions: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """ML-29: tp, tn, fp, fn (per group), in one pass."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    cells = {"tp": y & p, "tn": ~y & ~p, "fp": ~y & p, "fn": y & ~p}
    return predictions.groupBy(*(by or [])).agg(*[F.count(F.when(c, 1)).alias(k) for k, c in cells.items()])


def metrics(cells: DataFrame) -> DataFrame:
    """ML-29: measures of tp, tn, fp, fn; a measure without a denominator is 0."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = over(tp, tp + fp), over(tp, tp + fn)
    return cells.withColumns({
        "accuracy": over(tp + tn, tp + tn + fp + fn), "precision": precision, "recall": recall, "f1": over(2 * precision * recall, precision + recall),
        "specificity": over(tn, tn + fp), "fpr": over(fp, fp + tn), "recall_delayed": recall, "recall_on_time": over(tn, tn + fp),
    })


def positive_share(probability: str = "probability") -> Column:
    """The probability of class 1; 0 of a model that has only met class 0."""
    return F.coalesce(F.get(vector_to_array(probability), F.lit(1)), F.lit(0.0))


def areas(predictions: DataFrame, label: str = "label") -> dict[str, float]:
    """ML-30."""
    e = BinaryClassificationEvaluator(labelCol=label)
    return {"auc_roc": e.evaluate(predictions, {e.metricName: "areaUnderROC"}), "auc_pr": e.evaluate(predictions, {e.metricName: "areaUnderPR"})}


CELLS = ["tp", "tn", "fp", "fn"]


def evaluate(predictions: DataFrame, label: str = "label", by: list[str] | None = None, score: str = "p1", bins: int = 10_000) -> DataFrame:
    """ML-29, ML-30: cells, measures, auc_roc and auc_pr (of every group, if there are any), in one pass: rows count by bin
    of the score and by cell, and all else follows from at most ``bins`` rows a group. Scores of one bin count as
    equal; areas are by trapezoids (ROC) and steps (average precision), null where a class is missing. Without
    ``score`` the second value of ``probability`` is it."""
    if score not in predictions.columns:
        predictions = predictions.withColumn(score, positive_share())
    some, y, p = by or [], F.col(label) == 1, F.col("prediction") == 1
    cells = {"tp": y & p, "tn": ~y & ~p, "fp": ~y & p, "fn": y & ~p}
    per = predictions.groupBy(*some, F.floor(F.col(score) * bins).alias("_bin")).agg(*[F.count(F.when(c, 1)).alias(k) for k, c in cells.items()])
    per = per.withColumns({"_p": F.col("tp") + F.col("fn"), "_n": F.col("tn") + F.col("fp")})
    down = Window.partitionBy(*some).orderBy(F.desc("_bin"))
    run = per.withColumns({"_tp": F.sum("_p").over(down), "_fp": F.sum("_n").over(down)})
    both = F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0))
    area, precision = F.sum(F.col("_n") * (F.col("_tp") - F.col("_p") / 2)), F.sum(F.col("_p") * F.col("_tp") / (F.col("_tp") + F.col("_fp")))
    found = run.groupBy(*some).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CELLS], (area / both).alias("auc_roc"), F.when(both.isNotNull(), precision / F.sum("_p")).alias("auc_pr"))
    return metrics(found)


def train_test_gap(train: DataFrame, test: DataFrame, warn: float = 0.05, alert: float = 0.10) -> DataFrame:
    """ML-31: differences of two one-row metric frames, and how grave."""
    names = ["accuracy", "f1"]
    both = train.select(*[F.col(c).alias(f"train_{c}") for c in names]).crossJoin(test.select(*[F.col(c).alias(f"test_{c}") for c in names]))  # one row each
    gap = lambda c: F.col(f"train_{c}") - F.col(f"test_{c}")
    worst = F.greatest(*[F.abs(gap(c)) for c in names])
    return both.withColumns({f"gap_{c}": gap(c) for c in names} | {"overfitting": F.when(worst > alert, "alert").when(worst > warn, "warning").otherwise("none")})


def score_points(predictions: DataFrame, label: str = "label") -> DataFrame:
    """ML-32, UDF-01: label, probability of class 1, prediction."""
    return predictions.select(F.col(label).alias("label"), positive_share().alias("p1"), "prediction")


def roc(points: DataFrame, score: str = "p1", label: str = "label", bins: int | None = 1000) -> DataFrame:
    """ML-32: threshold, true and false positive rate. Scores are first counted by value (or by bin of the
    unit interval), so the running sums are over at most ``bins`` rows, whatever the input."""
    s = F.floor(F.col(score) * bins) / bins if bins else F.col(score)
    by = points.groupBy(s.alias("threshold")).agg(F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count(F.when(F.col(label) != 1, 1)).alias("n"))
    down = Window.orderBy(F.desc("threshold"))
    whole = Window.partitionBy()
    rate = lambda c: F.sum(c).over(down) / F.nullif(F.sum(c).over(whole), F.lit(0))
    return by.select("threshold", rate("p").alias("tpr"), rate("n").alias("fpr"))


def _keyed(df: DataFrame, keys: list[str] | None) -> tuple[DataFrame, list[str]]:
    """The frame and the keys of its random choices: those given, else a hash of label and features."""
    return (df, keys) if keys else (df.withColumn("_key", F.xxhash64(F.to_json(F.struct(vector_to_array("features").alias("f"), "label")))), ["_key"])


def grid_maps(values: dict[str, list]) -> list[dict]:
    """ML-25: every combination of the listed parameters, by name; without any, one empty one."""
    return [dict(zip(values, some, strict=True)) for some in itertools.product(*values.values())]


def tagged_predictions(points: DataFrame, name: str, candidates: list[dict], folds: list[int], seed: int = 42, params: dict | None = None, keep: list[str] | None = None) -> DataFrame:
    """ML-26, ML-27: for every candidate and fold of ``points`` (features, label, fold), the fold's rows as a model
    fitted on all others predicts them: candidate, fold, label, p1, prediction, and the columns to ``keep``. One frame
    for all, so it is stored and measured in one pass."""
    out = []
    for i, candidate in enumerate(candidates):
        estimator = classifier(name, seed, **{**(params or {}), **candidate})
        for fold in folds:
            model = estimator.fit(points.filter(F.col("fold") != fold).select("features", "label"))
            scored = model.transform(points.filter(F.col("fold") == fold))
            out.append(scored.select(F.lit(i).alias("candidate"), "fold", "label", positive_share().alias("p1"), "prediction", *(keep or [])))
    return reduce(DataFrame.unionByName, out)


def candidate_metrics(tagged: DataFrame) -> DataFrame:
    """A row of measures per candidate and fold."""
    return metrics(confusion(tagged, by=["candidate", "fold"]))


def best_candidate(measured: DataFrame, candidates: list[dict], metric: str = "f1") -> dict:
    """The parameters with the best mean of a measure over the folds; of equal ones the first listed."""
    means = measured.groupBy("candidate").agg(F.avg(metric).alias("mean")).orderBy(F.desc("mean"), "candidate").first()
    return candidates[means["candidate"]] if means else {}


def cross_validate(df: DataFrame, name: str, values: dict[str, list] | None = None, k: int = 5, keys: list[str] | None = None, seed: int = 42, metric: str = "f1", **params) -> tuple[dict, DataFrame]:
    """ML-26: the best parameters of the grid and the measures of each candidate and fold, over folds by a hash of
    the row (``keys``, else label and features), which don't depend on partitions. Points with their folds are stored, since
    every fit and prediction reads them, and so are the measures: a row per candidate and fold."""
    keyed, by = _keyed(df, keys)
    candidates = grid_maps(values or {})
    points = stored(with_fold(keyed, k, by, seed).select("features", "label", "fold"), "folds")
    measured = stored(candidate_metrics(tagged_predictions(points, name, candidates, list(range(k)), seed, params)), "fold-measures")
    return best_candidate(measured, candidates, metric), measured


def validate_once(df: DataFrame, name: str, values: dict[str, list] | None = None, ratio: float = 0.8, keys: list[str] | None = None, seed: int = 42, metric: str = "f1", **params) -> tuple[dict, DataFrame]:
    """ML-27: the same over one split: fold 1 is the validation set, the rest (``ratio``) trains every candidate."""
    keyed, by = _keyed(df, keys)
    candidates = grid_maps(values or {})
    marked = stored(keyed.withColumn("fold", (unit(by, seed, "validation") >= ratio).cast("int")).select("features", "label", "fold"), "folds")
    measured = stored(candidate_metrics(tagged_predictions(marked, name, candidates, [1], seed, params)), "fold-measures")
    return best_candidate(measured, candidates, metric), measured


def fold_metrics(df: DataFrame, name: str, k: int = 5, keys: list[str] | None = None, seed: int = 42, **params) -> DataFrame:
    """ML-26: a row of measures per fold; the folds' predictions are united and measured in one pass."""
    return cross_validate(df, name, None, k, keys, seed, **params)[1].drop("candidate")


def summary(per_fold: DataFrame) -> DataFrame:
    """ML-26: mean and population standard deviation of each measure."""
    names = [c for c in per_fold.columns if c not in ("candidate", "fold", "tp", "tn", "fp", "fn")]
    row = per_fold.agg(*[f(c).alias(f"{c}_{n}") for c in names for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_std").alias("std")) for c in names])).alias("r")).select("r.*")


def train_final(df: DataFrame, name: str, best: dict | None = None, seed: int = 42, **params):
    """ML-28: fitted with the best parameters found."""
    return classifier(name, seed, **{**params, **(best or {})}).fit(df)


def compare_runs(runs: DataFrame, metric: str = "f1", by: str = "experiment") -> DataFrame:
    """ML-33: runs ranked by a measure. There are as many rows as experiments."""
    return runs.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc(metric)))).orderBy("rank", by)


def depth_sensitivity(runs: DataFrame, depth: str, metric: str = "f1") -> DataFrame:
    """ML-33: mean, least and greatest measure by look-back depth."""
    return runs.groupBy(depth).agg(F.avg(metric).alias(f"{metric}_mean"), F.min(metric).alias(f"{metric}_min"), F.max(metric).alias(f"{metric}_max"), F.count("*").alias("n"))


def linear_regression(df: DataFrame, label: str = "label", **params):
    """ML-34: a linear model and its RMSE, MAE and R2 on the same data."""
    model = LinearRegression(**{"labelCol": label, "maxIter": 50, **params}).fit(df)
    scored = model.transform(df)
    e = RegressionEvaluator(labelCol=label)
    return model, {m: e.evaluate(scored, {e.metricName: m}) for m in ("rmse", "mae", "r2")}

"""A whole model run whose steps are stored, so that a run that stopped goes on where it was (PIP-05).

Each step writes one artefact (a table or a fitted model) into a folder of its own, under a key of what it depends
on: the step's own parameters and the keys of the steps before it, down to fingerprints of the two input tables. A
marker is written last, so a step that broke off counts as absent and is made again. Changing a parameter changes
only the keys after it; all else is read back.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.ml import training
from tidewater.ml.features import Extractor, FeatureSpec, components_of, feature_stages
from tidewater.operators.sampling import with_fold
from tidewater.sources import load_model, read_text_file, remove, save_model, write_text_file

MODELS = {"randomforest": RandomForestClassificationModel, "gbt": GBTClassificationModel, "xgboost": GBTClassificationModel, "logisticregression": LogisticRegressionModel}
DONE = "_DONE"


def fingerprint(df: DataFrame) -> str:
    """A text that changes with the schema, the number of rows or any value, but not with the rows' order: one scan."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("h")).first()
    return f"{df.schema.simpleString()}/{row['n']}/{row['h']}"


@dataclass
class Artefacts:
    """Stored steps under one folder; ``made`` and ``kept`` tell which were made and which were there."""

    spark: SparkSession
    folder: str
    made: list[str] = field(default_factory=list)
    kept: list[str] = field(default_factory=list)

    def place(self, name: str, *inputs) -> tuple[str, str]:
        """(key, folder) of a step."""
        key = hashlib.sha256(json.dumps([name, *inputs], sort_keys=True, default=str).encode()).hexdigest()[:16]
        return key, f"{self.folder.rstrip('/')}/{name}-{key}"

    def _step(self, name: str, inputs: tuple, write: Callable[[str], None]) -> tuple[str, str]:
        key, path = self.place(name, *inputs)
        if read_text_file(self.spark, f"{path}/{DONE}") is not None:
            self.kept.append(name)
            return key, path
        remove(self.spark, path)
        write(path)
        write_text_file(self.spark, f"{path}/{DONE}", json.dumps([name, *inputs], sort_keys=True, default=str))
        self.made.append(name)
        return key, path

    def table(self, name: str, inputs: tuple, build: Callable[[], DataFrame]) -> tuple[str, DataFrame]:
        key, path = self._step(name, inputs, lambda p: build().write.parquet(p))
        return key, self.spark.read.parquet(path)

    def model(self, name: str, inputs: tuple, kind, fitted_on: DataFrame, build: Callable[[], object]) -> tuple[str, object]:
        """A fitted model; one that was stored is loaded, and refused if the frame has not the columns it was fitted on."""
        key, path = self._step(name, inputs, lambda p: save_model(build(), p, fitted_on))
        return key, load_model(path, kind, fitted_on)

    def rest(self) -> None:
        """Delete the whole folder."""
        remove(self.spark, self.folder)


@dataclass
class RunResult:
    artefacts: Artefacts
    best: dict
    candidates: DataFrame  # candidate, fold, cells and measures
    cv: DataFrame  # the best candidate's measures: metric, mean, std
    predictions: DataFrame  # part (train, test), keys, label, p1, prediction
    measures: DataFrame  # part, cells, measures, areas
    importances: DataFrame
    roc: DataFrame  # of the held-out part
    model: object
    extractor: Extractor


def model_run(train: DataFrame, test: DataFrame, folder: str, spec: FeatureSpec, keys: list[str], model: str = "randomforest", params: dict | None = None, grid: dict[str, list] | None = None,
              folds: int = 3, metric: str = "f1", seed: int = 42, fast: bool = False) -> RunResult:
    """PIP-05: fit the features on the training set, find the best parameters by folds, fit the model, predict both
    sets and measure them. ``fast`` skips the folds, as does a fold number below 2. Run again on the same folder, it
    reads what is there.

    Points and predictions are tables, so no step is computed twice or held in memory; the driver gets models, the
    measures of candidates and a row per feature."""
    spark, params = train.sparkSession, dict(params or {})
    a = Artefacts(spark, folder)
    inputs = fingerprint(train), fingerprint(test)
    step, stages = a.model("features", (inputs[0], vars(spec)), PipelineModel, train, lambda: feature_stages(train, spec).fit(train))
    if spec.reduce == "pca":
        step, vectors = a.table("vectors", (step,), lambda: stages.transform(train).select("features"))
        extractor = Extractor(stages, components_of(vectors, spec), spec.target)
    else:
        extractor = Extractor(stages, None, spec.target)
    k = max(1, folds)
    learned, points = a.table("points", (step, k, seed, keys), lambda: with_fold(extractor.transform(train, keys), k, keys, seed))
    held, test_points = a.table("held-out-points", (step, inputs[1], keys), lambda: extractor.transform(test, keys))
    candidates = training.grid_maps(grid or {})
    best, measured, cv = params, None, None
    if not fast and folds > 1:
        step, tagged = a.table("tagged-predictions", (learned, model, params, candidates, k, seed), lambda: training.tagged_predictions(points, model, candidates, list(range(k)), seed, params))
        _, measured = a.table("candidate-measures", (step,), lambda: training.candidate_metrics(tagged))
        best = {**params, **training.best_candidate(measured, candidates, metric)}
        chosen = candidates.index({c: best[c] for c in candidates[0]})
        cv = training.summary(measured.filter(F.col("candidate") == chosen).drop("candidate"))
    if measured is None:
        measured = training.candidate_metrics(spark.createDataFrame([], "candidate int, fold int, label double, prediction double"))
        cv = training.summary(measured.limit(0).drop("candidate")).limit(0)
    fitted, final = a.model("model", (learned, model, best, seed), MODELS[training.kind(model)], points.select("features", "label"), lambda: training.train_final(points.select("features", "label"), model, best, seed))

    def predict() -> DataFrame:
        both = points.drop("fold").withColumn("part", F.lit("train")).unionByName(test_points.withColumn("part", F.lit("test")))
        scored = final.transform(both)
        return scored.select("part", *keys, F.col("label"), training.positive_share().alias("p1"), "prediction")

    step, predictions = a.table("predictions", (fitted, held), predict)

    _, measured_parts = a.table("measures", (step,), lambda: training.evaluate(predictions, by=["part"]))
    _, curve = a.table("roc", (step,), lambda: training.roc(predictions.filter("part = 'test'")))
    _, weights = a.table("importances", (fitted,), lambda: training.importances(spark, final))
    return RunResult(a, best, measured, cv, predictions, measured_parts, weights, curve, final, extractor)

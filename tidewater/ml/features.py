"""Feature pipelines (ML-01 to ML-11)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    PCA, Imputer, MinMaxScaler, OneHotEncoder, PolynomialExpansion, RobustScaler, SQLTransformer, StandardScaler, StringIndexer, UnivariateFeatureSelector, VectorAssembler, VectorIndexer,
    VectorSlicer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.clock import date_features
from tidewater.operators.schema import column_types, column_types_by_name

INDEX, ONE_HOT, NUMERIC, SCALED = "StringIndexer", "OneHotEncoder", "None", "StandardScaler"


@dataclass
class FeatureSpec:
    """Feature name to transformation, and how the vector is treated."""

    features: dict[str, str]
    target: str
    handle_invalid: str = "keep"
    index_vector: bool = False
    max_categories: int = 32
    reduce: str | None = None  # "pca"
    pca_k: int | None = None
    pca_variance: float = 0.7
    columns: dict[str, list[str]] = field(default_factory=dict)


def resolve(columns: list[str], features: dict[str, str], sides: tuple[str, ...] = ("origin_weather_", "destination_weather_")) -> dict[str, list[str]]:
    """ML-02: transformation to columns. A feature is a column itself, or all its aggregates
    (``<side><feature>_Max``) and hours (``<side><feature>_h1`` ...)."""
    out: dict[str, list[str]] = {}
    for name, how in features.items():
        some = [name] if name in columns else []
        hour = re.compile(rf"(?:{'|'.join(map(re.escape, sides))})?{re.escape(name)}_(?:h\d+|Sum|Avg|Max|Min|Std|Range|Slope)$")
        some += [c for c in columns if hour.match(c)]
        out.setdefault(how, []).extend(c for c in some if c not in out.get(how, []))
    return {k: v for k, v in out.items() if v}


def stages(spec: FeatureSpec, columns: list[str], dtypes: dict[str, str]) -> list:
    """ML-01: index, encode, impute by means, scale the group declared so, assemble, index the vector."""
    groups = resolve(columns, spec.features)
    text, hot, plain, scaled = (groups.get(k, []) for k in (INDEX, ONE_HOT, NUMERIC, SCALED))
    out, inputs = [], []
    if text or hot:
        out.append(StringIndexer(inputCols=text + hot, outputCols=[f"{c}_ix" for c in text + hot], handleInvalid=spec.handle_invalid))
        inputs += [f"{c}_ix" for c in text]
    if hot:
        out.append(OneHotEncoder(inputCols=[f"{c}_ix" for c in hot], outputCols=[f"{c}_hot" for c in hot], handleInvalid="keep"))
        inputs += [f"{c}_hot" for c in hot]
    if plain or scaled:
        out.append(SQLTransformer(statement=f"SELECT *, {', '.join(f'CAST(`{c}` AS DOUBLE) AS `{c}_num`' for c in plain + scaled)} FROM __THIS__"))
        out.append(Imputer(inputCols=[f"{c}_num" for c in plain + scaled], outputCols=[f"{c}_full" for c in plain + scaled], strategy="mean"))
        inputs += [f"{c}_full" for c in plain]
    if scaled:
        out.append(VectorAssembler(inputCols=[f"{c}_full" for c in scaled], outputCol="_scaled_raw", handleInvalid="keep"))
        out.append(StandardScaler(inputCol="_scaled_raw", outputCol="_scaled", withMean=True, withStd=True))
        inputs.append("_scaled")
    vector = "_vector" if spec.index_vector else "features"
    out.append(VectorAssembler(inputCols=inputs, outputCol=vector, handleInvalid="keep"))
    if spec.index_vector:
        out.append(VectorIndexer(inputCol=vector, outputCol="features", maxCategories=spec.max_categories, handleInvalid="keep"))
    return out


def auto_stages(df: DataFrame, target: str, scaler: str | None = None, selector: tuple[str, int] | None = None, index_dates: bool = False, max_categories: int = 32, by_name: bool = True, extra: list | None = None) -> list:
    """ML-03 to ML-05, ML-09: stages by column type: text indexed, booleans as doubles, dates expanded,
    the vector indexed with the date parts left continuous, then a selector, a scaler and stages of the caller."""
    kinds = (column_types_by_name if by_name else column_types)(df, exclude=(target,))
    dates = {c: date_features(c, timestamp=dict(df.dtypes)[c].startswith("timestamp")) for c in kinds["date"]}
    casts = [f"CAST(`{c}` AS DOUBLE) AS `{c}_num`" for c in kinds["boolean"] + kinds["numeric"]]
    parts = [n for d in dates.values() for n in d]
    units = {"year": "year", "month": "month", "day": "dayofmonth", "weekday": "dayofweek", "unix": "unix_timestamp", "hour": "hour", "minute": "minute"}
    for c, d in dates.items():
        for n in d:
            arg = f"CAST(`{c}` AS TIMESTAMP)" if n.endswith("_unix") else f"`{c}`"
            casts.append(f"CAST({units[n.rsplit('_', 1)[1]]}({arg}) AS DOUBLE) AS `{n}`")
    out, inputs = [], [f"{c}_num" for c in kinds["boolean"] + kinds["numeric"]]
    if casts:
        out.append(SQLTransformer(statement=f"SELECT *, {', '.join(casts)} FROM __THIS__"))
    texts = kinds["text"]
    if texts:
        out.append(SQLTransformer(statement=f"SELECT *, {', '.join(f'CAST(`{c}` AS STRING) AS `{c}_txt`' for c in texts)} FROM __THIS__"))
        out.append(StringIndexer(inputCols=[f"{c}_txt" for c in texts], outputCols=[f"{c}_ix" for c in texts], handleInvalid="keep"))
        inputs += [f"{c}_ix" for c in texts]
    out.append(VectorAssembler(inputCols=inputs + (parts if index_dates else []), outputCol="_to_index", handleInvalid="keep"))
    out.append(VectorIndexer(inputCol="_to_index", outputCol="_indexed", maxCategories=max_categories, handleInvalid="keep"))
    last = "_indexed"
    if parts and not index_dates:
        out.append(VectorAssembler(inputCols=["_indexed", *parts], outputCol="_assembled", handleInvalid="keep"))
        last = "_assembled"
    if selector:
        out.append(selector_stage(selector[0], "numTopFeatures", selector[1], last, "_selected", target))
        last = "_selected"
    if scaler:
        made = {"standard": StandardScaler(withMean=False, withStd=True), "minmax": MinMaxScaler(), "robust": RobustScaler()}[scaler]
        out.append(made.setInputCol(last).setOutputCol("_rescaled"))
        last = "_rescaled"
    out += extra or []
    out.append(VectorAssembler(inputCols=[last], outputCol="features", handleInvalid="keep"))
    return out


def selector_stage(kind: str, mode: str, threshold: float, source: str, out: str, label: str) -> UnivariateFeatureSelector:
    """ML-08, ML-09: chi-square for categorical features (``chi2``), analysis of variance (``anova``) or
    F-test (``f``) for continuous ones; modes numTopFeatures, percentile, fpr, fdr, fwe."""
    types = {"chi2": ("categorical", "categorical"), "anova": ("continuous", "categorical"), "f": ("continuous", "continuous")}[kind]
    s = UnivariateFeatureSelector(featuresCol=source, outputCol=out, labelCol=label, selectionMode=mode)
    return s.setFeatureType(types[0]).setLabelType(types[1]).setSelectionThreshold(threshold)


def hybrid_selection(categorical: list[int], numeric: list[int], label: str, mode: str = "fpr", threshold: float = 0.05, numeric_test: bool = False, source: str = "features", out: str = "selected") -> Pipeline:
    """ML-08: select among the categorical slots by chi-square, and with ``numeric_test`` among the numeric
    ones by analysis of variance; joined again."""
    made, inputs = [], []
    if numeric:
        made.append(VectorSlicer(inputCol=source, outputCol="_numeric", indices=numeric))
        if numeric_test:
            made.append(selector_stage("anova", mode, threshold, "_numeric", "_numeric_kept", label))
        inputs.append("_numeric_kept" if numeric_test else "_numeric")
    if categorical:
        made += [VectorSlicer(inputCol=source, outputCol="_categorical", indices=categorical), selector_stage("chi2", mode, threshold, "_categorical", "_categorical_kept", label)]
        inputs.append("_categorical_kept")
    return Pipeline(stages=[*made, VectorAssembler(inputCols=inputs, outputCol=out)])


class VariancePCA:
    """ML-06, ML-07: principal components of one covariance aggregate: the first ``k``, or as few as reach a share of
    the variance. All components are found at once, as many as the vector has slots, so any share is reached. A
    frame without rows has no components, and vectors come out empty."""

    def __init__(self, k: int | None = None, variance: float | None = None, source: str = "features", out: str = "pca_features"):
        self.wanted, self.variance, self.source, self.out, self.model, self.k = k, variance, source, out, None, 0
        self.shares: list[float] = []

    def fit(self, df: DataFrame) -> VariancePCA:
        first = df.select(F.size(vector_to_array(self.source)).alias("n")).first()
        if first is None:
            return self
        self.model = PCA(k=first["n"], inputCol=self.source, outputCol="_pca").fit(df)
        self.shares = [float(x) if x == x else 0.0 for x in self.model.explainedVariance.toArray()]  # no variance, no share
        total, n = 0.0, 0
        for n, share in enumerate(self.shares, 1):
            total += share
            if self.variance and total >= self.variance - 1e-12:
                break
        self.k = min(self.wanted, len(self.shares)) if self.wanted else n
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            return df.withColumn(self.out, array_to_vector(F.array().cast("array<double>")))
        out = VectorSlicer(inputCol="_pca", outputCol=self.out, indices=list(range(self.k))).transform(self.model.transform(df))
        return out.drop("_pca")

    def variance_table(self, spark: SparkSession) -> DataFrame:
        """Component, share, running share, and the elbow: the component furthest below the line from the
        first to the last."""
        shares = self.shares
        n, rows, run = len(shares), [], 0.0
        if not n:
            return spark.createDataFrame([], "component int, share double, running double, is_elbow boolean")
        gaps = [shares[0] + (shares[-1] - shares[0]) * i / max(1, n - 1) - s for i, s in enumerate(shares)]
        elbow = max(range(n), key=lambda i: gaps[i])
        for i, s in enumerate(shares):
            run += s
            rows.append((i + 1, s, run, i == elbow))
        return spark.createDataFrame(rows, "component int, share double, running double, is_elbow boolean")

    def loadings(self, spark: SparkSession, names: list[str]) -> DataFrame:
        if self.model is None:
            return spark.createDataFrame([], "feature string, component int, loading double")
        pc = self.model.pc.toArray()
        return spark.createDataFrame([(names[i], j + 1, float(pc[i, j])) for i in range(pc.shape[0]) for j in range(pc.shape[1])], "feature string, component int, loading double")


def finite(df: DataFrame, columns: list[str], default: float = 0.0) -> DataFrame:
    """UDF-02: nulls, NaN and infinities replaced before assembly."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.withColumns({c: F.when(ok(c), F.col(c).cast("double")).otherwise(default) for c in columns})


def finite_vector(c: str, default: float = 0.0):
    """UDF-02 for an assembled vector, at any width."""
    return array_to_vector(F.transform(vector_to_array(c), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), default).otherwise(x)))


def polynomial(source: str = "features", out: str = "expanded", degree: int = 2) -> PolynomialExpansion:
    """ML-11."""
    return PolynomialExpansion(degree=degree, inputCol=source, outputCol=out)


@dataclass
class Extractor:
    """ML-10: a pipeline (and components) fitted on the training set and applied to any."""

    model: PipelineModel
    pca: VariancePCA | None
    target: str

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """features and label, and the columns to ``keep``."""
        out = self.model.transform(df)
        vector = "features"
        if self.pca:
            out, vector = self.pca.transform(out), self.pca.out
        return out.select(*(keep or []), F.col(vector).alias("features"), F.col(self.target).cast("double").alias("label"))


def feature_stages(train: DataFrame, spec: FeatureSpec) -> Pipeline:
    return Pipeline(stages=stages(spec, train.columns, dict(train.dtypes)) if spec.features else auto_stages(train, spec.target))


def components_of(points: DataFrame, spec: FeatureSpec) -> VariancePCA | None:
    return VariancePCA(k=spec.pca_k, variance=None if spec.pca_k else spec.pca_variance).fit(points) if spec.reduce == "pca" else None


def extract(train: DataFrame, spec: FeatureSpec) -> tuple[Extractor, DataFrame]:
    model = feature_stages(train, spec).fit(train)
    extractor = Extractor(model, components_of(model.transform(train), spec), spec.target)
    return extractor, extractor.transform(train)

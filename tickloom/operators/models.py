"""Classifiers with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def preparation(features: list[str]) -> list:
    """Mean imputation, assembly, scaling: fitted on the train rows only."""
    imputed = [f"{f}__i" for f in features]
    return [
        Imputer(strategy="mean", inputCols=features, outputCols=imputed),
        VectorAssembler(inputCols=imputed, outputCol="raw_features", handleInvalid="keep"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
    ]


def forest(features: list[str], label="target", weight: str | None = None, trees=20, depth=5) -> Pipeline:
    rf = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=42)
    if weight:
        rf = rf.setWeightCol(weight)
    return Pipeline(stages=[*preparation(features), rf])


def boosted(features: list[str], label="target", rounds=10, depth=4) -> Pipeline:
    return Pipeline(stages=[*preparation(features), GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth, seed=42)])


def score(model: PipelineModel, df: DataFrame, out="y_prob") -> DataFrame:
    """Probability of class 1; works on a stream as well."""
    keep = df.columns
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).select(*keep, out)


def grid_search(df: DataFrame, features: list[str], label="target", fold: str | None = None, depths=(3, 5), trees=(10, 20), folds=3, parallelism=2) -> tuple:
    """Grid over depth and number of trees; returns (best model, table of AUC per setting)."""
    rf = RandomForestClassifier(labelCol=label, featuresCol="features", seed=42)
    grid = ParamGridBuilder().addGrid(rf.maxDepth, list(depths)).addGrid(rf.numTrees, list(trees)).build()
    cv = CrossValidator(
        estimator=Pipeline(stages=[*preparation(features), rf]),
        estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(labelCol=label),
        numFolds=folds,
        seed=42,
        parallelism=parallelism,
    )
    if fold:
        cv = cv.setFoldCol(fold)
    m = cv.fit(df)
    rows = [(int(p[rf.maxDepth]), int(p[rf.numTrees]), float(a)) for p, a in zip(grid, m.avgMetrics, strict=True)]
    return m.bestModel, df.sparkSession.createDataFrame(rows, "depth int, trees int, auc double")


def importances(model: PipelineModel, features: list[str], name="model") -> DataFrame:
    """Feature importances as a table (as many rows as features)."""
    spark = SparkSession.getActiveSession()
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(name, f, float(v)) for f, v in zip(features, values, strict=True)], "model string, feature string, importance double")


def weighted_importance(tables: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted mean importance over several models."""
    parts = [t.withColumn("_w", F.lit(float(w))) for t, w in tables]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("feature").agg((F.sum(F.col("importance") * F.col("_w")) / F.sum("_w")).alias("importance"))


def select_features(table: DataFrame, top: int | None = None, minimum: float | None = None) -> DataFrame:
    t = table.filter(F.col("importance") > minimum) if minimum is not None else table
    t = t.orderBy(F.col("importance").desc(), "feature")
    return t.limit(top) if top else t


def prune_correlated(pairs: DataFrame, limit=0.8) -> list[str]:
    """Second column of every pair above the limit (column names only)."""
    return [r.b for r in pairs.filter(F.abs("corr") > limit).select("b").distinct().collect()]


def principal_components(df: DataFrame, features: list[str], k: int) -> DataFrame:
    """Loadings and explained variance, long form (component, feature, loading, explained)."""
    prep = Pipeline(stages=preparation(features)).fit(df).transform(df)
    m = PCA(k=k, inputCol="features", outputCol="pc").fit(prep)
    load, var = m.pc.toArray(), m.explainedVariance.toArray()
    rows = [(i, f, float(load[j][i]), float(var[i]), float(var[: i + 1].sum())) for i in range(k) for j, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "component int, feature string, loading double, explained double, cumulative double")


def save_model(model: PipelineModel, base: str, name: str, version: str, metrics: dict[str, float]) -> str:
    """Store the model and append a metadata row."""
    path = f"{base}/{name}/{version}"
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    row = [(name, version, path, float(metrics.get("auc", 0.0)), float(metrics.get("f1", 0.0)))]
    spark.createDataFrame(row, "name string, version string, path string, auc double, f1 double").write.mode("append").json(f"{base}/metadata")
    return path


def latest_model(spark: SparkSession, base: str, name: str) -> PipelineModel:
    meta = spark.read.schema("name string, version string, path string, auc double, f1 double").json(f"{base}/metadata")
    path = meta.filter(F.col("name") == name).agg(F.max_by("path", "version")).first()[0]
    return PipelineModel.load(path)

"""Learned scorers on Spark ML: logistic regression, Platt scaling, and out-of-fold confidence."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip").transform(df)


class Logistic:
    """Standardised logistic regression with balanced classes: `fit`, then `score` adds `probability`."""

    def __init__(self, features: list[str], label: str = "label", balanced: bool = True, penalty: float = 0.01):
        self.features, self.label, self.balanced, self.penalty = features, label, balanced, penalty

    def fit(self, df: DataFrame) -> Logistic:
        rows = _assembled(df.where(F.col(self.label).isNotNull()), self.features).withColumn("_y", F.col(self.label).cast("double"))
        self.scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(rows)
        n, positive = rows.agg(F.count(F.lit(1)), F.sum("_y")).first()
        weight = F.when(F.col("_y") == 1, (n - positive) / max(positive, 1)).otherwise(1.0) if self.balanced and positive else F.lit(1.0)
        self.model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=self.penalty, maxIter=50).fit(self.scaler.transform(rows).withColumn("_w", weight))
        return self

    def score(self, df: DataFrame, out: str = "probability") -> DataFrame:
        rows = self.model.setProbabilityCol("_p").transform(self.scaler.transform(_assembled(df, self.features)))
        return rows.withColumn(out, vector_to_array("_p")[1]).select(*df.columns, out)


def platt(df: DataFrame, score: str, label: str) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a s + b))) fitted to outcomes."""
    rows = VectorAssembler(inputCols=[score], outputCol="_x", handleInvalid="skip").transform(df).withColumn("_y", F.col(label).cast("double"))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=50).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, folds: int, balanced: bool = False) -> DataFrame:
    """Adds `confidence`: for each fold, from a model fitted on the others."""
    df = df.cache()
    parts = [Logistic(features, label, balanced).fit(df.where(F.col(fold) != k)).score(df.where(F.col(fold) == k), "confidence") for k in range(folds)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def log_likelihood_ratio(df: DataFrame, same: Logistic, null: Logistic, key: list[str]) -> DataFrame:
    """Sum over spots of log p(same) - log p(null), for each key."""
    rows = null.score(same.score(df, "_s"), "_n")
    ratio = F.log(F.greatest("_s", F.lit(1e-9))) - F.log(F.greatest("_n", F.lit(1e-9)))
    return rows.groupBy(*key).agg(F.sum(ratio).alias("llr"))

"""Models of MLlib over the listening tables: clusters, components, and a linear classifier."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.operators.relations import in_order, quantiles
from tessitura.operators.sequence import temporal_folds
from tessitura.session import materialize


def vector_space(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """space: standardized, projected on the first components, of length 1."""
    v = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    v = StandardScaler(inputCol="_v", outputCol="_s", withMean=True).fit(v).transform(v)
    v = PCA(k=dims, inputCol="_s", outputCol="_p").fit(v).transform(v)
    return Normalizer(inputCol="_p", outputCol="_n").transform(v).withColumn("space", vector_to_array("_n")).drop("_v", "_s", "_p", "_n")


def clusters(df: DataFrame, columns: Sequence[str], k: int, seed: int = 1) -> DataFrame:
    """cluster of each row by k-means over the standardized columns."""
    v = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(df)
    v = StandardScaler(inputCol="_v", outputCol="_s", withMean=True).fit(v).transform(v)
    return KMeans(k=k, seed=seed, featuresCol="_s", predictionCol="cluster").fit(v).transform(v).drop("_v", "_s")


def scores(train: DataFrame, rows: DataFrame, columns: Sequence[str], label: str, penalty: float = 0.01) -> DataFrame:
    """score of each row: probability of the label by logistic regression."""
    put = VectorAssembler(inputCols=list(columns), outputCol="_v").transform
    model = LogisticRegression(featuresCol="_v", labelCol=label, regParam=penalty).fit(put(train))
    return model.transform(put(rows)).withColumn("score", vector_to_array("probability")[1]).drop("_v", "rawPrediction", "probability", "prediction")


def with_and_without(train: DataFrame, rows: DataFrame, columns: Sequence[str], friction: dict[str, float], label: str, penalty: float = 0.01) -> DataFrame:
    """Probabilities of the label: baseline (columns only), score (with friction), healthy (score with friction at the given values), delta = score - healthy.

    Both models are fitted on train with balanced classes. A proxy, not a cause.
    """
    n = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    weight = sum((F.when(F.col(label) == k, sum(n.values()) / (len(n) * c)).otherwise(0.0) for k, c in n.items()), F.lit(0.0))
    fitted = train.withColumn("_w", weight)

    def fit(names: list[str]):
        put = VectorAssembler(inputCols=names, outputCol="_v").transform
        model = LogisticRegression(featuresCol="_v", labelCol=label, weightCol="_w", regParam=penalty).fit(put(fitted))
        return lambda df, name: model.transform(put(df)).withColumn(name, vector_to_array("probability")[1]).drop("_v", "rawPrediction", "probability", "prediction")

    base, full = fit(list(columns)), fit([*columns, *friction])
    kept = {f"_{c}": F.col(c) for c in friction}
    found = full(base(rows, "baseline"), "score").withColumns(kept).withColumns({c: F.lit(float(v)) for c, v in friction.items()})
    found = full(found, "healthy").withColumns({c: F.col(f"_{c}") for c in friction}).drop(*kept)
    return found.withColumn("delta", F.col("score") - F.col("healthy"))


def auc(df: DataFrame, score: str, label: str) -> float:
    """Area under the curve over all distinct scores; NaN where there is one class only."""
    if df.select(label).distinct().count() < 2:
        return float("nan")
    return BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label, numBins=0).evaluate(df)


def scene_count(n: int) -> int:
    """How many clusters n items are put in: the root of n, at least 2 and at most 6, never more than items."""
    return min(max(2, min(6, round(n**0.5))), n)


def scenes(df: DataFrame, columns: Sequence[str], seed: int = 1) -> DataFrame:
    """cluster of each row, as many as scene_count() of the rows; a single row is cluster 0."""
    k = scene_count(df.count())
    return clusters(df, columns, k, seed) if k > 1 else df.withColumn("cluster", F.lit(0))


def skip_decomposition(train: DataFrame, rows: DataFrame, preference: Sequence[str], friction: Sequence[str], label: str, penalty: float = 0.01) -> DataFrame:
    """Chance of the label in all, by preference and by friction alone, and what friction adds.

    A model of the preference columns is fitted on the half of train with least friction (the sum of what the friction
    columns have above 0), one of the friction columns on all of it, and a third on the log-odds of both; a part's log-odds
    are put to 0 for the other's share. A proxy, not a cause.
    """
    load = sum((F.greatest(F.col(c).cast("double"), F.lit(0.0)) for c in friction), F.lit(0.0))
    loaded = train.withColumn("_load", load)
    middle = quantiles(loaded.select("_load"), "_load", [0.5]).first()["q0"]

    def fit(df: DataFrame, names: Sequence[str]):
        put = VectorAssembler(inputCols=list(names), outputCol="_v").transform
        model = LogisticRegression(featuresCol="_v", labelCol=label, regParam=penalty).fit(put(df))
        return lambda x, name: model.transform(put(x)).withColumn(name, vector_to_array("rawPrediction")[1]).drop("_v", "rawPrediction", "probability", "prediction")

    wants, hinders = fit(loaded.where(F.col("_load") <= middle), preference), fit(loaded, friction)
    odds = lambda df: hinders(wants(df, "_p"), "_f")
    both = fit(odds(loaded), ["_p", "_f"])
    chance = lambda c: 1 / (1 + F.exp(-F.col(c)))
    found = both(odds(rows), "_all")
    for name, gone in (("preference", "_f"), ("friction", "_p")):
        kept = found.withColumn("_kept", F.col(gone)).withColumn(gone, F.lit(0.0))
        found = both(kept, f"_{name}").withColumn(gone, F.col("_kept")).drop("_kept")
    found = found.withColumns({"total_risk": chance("_all"), "preference_risk": chance("_preference"), "friction_risk": chance("_friction")})
    return found.withColumn("friction_uplift", F.col("total_risk") - F.col("preference_risk")).drop("_p", "_f", "_all", "_preference", "_friction")


def backtest(df: DataFrame, order: Sequence[Column], folds: int, least_train: int, evaluate: Callable[[DataFrame, DataFrame], float]) -> list[tuple[int, int, int, float]]:
    """(fold, training rows, test rows, score) over expanding windows of the rows in a global order; evaluate(train, test) gives a fold's score."""
    rows = materialize(in_order(df, order, "_at"), "backtest")
    out = []
    for fold, end, last in temporal_folds(rows.count(), folds, least_train):
        train, test = rows.where(F.col("_at") < end).drop("_at"), rows.where((F.col("_at") >= end) & (F.col("_at") < last)).drop("_at")
        out.append((fold, end, last - end, evaluate(train, test)))
    return out


def save_model(model, path: str) -> None:
    """A fitted MLlib model, in its own format on any file system."""
    model.write().overwrite().save(path)


def save_arrays(df: DataFrame, path: str) -> None:
    """Rows with arrays (class probabilities, candidates with labels) as Parquet."""
    df.write.mode("overwrite").parquet(path)

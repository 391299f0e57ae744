"""A kernel machine with probabilities: random Fourier features before MLlib's linear machine, its margins calibrated by Platt's method
on folds that it was not fitted on."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RandomFourier(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Features whose inner products approach exp(-gamma |x - y|^2); the matrix (``size`` by ``features``) follows from the seed."""

    size = Param(Params._dummy(), "size", "inputs", TypeConverters.toInt)
    features = Param(Params._dummy(), "features", "outputs", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the matrix", TypeConverters.toInt)
    inputCol = Param(Params._dummy(), "inputCol", "vector", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector", TypeConverters.toString)

    def __init__(self, size: int = 1, features: int = 128, gamma: float = 1.0, seed: int = 42, inputCol: str = "features", outputCol: str = "kernel_features"):
        super().__init__()
        self._set(size=size, features=features, gamma=gamma, seed=seed, inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        size, n, gamma, seed = (self.getOrDefault(p) for p in (self.size, self.features, self.gamma, self.seed))
        rng = np.random.default_rng(seed)
        w, b = np.sqrt(2 * gamma) * rng.normal(size=(size, n)), rng.uniform(0, 2 * np.pi, n)

        @F.arrow_udf("array<double>")
        def project(x: pa.Array) -> pa.Array:
            out = np.sqrt(2 / n) * np.cos(x.flatten().to_numpy().reshape(len(x), size) @ w + b)
            return pa.ListArray.from_arrays(np.arange(0, n * len(x) + 1, n, dtype="int32"), out.ravel())

        return df.withColumn(self.getOrDefault(self.outputCol), array_to_vector(project(vector_to_array(self.getOrDefault(self.inputCol)))))


class Calibrated(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``probability`` of both classes from the margin in ``rawPrediction``: 1 / (1 + exp(-(slope * margin + shift)))."""

    slope = Param(Params._dummy(), "slope", "of the margin", TypeConverters.toFloat)
    shift = Param(Params._dummy(), "shift", "at margin 0", TypeConverters.toFloat)

    def __init__(self, slope: float = 1.0, shift: float = 0.0):
        super().__init__()
        self._set(slope=slope, shift=shift)

    def _transform(self, df: DataFrame) -> DataFrame:
        margin = vector_to_array("rawPrediction")[1]
        p = 1 / (1 + F.exp(-(margin * self.getOrDefault(self.slope) + self.getOrDefault(self.shift))))
        return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))


class KernelSVM(Estimator):
    """Fits a ``PipelineModel`` that adds ``prediction`` (by the margin's sign) and ``probability``.

    ``gamma=None`` takes 1 / (inputs * variance of all inputs).  Calibration folds are drawn by a hash of the features, so they do not
    depend on partitioning, and equal rows share a fold.
    """

    def __init__(self, labelCol: str = "label", weightCol: str | None = None, featuresCol: str = "features", n_features: int = 128, gamma: float | None = None, folds: int = 5, maxIter: int = 30, regParam: float = 0.01, seed: int = 42):
        super().__init__()
        self.label, self.weight, self.column, self.n_features, self.gamma = labelCol, weightCol, featuresCol, n_features, gamma
        self.folds, self.rounds, self.reg, self.seed = folds, maxIter, regParam, seed

    def _machine(self, df: DataFrame) -> tuple[RandomFourier, LinearSVC, DataFrame]:
        """The projection, the machine to fit on its outputs, and the rows with them."""
        m = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(self.column)).alias("s")).first().s
        mean, variance = m.mean.toArray(), m.variance.toArray() * (m["count"] - 1) / max(m["count"], 1)
        spread = float(np.mean(variance + mean**2) - np.mean(mean) ** 2)
        gamma = self.gamma if self.gamma is not None else 1 / (len(mean) * spread) if spread > 0 else 1.0
        kernel = RandomFourier(len(mean), self.n_features, gamma, self.seed, self.column)
        svm = LinearSVC(labelCol=self.label, featuresCol="kernel_features", maxIter=self.rounds, regParam=self.reg, **({"weightCol": self.weight} if self.weight else {}))
        return kernel, svm, kernel.transform(df.select(self.column, self.label, *([self.weight] if self.weight else [])))

    def fit_predicting(self, df: DataFrame) -> PipelineModel:
        """The model without ``probability``: its predictions are those of ``fit``, since the calibration has no part in them, for one
        fit of the machine instead of one and one for each calibration fold."""
        kernel, svm, rows = self._machine(df)
        return PipelineModel([kernel, svm.fit(rows)])

    def _fit(self, df: DataFrame) -> PipelineModel:
        kernel, svm, rows = self._machine(df)
        fold = F.pmod(F.xxhash64(vector_to_array(self.column), F.lit(self.seed)), F.lit(self.folds))
        rows = rows.withColumn("_fold", fold).drop(self.column).cache()
        with ThreadPool(self.folds + 1) as pool:  # all rows, and all but each fold's
            fitted, *without = pool.map(lambda k: svm.fit(rows if k < 0 else rows.filter(F.col("_fold") != k)), range(-1, self.folds))
        held = [m.transform(rows.filter(F.col("_fold") == k)) for k, m in enumerate(without)]
        margins = [x.select(F.col(self.label).alias("label"), vector_to_array("rawPrediction")[1].alias("margin")) for x in held]
        scale = self._platt(reduce(DataFrame.union, margins))
        rows.unpersist()
        return PipelineModel([kernel, fitted, scale])

    @staticmethod
    def _platt(margins: DataFrame) -> Calibrated:
        """Slope and shift by a logistic fit to Platt's softened targets; a row stands once for each class, weighted by its target."""
        n = margins.agg(F.count_if(F.col("label") == 1).alias("ones"), F.count_if(F.col("label") != 1).alias("zeros")).first()
        target = F.when(F.col("label") == 1, (n.ones + 1) / (n.ones + 2)).otherwise(1 / (n.zeros + 2))
        both = margins.withColumn("t", target).select("margin", F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("t").alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - F.col("t")).alias("w")))).alias("x")).select("margin", "x.*")
        model = LogisticRegression(featuresCol="_m", labelCol="y", weightCol="w", maxIter=100).fit(VectorAssembler(inputCols=["margin"], outputCol="_m").transform(both))
        return Calibrated(float(model.coefficients[0]), float(model.intercept))

"""A margin classifier with a radial kernel: random Fourier features, a linear support vector machine on them, and calibrated probabilities."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a part in the many small passes of a fit.
ROWS = 50_000
#: Rows whose random features a scoring task holds at a time.
SLICE = 1024


class Kernel(NamedTuple):
    """Directions and phases of random Fourier features, whose inner products approach the kernel as there are more of them."""

    directions: np.ndarray
    phases: np.ndarray

    def features(self, x: pd.Series) -> np.ndarray:
        return np.sqrt(2 / len(self.phases)) * np.cos(np.stack(x.to_list()) @ self.directions.T + self.phases)

    def margins(self, x: pd.Series, weights: np.ndarray, biases: np.ndarray) -> np.ndarray:
        """Margins of the rows of ``x`` by each machine; the features of ``SLICE`` rows are held at a time."""
        return np.concatenate([self.features(x[i : i + SLICE]) @ weights.T for i in range(0, len(x), SLICE)]) + biases


def mapped(inputs: str, kernel: Kernel) -> Column:
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(kernel.features(x)) if len(x) else [], dtype=object)

    return array_to_vector(run(vector_to_array(inputs)))


class KernelMargin(Estimator):
    """Adds ``out``, the probabilities of both classes.

    The kernel is exp(-gamma |x - y|^2), gamma one over the entries' number times their variance. A machine is fitted on all folds but
    one, for each fold; a logistic curve over the margins of rows that their machine has not seen makes probabilities of margins,
    and those of the machines are averaged. Folds go by a hash of the row, so they repeat.
    """

    def __init__(self, inputs: str = "_x", label: str = "y", weight: str | None = "weight", out: str = "_q", width: int = 128, cost: float = 5.0, folds: int = 3, rounds: int = 20, seed: int = 42):
        super().__init__()
        self.inputs, self.label, self.weight, self.out, self.width, self.cost, self.folds, self.rounds, self.seed = inputs, label, weight, out, width, cost, folds, rounds, seed

    def machine(self, rows: DataFrame, n: int) -> LinearSVCModel:
        svc = LinearSVC(featuresCol="_z", labelCol=self.label, maxIter=self.rounds, regParam=1 / (self.cost * max(n, 1)), predictionCol="_p", rawPredictionCol="_m")
        return (svc.setWeightCol(self.weight) if self.weight else svc).fit(rows)

    def _fit(self, df: DataFrame) -> KernelMarginModel:
        x = df.select(vector_to_array(self.inputs).alias("x"))
        about = x.select(F.size("x").alias("d"), F.explode("x").alias("v")).agg(F.max("d").alias("d"), F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("s"), F.count(F.lit(1)).alias("n")).first()
        d, n = about["d"] or 1, about["n"] // (about["d"] or 1)
        gamma = 1 / (d * about["s"]) if about["s"] else 1.0
        random = np.random.default_rng(self.seed)
        kernel = Kernel(random.normal(0, np.sqrt(2 * gamma), (self.width, d)), random.uniform(0, 2 * np.pi, self.width))
        keep = [self.inputs, self.label, *([self.weight] if self.weight else [])]
        rows = df.select(*keep).select(*keep[1:], mapped(self.inputs, kernel).alias("_z"), F.pmod(F.xxhash64(vector_to_array(self.inputs)), F.lit(self.folds)).alias("_fold")).coalesce(max(1, n // ROWS)).persist()
        machines, margins = [], []
        try:
            for i in range(self.folds):
                seen = rows.where(F.col("_fold") != i)
                if seen.agg(F.count_distinct(self.label)).first()[0] == 2:
                    machines.append(self.machine(seen, n * (self.folds - 1) // self.folds))
                    margins.append(machines[-1].transform(rows.where(F.col("_fold") == i)).select(self.label, vector_to_array("_m")[1].alias("margin")))
            if not machines:
                machines.append(self.machine(rows, n))
                margins.append(machines[-1].transform(rows).select(self.label, vector_to_array("_m")[1].alias("margin")))
            told = VectorAssembler(inputCols=["margin"], outputCol="_v").transform(reduce(DataFrame.unionByName, margins))
            curve = LogisticRegression(featuresCol="_v", labelCol=self.label, maxIter=20).fit(told)
        finally:
            rows.unpersist()
        weights = np.array([m.coefficients.toArray() for m in machines]), np.array([m.intercept for m in machines])
        return KernelMarginModel(self.inputs, self.out, kernel, *weights, float(curve.coefficients[0]), float(curve.intercept))


class KernelMarginModel(Model):
    def __init__(self, inputs: str, out: str, kernel: Kernel, weights: np.ndarray, biases: np.ndarray, slope: float, offset: float):
        super().__init__()
        self.inputs, self.out, self.told = inputs, out, (kernel, weights, biases, slope, offset)

    def _transform(self, df: DataFrame) -> DataFrame:
        kernel, weights, biases, slope, offset = self.told

        @F.pandas_udf("double")
        def probability(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            margins = kernel.margins(x, weights, biases)
            return pd.Series((1 / (1 + np.exp(-np.clip(slope * margins + offset, -500, 500)))).mean(axis=1))

        p = probability(vector_to_array(self.inputs))
        return df.withColumn("_one", p).withColumn(self.out, array_to_vector(F.array(1 - F.col("_one"), F.col("_one")))).drop("_one")

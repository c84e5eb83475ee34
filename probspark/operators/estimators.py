"""Estimators in the manner of pyspark.ml: fit(df) gives a model, transform(df) adds columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import balanced, score_summary
from ..plans.nodes import Node, Sum, number, safe_log
from . import inference
from .learn import learn_classifier, learn_estimator


class CircuitModel:
    """A fitted circuit over named columns."""

    def __init__(self, root: Node, cols: Sequence[str], key: str = "id"):
        self.root, self.cols, self.key = root, list(cols), key
        self.names = dict(enumerate(self.cols))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds log_prob."""
        return inference.log_likelihood(df, self.root, self.names, "log_prob")

    predict_log_proba = transform

    def mpe(self, df: DataFrame) -> DataFrame:
        return inference.mpe(df, self.root, self.names)

    def sample(self, df: DataFrame, seed: int = 42) -> DataFrame:
        """Hidden cells of df drawn; a table of ids alone gives free samples."""
        for c in self.cols:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("double"))
        return inference.sample(df, self.root, self.names, self.key, seed)

    def score(self, df: DataFrame) -> dict[str, float]:
        """Mean log likelihood and two standard errors."""
        return score_summary(self.transform(df), "log_prob").first().asDict()


class CircuitEstimator:
    def __init__(self, cols: Sequence[str], kinds: Sequence[type], domains: Sequence | None = None, key: str = "id", **args):
        self.cols, self.kinds, self.domains, self.key, self.args = list(cols), list(kinds), domains, key, args

    def fit(self, df: DataFrame) -> CircuitModel:
        return CircuitModel(learn_estimator(df, self.cols, self.kinds, self.domains, key=self.key, **self.args), self.cols, self.key)


class CircuitClassifierModel(CircuitModel):
    """Root sum over classes; the last column is the class."""

    def __init__(self, root: Sum, cols: Sequence[str], values: Sequence, key: str = "id"):
        super().__init__(root, cols, key)
        self.values = list(values)

    def _weighted(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        label = self.cols[-1]
        out, names = df.withColumn(label, F.lit(None).cast("double")), []
        for k, (w, c) in enumerate(zip(self.root.weights, self.root.children, strict=True)):
            scored = inference.log_likelihood(out, number(c), self.names, f"__c{k}")
            out, names = scored.withColumn(f"__c{k}", F.col(f"__c{k}") + safe_log(float(w))), [*names, f"__c{k}"]
        number(self.root)
        return out, names

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds probability (array over classes) and prediction; the class column is not read."""
        out, names = self._weighted(df)
        top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
        e = [F.exp(F.col(n) - top) for n in names]
        total = balanced(e)
        out = out.withColumn("probability", F.array(*[x / total for x in e]))
        pick = F.coalesce(*[F.when(F.col(n) == top, F.lit(v)) for n, v in zip(names, self.values, strict=True)])
        return out.withColumn("prediction", pick).drop(*names, self.cols[-1])

    predict_proba = transform

    def predict_log_proba(self, df: DataFrame) -> DataFrame:
        """Adds log_probability: log softmax over classes of each row."""
        return self.transform(df).withColumn("log_probability", F.transform("probability", lambda p: F.greatest(F.ln(p), F.lit(-1e31))))

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds prediction, the class of the most probable completion."""
        return inference.mpe(df.withColumn(self.cols[-1], F.lit(None).cast("double")), self.root, self.names).withColumnRenamed(self.cols[-1], "prediction")


class CircuitClassifier:
    """cols end with the class column."""

    def __init__(self, cols: Sequence[str], kinds: Sequence[type], domains: Sequence | None = None, key: str = "id", **args):
        self.cols, self.kinds, self.domains, self.key, self.args = list(cols), list(kinds), domains, key, args

    def fit(self, df: DataFrame) -> CircuitClassifierModel:
        label = self.cols[-1]
        values = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())
        root = learn_classifier(df, self.cols, self.kinds, len(self.cols) - 1, self.domains, self.key, **self.args)
        return CircuitClassifierModel(root, self.cols, values, self.key)


__all__ = ["CircuitClassifier", "CircuitClassifierModel", "CircuitEstimator", "CircuitModel"]

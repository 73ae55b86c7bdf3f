"""Models as estimators over DataFrames: fit(frame, target) and predict(frame) -> (id, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TesseraError
from . import neighbours, quantiles
from .neighbour_index import NeighbourIndex


class Model:
    """A model of one number or of class probabilities. ``in_disagreement`` says whether its output counts as doubt."""

    name = "model"
    in_disagreement = True

    def fit(self, frame: DataFrame, target: str) -> Model:
        raise NotImplementedError

    def predict(self, frame: DataFrame, out: str) -> DataFrame:
        """The frame with column ``out``."""
        raise NotImplementedError


class GroupMean(Model):
    """Mean target of a category; the overall mean where the category is unseen."""

    def __init__(self, column: str, name: str = "group_mean"):
        self.column, self.name = column, name

    def fit(self, frame: DataFrame, target: str) -> GroupMean:
        self.means = frame.groupBy(F.col(self.column).alias("__level")).agg(F.avg(target).alias("__mean"))
        self.overall = frame.agg(F.avg(target).alias("__all"))
        return self

    def predict(self, frame: DataFrame, out: str) -> DataFrame:
        joined = frame.join(F.broadcast(self.overall)).join(self.means, F.col(self.column).eqNullSafe(F.col("__level")), "left")
        return joined.withColumn(out, F.coalesce("__mean", "__all")).drop("__mean", "__all", "__level")


class Linear(Model):
    """Least squares on one number."""

    def __init__(self, column: str, name: str = "linear"):
        self.column, self.name = column, name

    def fit(self, frame: DataFrame, target: str) -> Linear:
        y, x = F.col(target).cast("double"), F.col(self.column).cast("double")
        self.line = frame.agg(F.regr_slope(y, x).alias("__slope"), F.regr_intercept(y, x).alias("__intercept"))
        return self

    def predict(self, frame: DataFrame, out: str) -> DataFrame:
        return frame.join(F.broadcast(self.line)).withColumn(out, F.col("__intercept") + F.col("__slope") * F.col(self.column)).drop("__slope", "__intercept")


class Trees(Model):
    """Boosted trees or a forest over numbers, booleans and categories.

    Missing numbers take the training median beside a flag; categories are indexed on train, unseen
    ones share one index. ``complete`` numbers are never missing and need neither. ``kind``: "boosted" or "forest". Boosted trees of more than two classes are those of
    boosting.Boosted, grown level by level.
    """

    def __init__(self, numeric: Sequence[str] = (), categorical: Sequence[str] = (), kind: str = "boosted", task: str = "regression", name: str | None = None, trees: int = 20, depth: int = 5, seed: int = 42, complete: Sequence[str] = ()):
        if not numeric and not categorical and not complete:
            raise TesseraError("a tree model needs a structured column")
        self.numeric, self.categorical, self.kind, self.task = list(numeric), list(categorical), kind, task
        self.complete = list(complete)
        self.name, self.trees, self.depth, self.seed = name or kind, trees, depth, seed
        self.several: Model | None = None

    def _features(self, frame: DataFrame) -> DataFrame:
        """The row in one struct beside its features, so that no name of ours meets one of the user's."""
        own = [F.struct(*(F.col(f"`{c}`") for c in frame.columns)).alias("__row")]
        for c in self.numeric:
            own += [F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])).alias(f"_n_{c}"), F.col(c).isNull().cast("double").alias(f"_m_{c}")]
        own += [F.col(c).cast("double").alias(f"_c_{c}") for c in self.complete]
        own += [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(f"_t_{c}") for c in self.categorical]
        return frame.select(*own)

    def fit(self, frame: DataFrame, target: str) -> Trees:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
        from pyspark.ml.feature import StringIndexer, VectorAssembler
        from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

        self.medians = {c: (m if m is not None else 0.0) for c, m in quantiles.medians(frame, self.numeric).items()}
        labels, stages, self.several = None, [], None
        target = f"__row.{target}"
        data = self._features(frame).where(F.col(target).isNotNull())
        if self.categorical:
            stages.append(StringIndexer(inputCols=[f"_t_{c}" for c in self.categorical], outputCols=[f"_i_{c}" for c in self.categorical], handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(VectorAssembler(inputCols=[*(x for c in self.numeric for x in (f"_n_{c}", f"_m_{c}")), *(f"_c_{c}" for c in self.complete), *(f"_i_{c}" for c in self.categorical)], outputCol="_features"))
        bins = max([32, *(data.select(F.count_distinct(f"_t_{c}")).first()[0] + 2 for c in self.categorical)])
        if self.task == "classification":
            labels = [r[0] for r in data.select(F.col(target).cast("string")).distinct().orderBy(target).collect()]
            if not 2 <= len(labels) <= 20:
                raise TesseraError("classification takes 2 to 20 classes")
            stages.append(StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc"))
            data = data.withColumn("_label", F.col(target).cast("string"))
            forest = self.kind == "forest"
            if not forest and len(labels) > 2:
                from .boosting import Boosted

                self.several = Boosted([*self.numeric, *self.complete], self.categorical, "level", self.task, self.name, self.trees, seed=self.seed).fit(frame, target.removeprefix("__row."))
                self.classes = self.several.classes
                return self
        else:
            data = data.withColumn("_y", F.col(target).cast("double"))
            forest = self.kind == "forest"
        common = {"featuresCol": "_features", "labelCol": "_y", "maxBins": bins, "maxDepth": self.depth, "seed": self.seed, "subsamplingRate": 0.9}
        maker = {("regression", False): GBTRegressor, ("regression", True): RandomForestRegressor, ("classification", False): GBTClassifier, ("classification", True): RandomForestClassifier}[self.task, forest]
        stages.append(maker(**common, **({"numTrees": self.trees} if forest else {"maxIter": self.trees, "stepSize": 0.1})))
        self.fitted, self.classes = Pipeline(stages=stages).fit(data), labels
        return self

    def predict(self, frame: DataFrame, out: str) -> DataFrame:
        if self.several is not None:
            return self.several.predict(frame, out)
        from pyspark.ml import PipelineModel
        from pyspark.ml.functions import vector_to_array

        used = [s for s in self.fitted.stages if s.__class__.__name__ != "StringIndexerModel" or s.getOrDefault("outputCol") != "_y"] if self.task == "classification" else self.fitted.stages
        done = PipelineModel(used).transform(self._features(frame))
        value = F.col("prediction") if self.task == "regression" else vector_to_array(F.col("probability"))
        return done.select("__row.*", value.alias(out))


class Neighbours(Model):
    """Median target, or class rates, of the k nearest training rows by standardised numbers, through one fitted index."""

    def __init__(self, numeric: Sequence[str], id_col: str, k: int = 5, task: str = "regression", name: str | None = None, weight: float = 0.15):
        if not numeric:
            raise TesseraError("a neighbour model needs a numeric column")
        self.numeric, self.id_col, self.k, self.task, self.weight = list(numeric), id_col, k, task, weight
        self.name = name or "neighbours"

    def fit(self, frame: DataFrame, target: str) -> Neighbours:
        self.train, self.target = frame.where(F.col(target).isNotNull()).select(self.id_col, *self.numeric, target), target
        self.classes = [r[0] for r in self.train.select(F.col(target).cast("string")).distinct().orderBy(target).limit(21).collect()] if self.task == "classification" else None
        self.index = NeighbourIndex(self.id_col, self.numeric, weight=self.weight).fit(self.train)
        return self

    def predict(self, frame: DataFrame, out: str) -> DataFrame:
        found = self.index.nearest(frame, self.k)
        if self.task == "classification":
            said = neighbours.rates_of(found, self.train.withColumn(self.target, F.col(self.target).cast("string")), self.id_col, self.target, self.classes)
        else:
            said = neighbours.median_of(found, self.train, self.id_col, self.target)
        return frame.join(said.toDF(self.id_col, out), self.id_col, "left").select(*frame.columns, out)

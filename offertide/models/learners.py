"""Regression learners for the stages of the effect model."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offertide.functions.storage import small_or_same
from offertide.models.fitting import for_trees
from offertide.models.matrix import EFFECT_FEATURES, tree_matrix
from offertide.settings import Settings


class Fitted(Protocol):
    def predict(self, df: DataFrame, name: str) -> DataFrame: ...
    def save(self, path: str) -> None: ...


class Learner(Protocol):
    inputs: tuple[str, ...]
    """Columns of a shaped frame that a fit or a prediction reads."""

    def prepare(self, train: DataFrame) -> "Learner": ...
    def shape(self, df: DataFrame) -> DataFrame: ...
    def fit(self, df: DataFrame, target: str) -> Fitted: ...
    def save(self, path: str) -> None: ...


class TreeStage:
    def __init__(self, model: GBTRegressionModel) -> None:
        self.model = model

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        return self.model.copy().setPredictionCol(name).transform(df)

    def used_slots(self) -> list[int]:
        """Places of the vector that some split reads; every split has a gain, so its importance isn't 0."""
        return [i for i, v in enumerate(self.model.featureImportances.toArray()) if v > 0]

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


class TreeLearner:
    """Boosted regression trees on the tree matrix."""

    kind = "trees"
    inputs = ("features",)

    def __init__(self, cfg: Settings, matrix: PipelineModel | None = None) -> None:
        self.cfg = cfg
        self.matrix = matrix

    def prepare(self, train: DataFrame) -> "TreeLearner":
        return TreeLearner(self.cfg, tree_matrix(train, EFFECT_FEATURES))

    def shape(self, df: DataFrame) -> DataFrame:
        return self.matrix.transform(df).select(*df.columns, "features")

    def fit(self, df: DataFrame, target: str) -> TreeStage:
        rows = for_trees(df.select("features", F.col(target).cast("double").alias(target)), self.cfg.tree_min_rows)
        return TreeStage(GBTRegressor(
            labelCol=target, maxIter=self.cfg.effect_trees, maxDepth=self.cfg.effect_depth,
            stepSize=self.cfg.effect_step, seed=self.cfg.seed, minInstancesPerNode=self.cfg.tree_min_rows,
        ).fit(rows))

    def save(self, path: str) -> None:
        self.matrix.write().overwrite().save(f"{path}/matrix")

    def load(self, path: str) -> "TreeLearner":
        return TreeLearner(self.cfg, PipelineModel.load(f"{path}/matrix"))

    def load_stage(self, spark, path: str) -> TreeStage:
        return TreeStage(GBTRegressionModel.load(path))


class CellStage:
    def __init__(self, table: DataFrame) -> None:
        self.table = table

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        cells = self.table.where("cell IS NOT NULL").select("cell", F.col("mean").alias("_mean"))
        overall = self.table.where("cell IS NULL").select(F.col("mean").alias("_overall"))
        return (
            df.join(cells, "cell", "left").crossJoin(overall)
            .withColumn(name, F.coalesce("_mean", "_overall")).drop("_mean", "_overall")
        )

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)


class CellMeanLearner:
    """Mean of the target per combination of yes/no conditions; the overall mean elsewhere."""

    kind = "cells"
    inputs = ("cell",)

    def __init__(self, conditions: Sequence[str], cfg: Settings) -> None:
        self.conditions = tuple(conditions)
        self.cfg = cfg

    def prepare(self, train: DataFrame) -> "CellMeanLearner":
        return self

    def shape(self, df: DataFrame) -> DataFrame:
        digits = ", ".join(f"IF({c}, '1', '0')" for c in self.conditions)
        return df.withColumn("cell", F.expr(f"concat({digits})"))

    def fit(self, df: DataFrame, target: str) -> CellStage:
        # At most 2 ^ conditions cells, plus the overall mean with a null cell.
        cells = df.groupBy("cell").agg(F.avg(target).alias("mean"))
        overall = df.agg(F.avg(target).alias("mean")).select(F.lit(None).cast("string").alias("cell"), "mean")
        return CellStage(small_or_same(cells.unionByName(overall), self.cfg.small_table_rows)[0])

    def save(self, path: str) -> None:
        pass

    def load(self, path: str) -> "CellMeanLearner":
        return self

    def load_stage(self, spark, path: str) -> CellStage:
        return CellStage(small_or_same(spark.read.parquet(path), self.cfg.small_table_rows)[0])

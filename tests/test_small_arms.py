"""Tree fits on arms too small to bin categories."""

from __future__ import annotations

import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler

from offertide.models.learners import TreeLearner


@pytest.mark.parametrize("n", [1, 3, 12])
def test_a_tiny_arm_fits_its_mean(spark, cfg, n):
    rows = spark.createDataFrame([("FMOXY"[k % 5], float(k), float(k % 2)) for k in range(n)], "g string, x double, y double")
    indexed = StringIndexer(inputCol="g", outputCol="i", handleInvalid="keep").fit(rows).transform(rows)
    shaped = VectorAssembler(inputCols=["i", "x"], outputCol="features").transform(indexed)
    fitted = TreeLearner(cfg.but(effect_trees=3)).fit(shaped, "y")
    mean = sum(k % 2 for k in range(n)) / n
    assert [r["m"] for r in fitted.predict(shaped, "m").collect()] == pytest.approx([mean] * n)

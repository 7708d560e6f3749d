"""Feature vectors from the contract columns."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame

from offertide.functions.quantiles import exact_quantiles
from offertide.operators.contract import COLUMNS, NULLABLE

NOT_FEATURES = frozenset({
    "account_id", "offer_id", "received_time", "campaign_wave",
    "treatment", "converted", "conversion_value", "reward_cost", "is_recurrent",
})
FEATURES = tuple(c for c in COLUMNS if c not in NOT_FEATURES)
CATEGORICAL = ("gender", "offer_type")
EFFECT_FEATURES = tuple(c for c in FEATURES if c != "offer_type")


def slots(features: tuple[str, ...]) -> list[tuple[str, str]]:
    """(vector slot, feature it belongs to) in vector order."""
    out = []
    for c in features:
        if c in CATEGORICAL:
            out.append((f"{c}_index", c))
        elif c in NULLABLE:
            out += [(f"{c}_filled", c), (f"{c}_missing", c)]
        else:
            out.append((c, c))
    return out


def tree_matrix(train: DataFrame, features: tuple[str, ...]) -> PipelineModel:
    """Vector for trees: indexed categories, medians for nulls plus a missing flag each.

    Fitted once on the training rows, so a level or a null at scoring time never moves
    the other codes.
    """
    nullable = [c for c in features if c in NULLABLE]
    categorical = [c for c in features if c in CATEGORICAL]
    stages = []
    if nullable:
        found = exact_quantiles(train, {c: c for c in nullable}, (0.5,)).collect()  # a row per column
        medians = {r["name"]: r["q"][0] for r in found}
        # A column without any value in training is filled with 0.
        filled = ", ".join(
            f"coalesce(CAST({c} AS DOUBLE), {float(medians.get(c) or 0.0)!r}D) AS {c}_filled,"
            f" CAST({c} IS NULL AS DOUBLE) AS {c}_missing" for c in nullable)
        stages.append(SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"))
    stages.append(StringIndexer(
        inputCols=categorical, outputCols=[f"{c}_index" for c in categorical],
        handleInvalid="keep", stringOrderType="alphabetAsc"))
    stages.append(VectorAssembler(inputCols=[s for s, _ in slots(features)], outputCol="features"))
    return Pipeline(stages=stages).fit(train)


def linear_matrix(train: DataFrame, features: tuple[str, ...] = FEATURES) -> PipelineModel:
    """Vector for the logistic model: dummies without the first level, nulls 0, standardised.

    A level not seen in training gets no dummy at all.
    """
    plain = [c for c in features if c not in CATEGORICAL]
    columns = [f"coalesce(CAST({c} AS DOUBLE), 0D) AS {c}_v" for c in plain]
    names = [f"{c}_v" for c in plain]
    for c in CATEGORICAL:
        if c in features:
            levels = sorted(r[0] for r in train.select(c).distinct().collect() if r[0] is not None)
            for i, level in enumerate(levels[1:]):
                columns.append(f"CAST(coalesce({c} = '{level}', false) AS DOUBLE) AS {c}_{i}_v")
                names.append(f"{c}_{i}_v")
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__"),
        VectorAssembler(inputCols=names, outputCol="linear_raw"),
        StandardScaler(inputCol="linear_raw", outputCol="linear", withMean=True, withStd=True),
    ]).fit(train)

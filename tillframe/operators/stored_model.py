"""A trained sales model as one pipeline that can be saved, and loaded by a session that knows nothing else.

All that a new product goes through, label codes, interactions, scaling, assembling, trees and the annual figure, are
stages of Spark ML with their fitted values inside.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillframe.operators.encoding import LabelCodes
from tillframe.operators.features import SCALED, TARGET, TARGET_RATIO
from tillframe.operators.regression import SalesModel
from tillframe.sinks import commit

# Sorts behind every label, as a missing one does; no label holds it, as it is no character.
MISSING = "\U0010ffff"
MOST_LABELS = 100_000
# The interactions of ``features.interaction_features`` and the constant of new products, as SQL.
INTERACTIONS = {
    "price_promotion_interaction": "price * promotion_intensity",
    "income_population_interaction": "median_income * population_density / 1000",
    "traffic_market_share": "weekly_foot_traffic * market_share",
    TARGET_RATIO: "cast(0 as double)",
}


def scoring_pipeline(model: SalesModel) -> PipelineModel:
    """The stages from a table of products to ``monthly_sales`` and ``annual_sales``, as ``regression.score_products``.

    A label that the model was not fitted on is an error. The labels go into the pipeline, so a column may have
    100,000 at most. A column of the products named like the target or a step in between gives way.
    """
    columns = list(model.codes.tables)
    labels = [_labels(model.codes, c) for c in columns]
    texts = [f"__label_{c}" for c in columns]
    coalesced = ", ".join(f"coalesce(cast(`{c}` as string), '{MISSING}') as `{t}`" for c, t in zip(columns, texts))
    made = [f"{c}_encoded" for c in columns] + list(INTERACTIONS)
    encoders = [StringIndexerModel.from_labels(known, t, f"{c}_encoded", handleInvalid="error") for known, t, c in zip(labels, texts, columns)]
    scaler = model.scaler.first()
    scaled = {c: f"(`{c}` - {_double(scaler[f'{c}_mean'])}) / {_double(scaler[f'{c}_std'] or 1.0)}" for c in SCALED}
    derived = ", ".join([*[f"{sql} as `{name}`" for name, sql in INTERACTIONS.items()], *[f"{sql} as `scaled_{c}`" for c, sql in scaled.items()]])
    inputs = [f"scaled_{c}" if c in SCALED else c for c in model.features]
    steps = [*texts, *made, *[f"scaled_{c}" for c in SCALED], "features", "prediction"]
    shown = f"* except ({', '.join(f'`{c}`' for c in steps)}), cast(prediction as double) as monthly_sales, prediction * 12 as annual_sales"
    return PipelineModel(
        [
            SQLTransformer(statement=f"select *, {coalesced} from __THIS__"),
            *encoders,
            SQLTransformer(statement=f"select *, {derived} from __THIS__"),
            VectorAssembler(inputCols=inputs, outputCol="features"),
            model.model,
            SQLTransformer(statement=f"select {shown} from __THIS__"),
        ]
    )


def save_model(model: SalesModel, path: str, spark: SparkSession | None = None) -> str:
    """Save the scoring pipeline at ``path``, in place of what is there; a failed save leaves that as it was."""
    spark = spark or model.scaler.sparkSession
    with commit.staged(spark, path) as stage:
        scoring_pipeline(model).write().save(stage)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_with(pipeline: PipelineModel, products: DataFrame) -> DataFrame:
    """``products`` with ``monthly_sales`` and ``annual_sales`` from a saved pipeline, whatever they had of that name."""
    return pipeline.transform(products.drop(TARGET, "annual_sales"))


def _labels(codes: LabelCodes, column: str) -> list[str]:
    table = codes.tables[column]
    found = table.count()
    if found > MOST_LABELS:
        raise ValueError(f"{column} has {found} labels; a stored model takes {MOST_LABELS}")
    rows = table.select(F.coalesce("label", F.lit(MISSING)).alias("label"), "code").orderBy("code").collect()
    return [r["label"] for r in rows]


def _double(value: float) -> str:
    """A literal that reads back as the same double."""
    return f"cast('{value!r}' as double)"


"""Tree-ensemble sales models with Spark ML: split, train, validate, compare, score."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool
from statistics import mean, pstdev

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillframe.functions.hashing import hash_bucket
from tillframe.operators.encoding import LabelCodes, label_encode
from tillframe.operators.features import (
    SCALED,
    TARGET,
    TARGET_RATIO,
    feature_names,
    interaction_features,
    ratio_features,
    scaler_params,
    standardize,
)
from tillframe.session import ensure_checkpoint_dir, materialize, scan_bytes

KEY = "obs_key"
# Training share in percent, folds, seed.
TRAIN_PCT = 80
FOLDS = 5
SEED = 42
FITS_AT_ONCE = 3
SPREAD_BYTES = 32 << 20  # stored bytes a core below which a table is dealt out anew


@dataclass(frozen=True)
class SalesModel:
    """A fitted regressor with what is needed to prepare new rows for it."""

    name: str
    model: Model
    codes: LabelCodes
    scaler: DataFrame
    features: list[str]


@dataclass(frozen=True)
class ModelTable:
    """Assembled rows (key, target, features, split, fold) and the scaler fitted on the training part."""

    rows: DataFrame
    scaler: DataFrame
    codes: LabelCodes
    features: list[str]
    folds: int

    @property
    def train(self) -> DataFrame:
        return self.rows.filter(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.rows.filter(F.col("split") == "test")


def random_forest(trees: int = 100, depth: int = 10, bins: int = 128, seed: int = SEED) -> RandomForestRegressor:
    """Bagged trees that see every feature at every split.

    Spark grows a tree level by level and keeps its nodes on the driver, so
    the depth is bounded (30 at most); 10 is the default here.
    """
    return RandomForestRegressor(
        labelCol=TARGET,
        numTrees=trees,
        maxDepth=depth,
        maxBins=bins,
        featureSubsetStrategy="all",
        seed=seed,
    )


def gradient_boosting(
    stages: int = 100, depth: int = 3, rate: float = 0.1, bins: int = 128, seed: int = SEED
) -> GBTRegressor:
    return GBTRegressor(labelCol=TARGET, maxIter=stages, maxDepth=depth, stepSize=rate, maxBins=bins, seed=seed)


def default_estimators() -> dict[str, Estimator]:
    return {"random_forest": random_forest(), "gradient_boosting": gradient_boosting()}


def train_test_split(df: DataFrame, key: str = KEY, train_pct: int = TRAIN_PCT) -> DataFrame:
    """Add ``split``: "train" or "test" by a hash of the key, whatever the partitioning."""
    in_train = hash_bucket(key, 100) < train_pct
    return df.withColumn("split", F.when(in_train, "train").otherwise("test"))


def with_folds(df: DataFrame, key: str = KEY, folds: int = FOLDS) -> DataFrame:
    """Add ``fold``, a second hash of the key that does not depend on the split."""
    return df.withColumn("fold", hash_bucket(key, folds, salt="fold"))


def model_table(
    observations: DataFrame, codes: LabelCodes, include_target_ratio: bool = True, folds: int = FOLDS
) -> ModelTable:
    """Split, scale and assemble observations for training.

    Training makes several passes over the rows before it keeps its own binned
    copy, so the assembled rows are written once.
    """
    names = feature_names(include_target_ratio)
    parts = with_folds(train_test_split(observations), folds=folds)
    scaler = _fixed(scaler_params(parts.filter(F.col("split") == "train")))
    featured = ratio_features(interaction_features(label_encode(parts, codes)))
    rows = _spread(_assemble(featured, scaler, names).select(KEY, TARGET, "features", "split", "fold"), observations)
    return ModelTable(materialize(rows, "model-table"), scaler, codes, names, folds)


def _spread(rows: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of a source that is stored small, which may be a single split, dealt to all cores; others stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if scan_bytes(source) < cores * SPREAD_BYTES else rows


def fit_model(name: str, estimator: Estimator, table: ModelTable) -> SalesModel:
    """Fit one estimator on the training part."""
    fitted, _ = _fitted(estimator, table, with_folds=False)
    return SalesModel(name, fitted, table.codes, table.scaler, table.features)


def in_shared_passes(estimator: Estimator) -> bool:
    """Whether the shared passes grow what the estimator asks for: all features at every split, all rows, no weights."""
    if not isinstance(estimator, (RandomForestRegressor, GBTRegressor)) or estimator.getMaxBins() > 255:
        return False
    plain = {"subsamplingRate": 1.0, "minInstancesPerNode": 1, "minInfoGain": 0.0, "minWeightFractionPerNode": 0.0}
    plain |= {"labelCol": TARGET, "featuresCol": "features", "predictionCol": "prediction", "leafCol": "", "impurity": "variance"}
    if any(estimator.getOrDefault(p) != v for p, v in plain.items()) or estimator.isDefined("weightCol"):
        return False
    strategy = estimator.getFeatureSubsetStrategy()
    if isinstance(estimator, RandomForestRegressor):
        return (strategy == "all" or (strategy == "auto" and estimator.getNumTrees() == 1)) and estimator.getBootstrap()
    return strategy == "all" and estimator.getLossType() == "squared" and not estimator.isDefined("validationIndicatorCol")


def _fitted(estimator: Estimator, table: ModelTable, with_folds: bool) -> tuple[Model, list[float] | None]:
    """The model fitted on the training part, and R² of each fold under a model that left it out (None: not asked for).

    Trees that the shared passes can grow are grown there: their work and what they keep does not multiply with the
    trees, as Spark's copy of the rows for each bagged tree does. Boosting takes its first tree whole, as Spark does;
    one boosted model alone, without folds to share the passes, is left to Spark, which is faster on many rows.
    """
    from tillframe.operators import shared_boosting, shared_forest, spark_trees

    spark = table.rows.sparkSession
    ensure_checkpoint_dir(spark)
    alone = isinstance(estimator, GBTRegressor) and not with_folds
    if alone or not in_shared_passes(estimator):
        return _fitted_apart(estimator, table) if with_folds else (estimator.fit(table.train), None)
    _refuse_missing_targets(table)
    depth, bins = estimator.getMaxDepth(), estimator.getMaxBins()
    if isinstance(estimator, RandomForestRegressor):
        grown = shared_forest.grow_forests(table, estimator.getNumTrees(), depth, bins, estimator.getSeed(), with_folds)
        base, weights = 0.0, [1.0] * estimator.getNumTrees()
    else:
        grown = shared_boosting.boost(table, estimator.getMaxIter(), depth, estimator.getStepSize(), bins, first_rate=1.0, with_folds=with_folds)
        base, weights = grown.models[shared_boosting.WHOLE].base, grown.models[shared_boosting.WHOLE].rates
    model = spark_trees.as_spark_model(estimator, grown.models[shared_boosting.WHOLE].trees, weights, grown.edges, spark, base)
    return model, [grown.fold_r2[k] for k in sorted(grown.fold_r2)] if with_folds else None


def _refuse_missing_targets(table: ModelTable) -> None:
    known = F.col(TARGET).isNotNull() & ~F.isnan(F.col(TARGET).cast("double"))
    rows, targets = table.train.agg(F.count("*"), F.count_if(known)).first()
    if not rows or targets < rows:
        raise ValueError(f"{rows - targets} of {rows} training rows have no target")


def predict_test(model: SalesModel, table: ModelTable) -> DataFrame:
    """Key, target and prediction of the held-out part."""
    return model.model.transform(table.test).select(KEY, TARGET, "prediction")


def regression_metrics(df: DataFrame, target: str = TARGET, prediction: str = "prediction") -> DataFrame:
    """Mean absolute error, root mean squared error and R² in one pass."""
    error = F.col(target) - F.col(prediction)
    spread_sum = F.var_pop(target) * F.count(target)
    return df.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), spread_sum)).alias("r2"),
    )


def cross_validate(
    name: str, estimator: Estimator, table: ModelTable, at_once: int = FITS_AT_ONCE
) -> tuple[SalesModel, DataFrame]:
    """R² over the folds of the training part, and the model fitted on all of it.

    All folds share the passes over the rows, where the estimator allows that; other estimators are fitted ``at_once``
    side by side, each with a binned copy of its rows in Spark's storage, which spills to disk, while it runs.
    """
    fitted, r2 = _fitted(estimator, table, with_folds=True) if in_shared_passes(estimator) else _fitted_apart(estimator, table, at_once)
    scores = table.rows.sparkSession.createDataFrame([(name, mean(r2), pstdev(r2))], "model string, cv_mean double, cv_std double")
    return SalesModel(name, fitted, table.codes, table.scaler, table.features), scores


def _fitted_apart(estimator: Estimator, table: ModelTable, at_once: int = FITS_AT_ONCE) -> tuple[Model, list[float]]:
    spark = table.rows.sparkSession
    ensure_checkpoint_dir(spark)
    evaluator = RegressionEvaluator(labelCol=TARGET, metricName="r2")
    train, fold = table.train, F.col("fold")

    def fit(left_out: int | None) -> Model | float:
        if left_out is None:
            return estimator.fit(train)
        model = estimator.fit(train.filter(fold != left_out))
        return evaluator.evaluate(model.transform(train.filter(fold == left_out)))

    with ThreadPool(at_once) as pool:
        fitted, *r2 = pool.map(inheritable_thread_target(spark)(fit), [None, *range(table.folds)], chunksize=1)
    return fitted, r2


def model_selection(estimators: dict[str, Estimator], table: ModelTable) -> tuple[SalesModel, DataFrame]:
    """Train and cross-validate every estimator; the best by held-out R², and all metrics.

    Of equal models the first wins.
    """
    models, rows = {}, []
    for ordinal, (name, estimator) in enumerate(estimators.items(), start=1):
        models[name], scores = cross_validate(name, estimator, table)
        held_out = regression_metrics(predict_test(models[name], table))
        cv = scores.first()
        rows.append(
            held_out.select(
                F.lit(ordinal).alias("ordinal"),
                F.lit(name).alias("model"),
                "mae",
                "rmse",
                "r2",
                F.lit(cv.cv_mean).alias("cv_mean"),
                F.lit(cv.cv_std).alias("cv_std"),
            )
        )
    metrics = _fixed(reduce(DataFrame.unionByName, rows))
    best = metrics.orderBy(F.desc("r2"), "ordinal").first().model
    return models[best], metrics.withColumn("is_best", F.col("model") == best)


def feature_importance(model: SalesModel, top: int | None = None) -> DataFrame:
    """Features by importance, the highest first."""
    spark = model.scaler.sparkSession
    pairs = list(zip(model.features, model.model.featureImportances.toArray().tolist(), strict=True))
    ranked = spark.createDataFrame(pairs, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return ranked if top is None else ranked.limit(top)


def score_products(products: DataFrame, model: SalesModel) -> DataFrame:
    """Add ``monthly_sales`` and ``annual_sales`` predictions to a table of candidate products.

    New products have no sales yet, so their sales-per-area feature is 0. A
    label the model was not fitted on raises.
    """
    prepared = interaction_features(label_encode(products, model.codes)).withColumn(TARGET_RATIO, F.lit(0.0))
    scored = model.model.transform(_assemble(prepared, model.scaler, model.features))
    kept = [c for c in products.columns if c != TARGET]
    return scored.select(
        *kept,
        F.col("prediction").alias("monthly_sales"),
        (F.col("prediction") * 12).alias("annual_sales"),
    )


def _assemble(df: DataFrame, scaler: DataFrame, features: list[str]) -> DataFrame:
    """Add the ``features`` vector, with scaled values where a feature is scaled."""
    scaled = standardize(df, scaler, prefix="scaled_")
    inputs = [f"scaled_{c}" if c in SCALED else c for c in features]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(scaled)


def _fixed(df: DataFrame) -> DataFrame:
    """A frame of known few rows (fitted parameters, one row per model), computed once."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)

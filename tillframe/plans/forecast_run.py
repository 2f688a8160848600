"""The complete sales forecast: features, model selection, scoring, scenarios, decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import DataFrame

from tillframe.operators import exploration, regression, scenarios
from tillframe.operators.encoding import fit_label_codes
from tillframe.session import materialize


@dataclass(frozen=True)
class ForecastRun:
    """The chosen model and the frames of the run."""

    model: regression.SalesModel
    metrics: DataFrame
    importance: DataFrame
    scores: DataFrame
    scenario_scores: DataFrame
    summary: DataFrame
    decisions: DataFrame
    explorations: dict[str, DataFrame]


def exploration_bundle(observations: DataFrame) -> dict[str, DataFrame]:
    """Every exploratory summary, by name; lazy."""
    return {
        "region_mean_sales": exploration.region_mean_sales(observations),
        "price_sales_points": exploration.price_sales_points(observations),
        "promotion_bins": exploration.promotion_bins(observations),
        "beverage_mean_sales": exploration.beverage_mean_sales(observations),
        "shelf_mean_sales": exploration.shelf_mean_sales(observations),
        "income_bins": exploration.income_bins(observations),
        "shelf_lift": exploration.shelf_lift(observations),
        "price_sales_corr": exploration.price_sales_corr(observations),
        "top_region_insight": exploration.top_region_insight(observations),
        "top_beverage_insight": exploration.top_beverage_insight(observations),
    }


def run(
    observations: DataFrame,
    products: DataFrame,
    estimators: dict[str, Estimator] | None = None,
    include_target_ratio: bool = True,
    folds: int = regression.FOLDS,
) -> ForecastRun:
    """Train on ``observations`` and assess ``products``, a table of candidates under ``obs_key``.

    The observations are written once, as training reads them many times; the
    products are scored under all scenarios in one pass.
    """
    table = materialize(observations, "observations")
    codes = fit_label_codes(table)
    rows = regression.model_table(table, codes, include_target_ratio, folds)
    model, metrics = regression.model_selection(estimators or regression.default_estimators(), rows)
    scored = scenarios.score_scenarios(products, lambda df: regression.score_products(df, model))
    return ForecastRun(
        model=model,
        metrics=metrics,
        importance=regression.feature_importance(model),
        scores=regression.score_products(products, model),
        scenario_scores=scenarios.scenario_scores(scored),
        summary=scenarios.scenario_summary(scored),
        explorations=exploration_bundle(table),
        decisions=scenarios.decision_report(scored),
    )

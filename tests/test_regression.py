import pytest

from tillframe.operators import regression, scenarios
from tillframe.operators.encoding import fit_label_codes
from tillframe.plans import forecast_run
from tillframe.sources.star_schema import observations



def forest():
    return regression.random_forest(trees=8, depth=5, bins=32)


def boosting():
    return regression.gradient_boosting(stages=5, bins=32)


# A candidate product.
NEW_PRODUCT = {
    "obs_key": "new",
    "region": "AMERICA",
    "population_density": 600.0,
    "median_income": 75000.0,
    "store_chain": "ASIA",
    "store_size": 55000.0,
    "weekly_foot_traffic": 12000.0,
    "price": 3.5,
    "promotion_intensity": 0.5,
    "shelf_location": "Top Shelf",
    "competitor_count": 4,
    "market_share": 0.15,
}


@pytest.fixture(scope="module")
def rows(spark, folder):
    return observations(spark, folder).persist()


@pytest.fixture(scope="module")
def table(rows):
    return regression.model_table(rows, fit_label_codes(rows))


@pytest.fixture(scope="module")
def model(table):
    return regression.fit_model("random_forest", forest(), table)


@pytest.fixture(scope="module")
def product(spark, rows):
    kind = rows.select("beverage_type").orderBy("beverage_type").first().beverage_type
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "monthly_sales")
    values = {**NEW_PRODUCT, "beverage_type": kind}
    return spark.createDataFrame([tuple(values[c.split()[0]] for c in schema.split(", "))], schema)


def test_split_is_stable_and_near_its_share(rows):
    def keys(df):
        return set(r.obs_key for r in regression.train_test_split(df).filter("split = 'train'").collect())

    train = keys(rows)
    assert train == keys(rows.repartition(5))
    assert 0.77 < len(train) / rows.count() < 0.83


def test_folds_do_not_follow_the_split(rows):
    parts = regression.with_folds(regression.train_test_split(rows))
    counts = {tuple(r[:2]): r[2] for r in parts.groupBy("split", "fold").count().collect()}
    assert {f for _, f in counts} == set(range(5))
    assert all(0.15 < counts["test", f] / sum(counts["test", g] for g in range(5)) < 0.25 for f in range(5))


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 3.0)], "monthly_sales double, prediction double")
    row = regression.regression_metrics(df).first()
    assert (row.mae, row.rmse, row.r2) == (1.0, pytest.approx((5 / 3) ** 0.5), pytest.approx(1 - 5 / 8))
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "monthly_sales double, prediction double")
    assert regression.regression_metrics(flat).first().r2 is None


def test_forest_beats_the_mean_and_repeats(model, table):
    first = regression.regression_metrics(regression.predict_test(model, table)).first()
    again = regression.fit_model("random_forest", forest(), table)
    assert first.r2 > 0.5
    assert regression.regression_metrics(regression.predict_test(again, table)).first() == first


def test_importances_sum_to_one(model):
    ranked = regression.feature_importance(model).collect()
    assert len(ranked) == 16
    assert sum(r.importance for r in ranked) == pytest.approx(1.0)
    assert [r.importance for r in ranked] == sorted((r.importance for r in ranked), reverse=True)
    assert regression.feature_importance(model, top=5).count() == 5


def test_without_the_target_ratio(rows):
    table = regression.model_table(rows, fit_label_codes(rows), include_target_ratio=False)
    honest = regression.fit_model("boosting", boosting(), table)
    assert len(honest.features) == 15
    assert {r.feature for r in regression.feature_importance(honest).collect()} == set(honest.features)


def test_selection_takes_the_best_by_test_score(rows, table):
    table = regression.model_table(rows, table.codes, folds=2)
    weak = regression.random_forest(trees=1, depth=1, bins=32)
    best, metrics = regression.model_selection({"weak": weak, "boosting": boosting(), "same": boosting()}, table)
    measured = {r.model: r for r in metrics.collect()}
    assert best.name == "boosting" and measured["boosting"].is_best and not measured["same"].is_best
    assert measured["boosting"].r2 == measured["same"].r2 > measured["weak"].r2
    assert all(r.cv_std >= 0 and r.cv_mean <= 1 for r in measured.values())


def test_scores_of_a_new_product(product, model):
    row = regression.score_products(product, model).first()
    assert row.annual_sales == pytest.approx(12 * row.monthly_sales) and row.monthly_sales > 0
    assert row.price == 3.5


def test_unseen_product_label_raises(product, model):
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="unseen label in region"):
        regression.score_products(product.withColumn("region", F.lit("Atlantis")), model).collect()


def test_scenario_terms(product):
    grid = {r.scenario: r for r in scenarios.scenario_grid(product).collect()}
    assert {s: (round(r.price, 2), r.promotion_intensity, r.shelf_location) for s, r in grid.items()} == {
        "base": (3.5, 0.5, "Top Shelf"),
        "promotion": (3.15, 0.8, "Top Shelf"),
        "premium": (4.2, 0.5, "Eye Level"),
        "mass_market": (2.8, 0.6, "Top Shelf"),
    }


def test_base_scenario_is_the_direct_score(product, model):
    scored = regression.score_products(scenarios.scenario_grid(product), model)
    base = scored.filter("scenario = 'base'").first()
    assert base.annual_sales == regression.score_products(product, model).first().annual_sales
    wide = scenarios.score_scenarios(product, lambda df: regression.score_products(df, model))
    by_name = {r.scenario: r.annual_sales for r in scored.collect()}
    assert {r.scenario: r.annual_sales for r in scenarios.scenario_scores(wide).collect()} == by_name
    report = scenarios.decision_report(wide).first()
    summary = scenarios.scenario_summary(wide).first()
    assert report.base_annual == base.annual_sales and report.promotion_intensity == 0.8
    assert report.best_annual == summary.best_annual and summary.annual_gap == summary.best_annual - summary.worst_annual


def test_scenario_ties_take_the_earlier(spark):
    entries = [(i, s, 7.0) for i, s in enumerate(scenarios.SCENARIOS, start=1)]
    kinds = "obs_key string, scenarios array<struct<scenario_no int, scenario string, annual_sales double>>"
    df = spark.createDataFrame([("p", entries), ("p", entries)], kinds)
    assert scenarios.scenario_summary(df).count() == 2  # products with equal keys stay apart
    row = scenarios.scenario_summary(df).first()
    assert (row.best_scenario, row.worst_scenario, row.annual_gap) == ("base", "base", 0.0)


def test_complete_forecast(rows, product):
    run = forecast_run.run(rows, product, {"random_forest": forest()}, folds=2)
    assert run.model.name == "random_forest" and run.metrics.count() == 1
    assert run.scores.count() == 1 and run.scenario_scores.count() == 4 and run.decisions.count() == 1
    assert run.summary.first().best_annual >= run.summary.first().worst_annual
    assert run.explorations["promotion_bins"].count() == 5 and run.explorations["top_region_insight"].count() == 1


def test_null_keys_go_one_way_by_hash(spark):
    df = spark.createDataFrame([(None,), ("",)], "obs_key string")
    assert {r.split for r in regression.train_test_split(df).collect()} == {
        regression.train_test_split(df.where("obs_key = ''")).first().split
    }

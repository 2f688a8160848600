import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tillframe.operators import regression, stored_model
from tillframe.operators.encoding import fit_label_codes
from tillframe.sources.star_schema import observations

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
OTHER_SESSION = """
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g").getOrCreate()
scored = PipelineModel.load({model!r}).transform(spark.read.parquet({products!r}))
scored.select("obs_key", "monthly_sales", "annual_sales").write.parquet({out!r})
spark.stop()
"""


@pytest.fixture(scope="module")
def rows(spark, folder):
    table = observations(spark, folder)
    return table.withColumn("region", F.when(F.crc32(F.col("obs_key").cast("binary")) % 9 > 0, F.col("region"))).persist()  # some are missing


@pytest.fixture(scope="module", params=["forest", "boosting"])
def model(request, rows):
    table = regression.model_table(rows, fit_label_codes(rows), include_target_ratio=request.param == "forest")
    estimator = regression.random_forest(trees=5, depth=4, bins=32) if request.param == "forest" else regression.gradient_boosting(stages=4, bins=32)
    return regression.fit_model(request.param, estimator, table)


def scores(df):
    return {r["obs_key"]: (r["monthly_sales"], r["annual_sales"]) for r in df.collect()}


def test_another_session_gives_equal_scores(spark, rows, model, tmp_path):
    """Another process, with Spark alone: this package is not on its path."""
    wanted = scores(regression.score_products(rows, model))
    path = stored_model.save_model(model, str(tmp_path / "model"))
    assert scores(stored_model.score_with(stored_model.load_model(path), rows)) == wanted
    products, out = str(tmp_path / "products"), str(tmp_path / "scored")
    rows.drop("monthly_sales").write.parquet(products)
    code = OTHER_SESSION.format(model=path, products=products, out=out)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), env=env, timeout=120, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    assert scores(spark.read.parquet(out)) == wanted


def test_products_keep_their_columns(rows, model):
    found = stored_model.score_with(stored_model.scoring_pipeline(model), rows)
    assert found.columns == [*[c for c in rows.columns if c != "monthly_sales"], "monthly_sales", "annual_sales"]


def test_unknown_labels_are_an_error(rows, model):
    odd = rows.limit(3).withColumn("store_chain", F.lit("nowhere"))
    with pytest.raises(Exception):
        stored_model.score_with(stored_model.scoring_pipeline(model), odd).collect()


def test_too_many_labels(model, monkeypatch):
    monkeypatch.setattr(stored_model, "MOST_LABELS", 1)
    with pytest.raises(ValueError, match="labels"):
        stored_model.scoring_pipeline(model)


def test_the_package_reaches_the_tasks_from_any_folder(tmp_path):
    """A session built elsewhere sends the package along; a task finds it without a path."""
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
from tillframe.session import build_session
from tillframe.sources import csv_splits
spark = build_session("elsewhere", master="local[1]", spark__ui__enabled="false", spark__driver__memory="1g")
sys.path.remove({REPO!r})
print("FOUND", spark.range(3).mapInPandas(lambda batches: (b.assign(id=csv_splits.ends_inside('"', False)) for b in batches), "id boolean").count())
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), env=env, timeout=120, capture_output=True, text=True)
    assert "FOUND 3" in done.stdout, done.stderr[-2000:]

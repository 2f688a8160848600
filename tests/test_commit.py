import os

import pytest
from pyspark.sql import functions as F

from tillframe import session
from tillframe.operators import distincts
from tillframe.sinks import commit, writers


def names(folder):
    return sorted(n for n in os.listdir(folder) if not n.startswith("."))


@pytest.mark.parametrize("file_format", writers.FORMATS)
@pytest.mark.parametrize("single", [False, True])
def test_a_failed_job_leaves_the_old_result(spark, tmp_path, file_format, single):
    path = str(tmp_path / "out")
    good = spark.range(100).repartition(4)
    writers.save(good, path, file_format, single_file=single)
    bad = spark.range(1000).repartition(4).withColumn("id", F.when(F.col("id") == 999, F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(Exception):
        writers.save(bad, path, file_format, single_file=single)
    assert writers.load(spark, path, good, file_format).count() == 100
    assert names(tmp_path) == ["out"]
    writers.save(spark.range(7), path, file_format, single_file=single)
    assert writers.load(spark, path, good, file_format).count() == 7 and names(tmp_path) == ["out"]


def test_a_frame_may_replace_what_it_reads(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.save(spark.range(10), path, "parquet")
    writers.save(spark.read.parquet(path).where("id < 4"), path, "parquet")
    assert spark.read.parquet(path).count() == 4


def test_an_interrupted_replacement_is_put_back(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.save(spark.range(10), path, "parquet")
    os.rename(path, f"{path}{commit.OLD}1234")  # the driver died between the two renames
    assert commit.recover(spark, path) and not commit.recover(spark, path)
    assert spark.read.parquet(path).count() == 10 and names(tmp_path) == ["out"]


def test_a_replacement_that_cannot_be_renamed(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.save(spark.range(10), path, "parquet")
    with pytest.raises(OSError):
        commit.replace(spark, str(tmp_path / "nothing"), path)
    assert spark.read.parquet(path).count() == 10 and names(tmp_path) == ["out"]


def test_working_tables_go_at_the_end(spark, tmp_path):
    before = session.materialize(spark.range(3), "stays")
    with session.working_tables(spark):
        table = session.materialize(spark.range(5), "goes")
        with session.working_tables(spark):
            inner = session.materialize(spark.range(2), "goes-too")
        assert not os.path.exists(inner.inputFiles()[0].removeprefix("file://"))
        files = [f.removeprefix("file://") for f in table.inputFiles()]
        table.write.parquet(str(tmp_path / "result"))
    assert not any(map(os.path.exists, files)) and before.count() == 3
    assert spark.read.parquet(str(tmp_path / "result")).count() == 5
    after = session.materialize(spark.range(4), "stays")
    assert after.count() == 4


def test_one_file_in_order_from_parallel_parts(spark, tmp_path):
    rows = [(i, f'a,"{i}"\nb' if i % 3 else None) for i in range(1000)]
    frame = spark.createDataFrame(rows, "id long, `the text` string").repartitionByRange(6, "id").sortWithinPartitions("id")
    path = writers.save(frame, str(tmp_path / "one"), "csv", single_file=True)
    files = [n for n in names(path) if not n.startswith("_")]
    assert files == ["part-00000.csv"]
    assert [tuple(r) for r in writers.load(spark, path, frame, "csv", multi_line=True).collect()] == rows
    assert open(f"{path}/part-00000.csv").readline() == "id,the text\n"
    path = writers.save(frame, str(tmp_path / "json"), "json", single_file=True)
    assert [r["id"] for r in spark.read.json(f"{path}/part-00000.json").collect()] == list(range(1000))
    path = writers.save(frame.limit(0), str(tmp_path / "none"), "csv", single_file=True)
    assert spark.read.options(**writers.CSV_READ).csv(path).columns == ["id", "the text"]


def test_the_sample_does_not_depend_on_the_partitions(spark):
    frame = spark.range(20_000).select("id", (F.col("id") % 7).alias("k"), F.when(F.col("id") % 5 > 0, F.lit("x")).alias("s"))
    whole = sorted(tuple(r) for r in writers.sample_rows(frame, 500).select("id").collect())
    assert len(whole) == 500
    for parts in (1, 3, 16):
        other = frame.repartition(parts, "k").select("id", "k", "s")
        assert sorted(tuple(r) for r in writers.sample_rows(other, 500).select("id").collect()) == whole
    ids = [i for (i,) in whole]
    assert abs(sum(ids) / 500 - 10_000) < 1500 and ids != list(range(500))
    assert writers.sample_rows(frame, 500, seed=1).select("id").collect() != whole
    assert writers.sample_rows(frame, 20_000).count() == 20_000 == writers.sample_rows(frame, 10**9).count()
    assert writers.sample_rows(frame, 0).count() == 0 == writers.sample_rows(frame.limit(0), 5).count()


def test_equal_rows_are_counted(spark):
    frame = spark.range(3000).select(F.lit(1).alias("a"), F.create_map(F.lit("k"), F.lit(2)).alias("m"))
    found = writers.sample_rows(frame, 100)
    assert found.count() == 100 and found.columns == ["a", "m"]


def test_distinct_counts_at_every_level(spark):
    rows = [(f"r{i % 3}" if i % 11 else None, f"m{i % 2}", f"2024-0{1 + i % 4}", f"c{i % 701}", f"o{i % 997}", None if i % 2 else f"p{i % 50}") for i in range(5000)]
    frame = spark.createDataFrame(rows, "region string, market string, year_month string, customer_id string, order_id string, product_id string")
    found = {(r["level"], r["name"], r["measure"]): (r["exact"], r["estimate"]) for r in distincts.distinct_counts(frame).collect()}
    wanted = {}
    for level, at in (("region", 0), ("market", 1), ("period", 2), ("total", None)):
        for m, c in ((3, "customer_id"), (4, "order_id"), (5, "product_id")):
            sets = {}
            for r in rows:
                sets.setdefault(r[at] if at is not None else None, set()).add(r[m])
            wanted |= {(level, name, c): len(ids - {None}) for name, ids in sets.items()}
    assert {k: v[0] for k, v in found.items()} == wanted
    assert all(abs(estimate - exact) <= 1 + exact * distincts.error_bound() for exact, estimate in found.values())


def test_reports_read_only_the_states(spark):
    frame = spark.createDataFrame([("r", "m", "t", "c", "o", "p")], "region string, market string, year_month string, customer_id string, order_id string, product_id string")
    for states, counts in ((distincts.sketch_states(frame), distincts.sketched_counts), (distincts.bitmap_blocks(frame), distincts.exact_counts)):
        assert "Expand" not in states._jdf.queryExecution().executedPlan().toString()
    table = distincts.materialize(distincts.sketch_states(frame), "states")
    assert distincts.sketched_counts(table)._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1

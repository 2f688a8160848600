import os

import pytest

from tillframe.operators import cleaning, sales
from tillframe.plans import retail_run
from tillframe.schema import HEADINGS
from tillframe import session
from tillframe.sinks import writers
from tillframe.sources import csv_lines
from tillframe.sources.star_schema import order_lines

HEADER = "Sales,Order ID,Order Date,Quantity,Profit,Note"


def write(path, name, *lines):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv_columns_are_taken_by_heading(spark, tmp_path):
    folder = write(tmp_path / "in", "a.CSV", HEADER, "12.5,o1,1/5/2011,2,3,hello", "bad,o2,1/6/2011,1,1,")
    write(tmp_path / "in", "b.csv", HEADER, "7,o3,1/7/2011,1,1,x")
    write(tmp_path / "in", "ignored.txt", "not,a,table")
    df = csv_lines.read_order_lines(spark, folder)
    assert df.columns == ["sales", "order_id", "order_date", "quantity", "profit", "Note"]
    assert dict(df.dtypes)["sales"] == "double" and dict(df.dtypes)["Note"] == "string"
    assert {r.order_id: r.sales for r in df.collect()} == {"o1": 12.5, "o2": None, "o3": 7.0}
    assert df.select("sales").agg({"sales": "sum"}).first()[0] == 19.5
    files = {os.path.basename(r.path): r.bytes for r in csv_lines.list_csv_files(spark, folder).collect()}
    assert set(files) == {"a.CSV", "b.csv"} and all(files.values())


def test_files_with_other_headers_are_refused(spark, tmp_path):
    folder = write(tmp_path / "in", "a.csv", "Sales,Profit", "1,2")
    write(tmp_path / "in", "b.csv", "Profit,Sales", "1,2")
    with pytest.raises(Exception, match="(?i)header"):
        csv_lines.read_order_lines(spark, folder).collect()


def test_inferred_types(spark, tmp_path):
    folder = write(tmp_path / "in", "a.csv", HEADER, "12.5,17,1/5/2011,2,3,hello")
    types = dict(csv_lines.read_order_lines(spark, folder, infer_schema=True).dtypes)
    assert (types["sales"], types["order_id"], types["quantity"]) == ("double", "int", "int")


@pytest.fixture(scope="module")
def lines(spark, folder):
    return cleaning.cleaned_lines(order_lines(spark, folder)).persist()


def test_unknown_format(lines, tmp_path):
    with pytest.raises(ValueError, match="unknown format 'xml'"):
        writers.save(lines, str(tmp_path / "x"), "xml")
    assert not (tmp_path / "x").exists()


@pytest.mark.parametrize("file_format", writers.FORMATS)
def test_overwrite_and_round_trip(spark, lines, tmp_path, file_format):
    path = str(tmp_path / file_format)
    writers.save(lines.limit(3), path, file_format)
    writers.save(lines, path, file_format)
    back = writers.load(spark, path, lines, file_format)
    assert back.exceptAll(lines).count() == 0 and back.count() == lines.count()


def test_single_file_is_one_part_and_keeps_the_order(spark, lines, tmp_path):
    months = sales.monthly_sales(lines)
    path = writers.save(months, str(tmp_path / "one"), "csv", single_file=True)
    parts = [f for f in os.listdir(path) if f.endswith(".csv")]
    assert len(parts) == 1
    text = (tmp_path / "one" / parts[0]).read_text().splitlines()[1:]
    assert [t.split(",")[0] for t in text] == [r.year_month for r in months.collect()]
    spread = writers.save(lines.repartition(3), str(tmp_path / "many"), "csv")
    assert len([f for f in os.listdir(spread) if f.endswith(".csv")]) == 3


@pytest.mark.parametrize("multi_line", [False, True])
def test_csv_keeps_every_text(spark, tmp_path, multi_line):
    texts = ['Bin 12" wide, red', '"quoted"', "a,b", "back\\slash", "", None, " ", 'end"'] + ["two\nlines"] * multi_line
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    path = writers.save(df, str(tmp_path / "x"), "csv")
    assert sorted(writers.load(spark, path, df, "csv", multi_line).collect()) == sorted(df.collect())


def test_csv_with_doubled_quotes_reads_right(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Order ID,Product Name,Sales,Quantity\no1,"Bin 12"" wide, red",5.5,2\n')
    row = csv_lines.read_order_lines(spark, str(tmp_path)).first()
    assert (row.product_name, row.sales, row.quantity) == ('Bin 12" wide, red', 5.5, 2)


def test_shared_folder(spark):
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Fake:
        def __init__(self, master, given=None):
            self.conf = Conf()
            self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": lambda _: given})()

    assert session.shared_folder(Fake("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Fake("yarn"))
    local = Fake("local[2]")
    assert session.shared_folder(local) == session.shared_folder(local)


@pytest.mark.parametrize("rows", [1, 50, 4999, 5000, 6000])
def test_samples_are_exactly_capped(spark, rows):
    df = spark.range(5000).repartition(7)
    sample = writers.sample_rows(df, rows)
    assert sample.count() == min(rows, 5000)
    assert sample.distinct().count() == min(rows, 5000)


def differing(a, b):
    return a.exceptAll(b).count() + b.exceptAll(a).count()


def test_complete_run_from_csv(spark, lines, folder, tmp_path):
    raw = order_lines(spark, folder).drop("market", "weeknum")
    source = str(tmp_path / "source")
    writers.save(raw.withColumnsRenamed({c: HEADINGS[c] for c in raw.columns}), source, "csv")
    base = str(tmp_path / "out")
    run = retail_run.run_csv(spark, source, base, analysed_at="2024-01-02 03:04:05")
    assert run.results["market_analysis"] is None and run.results["weekly_sales"] is None
    assert not any("market" in name or "weekly" in name for name in run.saved)
    assert spark.read.parquet(run.saved["cleaned_data/parquet"]).count() == lines.count()
    assert spark.read.option("header", True).csv(run.saved["cleaned_data/csv"]).count() == lines.count()
    for name, df in run.results.items():
        if f"{name}/csv" in run.saved:
            assert differing(writers.load(spark, run.saved[f"{name}/csv"], df, "csv"), df) == 0, name
    assert differing(run.results["regional_analysis"], sales.region_performance(lines)) == 0
    assert run.results["cleaning_retention"].first().rows_before == raw.count()
    assert run.results["source_profile"].count() == len(raw.columns) and run.results["preview"].count() == 5
    text = [r.value for r in spark.read.text(f"{base}/analysis_report").collect()]
    assert text[0].startswith("total_transactions: ") and text[-1] == "analysed_at: 2024-01-02 03:04:05"
    names = {r.path.split("/")[-2] for r in run.manifest.collect()}
    assert {"cleaned_data", "analysis_regional_analysis", "analysis_report"} <= names


def test_bundle_writes_lines_in_both_formats(spark, lines, tmp_path):
    saved = retail_run.save_bundle({"cleaned_data": lines, "nothing": None}, str(tmp_path / "b"), samples=True)
    assert set(saved) == {"cleaned_data/parquet", "cleaned_data/csv", "cleaned_data/sample"}
    assert spark.read.parquet(saved["cleaned_data/parquet"]).count() == lines.count()


def test_profile_and_preview(lines):
    profile = csv_lines.source_profile(lines.select("order_id", "sales")).collect()
    assert [(r.ordinal, r.column_name, r.data_type) for r in profile] == [(1, "order_id", "string"), (2, "sales", "double")]
    assert {r.row_count for r in profile} == {lines.count()} and {r.column_count for r in profile} == {2}
    assert csv_lines.preview(lines).count() == 5


def test_malformed_lines_are_counted(spark, tmp_path):
    (tmp_path / "lines.csv").write_text('Order ID,Sales,Quantity\na,"1,234.50",1\nb,2.5,x\nc,3,\nd,4,1\n')
    lines = csv_lines.read_order_lines(spark, str(tmp_path), malformed="bad_line")
    profile = {r["column_name"]: r for r in csv_lines.source_profile(lines, "bad_line").collect()}
    assert [profile[c]["null_count"] for c in ("order_id", "sales", "quantity")] == [0, 1, 2]
    assert {(r["row_count"], r["column_count"], r["malformed_count"]) for r in profile.values()} == {(4, 3, 2)}
    assert csv_lines.source_profile(lines.drop("bad_line")).columns[-1] == "column_count"

"""The complete order-line analysis: clean, report, save."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from tillframe.operators import cleaning, kpi, quality, sales
from tillframe.sinks import writers
from tillframe.sources.csv_lines import preview, read_order_lines, source_profile

CLEANED = "cleaned_data"
SAVES_AT_ONCE = 4


@dataclass(frozen=True)
class RetailRun:
    """Where a run was saved, its results (None for reports whose columns are absent), KPI report and list of files."""

    base: str
    saved: dict[str, str]
    results: dict[str, DataFrame | None]
    report: DataFrame
    manifest: DataFrame


def report_bundle(lines: DataFrame) -> dict[str, DataFrame | None]:
    """Every report over cleaned lines, by name; lazy."""
    # The names of the saved results, up to the shipping analysis.
    return {
        CLEANED: lines,
        "quality_overview": quality.quality_overview(lines),
        "null_counts": quality.null_counts(lines),
        "numeric_summary": quality.numeric_summary(lines),
        "regional_analysis": sales.region_performance(lines),
        "market_analysis": sales.market_performance(lines),
        "country_analysis": sales.top_countries(lines),
        "product_analysis": sales.category_performance(lines),
        "top_products": sales.top_products(lines),
        "top_profitable_products": sales.top_profitable_products(lines),
        "yearly_sales": sales.yearly_sales(lines),
        "monthly_sales": sales.monthly_sales(lines),
        "quarterly_sales": sales.quarterly_sales(lines),
        "weekly_sales": sales.weekly_sales(lines),
        "customer_segments": sales.segment_performance(lines),
        "top_customers": sales.top_customers(lines),
        "shipping_analysis": sales.shipping_mode_performance(lines),
        "shipping_sales_corr": sales.shipping_sales_corr(lines),
        "shipping_cost_summary": sales.shipping_cost_summary(lines),
        "kpi_summary": kpi.kpi_summary(lines),
        "kpi_shipping_total": kpi.kpi_shipping_total(lines),
        "best_region": kpi.best_region(lines),
        "best_market": kpi.best_market(lines),
        "best_category": kpi.best_category(lines),
        "avg_customer_value": kpi.avg_customer_value(lines),
        "preview": preview(lines),
    }


def source_bundle(raw: DataFrame) -> dict[str, DataFrame | None]:
    """What is reported of the lines as they came, by name; lazy."""
    return {"source_profile": source_profile(raw), "cleaning_retention": cleaning.cleaning_retention(raw)}


def result_path(base: str, name: str, file_format: str) -> str:
    return f"{base}/{file_format}/{name}"


def save_bundle(
    results: dict[str, DataFrame | None], base: str, samples: bool = False, lines_parquet: str | None = None
) -> dict[str, str]:
    """Save the cleaned lines as Parquet and CSV and every report as CSV; returns name/format -> path.

    Reports that are None are skipped. ``samples`` adds the capped CSV exports,
    taken from the saved files so that no report is computed twice.
    ``lines_parquet`` names an existing Parquet copy of the lines, which is
    then not written again. A few saves run side by side, as most reports end
    in a handful of small tasks.
    """

    def save_one(name: str, df: DataFrame) -> dict[str, str]:
        stem, cap = f"analysis_{name}", writers.REPORT_SAMPLE_ROWS
        saved = {}
        if name == CLEANED:
            stem, cap = name, writers.LINES_SAMPLE_ROWS
            saved[f"{name}/parquet"] = lines_parquet or writers.save(df, result_path(base, stem, "parquet"), "parquet")
        saved[f"{name}/csv"] = writers.save(df, result_path(base, stem, "csv"), "csv")
        if samples:
            kind = "parquet" if name == CLEANED else "csv"  # not parsed once more
            stored = writers.load(df.sparkSession, saved[f"{name}/{kind}"], df, kind)
            sample = writers.sample_rows(stored, cap) if name == CLEANED else stored.limit(cap)
            saved[f"{name}/sample"] = writers.save(sample, result_path(base, stem, "sample"), "csv")
        return saved

    present = {name: df for name, df in results.items() if df is not None}
    if not present:
        return {}
    session = next(iter(present.values())).sparkSession
    with ThreadPool(SAVES_AT_ONCE) as pool:
        parts = pool.starmap(inheritable_thread_target(session)(save_one), present.items())
    return {path_name: path for part in parts for path_name, path in part.items()}


def run(raw: DataFrame, base: str, analysed_at: str | None = None, samples: bool = False) -> RetailRun:
    """Clean ``raw``, save the lines and every report below ``base``, and write the KPI report.

    The cleaned lines are written once as Parquet and every report reads that
    table: one parse of the source, column pruning for each report, and a lost
    executor costs a re-read only.
    """
    cleaned = cleaning.cleaned_lines(raw)
    table = writers.save(cleaned, result_path(base, CLEANED, "parquet"), "parquet")
    lines = writers.load(raw.sparkSession, table, cleaned, "parquet")
    results = report_bundle(lines) | source_bundle(raw)
    saved = save_bundle(results, base, samples, lines_parquet=table)
    report = kpi.kpi_report(lines, analysed_at)
    writers.save_report_text(report, f"{base}/analysis_report")
    return RetailRun(base, saved, results, report, writers.output_manifest(raw.sparkSession, base))


def run_csv(
    spark: SparkSession, source: str, base: str, analysed_at: str | None = None, samples: bool = False
) -> RetailRun:
    """``run`` on the CSV files at ``source``."""
    return run(read_order_lines(spark, source), base, analysed_at, samples)

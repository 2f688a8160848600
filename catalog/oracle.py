"""ANSI-SQL twins of the queries, run by DuckDB over the same tables."""

from __future__ import annotations

LINES = """
lines as (
  select cast(o_orderkey as varchar) as order_id,
    strftime(o_orderdate, '%m/%d/%Y') as order_date, strftime(l_shipdate, '%m/%d/%Y') as ship_date,
    o_orderpriority as ship_mode, cast(c_custkey as varchar) as customer_id, c_name as customer_name,
    c_mktsegment as segment, cn.n_name as country, cr.r_name as region, sr.r_name as market,
    cast(p_partkey as varchar) as product_id, p_name as product_name, p_type as category, p_brand as sub_category,
    case when l_linenumber = 1 and l_returnflag = 'N' then 0.0::double
         else l_extendedprice * (1 - l_discount) end as sales,
    l_quantity as quantity, nullif(l_discount, 0.0::double) as discount,
    case when l_linenumber = 7 and l_returnflag = 'R' then null
         else l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice * 0.9::double end as profit,
    nullif(l_extendedprice * l_tax, 0.0::double) as shipping_cost,
    cast(year(o_orderdate) as int) as "year", cast(weekofyear(o_orderdate) as int) as weeknum
  from lineitem join orders on l_orderkey = o_orderkey
    join customer on o_custkey = c_custkey
    join nation cn on c_nationkey = cn.n_nationkey join region cr on cn.n_regionkey = cr.r_regionkey
    join part on l_partkey = p_partkey
    join supplier on l_suppkey = s_suppkey
    join nation sn on s_nationkey = sn.n_nationkey join region sr on sn.n_regionkey = sr.r_regionkey
)"""

OBSERVATIONS = """
observations as (
  select l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey as obs_key,
    cr.r_name as region, cast(nc.n_cust as double) as population_density,
    c_acctbal * 6 + 10000 as median_income, sr.r_name as store_chain, s_acctbal * 5 + 20000 as store_size,
    o_totalprice / 25 as weekly_foot_traffic, p_type as beverage_type,
    l_extendedprice / l_quantity / 1000 as price, l_discount * 10 as promotion_intensity,
    case l_returnflag when 'A' then 'Eye Level' when 'N' then 'Top Shelf' else 'Bottom Shelf' end as shelf_location,
    l_linenumber as competitor_count, l_tax * 10 as market_share,
    l_extendedprice * (1 - l_discount) as monthly_sales, l_orderkey as obs_index
  from lineitem join orders on l_orderkey = o_orderkey
    join customer on o_custkey = c_custkey
    join nation cn on c_nationkey = cn.n_nationkey join region cr on cn.n_regionkey = cr.r_regionkey
    join (select c_nationkey as k, count(*) as n_cust from customer group by 1) nc on nc.k = c_nationkey
    join part on l_partkey = p_partkey
    join supplier on l_suppkey = s_suppkey
    join nation sn on s_nationkey = sn.n_nationkey join region sr on sn.n_regionkey = sr.r_regionkey
)"""

VALID = "sales > 0 and quantity > 0 and profit is not null"


def decimal_round(x: str, digits: int) -> str:
    """Round half up on the shortest decimal form of a double, as Spark's round does."""
    return f"cast(round(cast(cast({x} as varchar) as decimal(38, 15)), {digits}) as double)"


def steady_round(x: str, digits: int) -> str:
    """Round a value whose last bits may differ between engines; the queries do the same."""
    return f"cast(round(cast({x} as decimal(28, 8)), {digits}) as double)"


def exact_sum(x: str) -> str:
    """Compensated sum of doubles; amounts have four places, so its last bits are rounded away there."""
    return f"cast(cast(cast(fsum({x}) as decimal(28, 4)) as varchar) as double)"


def total(x: str) -> str:
    return decimal_round(exact_sum(x), 2)


def average(x: str, factor: str = "") -> str:
    return decimal_round(f"{exact_sum(x)} / count({x}){factor}", 2)


CLEANED = f"""
cleaned as (
  select * exclude (order_date, ship_date, discount, shipping_cost), order_date, ship_date,
    cast(year(order_date) as int) as order_year, cast(month(order_date) as int) as order_month,
    cast(quarter(order_date) as int) as order_quarter, strftime(order_date, '%Y-%m') as year_month,
    cast(datediff('day', order_date, ship_date) as int) as shipping_days,
    coalesce(discount, 0.0) as discount, coalesce(shipping_cost, 0.0) as shipping_cost,
    {decimal_round("profit / sales * 100", 2)} as profit_margin
  from (
    select * replace (cast(try_strptime(order_date, '%m/%d/%Y') as date) as order_date,
                      cast(try_strptime(ship_date, '%m/%d/%Y') as date) as ship_date)
    from lines where {VALID}
  )
)"""

MARGIN_PCT = decimal_round(f"{exact_sum('profit')} / nullif({exact_sum('sales')}, 0) * 100", 2)
TOTAL_SALES = f"{total('sales')} as total_sales"
TOTAL_PROFIT = f"{total('profit')} as total_profit"
AVG_SALES = f"{average('sales')} as avg_line_sales"
MARGIN = f"{MARGIN_PCT} as margin_pct"
CUSTOMERS = "count(distinct customer_id) as customer_count"
ORDERS = "count(distinct order_id) as order_count"

ALL_LINE_COLUMNS = (
    "order_id, order_date, ship_date, ship_mode, customer_id, customer_name, segment, country, region, market, "
    "product_id, product_name, category, sub_category, sales, quantity, discount, profit, shipping_cost, "
    '"year", weeknum'
)
CLEANED_COLUMNS = (
    ALL_LINE_COLUMNS + ", profit_margin, order_year, order_month, order_quarter, year_month, shipping_days"
)

LINE_TYPES = (
    [(c.strip().strip('"'), "string") for c in ALL_LINE_COLUMNS.split(",")[:14]]
    + [(c, "double") for c in ("sales", "quantity", "discount", "profit", "shipping_cost")]
    + [("year", "int"), ("weeknum", "int")]
)

FORMULA = """greatest(0.0, (population_density * 0.1::double + median_income * 0.0001::double
  + store_size * 0.001::double + weekly_foot_traffic * 0.05::double + (1 - price * 0.2::double) * 1000
  + promotion_intensity * 500 + (case when shelf_location = 'Eye Level' then 1.0::double else 0.5::double end) * 200)
  * (1 + 0.2::double * sin(obs_index / 100::double)))"""

GRID = """
grid as (
  select o.* exclude (price, promotion_intensity, shelf_location, monthly_sales),
    s.scenario_no, s.scenario, price * s.factor as price,
    coalesce(s.promotion, promotion_intensity) as promotion_intensity,
    coalesce(s.shelf, shelf_location) as shelf_location
  from (select *, row_number() over () as product_no from observations) o, (values (1, 'base', 1.0::double, null::double, null::varchar),
    (2, 'promotion', 0.9::double, 0.8::double, null), (3, 'premium', 1.2::double, null, 'Eye Level'),
    (4, 'mass_market', 0.8::double, 0.6::double, null)) s(scenario_no, scenario, factor, promotion, shelf)
)"""

SCORES = f"""
scores as (
  select *, monthly_sales * 12 as annual_sales from (select *, {FORMULA} as monthly_sales from grid)
)"""

FORMULA_COLUMNS = (
    "population_density",
    "median_income",
    "store_size",
    "weekly_foot_traffic",
    "price",
    "promotion_intensity",
)


def over_lines(body: str) -> str:
    return f"with {LINES} {body}"


def over_cleaned(body: str) -> str:
    return f"with {LINES}, {CLEANED} {body}"


def over_observations(body: str) -> str:
    return f"with {OBSERVATIONS} {body}"


def over_scores(body: str) -> str:
    return f"with {OBSERVATIONS}, {GRID}, {SCORES} {body}"


def grouped(keys: str, measures: list[str], order: str = "", having: str = "") -> str:
    """A report over the cleaned lines."""
    having = f"having {having}" if having else ""
    return over_cleaned(f"select {keys}, {', '.join(measures)} from cleaned group by {keys} {having} {order}")


def binned(column: str) -> str:
    """Mean sales over five equal-width, right-closed bins."""

    def short(x: str) -> str:
        scale = f"pow(10.0::double, case when abs({x}) >= 1 or {x} = 0 then 3 else 2 - floor(log10(abs({x}))) end)"
        plain = f"cast(cast(cast(round_even({x} * {scale}, 0) / {scale} as varchar) as decimal(38, 12)) as varchar)"
        return f"regexp_replace(regexp_replace({plain}, '0+$', ''), '[.]$', '.0')"

    return over_observations(f"""
, limits as (select min({column}) as lo, max({column}) as hi from observations)
, bins as (
  select cast(i as int) as bin_index,
    case when i = 0 then lo - (hi - lo) * 0.001::double else lo + (hi - lo) / 5 * i end as bin_lo,
    case when i = 4 then hi else lo + (hi - lo) / 5 * (i + 1) end as bin_hi
  from limits, range(5) r(i)
)
select bin_index, bin_lo, bin_hi, '(' || {short("bin_lo")} || ', ' || {short("bin_hi")} || ']' as bin_label,
  count(monthly_sales) as row_count, {steady_round("avg(monthly_sales)", 4)} as mean_sales
from bins left join observations on {column} > bin_lo and {column} <= bin_hi
group by bin_index, bin_lo, bin_hi""")


def label_codes(columns: tuple[str, ...]) -> str:
    """CTEs ``codes_<column>`` with 0-based ranks of the sorted labels."""
    return "".join(
        f", codes_{c} as (select {c} as label, cast(row_number() over (order by {c}) - 1 as int) as code "
        f"from (select distinct {c} from observations))"
        for c in columns
    )


CATEGORICAL = ("region", "store_chain", "beverage_type", "shelf_location")
CODE_JOINS = " ".join(f"join codes_{c} on observations.{c} = codes_{c}.label" for c in CATEGORICAL)
CODE_COLUMNS = ", ".join(f"codes_{c}.code as {c}_encoded" for c in CATEGORICAL)
INTERACTIONS = """price * promotion_intensity as price_promotion_interaction,
  median_income * population_density / 1000 as income_population_interaction,
  weekly_foot_traffic * market_share as traffic_market_share"""
LOGS = ", ".join(
    f"{steady_round(f'ln(1 + {c})', 6)} as log_{c}" for c in ("monthly_sales", "store_size", "weekly_foot_traffic")
)
PLAIN_OBSERVATIONS = (
    "obs_key, region, population_density, median_income, store_chain, store_size, weekly_foot_traffic, "
    "beverage_type, price, promotion_intensity, shelf_location, competitor_count, market_share, monthly_sales"
)
SPLIT = "('0x' || substr(md5(obs_key), 1, 8))::bigint % 100 < 80"
FOLD = "cast(('0x' || substr(md5('fold' || obs_key), 1, 8))::bigint % 5 as int)"

FEATURES = (
    "population_density, median_income, store_size, weekly_foot_traffic, price, promotion_intensity, "
    "competitor_count, market_share, region_encoded, store_chain_encoded, beverage_type_encoded, "
    "shelf_location_encoded, price_promotion_interaction, income_population_interaction, traffic_market_share, "
    "sales_per_sqft"
).split(", ")
MODELS = "from (values ('random_forest'), ('gradient_boosting')) v(model)"

SUMMARY = {
    "count": "cast(count({c}) as double)",
    "mean": "avg({c})",
    "stddev": "stddev_samp({c})",
    "min": "min({c})",
    "max": "max({c})",
}


def numeric_summary() -> str:
    columns = ("sales", "quantity", "discount", "profit", "shipping_cost")
    parts = [
        f"select '{c}' as column_name, '{s}' as statistic, {steady_round(e.format(c=c), 4)} as value from cleaned"
        for c in columns
        for s, e in SUMMARY.items()
    ]
    return over_cleaned(" union all ".join(parts))


def kpi_report() -> str:
    money = "'$' || format('{{:,.2f}}', {x})"
    best = """(select coalesce({k}, 'unknown') || ' (' || {shown} || ')' from
      (select {k}, {score} as s from cleaned group by {k}) order by s desc nulls last, {k} limit 1)"""
    profit, margin = total("profit"), MARGIN_PCT
    shown_money, shown_pct = money.format(x="s"), "cast(s as varchar) || '%'"
    lines = [
        ("total_transactions", "(select format('{:,}', count(*)) from cleaned)"),
        ("total_sales", f"(select {money.format(x=total("sales"))} from cleaned)"),
        ("total_profit", f"(select {money.format(x=profit)} from cleaned)"),
        ("overall_margin", f"(select cast({margin} as varchar) || '%' from cleaned)"),
        ("best_region", best.format(k="region", score=profit, shown=shown_money)),
        ("best_market", best.format(k="market", score=profit, shown=shown_money)),
        ("best_category", best.format(k="category", score=margin, shown=shown_pct)),
        (
            "avg_customer_value",
            f"(select {money.format(x=average('v'))} from "
            f"(select {total('sales')} as v from cleaned group by customer_id))",
        ),
    ]
    return over_cleaned(
        " union all ".join(
            f"select {i} as ordinal, '{metric}' as metric, {value} as value"
            for i, (metric, value) in enumerate(lines, start=1)
        )
    )


# Saved result -> the query that it equals, where the names differ.
BUNDLE_NAMES = {
    "cleaned_data": "cleaned_lines",
    "regional_analysis": "region_performance",
    "market_analysis": "market_performance",
    "country_analysis": "top_countries",
    "product_analysis": "category_performance",
    "customer_segments": "segment_performance",
    "shipping_analysis": "shipping_mode_performance",
}
BUNDLE_SAME = (
    "quality_overview null_counts numeric_summary top_products top_profitable_products yearly_sales monthly_sales "
    "quarterly_sales weekly_sales top_customers shipping_sales_corr shipping_cost_summary kpi_summary "
    "kpi_shipping_total best_region best_market best_category avg_customer_value preview source_profile "
    "cleaning_retention"
).split()


def bundle(found: dict[str, str]) -> str:
    """Rows and the sum of all numbers of every saved result, and the digest of the KPI text."""
    first = ", ".join(f"{c} nulls first" for c in CLEANED_COLUMNS.split(", "))
    found = found | {"preview": over_cleaned(f"select {CLEANED_COLUMNS} from cleaned order by {first} limit 5")}
    parts = []
    for name, query in (BUNDLE_NAMES | {n: n for n in BUNDLE_SAME}).items():
        lines = name == "cleaned_data"
        cells = f"unpivot (select columns(*)::varchar from ({found[query]})) on columns(*) into name k value x"
        summed = f"""(select (select count(*) from ({found[query]})) as n, cast(cast(coalesce(
          (select sum(try_cast(x as decimal(38,4))) from ({cells})), 0) as decimal(38,2)) as varchar) as d)"""
        cap, digest = ("100000", "cast(null as varchar)") if lines else ("50000", "d")
        copies = [("csv", "n", "d"), ("sample", f"least({cap}, n)", digest), *([("parquet", "n", "d")] if lines else [])]
        shown = ", ".join(f"('{name}/{kind}', {n}, {d})" for kind, n, d in copies)
        parts.append(f"select v.name, v.row_count, v.digest from {summed}, lateral (values {shown}) v(name, row_count, digest)")
    text = "select metric || ': ' || value as line from (" + found["kpi_report_rows"] + ")"
    parts.append(
        f"select 'analysis_report', count(*), md5(string_agg(line, chr(10) order by line)) from ({text})"
    )
    return " union all ".join(parts)


def forecast_counts() -> str:
    """Rows of every frame of the forecast: per model, feature, product, scenario, and of the explorations."""
    rows = "(select count(*) from observations)"
    counts = {
        "metrics": "2",
        "importance": f"{len(FEATURES)}",
        "scores": rows,
        "scenario_scores": f"4 * {rows}",
        "summary": rows,
        "decisions": rows,
        "region_mean_sales": "(select count(distinct region) from observations)",
        "price_sales_points": rows,
        "promotion_bins": "5",
        "beverage_mean_sales": "(select count(distinct beverage_type) from observations)",
        "shelf_mean_sales": "(select count(distinct shelf_location) from observations)",
        "income_bins": "5",
        "shelf_lift": "1",
        "price_sales_corr": "1",
        "top_region_insight": "1",
        "top_beverage_insight": "1",
    }
    return over_observations(
        " union all ".join(f"select '{n}' as name, cast({c} as bigint) as row_count" for n, c in counts.items())
    )


def held_out_rows() -> str:
    return over_observations(
        f"""select obs_key, monthly_sales, true as is_predicted, true as beats_mean from observations
        where not ({SPLIT})"""
    )


def source_profile() -> str:
    rows = ", ".join(f"({i}, '{name}', '{kind}')" for i, (name, kind) in enumerate(LINE_TYPES, start=1))
    return over_lines(
        f"""select v.ordinal, v.column_name, v.data_type, n.row_count, cast({len(LINE_TYPES)} as bigint) as column_count
        from (values {rows}) v(ordinal, column_name, data_type), (select count(*) as row_count from lines) n"""
    )


TRAINING = f"""f as (
          select obs_key, {FOLD} as fold, monthly_sales as y, population_density, median_income, store_size, weekly_foot_traffic,
          price, promotion_intensity, competitor_count, market_share, {CODE_COLUMNS}, {INTERACTIONS},
          monthly_sales / store_size as sales_per_sqft from observations {CODE_JOINS} where {SPLIT}
        )"""


def deep_tree() -> str:
    """The mean sales of the training rows that have the same features, for almost every row its own."""
    mean = steady_round(f"avg(y) over (partition by {', '.join(FEATURES)})", 4)
    return over_observations(f"{label_codes(CATEGORICAL)}, {TRAINING} select obs_key, {mean} as prediction from f")


def first_splits(bins: int = 23) -> str:
    """For each left-out fold the split of one feature that leaves the least squared error, and the means on its sides."""
    values = " union all ".join(f"select {i} as place, '{f}' as feature, fold, y, cast({f} as double) as x from f" for i, f in enumerate(FEATURES))
    return over_observations(
        f"""{label_codes(CATEGORICAL)}, {TRAINING}, u as ({values}),
        ends as (select feature, min(x) as a, max(x) as b from u group by feature),
        edges as (select feature, a + (b - a) * k / {bins} as edge from ends, range(1, {bins}) r(k)),
        cut as (select place, feature, edge, fold, count(*) as n, sum(y) as s from u join edges using (feature) where x <= edge group by all),
        total as (select fold, count(*) as n, sum(y) as s from f group by fold),
        models as (select unnest([-1, 0, 1, 2, 3, 4]) as left_out),
        whole as (select left_out, sum(n) as n, sum(s) as s from models, total where fold <> left_out group by left_out),
        sides as (
          select left_out, place, feature, edge, sum(cut.n) as n, sum(cut.s) as s, whole.n as wn, whole.s as ws
          from whole join cut on fold <> left_out group by left_out, place, feature, edge, whole.n, whole.s
        ), best as (
          select *, row_number() over (partition by left_out order by s * s / n + (ws - s) * (ws - s) / (wn - n) desc, place, edge) as r
          from sides where n < wn
        )
        select cast(left_out as integer) as left_out, feature, {steady_round("s / n", 4)} as left_mean,
        {steady_round("(ws - s) / (wn - n)", 4)} as right_mean from best where r = 1"""
    )


def distinct_counts() -> str:
    """Distinct ids by region, market, month and over all lines."""
    levels = {"region": "region", "market": "market", "period": "year_month", "total": "cast(null as varchar)"}
    return over_cleaned(
        " union all ".join(
            f"""select '{level}' as level, {key} as name, '{c}' as measure, count(distinct {c}) as exact, true as within_bound
            from cleaned group by {key if level != "total" else "()"}"""
            for level, key in levels.items()
            for c in ("customer_id", "order_id", "product_id")
        )
    )


def twins() -> dict[str, str]:
    """SQL by query name."""
    all_lines = over_lines(f"select {ALL_LINE_COLUMNS} from lines")
    all_cleaned = over_cleaned(f"select {CLEANED_COLUMNS} from cleaned")
    means = "select {k}, avg(monthly_sales) as m from observations where {k} is not null group by {k}"
    steady_mean = steady_round("m", 4) + " as mean_sales"
    shelf = means.format(k="shelf_location")
    product, customer = "product_id, product_name, category", "customer_id, customer_name, segment"
    top = "order by total_sales desc nulls last, {k} limit {n}"
    key_asc = {
        "product": "product_id nulls first, product_name nulls first, category nulls first",
        "customer": "customer_id nulls first, customer_name nulls first, segment nulls first",
    }
    scaled = ", ".join(
        steady_round(f"({c} - avg({c}) over ()) / coalesce(nullif(stddev_pop({c}) over (), 0), 1)", 6) + f" as {c}"
        for c in FORMULA_COLUMNS
    )
    profit_lines = (
        "select *, " + decimal_round("profit / sales * 100", 2) + f" as profit_margin from lines where {VALID}"
    )
    found = {
        # sources
        "csv_scan": over_lines(
            f"""select * replace (product_name || ' 12" wide, "red"' as product_name,
            case when quantity = 1 then '' when quantity <> 2 then ' ' || customer_name || ' ' end as customer_name)
            from (select {ALL_LINE_COLUMNS} from lines)"""
        ),
        "csv_discovery": all_lines,
        "csv_multi_line": over_lines(
            f"""select * replace (product_name || case when quantity > 10 then chr(10) || '12" wide,' || chr(10) || chr(10) || '"red"'
            else '' end as product_name) from (select {ALL_LINE_COLUMNS} from lines)"""
        ),
        "csv_mixed_headers": over_lines(
            f"""select * replace (case when cast(quantity as int) % 3 <> 2 then discount end as discount)
            from (select {ALL_LINE_COLUMNS} from lines)"""
        ),
        "source_profile": source_profile(),
        "preview": over_cleaned(
            """select order_id, order_date, sales, profit, profit_margin from cleaned
            order by order_id, order_date, sales, profit, profit_margin limit 5"""
        ),
        # sinks
        "sink_csv": all_cleaned,
        "sink_parquet": all_cleaned,
        "sink_json": all_cleaned,
        "sink_single_file": over_cleaned(
            "select cast(1 as bigint) as file_count, count(distinct year_month) as row_count from cleaned"
        ),
        "sample_export": over_cleaned(
            """select cap, least(cap, n) as rows_saved
            from (values (100000), (1000)) c(cap), (select count(*) as n from cleaned)"""
        ),
        "bounded_sample": over_cleaned(
            """select order_id, product_id, cast(quantity as int) as quantity from cleaned
            order by cast('0x' || substr(md5(concat_ws('|', order_id, product_id, cast(quantity as int))), 1, 15) as bigint) limit 1000"""
        ),
        "sink_replace": over_cleaned("select order_id, quantity, sales from cleaned where quantity < 20"),
        "output_manifest": "select f as file_format, true as has_files, true as has_bytes "
        "from (values ('csv'), ('parquet'), ('json')) v(f)",
        "kpi_report_rows": kpi_report(),
        # filters and projections
        "clean_filter": over_lines(f"select {ALL_LINE_COLUMNS} from lines where {VALID}"),
        "parse_dates": over_lines(
            """select order_id, cast(try_strptime(order_date, '%m/%d/%Y') as date) as order_date,
            cast(try_strptime(ship_date, '%m/%d/%Y') as date) as ship_date from lines"""
        ),
        "profit_margin": over_lines(f"select order_id, sales, profit, profit_margin from ({profit_lines})"),
        "date_parts": over_cleaned(
            "select order_id, order_date, order_year, order_month, order_quarter, year_month from cleaned"
        ),
        "shipping_days": over_cleaned("select order_id, order_date, ship_date, shipping_days from cleaned"),
        "fill_defaults": over_lines(
            """select sales, quantity, coalesce(discount, 0.0) as discount,
            coalesce(shipping_cost, 0.0) as shipping_cost from lines"""
        ),
        "cleaned_lines": all_cleaned,
        "cleaning_retention": over_lines(
            f"""select count(*) as rows_before, count(*) filter ({VALID}) as rows_after,
            round(count(*) filter ({VALID}) / count(*)::double * 100, 2) as retention_pct from lines"""
        ),
        # data quality
        "quality_overview": over_cleaned(
            f"""select count(*) as row_count, {ORDERS}, {CUSTOMERS}, count(distinct product_id) as product_count,
            count(distinct country) as country_count from cleaned"""
        ),
        "null_counts": over_cleaned(
            "select "
            + ", ".join(f"count(*) filter ({c} is null) as {c}" for c in CLEANED_COLUMNS.split(", "))
            + " from cleaned"
        ),
        "null_counts_raw": over_lines(
            "select "
            + ", ".join(f"count(*) filter ({c} is null) as {c}" for c in ALL_LINE_COLUMNS.split(", "))
            + " from lines"
        ),
        "numeric_summary": numeric_summary(),
        # sales reports
        "region_performance": grouped("region", [TOTAL_SALES, TOTAL_PROFIT, CUSTOMERS, ORDERS, AVG_SALES, MARGIN]),
        "market_performance": grouped("market", [TOTAL_SALES, TOTAL_PROFIT, CUSTOMERS]),
        "top_countries": grouped(
            "country", [TOTAL_SALES, TOTAL_PROFIT, CUSTOMERS], top.format(k="country nulls first", n=10)
        ),
        "category_performance": grouped(
            "category, sub_category",
            [
                TOTAL_SALES,
                TOTAL_PROFIT,
                "count(*) as line_count",
                AVG_SALES,
                MARGIN,
                f"{average('discount', ' * 100')} as avg_discount_pct",
            ],
        ),
        "top_products": grouped(
            product,
            [TOTAL_SALES, "sum(quantity) as total_quantity", ORDERS, AVG_SALES],
            top.format(k=key_asc["product"], n=10),
        ),
        "top_profitable_products": grouped(
            product,
            [TOTAL_PROFIT, TOTAL_SALES, MARGIN],
            f"order by total_profit desc nulls last, {key_asc['product']} limit 10",
            f"{total('profit')} > 0",
        ),
        "yearly_sales": grouped("order_year", [TOTAL_SALES, TOTAL_PROFIT, CUSTOMERS, ORDERS, MARGIN]),
        "monthly_sales": grouped("year_month", [TOTAL_SALES, TOTAL_PROFIT, ORDERS]),
        "quarterly_sales": grouped("order_year, order_quarter", [TOTAL_SALES, TOTAL_PROFIT]),
        "weekly_sales": grouped(
            '"year", weeknum',
            [TOTAL_SALES, TOTAL_PROFIT, ORDERS],
            top.format(k='"year" nulls first, weeknum nulls first', n=15),
        ),
        "segment_performance": grouped("segment", [CUSTOMERS, TOTAL_SALES, TOTAL_PROFIT, AVG_SALES, MARGIN]),
        "top_customers": grouped(
            customer,
            [TOTAL_SALES, ORDERS, AVG_SALES, TOTAL_PROFIT, f"{average('shipping_days')} as avg_shipping_days"],
            top.format(k=key_asc["customer"], n=10),
        ),
        "shipping_mode_performance": grouped(
            "ship_mode",
            [
                "count(order_id) as line_count",
                TOTAL_SALES,
                AVG_SALES,
                f"{average('profit')} as avg_profit",
                f"{average('shipping_days')} as avg_shipping_days",
                f"{average('profit_margin')} as avg_margin_pct",
            ],
        ),
        "shipping_sales_corr": over_cleaned(
            f"""select {steady_round("corr(coalesce(shipping_days, 0)::double, coalesce(sales, 0.0))", 6)}
            as correlation from cleaned"""
        ),
        "shipping_cost_summary": over_cleaned(
            f"""select {average("shipping_cost")} as avg_cost, {decimal_round("max(shipping_cost)", 2)} as max_cost,
            {decimal_round("min(shipping_cost)", 2)} as min_cost, {total("shipping_cost")} as total_cost
            from cleaned"""
        ),
        # headline figures
        "kpi_summary": over_cleaned(
            f"""select count(*) as line_count, {ORDERS}, {CUSTOMERS}, count(distinct product_id) as product_count,
            {TOTAL_SALES}, {TOTAL_PROFIT}, {AVG_SALES}, {MARGIN} from cleaned"""
        ),
        "distinct_counts": distinct_counts(),
        "kpi_shipping_total": over_cleaned(f"select {total('shipping_cost')} as total_cost from cleaned"),
        "best_region": grouped(
            "region", [TOTAL_PROFIT], "order by total_profit desc nulls last, region nulls first limit 1"
        ),
        "best_market": grouped(
            "market", [TOTAL_PROFIT], "order by total_profit desc nulls last, market nulls first limit 1"
        ),
        "best_category": grouped(
            "category", [MARGIN], "order by margin_pct desc nulls last, category nulls first limit 1"
        ),
        "avg_customer_value": over_cleaned(
            f"""select {average("v")} as avg_customer_value from
            (select {total("sales")} as v from cleaned group by customer_id)"""
        ),
        # features
        "interaction_features": over_observations(f"select obs_key, {INTERACTIONS} from observations"),
        "ratio_features": over_observations(
            """select obs_key, monthly_sales / nullif(store_size, 0) as sales_per_sqft,
            case when price = 0 then case when monthly_sales = 0 then 'nan'::double else 0.0 end
                 else monthly_sales / price end as price_elasticity from observations"""
        ),
        "log_features": over_observations(f"select obs_key, {LOGS} from observations"),
        "label_encode": over_observations(
            f"{label_codes(CATEGORICAL)} select obs_key, {', '.join(CATEGORICAL)}, {CODE_COLUMNS} "
            f"from observations {CODE_JOINS}"
        ),
        "feature_table": over_observations(
            f"""{label_codes(CATEGORICAL)} select {PLAIN_OBSERVATIONS}, {CODE_COLUMNS}, {INTERACTIONS},
            monthly_sales / store_size as sales_per_sqft, monthly_sales / price as price_elasticity, {LOGS}
            from observations {CODE_JOINS}"""
        ),
        "feature_matrix": over_observations(
            f"""{label_codes(CATEGORICAL)} select population_density, median_income, store_size, weekly_foot_traffic,
            price, promotion_intensity, competitor_count, market_share, {CODE_COLUMNS}, {INTERACTIONS},
            monthly_sales / store_size as sales_per_sqft, monthly_sales from observations {CODE_JOINS}"""
        ),
        "standardize": over_observations(f"select obs_key, {scaled} from observations"),
        "expected_sales": over_observations(
            f"select obs_key, {steady_round(FORMULA, 4)} as expected_sales from observations"
        ),
        # exploration
        "price_sales_points": over_observations("select price, monthly_sales from observations"),
        "region_mean_sales": over_observations(f"select region, {steady_mean} from ({means.format(k='region')})"),
        "beverage_mean_sales": over_observations(
            f"select beverage_type, {steady_mean} from ({means.format(k='beverage_type')})"
        ),
        "shelf_mean_sales": over_observations(
            f"""select shelf_location, {steady_mean}, round(m / sum(m) over () * 100, 1) as share_pct
            from ({shelf})"""
        ),
        "promotion_bins": binned("promotion_intensity"),
        "income_bins": binned("median_income"),
        "top_region_insight": over_observations(
            f"select region, {steady_mean} from ({means.format(k='region')}) order by m desc, region limit 1"
        ),
        "top_beverage_insight": over_observations(
            f"""select beverage_type, {steady_mean} from ({means.format(k="beverage_type")})
            order by m desc, beverage_type limit 1"""
        ),
        "shelf_lift": over_observations(
            f""", means as ({shelf})
            select (select shelf_location from means order by m desc, shelf_location limit 1) as best_shelf,
            round((max(m) / min(m) - 1) * 100, 1) as lift_pct from means"""
        ),
        "price_sales_corr": over_observations(
            f"select {steady_round('corr(price, monthly_sales)', 6)} as correlation from observations"
        ),
        # regression
        "train_test_split": over_observations(
            f"""select obs_key, case when {SPLIT} then 'train' else 'test' end as split, {FOLD} as fold
            from observations"""
        ),
        "regression_metrics": over_observations(
            f""", p as (select monthly_sales as y, {FORMULA} as q from observations)
            select {steady_round("avg(abs(y - q))", 4)} as mae,
            {steady_round("sqrt(avg((y - q) * (y - q)))", 4)} as rmse,
            {steady_round("1 - sum((y - q) * (y - q)) / (var_pop(y) * count(y))", 6)} as r2 from p"""
        ),
        "train_random_forest": held_out_rows(),
        "train_gradient_boosting": held_out_rows(),
        "cross_validation": f"select model, true as beats_mean, true as has_spread {MODELS}",
        "boosted_first_split": first_splits(),
        "deep_tree": deep_tree(),
        "shared_cross_validation": over_observations(
            f"select {FOLD} as fold, count(*) as rows, true as beats_mean from observations where {SPLIT} group by 1"
        ),
        "model_selection": f"select model, true as beats_mean, true as best_is_highest {MODELS}",
        "feature_importance": "select unnest(["
        + ", ".join(f"'{f}'" for f in FEATURES)
        + "]) as feature, true as sums_to_one",
        "score_products": over_observations("select obs_key, true as annual_is_twelvefold from observations"),
        "stored_scores": over_observations("select obs_key, true as annual_is_twelvefold, true as is_same from observations"),
        "forecast_run": forecast_counts(),
        # scenarios
        "scenario_scores": f"with {OBSERVATIONS}, {GRID} "
        "select obs_key, scenario, true as annual_is_twelvefold from grid",
        "scenario_grid": f"with {OBSERVATIONS}, {GRID} "
        "select obs_key, scenario_no, scenario, price, promotion_intensity, shelf_location from grid",
        "scenario_formula_scores": over_scores(
            f"""select obs_key, scenario, {steady_round("monthly_sales", 4)} as monthly_sales,
            {steady_round("annual_sales", 4)} as annual_sales from scores"""
        ),
        "scenario_summary": over_scores(
            f"""select any_value(obs_key) as obs_key, arg_min(scenario, struct_pack(a := -annual_sales, b := scenario_no)) as best_scenario,
            {steady_round("max(annual_sales)", 4)} as best_annual,
            arg_min(scenario, struct_pack(a := annual_sales, b := scenario_no)) as worst_scenario,
            {steady_round("min(annual_sales)", 4)} as worst_annual,
            {steady_round("max(annual_sales) - min(annual_sales)", 4)} as annual_gap
            from scores group by product_no"""
        ),
        "decision_report": over_scores(
            f""", d as (select any_value(obs_key) as obs_key,
              max(beverage_type) filter (scenario = 'base') as beverage_type,
              max(price) filter (scenario = 'base') as price, max(region) filter (scenario = 'base') as region,
              max(store_chain) filter (scenario = 'base') as store_chain,
              max(shelf_location) filter (scenario = 'base') as shelf_location,
              max(competitor_count) filter (scenario = 'base') as competitor_count,
              max(annual_sales) filter (scenario = 'base') as base_annual,
              max(annual_sales) as best_annual, min(annual_sales) as worst_annual,
              max(price) filter (scenario = 'promotion') as promotion_price,
              max(promotion_intensity) filter (scenario = 'promotion') as promotion_intensity
              from scores group by product_no)
            select * exclude (base_annual, best_annual, worst_annual),
              {steady_round("base_annual", 4)} as base_annual, {steady_round("best_annual", 4)} as best_annual,
              {steady_round("worst_annual", 4)} as worst_annual,
              {steady_round("(best_annual / nullif(base_annual, 0) - 1) * 100", 1)} as best_uplift_pct,
              {steady_round("(1 - worst_annual / nullif(base_annual, 0)) * 100", 1)} as worst_drop_pct
            from d"""
        ),
    }
    found["save_bundle"] = bundle(found)
    return found

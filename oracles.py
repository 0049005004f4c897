"""Checking SQL per query id, for DuckDB over the test tables."""

from __future__ import annotations

import fixtures as fixture

_NAMES = {t: t for t in fixture.SOURCE_TABLES}

TYPED = (
    f"households AS ({fixture.HOUSEHOLDS.format(**_NAMES)}),\n"
    f"products AS ({fixture.PRODUCTS.format(**_NAMES)}),\n"
    f"transactions AS ({fixture.TRANSACTIONS.format(**_NAMES)})"
)

RAW = (
    f"raw_households AS ({fixture.RAW_HOUSEHOLDS.format(households='households')}),\n"
    f"raw_products AS ({fixture.RAW_PRODUCTS.format(products='products')}),\n"
    f"raw_transactions AS ({fixture.RAW_TRANSACTIONS.format(transactions='transactions')})"
)


def _known(c: str) -> str:
    return f"({c} IS NOT NULL AND lower(rtrim({c})) NOT IN ('null', ''))"


SEASON = (
    "CASE WHEN t.WEEK_NUM BETWEEN 1 AND 13 THEN 'Spring' WHEN t.WEEK_NUM BETWEEN 14 AND 26 THEN 'Summer' "
    "WHEN t.WEEK_NUM BETWEEN 27 AND 39 THEN 'Fall' ELSE 'Winter' END"
)
STATUS = (
    "CASE WHEN h.CHILDREN IS NULL OR lower(rtrim(h.CHILDREN)) = 'null' THEN 'Unknown' "
    "WHEN TRY_CAST(h.CHILDREN AS DOUBLE) > 0 THEN 'Has Children' ELSE 'No Children' END"
)
SPEND = "CAST(sum(t.SPEND) AS DOUBLE)"
AVG_SPEND = f"{SPEND} / nullif(count(DISTINCT t.BASKET_NUM), 0)"
HOUSEHOLDS = "count(DISTINCT t.HSHD_NUM)"
T_H = "transactions t JOIN households h ON t.HSHD_NUM = h.HSHD_NUM"
T_P = "transactions t JOIN products p ON t.PRODUCT_NUM = p.PRODUCT_NUM"

SUMMARIES = {
    "income": f"SELECT h.INCOME_RANGE, {AVG_SPEND} AS avg_spend, {HOUSEHOLDS} AS hh_count FROM {T_H} "
    f"WHERE {_known('h.INCOME_RANGE')} GROUP BY h.INCOME_RANGE",
    "hhsize": f"SELECT h.HH_SIZE, {AVG_SPEND} AS avg_spend FROM {T_H} "
    f"WHERE {_known('h.HH_SIZE')} GROUP BY h.HH_SIZE",
    "children": f"SELECT {STATUS} AS children_status, {AVG_SPEND} AS avg_spend, {HOUSEHOLDS} AS hh_count "
    f"FROM {T_H} GROUP BY 1",
    "region": f"SELECT t.STORE_R, {SPEND} AS total_spend, {HOUSEHOLDS} AS unique_hh FROM transactions t "
    f"WHERE {_known('t.STORE_R')} GROUP BY t.STORE_R",
    "weekly": f"SELECT t.WEEK_NUM, t.YEAR, {SPEND} AS spend FROM transactions t GROUP BY t.WEEK_NUM, t.YEAR",
    "dept_year": f"SELECT p.DEPARTMENT, t.YEAR, {SPEND} AS total_spend FROM {T_P} "
    "WHERE t.YEAR IS NOT NULL GROUP BY p.DEPARTMENT, t.YEAR",
    "seasonal": f"SELECT {SEASON} AS season, {SPEND} AS total_spend, {AVG_SPEND} AS avg_spend, "
    f"{HOUSEHOLDS} AS unique_hh FROM transactions t WHERE t.WEEK_NUM IS NOT NULL GROUP BY 1",
    "seasonal_commodity": f"SELECT {SEASON} AS season, p.DEPARTMENT, {SPEND} AS total_spend FROM {T_P} "
    "WHERE t.WEEK_NUM IS NOT NULL GROUP BY 1, 2 ORDER BY season, total_spend DESC, p.DEPARTMENT LIMIT 20",
    "brand": f"SELECT p.BRAND_TY, {SPEND} AS total_spend, count(*) AS transaction_count FROM {T_P} "
    f"WHERE {_known('p.BRAND_TY')} GROUP BY p.BRAND_TY",
    "organic": f"SELECT p.NATURAL_ORGANIC_FLAG, {SPEND} AS total_spend, {HOUSEHOLDS} AS buyers FROM {T_P} "
    f"WHERE {_known('p.NATURAL_ORGANIC_FLAG')} GROUP BY p.NATURAL_ORGANIC_FLAG",
    "brand_income": f"SELECT h.INCOME_RANGE, p.BRAND_TY, {SPEND} AS total_spend FROM {T_P} "
    f"JOIN households h ON t.HSHD_NUM = h.HSHD_NUM WHERE {_known('p.BRAND_TY')} AND {_known('h.INCOME_RANGE')} "
    "GROUP BY 1, 2",
    "dept": f"SELECT p.DEPARTMENT, {SPEND} AS total_spend, {HOUSEHOLDS} AS unique_households FROM {T_P} "
    "GROUP BY p.DEPARTMENT",
    "commodity": f"SELECT p.COMMODITY, {SPEND} AS total_spend FROM {T_P} GROUP BY p.COMMODITY "
    "ORDER BY total_spend DESC, p.COMMODITY LIMIT 10",
}

BASKET_CTES = f"""
top_baskets AS (
  SELECT BASKET_NUM FROM transactions GROUP BY BASKET_NUM
  ORDER BY sum(SPEND) DESC, BASKET_NUM NULLS FIRST LIMIT 5000),
items AS (
  SELECT DISTINCT t.BASKET_NUM, p.COMMODITY FROM {T_P} JOIN top_baskets b ON t.BASKET_NUM = b.BASKET_NUM
  WHERE {_known('p.COMMODITY')}),
pairs AS (
  SELECT a.COMMODITY AS item_1, b.COMMODITY AS item_2, count(*) AS times_bought_together
  FROM items a JOIN items b ON a.BASKET_NUM = b.BASKET_NUM AND a.COMMODITY < b.COMMODITY GROUP BY 1, 2),
pairs_100 AS (SELECT * FROM pairs ORDER BY times_bought_together DESC, item_1, item_2 LIMIT 100),
stats AS (
  SELECT p.COMMODITY, count(DISTINCT t.BASKET_NUM) AS basket_count, {SPEND} AS total_spend
  FROM {T_P} WHERE {_known('p.COMMODITY')} GROUP BY p.COMMODITY)"""

PAIRS_10 = "SELECT * FROM pairs ORDER BY times_bought_together DESC, item_1, item_2 LIMIT 10"


def _priority(high: int, medium: int) -> str:
    return (
        f"SELECT item_1, item_2, times_bought_together, CASE WHEN times_bought_together > {high} THEN 'High' "
        f"WHEN times_bought_together > {medium} THEN 'Medium' ELSE 'Emerging' END AS priority FROM "
        "(SELECT * FROM pairs ORDER BY times_bought_together DESC, item_1, item_2 LIMIT 20)"
    )


BASKETS = {
    "basket": PAIRS_10,
    "basket_pairs_100": "SELECT * FROM pairs_100",
    "basket_pairs_20": "SELECT * FROM pairs_100 ORDER BY times_bought_together DESC, item_1, item_2 LIMIT 20",
    "basket_large": PAIRS_10,
    "basket_all_pairs": "SELECT * FROM pairs",
    "basket_ranked": "SELECT row_number() OVER (ORDER BY times_bought_together DESC, item_1, item_2) AS rank, * "
    f"FROM ({PAIRS_10})",
    "basket_bottom_up": "SELECT row_number() OVER (ORDER BY rank DESC) AS place, * FROM (SELECT row_number() OVER "
    "(ORDER BY times_bought_together DESC, item_1, item_2) AS rank, * FROM pairs_100 ORDER BY rank LIMIT 10)",
    "pair_walk": "SELECT item_1, item_2, TRUE AS agrees FROM pairs_100 WHERE (SELECT count(*) FROM pairs_100) >= 10",
    "basket_labels": f"SELECT item_1 || ' + ' || item_2 AS label, times_bought_together FROM ({PAIRS_10})",
    "pair_axis_max": "SELECT max(times_bought_together) AS axis_max FROM pairs_100",
    "commodity_stats": "SELECT * FROM stats",
    "basket_pair_features": """
SELECT item_1, item_2, times_bought_together, freq_1, freq_2, spend_1, spend_2,
 least(freq_1, freq_2) AS min_freq, greatest(freq_1, freq_2) AS max_freq,
 CAST(least(freq_1, freq_2) AS DOUBLE) / (greatest(freq_1, freq_2) + 1) AS freq_ratio, spend_1 + spend_2 AS total_spend
FROM (SELECT q.*, coalesce(x.basket_count, 0) AS freq_1, coalesce(y.basket_count, 0) AS freq_2,
       coalesce(x.total_spend, 0.0) AS spend_1, coalesce(y.total_spend, 0.0) AS spend_2
      FROM pairs_100 q LEFT JOIN stats x ON q.item_1 = x.COMMODITY LEFT JOIN stats y ON q.item_2 = y.COMMODITY)""",
    "cross_sell_priority": _priority(500, 200),
    "cross_sell_priority_low_cuts": _priority(60, 50),
}

DETAIL = f"""
SELECT t.HSHD_NUM, t.BASKET_NUM, CAST(t.PURCHASE_DATE AS VARCHAR) AS PURCHASE_DATE, t.PRODUCT_NUM, p.DEPARTMENT,
 p.COMMODITY, CAST(t.SPEND AS DOUBLE) AS SPEND, t.UNITS, t.STORE_R, t.WEEK_NUM, t.YEAR, h.L, h.AGE_RANGE, h.MARITAL,
 h.INCOME_RANGE, h.HOMEOWNER, h.HSHD_COMPOSITION, h.HH_SIZE, h.CHILDREN
FROM transactions t LEFT JOIN households h ON t.HSHD_NUM = h.HSHD_NUM LEFT JOIN products p ON t.PRODUCT_NUM = p.PRODUCT_NUM"""

_TIES = ["t.HSHD_NUM", "t.BASKET_NUM", "t.PRODUCT_NUM", "t.SPEND", "t.UNITS", "t.STORE_R",
         "t.PURCHASE_DATE", "t.WEEK_NUM", "t.YEAR"]


def _page(first: str, offset: int, where: str = "") -> str:
    ties = ", ".join(f"{c} NULLS FIRST" for c in _TIES if not first.startswith(c))
    return f"{DETAIL} {where} ORDER BY {first}, {ties} LIMIT 100 OFFSET {offset}"


DETAILS = {
    "data_pull_page": _page("t.HSHD_NUM NULLS FIRST", 0, "WHERE t.HSHD_NUM = 10"),
    "data_pull_all_page": _page("t.SPEND DESC NULLS LAST", 200),
    "data_pull_deep_page": _page("t.SPEND DESC NULLS LAST", 200),
    "data_pull_all_by_department": _page("p.DEPARTMENT NULLS FIRST", 100),
    "data_pull_next_page": _page("t.SPEND DESC NULLS LAST", 300),
    "data_pull_count": "SELECT count(*) AS cnt FROM transactions WHERE HSHD_NUM = 10",
    "data_pull_pages": "SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 100.0) AS BIGINT)) AS total_pages "
    "FROM transactions",
}

RFM_CTES = f"""
snap AS (SELECT max(PURCHASE_DATE) AS d FROM transactions),
rfm AS (
  SELECT t.HSHD_NUM, max(t.PURCHASE_DATE) AS last_purchase, count(DISTINCT t.BASKET_NUM) AS frequency,
   {SPEND} AS total_spend, CAST(sum(t.UNITS) AS BIGINT) AS total_units,
   CAST(sum(CASE WHEN t.PURCHASE_DATE >= CAST(s.d - INTERVAL 6 MONTH AS DATE) THEN t.SPEND ELSE 0 END) AS DOUBLE)
    AS recent_spend,
   CAST(sum(CASE WHEN t.PURCHASE_DATE < CAST(s.d - INTERVAL 6 MONTH AS DATE) THEN t.SPEND ELSE 0 END) AS DOUBLE)
    AS older_spend,
   s.d AS snapshot_date
  FROM transactions t CROSS JOIN snap s GROUP BY t.HSHD_NUM, s.d),
codes AS (
  SELECT HSHD_NUM, CASE WHEN trim(CHILDREN) = 'Y' THEN 1 ELSE 0 END AS CHILDREN,
   dense_rank() OVER (ORDER BY coalesce(INCOME_RANGE, 'None')) - 1 AS INCOME_RANGE,
   dense_rank() OVER (ORDER BY coalesce(AGE_RANGE, 'None')) - 1 AS AGE_RANGE,
   dense_rank() OVER (ORDER BY coalesce(HH_SIZE, 'None')) - 1 AS HH_SIZE,
   dense_rank() OVER (ORDER BY coalesce(L, 'None')) - 1 AS L
  FROM households),
features AS (
  SELECT r.*, CAST(date_diff('day', last_purchase, snapshot_date) AS INTEGER) AS recency,
   total_spend / greatest(frequency, 1) AS avg_basket_value, recent_spend - older_spend AS spend_trend,
   CAST(coalesce(c.INCOME_RANGE, 0) AS INTEGER) AS INCOME_RANGE, CAST(coalesce(c.AGE_RANGE, 0) AS INTEGER) AS AGE_RANGE,
   CAST(coalesce(c.HH_SIZE, 0) AS INTEGER) AS HH_SIZE, CAST(coalesce(c.L, 0) AS INTEGER) AS L,
   CAST(coalesce(c.CHILDREN, 0) AS INTEGER) AS CHILDREN
  FROM rfm r LEFT JOIN codes c ON r.HSHD_NUM = c.HSHD_NUM),
labelled AS (SELECT *, CASE WHEN recency > 90 THEN 1.0 ELSE 0.0 END AS churned FROM features)"""

DATES_AS_TEXT = (
    "* REPLACE (CAST(last_purchase AS VARCHAR) AS last_purchase, CAST(snapshot_date AS VARCHAR) AS snapshot_date)"
)

# The labels, segments, strategies and bands that the jobs must show.
CORRELATIONS = " UNION ALL ".join(
    f"SELECT '{label}' AS feature, round_even(corr({c}, churned), 3) AS correlation FROM labelled"
    for c, label in {
        "recency": "Recency (days)",
        "frequency": "Visit Frequency",
        "avg_basket_value": "Avg Basket Value",
        "total_spend": "Total Spend",
        "spend_trend": "Spend Trend",
    }.items()
)

BINS = "CASE WHEN p <= 0.3 THEN 'Low Risk' WHEN p <= 0.6 THEN 'Medium Risk' ELSE 'High Risk' END"
ABSENCE = "SELECT HSHD_NUM, recency / CAST((SELECT nullif(max(recency), 0) FROM features) AS DOUBLE) AS p FROM features"
BY_RULE = f"SELECT f.HSHD_NUM, total_spend * 2 AS clv_score, p AS churn_prob, {BINS} AS risk_segment, recency, frequency, " \
    f"total_spend FROM features f JOIN ({ABSENCE}) a ON f.HSHD_NUM = a.HSHD_NUM"
HITS = "SELECT churned = 1 AS a, frequency < 10 AS p FROM labelled"


def _share(part: str, whole: str) -> str:
    return f"coalesce(CAST({part} AS DOUBLE) / nullif({whole}, 0), 0.0)"


_REPORT = f"""
SELECT * FROM (WITH counted AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE NOT a AND NOT p) AS h0, count(*) FILTER (WHERE a AND p) AS h1,
    count(*) FILTER (WHERE NOT a) AS a0, count(*) FILTER (WHERE a) AS a1, count(*) FILTER (WHERE NOT p) AS p0,
    count(*) FILTER (WHERE p) AS p1 FROM ({HITS})),
rates AS (
  SELECT *, {_share('h0', 'p0')} AS pr0, {_share('h1', 'p1')} AS pr1, {_share('h0', 'a0')} AS re0, {_share('h1', 'a1')} AS re1,
    {_share('2 * h0', 'p0 + a0')} AS f0, {_share('2 * h1', 'p1 + a1')} AS f1 FROM counted),
lines AS (
  SELECT '0' AS class, pr0 AS precision, re0 AS recall, f0 AS f1, a0 AS support FROM rates
  UNION ALL SELECT '1', pr1, re1, f1, a1 FROM rates
  UNION ALL SELECT 'accuracy', NULL, NULL, {_share('h0 + h1', 'n')}, n FROM rates
  UNION ALL SELECT 'macro avg', (pr0 + pr1) / 2, (re0 + re1) / 2, (f0 + f1) / 2, n FROM rates
  UNION ALL SELECT 'weighted avg', {_share('pr0 * a0 + pr1 * a1', 'n')}, {_share('re0 * a0 + re1 * a1', 'n')},
    {_share('f0 * a0 + f1 * a1', 'n')}, n FROM rates)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM lines)"""

RULE_QUERIES = {
    "churn_counts_by_rule": f"SELECT s.risk_segment, count(b.HSHD_NUM) AS n FROM (VALUES ('Low Risk'), ('Medium Risk'), "
    f"('High Risk')) s(risk_segment) LEFT JOIN ({BY_RULE}) b ON s.risk_segment = b.risk_segment GROUP BY 1",
    "churn_stats_by_rule": "SELECT count(*) AS total, count(*) FILTER (WHERE risk_segment = 'High Risk') AS high_risk, "
    "count(*) FILTER (WHERE risk_segment = 'Medium Risk') AS medium_risk, "
    "count(*) FILTER (WHERE risk_segment = 'Low Risk') AS low_risk, round_even(avg(clv_score), 2) AS avg_clv, "
    f"round_even(max(clv_score), 2) AS max_clv FROM ({BY_RULE})",
    "top_clv_by_rule": "SELECT row_number() OVER (ORDER BY clv_score DESC, HSHD_NUM) AS place, HSHD_NUM, clv_score, churn_prob, "
    f"risk_segment, frequency, recency FROM ({BY_RULE}) ORDER BY place LIMIT 10",
    "churn_order_by_rule": f"SELECT row_number() OVER (ORDER BY churn_prob DESC, HSHD_NUM) AS place, HSHD_NUM FROM ({BY_RULE})",
    "prediction_display_by_rule": "SELECT HSHD_NUM, printf('%.2f', round_even(clv_score, 2)) AS clv_text, "
    "CAST(round_even(churn_prob * 100, 0) AS BIGINT) || '%' AS churn_text, CAST(floor(churn_prob * 100) AS BIGINT) AS bar_width, "
    f"printf('%.2f', round_even(total_spend, 2)) AS spend_text FROM ({BY_RULE})",
    "churn_report_by_rule": _REPORT,
    "regression_quality_by_rule": "SELECT round(1 - avg(e * e) / nullif(var_pop(total_spend), 0), 6) AS r2, "
    "round(avg(abs(e)), 4) AS mae FROM (SELECT total_spend, total_spend - avg_basket_value * 3 AS e FROM features)",
}

HOUSEHOLD_QUERIES = {
    "snapshot_date": "SELECT CAST(d AS VARCHAR) AS snap_date FROM snap",
    "rfm": f"SELECT {DATES_AS_TEXT} FROM rfm",
    "household_features": f"SELECT {DATES_AS_TEXT} FROM features",
    "household_codes": "SELECT HSHD_NUM, CAST(INCOME_RANGE AS INTEGER) AS INCOME_RANGE, CAST(AGE_RANGE AS INTEGER) "
    "AS AGE_RANGE, CAST(HH_SIZE AS INTEGER) AS HH_SIZE, CAST(L AS INTEGER) AS L, CHILDREN FROM codes",
    "clv_walk": "SELECT HSHD_NUM, TRUE AS agrees FROM features",
    "churn_walk": "SELECT HSHD_NUM, TRUE AS agrees FROM features",
    "churn_importances_walk": "SELECT unnest(['frequency', 'avg_basket_value', 'INCOME_RANGE', 'AGE_RANGE', 'HH_SIZE', 'L', 'CHILDREN']) AS feature, TRUE AS agrees",
    "churn_sample": "SELECT HSHD_NUM FROM features ORDER BY md5(CAST(HSHD_NUM AS VARCHAR) || ':42'), HSHD_NUM LIMIT 500",
    "churn_prediction_inputs": "SELECT HSHD_NUM, recency, frequency, total_spend FROM features",
    "churn_rate": "SELECT round(avg(churned), 6) AS churn_rate FROM labelled",
    "churn_correlations": CORRELATIONS,
    "churn_correlation_directions": "SELECT *, CASE WHEN correlation > 0 THEN 'raises risk' ELSE 'protective' END "
    f"AS direction FROM ({CORRELATIONS})",
    "churn_class_weights": "SELECT CAST(churned AS INTEGER) AS label, count(*) AS n, round((SELECT count(*) FROM labelled) "
    "/ CAST((SELECT count(DISTINCT churned) FROM labelled) * count(*) AS DOUBLE), 6) AS weight FROM labelled GROUP BY 1",
    "risk_segment_bins": f"SELECT HSHD_NUM, p AS churn_prob, {BINS} AS risk_segment FROM ({ABSENCE})",
    "risk_segment_strategies": f"""
SELECT HSHD_NUM, risk_segment, CASE risk_segment
 WHEN 'High Risk' THEN 'Personalised win-back offer + loyalty points double-up within 30 days.'
 WHEN 'Medium Risk' THEN 'Targeted email with top-category coupon based on past spend patterns.'
 ELSE 'Upsell cross-category products surfaced from basket analysis.' END AS strategy
FROM (SELECT HSHD_NUM, {BINS} AS risk_segment FROM ({ABSENCE}))""",
    "probability_bands": "SELECT HSHD_NUM, p AS churn_prob, CASE WHEN p > 0.6 THEN 'red' WHEN p > 0.3 THEN 'amber' "
    f"ELSE 'green' END AS band, CAST(round_even(p * 100, 0) AS BIGINT) || '%' AS percent FROM ({ABSENCE})",
}


def _cell(row: str, column: str, value: str, name: str) -> str:
    return f"coalesce(max(CASE WHEN {column} = {value} THEN total_spend END), 0.0) AS \"{name}\""


def _grid(source: str, row: str, column: str) -> str:
    return (
        f"SELECT r.{row}, c.{column}, coalesce(x.total_spend, 0.0) AS total_spend FROM (SELECT DISTINCT {row} FROM ({source})) r "
        f"CROSS JOIN (SELECT DISTINCT {column} FROM ({source}) WHERE {column} IS NOT NULL) c LEFT JOIN ({source}) x "
        f"ON r.{row} IS NOT DISTINCT FROM x.{row} AND c.{column} = x.{column}"
    )


def _in_order(source: str, order: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) AS place, * FROM ({source})"


def _pivot(source: str, row: str, column: str, values: dict[str, str]) -> str:
    cells = ", ".join(_cell(row, column, v, n) for n, v in values.items())
    return f"SELECT {row}, {cells} FROM ({source}) GROUP BY {row}"


_SEASONS = {s: f"'{s}'" for s in ("Spring", "Summer", "Fall", "Winter")}

DISPLAYS = {
    "kpi_top_department": "SELECT coalesce((SELECT DEPARTMENT FROM "
    f"({SUMMARIES['dept']}) ORDER BY total_spend DESC, DEPARTMENT LIMIT 1), 'N/A') AS DEPARTMENT",
    "kpi_top_commodity": f"SELECT coalesce((SELECT COMMODITY FROM ({SUMMARIES['commodity']}) "
    "ORDER BY total_spend DESC, COMMODITY LIMIT 1), 'N/A') AS COMMODITY",
    "weekly_labels": "SELECT 'W' || WEEK_NUM || ' ' || YEAR AS label, spend FROM "
    f"({SUMMARIES['weekly']})",
    "organic_labelled": "SELECT CASE WHEN NATURAL_ORGANIC_FLAG = 'Y' THEN 'Organic' ELSE 'Non-Organic' END AS label, * "
    f"FROM ({SUMMARIES['organic']})",
    "seasonal_ordered": "SELECT d.season_order, d.season, coalesce(s.total_spend, 0.0) AS total_spend FROM "
    "(VALUES (1, 'Spring'), (2, 'Summer'), (3, 'Fall'), (4, 'Winter')) d(season_order, season) "
    f"LEFT JOIN ({SUMMARIES['seasonal']}) s ON d.season = s.season",
    "dept_year_pivot": _grid(SUMMARIES["dept_year"], "DEPARTMENT", "YEAR"),
    "seasonal_dept_pivot": _pivot(SUMMARIES["seasonal_commodity"], "DEPARTMENT", "season", _SEASONS),
    "brand_income_pivot": _grid(SUMMARIES["brand_income"], "INCOME_RANGE", "BRAND_TY"),
    "brand_any_name_pivot": _grid(
        SUMMARIES["brand_income"].replace("JOIN products p", f"JOIN ({fixture.ODD_PRODUCTS.format(**_NAMES, products='products')}) p"),
        "INCOME_RANGE", "BRAND_TY",
    ),
    "weekly_in_order": _in_order(SUMMARIES["weekly"], "YEAR NULLS FIRST, WEEK_NUM NULLS FIRST"),
    "income_in_order": _in_order(SUMMARIES["income"], "avg_spend DESC, INCOME_RANGE"),
    "dept_in_order": _in_order(SUMMARIES["dept"], "total_spend DESC, DEPARTMENT"),
    "dept_year_in_order": _in_order(SUMMARIES["dept_year"], "YEAR, total_spend DESC, DEPARTMENT"),
    "brand_json": "SELECT CAST(to_json({BRAND_TY: BRAND_TY, transaction_count: transaction_count}) AS VARCHAR) AS json "
    f"FROM ({SUMMARIES['brand']})",
}

_NA = (
    "'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', "
    "'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"
)


def _bronze(table: str, columns: list[str]) -> str:
    cells = ", ".join(f"CASE WHEN {c} NOT IN ({_NA}) THEN {c} END AS {c}" for c in columns)
    return f"SELECT {cells} FROM {table}"


_HH = ["HSHD_NUM", "L", "AGE_RANGE", "MARITAL", "INCOME_RANGE", "HOMEOWNER", "HSHD_COMPOSITION", "HH_SIZE", "CHILDREN"]
_PR = ["PRODUCT_NUM", "DEPARTMENT", "COMMODITY", "BRAND_TY", "NATURAL_ORGANIC_FLAG"]
_TX = ["BASKET_NUM", "HSHD_NUM", "PURCHASE_", "PRODUCT_NUM", "SPEND", "UNITS", "STORE_R", "WEEK_NUM", "YEAR"]


def _clean(bronze: str, key: str, texts: list[str]) -> str:
    cells = ", ".join(f"rtrim({c}) AS {c}" for c in texts)
    return f"SELECT TRY_CAST({key} AS BIGINT) AS {key}, {cells} FROM ({bronze})"


INGEST = {
    "ingest_bronze": _bronze("raw_transactions", _TX).replace("AS PURCHASE_,", "AS PURCHASE_DATE,"),
    "ingest_clean": "SELECT TRY_CAST(BASKET_NUM AS BIGINT) AS BASKET_NUM, TRY_CAST(HSHD_NUM AS BIGINT) AS HSHD_NUM, "
    "CAST(TRY_CAST(PURCHASE_ AS DATE) AS VARCHAR) AS PURCHASE_DATE, TRY_CAST(PRODUCT_NUM AS BIGINT) AS PRODUCT_NUM, "
    "CAST(TRY_CAST(SPEND AS DECIMAL(20,4)) AS DOUBLE) AS SPEND, TRY_CAST(UNITS AS INTEGER) AS UNITS, STORE_R, "
    "TRY_CAST(WEEK_NUM AS INTEGER) AS WEEK_NUM, TRY_CAST(YEAR AS INTEGER) AS YEAR FROM raw_transactions",
    "ingest_clean_households": _clean(_bronze("raw_households", _HH), "HSHD_NUM", _HH[1:]),
    "ingest_clean_products": _clean(_bronze("raw_products", _PR), "PRODUCT_NUM", _PR[1:]),
    "ingest_unreadable": "SELECT "
    + ", ".join(
        f"count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS {k}) IS NULL) AS {n}"
        for n, c, k in [
            ("BASKET_NUM", "BASKET_NUM", "BIGINT"),
            ("HSHD_NUM", "HSHD_NUM", "BIGINT"),
            ("PURCHASE_DATE", "PURCHASE_", "DATE"),
            ("PRODUCT_NUM", "PRODUCT_NUM", "BIGINT"),
            ("SPEND", "SPEND", "DECIMAL(20,4)"),
            ("UNITS", "UNITS", "INTEGER"),
            ("WEEK_NUM", "WEEK_NUM", "INTEGER"),
            ("YEAR", "YEAR", "INTEGER"),
        ]
    )
    + " FROM raw_transactions",
    "ingest_summary": 'SELECT \'transactions\' AS "table", count(*) AS "rows" FROM raw_transactions UNION ALL '
    "SELECT 'products', count(*) FROM raw_products UNION ALL SELECT 'households', count(*) FROM raw_households",
}


INGEST["ingest_replace"] = INGEST["ingest_clean"]
INGEST["ingest_households_first"] = (
    f"SELECT {', '.join(_HH)} FROM (SELECT *, row_number() OVER (PARTITION BY HSHD_NUM ORDER BY "
    + ", ".join(f"{c} NULLS FIRST" for c in _HH[1:])
    + f") AS n FROM ({INGEST['ingest_clean_households']} UNION ALL SELECT * FROM households)) WHERE n = 1"
)


_DIRTY = fixture.DIRTY_TRANSACTIONS.format(raw_transactions="raw_transactions")
_REJECTED = [("PURCHASE_DATE", "PURCHASE_", "DATE"), ("SPEND", "SPEND", "DECIMAL(20,4)"), ("UNITS", "UNITS", "INTEGER")]
# A year of more than four digits is no date; neither is text with a fraction a whole number.
_READABLE = {"DATE": "regexp_matches({c}, '^[0-9]{{4}}-')", "INTEGER": "regexp_matches({c}, '^[0-9]+$')"}


def _read(c: str, kind: str) -> str:
    known = _READABLE.get(kind, "true").format(c=c)
    return f"CASE WHEN {known} THEN TRY_CAST({c} AS {kind}) END"


INGEST["ingest_rejects"] = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT 'transactions' AS \"table\", '{n}' AS \"column\", count(*) FILTER (WHERE {c} IS NOT NULL AND {_read(c, k)} IS NULL) "
    f"AS \"rows\" FROM ({_DIRTY})" for n, c, k in _REJECTED
) + ') WHERE "rows" > 0'
INGEST["ingest_dirty"] = (
    "SELECT TRY_CAST(BASKET_NUM AS BIGINT) AS BASKET_NUM, TRY_CAST(HSHD_NUM AS BIGINT) AS HSHD_NUM, "
    f"CAST({_read('PURCHASE_', 'DATE')} AS VARCHAR) AS PURCHASE_DATE, TRY_CAST(PRODUCT_NUM AS BIGINT) AS PRODUCT_NUM, "
    f"CAST({_read('SPEND', 'DECIMAL(20,4)')} AS DOUBLE) AS SPEND, {_read('UNITS', 'INTEGER')} AS UNITS, STORE_R, "
    f"TRY_CAST(WEEK_NUM AS INTEGER) AS WEEK_NUM, TRY_CAST(YEAR AS INTEGER) AS YEAR FROM ({_DIRTY})"
)

# Rows of each result a refresh writes.
_ROWS = {name: f"SELECT count(*) FROM ({query})" for name, query in (SUMMARIES | {"basket": PAIRS_10}).items()} | {
    "top_clv": "SELECT least(10, count(*)) FROM features",
    "churn_counts": "SELECT 3",
    "avg_clv": "SELECT 1",
    "high_risk_count": "SELECT 1",
    "churn_stats": "SELECT 1",
    "churn_importances": "SELECT 7",
    "churn_correlations": "SELECT 5",
    "churn_rate": "SELECT 1",
    "churn_report": "SELECT 5",
    "basket_model": "SELECT least(20, count(*)) FROM pairs_100",
    "basket_importances": "SELECT 6",
    "basket_model_summary": "SELECT 1",
}

_MEASURES = {
    "income": "hh_count", "hhsize": "avg_spend", "children": "hh_count", "region": "total_spend", "weekly": "spend",
    "dept_year": "total_spend", "seasonal": "total_spend", "seasonal_commodity": "total_spend", "brand": "total_spend",
    "organic": "total_spend", "brand_income": "total_spend", "dept": "total_spend", "commodity": "total_spend",
    "basket": "times_bought_together",
}

REFRESH = {
    "refresh_written": " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", count(*) AS \"rows\", round(CAST(sum({m}) AS DOUBLE), 2) AS total FROM ({q})"
        for name, m in _MEASURES.items() for q in [(SUMMARIES | {"basket": PAIRS_10})[name]]
    ),
    "refresh_all": " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", CAST(({rows}) AS BIGINT) AS \"rows\"" for name, rows in _ROWS.items()
    )
}


def oracle_sql() -> dict[str, str]:
    sql = {}
    for group, ctes in (
        (SUMMARIES, TYPED),
        (BASKETS, f"{TYPED},{BASKET_CTES}"),
        (DETAILS, TYPED),
        (HOUSEHOLD_QUERIES, f"{TYPED},{RFM_CTES}"),
        (RULE_QUERIES, f"{TYPED},{RFM_CTES}"),
        (DISPLAYS, TYPED),
        (INGEST, f"{TYPED},\n{RAW}"),
        (REFRESH, f"{TYPED},{BASKET_CTES},{RFM_CTES}"),
    ):
        for name, query in group.items():
            sql[name] = f"WITH {ctes}\n{query}"
    for name in ("income", "children", "dept_year", "brand", "organic", "brand_income", "dept", "commodity", "commodity_stats",
                 "household_features", "data_pull_all_by_department"):
        sql[f"{name}_large"] = sql[name]
    return sql

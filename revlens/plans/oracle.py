"""Independent DuckDB SQL for every exactly-checkable query in the catalog.

Each string runs on the raw Parquet views (region, nation, customer, part,
orders, lineitem, documents, ...). Shared CTEs rebuild the fixture tables
from the star schema with the same explicit DECIMAL casts as
``revlens.sources.tables`` so that sums are exact in both engines.
"""

from __future__ import annotations

TX_CTE = """
tx AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) AS order_id,
         l.l_linenumber AS line_number,
         CAST(o.o_orderdate AS TIMESTAMP) AS order_date,
         c.c_name AS customer,
         c.c_mktsegment AS segment,
         r.r_name AS region,
         p.p_type AS product,
         p.p_brand AS industry,
         o.o_orderpriority AS license,
         CAST(l.l_quantity AS DOUBLE) AS quantity,
         l.l_discount * 5 AS discount,
         CAST(CAST(l.l_extendedprice AS DECIMAL(12,2))
              * (1 - CAST(l.l_discount * 5 AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS sales,
         CAST(CAST(CAST(l.l_extendedprice AS DECIMAL(12,2))
              * (1 - CAST(l.l_discount * 5 AS DECIMAL(4,2))) AS DECIMAL(18,4))
              - CAST(l.l_extendedprice AS DECIMAL(12,2))
                * (CAST(0.450 AS DECIMAL(4,3)) + CAST(0.005 AS DECIMAL(4,3)) * p.p_size)
              AS DECIMAL(20,5)) AS profit
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
txm AS (
  SELECT *,
         greatest(-1.0, least(1.0, CAST(profit AS DOUBLE) / nullif(CAST(sales AS DOUBLE), 0))) AS margin_rate,
         discount > 0.3 AS high_discount_flag
  FROM tx
)"""

MONTHLY_CTE = """
monthly AS (
  SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, segment,
         sum(sales) AS sales, sum(profit) AS profit, avg(margin_rate) AS margin_rate
  FROM txm GROUP BY 1, 2
)"""


def with_tx(body: str, *ctes: str) -> str:
    parts = [TX_CTE] + list(ctes)
    return "WITH " + ",".join(parts) + "\n" + body


def _avg(x: str, scale: int = 12) -> str:
    """A mean whose sum is exact, divided once."""
    return f"CAST(sum(CAST({x} AS DECIMAL({scale + 16},{scale}))) AS DOUBLE) / count({x})"


def _label(v: str, d: str, m: str) -> str:
    """The persona label: what stands out, in the list for high or low values."""
    names = "('Champion', 'Value Seeker', 'High Value')", "('Steady SMB', 'At Risk', 'Standard')"
    high, low = (["'" + x.strip(" '()") + "'" for x in n.split(",")] for n in names)
    place = f"(CASE WHEN {m} >= 0.15 THEN 1 WHEN {d} >= 0.20 THEN 2 ELSE 3 END)"
    return f"list_extract(CASE WHEN {v} >= 5000 THEN [{', '.join(high)}] ELSE [{', '.join(low)}] END, {place})"


# The forecast of the fixed coefficients (catalog.FIXED_*).
FORECAST_CTE = """
fmodel AS (
  SELECT segment, count(*) AS n, max(month) AS last_month FROM monthly GROUP BY segment
),
fraw AS (
  SELECT segment, CAST(h AS INTEGER) AS step, CAST(last_month + to_months(CAST(h AS INTEGER)) AS DATE) AS month,
         CAST(n + h - 1 AS DOUBLE) AS t
  FROM fmodel, range(1, 4) r(h)
),
fcst AS (
  SELECT segment, step, month, round(y, 2) AS yhat, round(y - 24500.0, 2) AS yhat_lower, round(y + 24500.0, 2) AS yhat_upper,
         CAST(0.4 AS DOUBLE) AS r2_validation
  FROM (SELECT *, (0.25 + (0.01 * t + 0.0005 * (t * t) + 0.1 * sin(2 * pi() * 1 / 12 * t) + -0.2 * cos(2 * pi() * 1 / 12 * t)
               + 0.05 * sin(2 * pi() * 2 / 12 * t) + 0.02 * cos(2 * pi() * 2 / 12 * t)
               + -0.03 * sin(2 * pi() * 3 / 12 * t) + 0.04 * cos(2 * pi() * 3 / 12 * t))) * 25000.0 + 100000.0 AS y
        FROM fraw)
)"""

FVC_CTE = """
fvc AS (
  SELECT f.segment, f.yhat AS next_period_revenue, f.yhat_lower AS confidence_lower, f.yhat_upper AS confidence_upper,
         c.current_revenue, CASE WHEN c.current_revenue > 0 THEN (f.yhat - c.current_revenue) / c.current_revenue ELSE 0.0 END AS pct,
         f.r2_validation
  FROM fcst f JOIN (SELECT segment, CAST(arg_max(sales, month) AS DOUBLE) AS current_revenue FROM monthly GROUP BY segment) c
    ON c.segment = f.segment
  WHERE f.step = 1
)"""

_TREND = "CASE WHEN {p} >= 0.05 THEN 'up' WHEN {p} <= -0.05 THEN 'down' ELSE 'flat' END"

ORACLE: dict[str, str] = {}

ORACLE["transactions"] = with_tx("""
SELECT order_id, line_number, CAST(order_date AS DATE) AS order_date, customer, segment, region,
       product, industry, license, quantity, round(discount, 6) AS discount,
       CAST(sales AS DOUBLE) AS sales, CAST(profit AS DOUBLE) AS profit
FROM tx""")

ORACLE["margin_features"] = with_tx("""
SELECT order_id, line_number, CAST(order_date AS DATE) AS order_date, customer,
       CAST(sales AS DOUBLE) AS sales, round(margin_rate, 6) AS margin_rate, high_discount_flag
FROM txm""")

ORACLE["monthly_rollup"] = with_tx("""
SELECT month, segment, CAST(sales AS DOUBLE) AS sales, CAST(profit AS DOUBLE) AS profit,
       round(margin_rate, 6) AS margin_rate
FROM monthly""", MONTHLY_CTE)

from revlens.schema import NULL_TOKENS as _TOKENS  # noqa: E402

_TOK = ", ".join("'" + t.replace("'", "''") + "'" for t in _TOKENS)


def _nt(x: str) -> str:
    return f"(CASE WHEN {x} IN ({_TOK}) THEN NULL ELSE {x} END)"


def _num(x: str, default: str) -> str:
    v = _nt(x)
    return (f"coalesce(try_cast({v} AS DOUBLE), "
            f"try_cast(regexp_replace({v}, '[^0-9.\\-]', '', 'g') AS DOUBLE), {default})")


def _date(x: str) -> str:
    v = f"trim({_nt(x)})"
    fmts = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y"]
    return "coalesce(" + ", ".join(f"try_strptime({v}, '{f}')" for f in fmts) + ")"


RAW_CTE = """
raw AS (
  SELECT CASE WHEN k % 47 = 0 THEN NULL ELSE order_id END AS order_id_raw,
         CASE WHEN k % 61 = 0 THEN 'not a date'
              WHEN k % 3 = 0 THEN strftime(order_date, '%Y-%m-%d')
              WHEN k % 3 = 1 THEN strftime(order_date, '%Y/%m/%d')
              ELSE strftime(order_date, '%-m/%-d/%Y') END AS date_raw,
         CASE WHEN k % 43 = 0 THEN NULL ELSE customer END AS client_raw,
         CASE WHEN k % 59 = 0 THEN NULL ELSE segment END AS tier_raw,
         CASE WHEN k % 53 = 0 THEN NULL ELSE region END AS country_raw,
         product AS sku_raw,
         CASE WHEN k % 97 = 0 THEN 'n/a' WHEN k % 89 = 0 THEN '0' WHEN k % 83 = 0 THEN '-12.50'
              ELSE '$' || CAST(sales AS VARCHAR) END AS amount_raw,
         CASE WHEN k % 79 = 0 THEN '0' WHEN k % 73 = 0 THEN NULL
              ELSE CAST(CAST(quantity AS INTEGER) AS VARCHAR) END AS qty_raw,
         CASE WHEN k % 71 = 0 THEN '45%' WHEN k % 67 = 0 THEN NULL
              ELSE CAST(CAST(discount AS DECIMAL(4,2)) AS VARCHAR) END AS discount_raw,
         CASE WHEN k % 41 = 0 THEN NULL ELSE CAST(profit AS VARCHAR) END AS profit_raw,
         industry AS sector_raw
  FROM (SELECT *, CAST(order_id AS BIGINT) * 10 + line_number AS k FROM tx)
)"""

TYPED_CTE = f"""
typed0 AS (
  SELECT {_nt('order_id_raw')} AS order_id,
         {_date('date_raw')} AS order_date,
         coalesce({_nt('client_raw')}, 'Unknown Client') AS customer,
         coalesce({_nt('tier_raw')}, 'General') AS segment,
         coalesce({_nt('country_raw')}, 'Global') AS region,
         coalesce({_nt('sku_raw')}, 'Standard Product') AS product,
         coalesce({_nt('sector_raw')}, 'Unknown') AS industry,
         'Standard' AS license,
         {_num('amount_raw', '0.0')} AS sales,
         {_num('qty_raw', '1.0')} AS quantity,
         {_num('discount_raw', '0.0')} AS discount,
         {_num('profit_raw', '0.0')} AS profit,
         date_raw, amount_raw, qty_raw, discount_raw, profit_raw
  FROM raw
),
typed AS (
  SELECT *, CASE WHEN order_date IS NULL THEN 'date'
                 WHEN NOT (sales > 0) THEN 'sales'
                 WHEN NOT (quantity > 0) THEN 'quantity'
                 WHEN discount < 0 OR discount > 1 THEN 'discount' END AS failed_rule
  FROM typed0
),
clean AS (
  SELECT coalesce(order_id, 'Unknown') AS order_id, order_date, customer, segment, region, product,
         industry, license, sales, quantity, coalesce(discount, 0.0) AS discount,
         coalesce(profit, 0.0) AS profit,
         greatest(-1.0, least(1.0, profit / nullif(sales, 0))) AS margin_rate,
         discount > 0.3 AS high_discount_flag
  FROM typed WHERE failed_rule IS NULL
)"""

ENC_CTE = """
enc AS (
  SELECT col AS "column", value, CAST(dense_rank() OVER (PARTITION BY col ORDER BY value) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT 'segment' AS col, segment AS value FROM tx
        UNION SELECT DISTINCT 'industry', industry FROM tx
        UNION SELECT DISTINCT 'region', region FROM tx
        UNION SELECT DISTINCT 'product', product FROM tx)
)"""

MED_CTE = """
med AS (
  SELECT segment, median(CAST(sales AS DOUBLE) / greatest(quantity, 1e-6)) AS m FROM tx GROUP BY segment
)"""

REPS_CTE = """
feat AS (
  SELECT t.segment, t.region, t.quantity,
         CAST(t.sales AS DOUBLE) / greatest(t.quantity, 1e-6) AS rpu,
         ei.code AS industry_enc, ep.code AS product_enc
  FROM tx t
  JOIN enc ei ON ei."column" = 'industry' AND ei.value = t.industry
  JOIN enc ep ON ep."column" = 'product' AND ep.value = t.product
),
combo AS (
  SELECT segment, region, median(quantity) AS mq, median(rpu) AS mr FROM feat GROUP BY 1, 2
),
segm AS (
  SELECT segment, median(quantity) AS sq, median(rpu) AS sr FROM feat GROUP BY 1
),
mi AS (
  SELECT segment, region, industry_enc FROM (
    SELECT segment, region, industry_enc,
           row_number() OVER (PARTITION BY segment, region ORDER BY count(*) DESC, industry_enc) AS rk
    FROM feat GROUP BY 1, 2, 3) WHERE rk = 1
),
mp AS (
  SELECT segment, region, product_enc FROM (
    SELECT segment, region, product_enc,
           row_number() OVER (PARTITION BY segment, region ORDER BY count(*) DESC, product_enc) AS rk
    FROM feat GROUP BY 1, 2, 3) WHERE rk = 1
),
grid AS (
  SELECT s.value AS segment, s.code AS segment_enc, r.value AS region, r.code AS region_enc
  FROM enc s JOIN enc r ON s."column" = 'segment' AND r."column" = 'region'
),
reps AS (
  SELECT g.segment, g.region, g.segment_enc, g.region_enc,
         coalesce(c.mq, sg.sq) AS quantity, coalesce(c.mr, sg.sr) AS revenue_per_unit,
         coalesce(mi.industry_enc, 0) AS industry_enc, coalesce(mp.product_enc, 0) AS product_enc
  FROM grid g
  LEFT JOIN combo c ON c.segment = g.segment AND c.region = g.region
  LEFT JOIN segm sg ON sg.segment = g.segment
  LEFT JOIN mi ON mi.segment = g.segment AND mi.region = g.region
  LEFT JOIN mp ON mp.segment = g.segment AND mp.region = g.region
)"""

ORACLE["customer_profiles"] = with_tx("""
SELECT customer, CAST(sum(sales) AS DOUBLE) AS sales, round(""" + _avg("margin_rate") + """, 6) AS margin_rate,
       round(""" + _avg("discount") + """, 6) AS discount
FROM txm GROUP BY customer""")

ORACLE["avg_margin_by_segment"] = with_tx("""
SELECT segment, round(""" + _avg("margin_rate") + """, 4) AS avg_margin FROM txm GROUP BY segment""")

ORACLE["median_rev_per_unit"] = with_tx("""
SELECT segment, round(median(CAST(sales AS DOUBLE) / greatest(quantity, 1e-6)), 6) AS median_revenue_per_unit
FROM tx GROUP BY segment
UNION ALL
SELECT NULL, round(median(CAST(sales AS DOUBLE) / greatest(quantity, 1e-6)), 6) FROM tx""")

ORACLE["kpi_overview"] = with_tx("""
SELECT round(""" + _avg("margin_rate") + """ * 100, 1) AS portfolio_margin_health,
       count(*) FILTER (WHERE margin_rate < 0.05) AS risk_alerts,
       round(CAST(coalesce(sum(sales) FILTER (WHERE margin_rate < 0.05), 0) AS DOUBLE), 4) AS at_risk_sales,
       round(CAST(coalesce(sum(sales) FILTER (WHERE margin_rate < 0.05), 0) AS DOUBLE) * 0.15, 6)
         AS recovery_opportunity,
       CAST(25.0 AS DOUBLE) AS margin_target,
       round(least(100.0, round(""" + _avg("margin_rate") + """ * 100, 1) / 25.0 * 100), 6) AS target_progress,
       count(*) AS n_rows
FROM txm""")

_LAST12 = "(SELECT DISTINCT month FROM monthly ORDER BY month DESC LIMIT {n})"

ORACLE["revenue_pivot"] = with_tx("""
SELECT month,
       CAST(coalesce(sum(sales) FILTER (WHERE segment = 'AUTOMOBILE'), 0) AS DOUBLE) AS AUTOMOBILE,
       CAST(coalesce(sum(sales) FILTER (WHERE segment = 'BUILDING'), 0) AS DOUBLE) AS BUILDING,
       CAST(coalesce(sum(sales) FILTER (WHERE segment = 'FURNITURE'), 0) AS DOUBLE) AS FURNITURE,
       CAST(coalesce(sum(sales) FILTER (WHERE segment = 'HOUSEHOLD'), 0) AS DOUBLE) AS HOUSEHOLD,
       CAST(coalesce(sum(sales) FILTER (WHERE segment = 'MACHINERY'), 0) AS DOUBLE) AS MACHINERY
FROM monthly WHERE month IN """ + _LAST12.format(n=12) + " GROUP BY month", MONTHLY_CTE)

ORACLE["revenue_sparkline"] = with_tx("""
SELECT month, CAST(sum(sales) AS DOUBLE) AS sales FROM monthly
WHERE month IN """ + _LAST12.format(n=6) + " GROUP BY month", MONTHLY_CTE)

_RISK_SELECT = """SELECT order_id, line_number, customer, segment, region, CAST(order_date AS DATE) AS order_date,
       CAST(sales AS DOUBLE) AS sales, round(discount, 6) AS discount, round(margin_rate, 6) AS margin_rate
FROM txm WHERE margin_rate < 0.05"""

ORACLE["at_risk_deals"] = with_tx(_RISK_SELECT)
ORACLE["top_at_risk"] = with_tx(_RISK_SELECT + """
ORDER BY sales DESC, order_id NULLS FIRST, line_number NULLS FIRST, order_date NULLS FIRST,
         customer NULLS FIRST, product NULLS FIRST, industry NULLS FIRST, quantity NULLS FIRST,
         discount NULLS FIRST, profit NULLS FIRST
LIMIT 50""")

ORACLE["search_transactions"] = with_tx("""
SELECT order_id, line_number, customer, segment, CAST(sales AS DOUBLE) AS sales FROM tx
WHERE (contains(lower(coalesce(order_id, '')), '99') OR contains(lower(coalesce(customer, '')), '99'))
  AND segment = 'BUILDING'""")

_CHART = """chart AS (SELECT month, segment, CAST(sales AS DOUBLE) AS sales, false AS is_forecast FROM monthly
           UNION ALL SELECT month, segment, yhat, true FROM fcst)"""
for _n, _k in (("3m", 3), ("6m", 6), ("12m", 12)):
    ORACLE[f"time_range_{_n}"] = with_tx(
        "SELECT * FROM chart WHERE is_forecast OR month IN (SELECT DISTINCT month FROM monthly ORDER BY month DESC "
        f"LIMIT {_k})", MONTHLY_CTE, FORECAST_CTE, _CHART)
ORACLE["time_range_ytd"] = with_tx("SELECT * FROM chart WHERE is_forecast OR year(month) = 2000", MONTHLY_CTE,
                                   FORECAST_CTE, _CHART)

LISTING_CTE = """
listing AS (
  SELECT coalesce(order_id, '') AS order_id, strftime(order_date, '%Y-%m-%d') AS order_date, customer, segment,
         coalesce(region, 'Global') AS region, product, coalesce(CAST(sales AS DOUBLE), 0.0) AS sales,
         round(coalesce(margin_rate, 0.0) * 100, 1) AS margin_pct,
         printf('%.1f', round(coalesce(margin_rate, 0.0) * 100, 1)) || '%' AS margin
  FROM txm
)"""

ORACLE["transactions_view"] = with_tx("SELECT * FROM listing", LISTING_CTE)

_LIST_ORDER = ("order_date NULLS FIRST, order_id NULLS FIRST, customer NULLS FIRST, segment NULLS FIRST, "
               "region NULLS FIRST, product NULLS FIRST, sales NULLS FIRST, margin_pct")

ORACLE["preview"] = with_tx(
    "SELECT *, (SELECT count(*) FROM tx) AS total_count FROM listing ORDER BY " + _LIST_ORDER + " LIMIT 100",
    LISTING_CTE)

ORACLE["paged_transactions"] = with_tx(
    "SELECT *, CAST(ceil(rn / 12.0) AS BIGINT) AS page, "
    "CAST(greatest(1, ceil((SELECT count(*) FROM listing) / 12.0)) AS BIGINT) AS total_pages FROM ("
    "SELECT *, row_number() OVER (ORDER BY " + _LIST_ORDER + ") AS row_number FROM listing) "
    "t(order_id, order_date, customer, segment, region, product, sales, margin_pct, margin, rn)",
    LISTING_CTE)
# keep the column name row_number
ORACLE["paged_transactions"] = ORACLE["paged_transactions"].replace(
    "SELECT *, CAST(ceil(rn / 12.0)", "SELECT order_id, order_date, customer, segment, region, product, sales, "
    "margin_pct, margin, rn AS row_number, CAST(ceil(rn / 12.0)")

MOM_CTE = """
mom AS (
  SELECT segment, month, CAST(sales AS DOUBLE) AS sales,
         lag(CAST(sales AS DOUBLE)) OVER (PARTITION BY segment ORDER BY month) AS prev_sales
  FROM monthly
),
mom2 AS (
  SELECT *, CASE WHEN prev_sales > 0 THEN (sales - prev_sales) / prev_sales ELSE 0.0 END AS pct FROM mom
)"""

ORACLE["mom_change"] = with_tx(
    "SELECT segment, month, sales, prev_sales, round(pct, 6) AS pct_change FROM mom2", MONTHLY_CTE, MOM_CTE)
ORACLE["trend_label"] = with_tx(
    "SELECT segment, month, CASE WHEN pct >= 0.05 THEN 'up' WHEN pct <= -0.05 THEN 'down' ELSE 'flat' END AS trend "
    "FROM mom2", MONTHLY_CTE, MOM_CTE)

ORACLE["margin_flag"] = with_tx("""
SELECT order_id, line_number, round(margin_rate, 6) AS margin_rate,
       CASE WHEN margin_rate >= 0.15 THEN 'green' WHEN margin_rate >= 0.05 THEN 'caution' ELSE 'red' END
         AS margin_flag
FROM txm""")

ORACLE["margin_rating"] = with_tx("""
SELECT order_id, line_number,
       CASE WHEN margin_rate >= 0.15 THEN 'healthy' WHEN margin_rate >= 0.05 THEN 'at_risk' ELSE 'critical' END
         AS margin_rating,
       margin_rate > 0 AS is_profitable
FROM txm""")

ORACLE["margin_band"] = with_tx("""
SELECT order_id, customer, margin_pct,
       CASE WHEN margin_pct >= 15 THEN 'healthy' WHEN margin_pct >= 10 THEN 'thin' ELSE 'low' END AS margin_band
FROM listing""", LISTING_CTE)

CUST_CTE = """
cust AS (
  SELECT customer, CAST(sum(sales) AS DOUBLE) AS v, round(""" + _avg("discount") + """, 9) AS d,
         round(""" + _avg("margin_rate") + """, 9) AS m
  FROM txm GROUP BY customer
)"""

ORACLE["persona_label"] = with_tx("""
SELECT customer,
       """ + _label("v", "d", "m") + """ AS persona_label
FROM cust""", CUST_CTE)

ORACLE["churn_risk"] = with_tx("""
SELECT customer,
       CASE WHEN m < 0.10 OR d >= 0.25 THEN 'high' WHEN m < 0.15 OR d >= 0.15 THEN 'medium' ELSE 'low' END
         AS churn_risk
FROM cust""", CUST_CTE)

ORACLE["token_estimate"] = """
SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, CAST(ceil(length(text) / 4) AS BIGINT) AS token_estimate,
       round(100.0 * CAST(ceil(length(text) / 4) AS DOUBLE) / 600.0, 1) AS budget_used_pct
FROM documents"""

ORACLE["content_fingerprint"] = """
SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents"""

DEALS_CTE = """
deals AS (
  SELECT order_id || '-' || CAST(line_number AS VARCHAR) AS deal_id, segment, region, industry, product,
         CAST(quantity AS INTEGER) AS quantity, CAST(sales AS DOUBLE) AS sales, CAST(discount AS DOUBLE) AS discount
  FROM tx
)"""

ORACLE["rule_recovery"] = with_tx("""
SELECT deal_id, industry, product, CAST(c AS DOUBLE) AS safe_ceiling_pct, CAST(c + 15.0 AS DOUBLE) AS cliff_pct,
       round(sales * greatest(0.0, discount * 100 - c) / 100, 6) AS recovery
FROM (SELECT *, (CASE industry WHEN 'Tech' THEN 22.0 WHEN 'Finance' THEN 12.0 WHEN 'Healthcare' THEN 18.0
                               ELSE 15.0 END)
              + (CASE product WHEN 'Enterprise API' THEN 5.0 WHEN 'Basic' THEN -3.0 ELSE 0.0 END) AS c
      FROM deals)""", DEALS_CTE)

ORACLE["discount_sweep"] = with_tx("""
SELECT segment, region, product, quantity, discount_pct,
       round(CASE WHEN d <= 10 THEN 28 + o - d * 1.2
                  WHEN d <= 25 THEN 16 + o - (d - 10) * 0.8
                  WHEN d <= 40 THEN 4 + o - (d - 25) * 0.4
                  ELSE greatest(-15.0, -2 + o - (d - 40) * 0.5) END, 1) + 0.0 AS margin_pct,
       CASE WHEN d > 35 THEN 'danger' ELSE 'healthy' END AS zone
FROM (SELECT c.*, CAST(i AS INTEGER) AS discount_pct, CAST(i AS DOUBLE) AS d,
             (CASE segment WHEN 'Enterprise' THEN -2.5 WHEN 'Small Business' THEN 1.0 ELSE 0.0 END)
           + (CASE region WHEN 'Europe' THEN 1.5 WHEN 'APAC' THEN -1.0 ELSE 0.0 END)
           + (CASE product WHEN 'Enterprise API' THEN 4.0 WHEN 'Basic' THEN -2.0 ELSE 0.0 END)
           + CAST(quantity AS DOUBLE) / 1000 * -1.5 AS o
      FROM (SELECT DISTINCT segment, region, product, quantity FROM deals) c, range(0, 81) r(i))""",
                                   DEALS_CTE)

ORACLE["whatif_discount"] = with_tx("""
SELECT month, segment, CAST(s AS DOUBLE) AS scenario_discount, round(sum(sales), 4) AS actual_revenue,
       round(sum(lv * (1 - s)), 4) AS scenario_revenue, round(sum(lv * (1 - s)) - sum(sales), 4) AS revenue_delta
FROM (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, segment, CAST(sales AS DOUBLE) AS sales,
             CAST(sales AS DOUBLE) / (1 - discount) AS lv
      FROM tx WHERE discount < 1) b,
     (VALUES (0.0), (0.05), (0.10), (0.20)) v(s)
GROUP BY 1, 2, 3""")

ORACLE["encode_categories"] = with_tx("SELECT * FROM enc", ENC_CTE)

ORACLE["encode_oov"] = with_tx("""
SELECT t.segment, t.region, t.industry, t.product,
       coalesce(es.code, -1) AS segment_enc, coalesce(er.code, -1) AS region_enc,
       coalesce(ei.code, -1) AS industry_enc, coalesce(ep.code, -1) AS product_enc,
       CAST((es.code IS NULL)::INT + (er.code IS NULL)::INT + (ei.code IS NULL)::INT + (ep.code IS NULL)::INT
            AS INTEGER) AS n_warnings
FROM typed t
LEFT JOIN enc es ON es."column" = 'segment' AND es.value = t.segment
LEFT JOIN enc er ON er."column" = 'region' AND er.value = t.region
LEFT JOIN enc ei ON ei."column" = 'industry' AND ei.value = t.industry
LEFT JOIN enc ep ON ep."column" = 'product' AND ep.value = t.product""", ENC_CTE, RAW_CTE, TYPED_CTE)

ORACLE["impute_rev_per_unit"] = with_tx("""
SELECT t.segment, round(t.sales, 6) AS sales, round(t.quantity, 6) AS quantity,
       round(CASE WHEN coalesce(CASE WHEN t.quantity > 0 THEN t.sales / t.quantity END, 0.0) > 0
                  THEN t.sales / t.quantity
                  ELSE coalesce(med.m, (SELECT avg(m) FROM med)) END, 6) AS revenue_per_unit,
       NOT (coalesce(CASE WHEN t.quantity > 0 THEN t.sales / t.quantity END, 0.0) > 0) AS rpu_imputed
FROM typed t LEFT JOIN med ON med.segment = t.segment""", MED_CTE, RAW_CTE, TYPED_CTE)

ORACLE["representative_deals"] = with_tx("""
SELECT segment, region, segment_enc, region_enc, round(quantity, 6) AS quantity,
       round(revenue_per_unit, 6) AS revenue_per_unit, industry_enc, product_enc
FROM reps""", ENC_CTE, REPS_CTE)

ORACLE["ceiling_grid"] = with_tx("""
SELECT segment, region, CAST(round(i * 0.01, 2) AS DOUBLE) AS discount, round(quantity, 6) AS quantity,
       round(CAST(round(i * 0.01, 2) AS DOUBLE) * quantity, 6) AS discount_x_quantity,
       CAST(round(i * 0.01, 2) > 0.3 AS INTEGER) AS high_discount_flag_int
FROM reps, range(0, 81) r(i)""", ENC_CTE, REPS_CTE)

ORACLE["deal_features"] = with_tx("""
SELECT order_id, line_number, round(discount * quantity, 6) AS discount_x_quantity,
       round(CAST(sales AS DOUBLE) / greatest(quantity, 1e-6), 6) AS revenue_per_unit,
       CAST(discount > 0.3 AS INTEGER) AS high_discount_flag_int
FROM tx""")

ORACLE["validate_deals"] = with_tx("""
SELECT segment, region, round(quantity, 6) AS quantity, round(sales, 6) AS sales, round(discount, 6) AS discount,
       concat_ws(',', e1, e2, e3, e4, e5, e6, e7, e8) AS errors,
       coalesce(e1, e2, e3, e4, e5, e6, e7, e8) IS NULL AS is_valid
FROM (SELECT *,
        CASE WHEN segment IS NULL OR length(segment) < 1 OR length(segment) > 64 THEN 'segment' END AS e1,
        CASE WHEN region IS NULL OR length(region) < 1 OR length(region) > 64 THEN 'region' END AS e2,
        CASE WHEN industry IS NULL OR length(industry) < 1 OR length(industry) > 64 THEN 'industry' END AS e3,
        CASE WHEN product IS NULL OR length(product) < 1 OR length(product) > 128 THEN 'product' END AS e4,
        CASE WHEN quantity IS NULL OR quantity < 1 OR quantity > 100000 THEN 'quantity' END AS e5,
        CASE WHEN sales IS NULL OR sales <= 0 OR sales > 50000000.0 THEN 'sales' END AS e6,
        CASE WHEN discount IS NULL OR discount < 0 OR discount > 0.9 THEN 'discount' END AS e7,
        CASE WHEN coalesce(NOT (sales / nullif(quantity, 0) > 0), true) THEN 'revenue_per_unit' END AS e8
      FROM typed)""", RAW_CTE, TYPED_CTE)

ORACLE["normalized_headers"] = with_tx("""
SELECT order_id_raw AS order_id, date_raw AS order_date, client_raw AS customer, tier_raw AS segment,
       country_raw AS region, sku_raw AS product, amount_raw AS sales, qty_raw AS quantity,
       discount_raw AS discount, profit_raw AS profit, sector_raw AS industry
FROM raw""", RAW_CTE)

ORACLE["synth_order_id"] = with_tx("""
SELECT count(*) AS n_rows, count(*) AS n_distinct, 'AUTO-000001' AS min_id, printf('AUTO-%06d', count(*)) AS max_id
FROM raw""", RAW_CTE)

ORACLE["coerce_numeric"] = with_tx("""
SELECT amount_raw, qty_raw, discount_raw, round(sales, 6) AS sales, round(quantity, 6) AS quantity,
       round(discount, 6) AS discount, round(profit, 6) AS profit
FROM typed0""", RAW_CTE, TYPED_CTE)

ORACLE["fill_categorical"] = with_tx(f"""
SELECT 'order_id' AS column_name, count(*) FILTER (WHERE {_nt('order_id_raw')} IS NULL) AS null_count FROM raw
UNION ALL SELECT 'customer', count(*) FILTER (WHERE {_nt('client_raw')} IS NULL) FROM raw
UNION ALL SELECT 'segment', count(*) FILTER (WHERE {_nt('tier_raw')} IS NULL) FROM raw
UNION ALL SELECT 'region', count(*) FILTER (WHERE {_nt('country_raw')} IS NULL) FROM raw
UNION ALL SELECT 'product', count(*) FILTER (WHERE {_nt('sku_raw')} IS NULL) FROM raw
UNION ALL SELECT 'industry', count(*) FILTER (WHERE {_nt('sector_raw')} IS NULL) FROM raw""", RAW_CTE)

ORACLE["parse_dates"] = with_tx(f"""
SELECT date_raw, {_date('date_raw')} AS order_date FROM raw""", RAW_CTE)

ORACLE["clean_transactions"] = with_tx("""
SELECT order_id, CAST(order_date AS DATE) AS order_date, customer, segment, region, product, industry, license,
       round(sales, 6) AS sales, round(quantity, 6) AS quantity, round(discount, 6) AS discount,
       round(profit, 6) AS profit, round(margin_rate, 6) AS margin_rate, high_discount_flag
FROM clean""", RAW_CTE, TYPED_CTE)

ORACLE["dq_report"] = with_tx("""
SELECT coalesce(failed_rule, 'kept') AS rule, count(*) AS rows FROM typed GROUP BY 1""", RAW_CTE, TYPED_CTE)

ORACLE["dq_examples"] = with_tx("""
SELECT failed_rule, CAST(example_rank AS INTEGER) AS example_rank, order_id, customer, round(sales, 6) AS sales, round(quantity, 6) AS quantity,
       round(discount, 6) AS discount, violations, greatest(violations - 5, 0) AS and_more
FROM (SELECT *, row_number() OVER (PARTITION BY failed_rule ORDER BY order_id NULLS FIRST, customer NULLS FIRST,
                                   sales NULLS FIRST, quantity NULLS FIRST, discount NULLS FIRST) AS example_rank,
             count(*) OVER (PARTITION BY failed_rule) AS violations
      FROM typed WHERE failed_rule IS NOT NULL)
WHERE example_rank <= 5""", RAW_CTE, TYPED_CTE)

ORACLE["ingest_summary"] = with_tx("""
SELECT count(*) AS rows_raw, count(*) FILTER (WHERE failed_rule IS NULL) AS rows_loaded,
       count(*) - count(*) FILTER (WHERE failed_rule IS NULL) AS rows_dropped,
       count(DISTINCT CASE WHEN failed_rule IS NULL THEN (date_trunc('month', order_date), segment) END)
         AS rows_monthly,
       (SELECT string_agg(segment, '|' ORDER BY segment) FROM
          (SELECT DISTINCT segment FROM typed WHERE failed_rule IS NULL)) AS segments,
       coalesce(bool_and(profit = 0) FILTER (WHERE failed_rule IS NULL), true) AS profit_all_zero,
       -- 11 header renames + License synthesised, + the all-zero-profit warning
       CAST(12 + (CASE WHEN coalesce(bool_and(profit = 0) FILTER (WHERE failed_rule IS NULL), true)
                       THEN 1 ELSE 0 END) AS INTEGER) AS n_warnings,
       CAST(CASE WHEN count(*) FILTER (WHERE failed_rule IS NULL) = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_errors
FROM typed""", RAW_CTE, TYPED_CTE)

ORACLE["transactions_page"] = with_tx(
    "SELECT * FROM (SELECT order_id, order_date, customer, segment, region, product, sales, margin_pct, margin, "
    "rn AS row_number, CAST(ceil(rn / 8.0) AS BIGINT) AS page, "
    "CAST(greatest(1, ceil((SELECT count(*) FROM listing) / 8.0)) AS BIGINT) AS total_pages FROM ("
    "SELECT *, row_number() OVER (ORDER BY " + _LIST_ORDER + ") AS rn FROM listing)) "
    "WHERE page = least(greatest(100000, 1), total_pages)", LISTING_CTE)

ORACLE["transactions_middle_page"] = (ORACLE["transactions_page"].replace("/ 8.0", "/ 12.0")
                                      .replace("greatest(100000, 1)", "greatest((SELECT count(*) FROM listing) // 24, 1)"))

ORACLE["forecast_design"] = with_tx("""
SELECT segment, month, CAST(t AS INTEGER) AS t_idx, CAST(n AS INTEGER) AS n_months,
       (round((y - ym) / (CASE WHEN ys < 1e-6 THEN 1.0 ELSE ys END), 6) + 0.0) AS y_s,
       t < n - least(6, CAST(floor(n / 3) AS INTEGER)) AS is_train,
       (round(CAST(t AS DOUBLE), 6) + 0.0) AS t, (round(CAST(t AS DOUBLE) * t, 6) + 0.0) AS t2,
       (round(sin(2 * pi() * 1 / 12 * t), 6) + 0.0) AS sin1, (round(cos(2 * pi() * 1 / 12 * t), 6) + 0.0) AS cos1,
       (round(sin(2 * pi() * 2 / 12 * t), 6) + 0.0) AS sin2, (round(cos(2 * pi() * 2 / 12 * t), 6) + 0.0) AS cos2,
       (round(sin(2 * pi() * 3 / 12 * t), 6) + 0.0) AS sin3, (round(cos(2 * pi() * 3 / 12 * t), 6) + 0.0) AS cos3
FROM (SELECT segment, month, CAST(sales AS DOUBLE) AS y,
             row_number() OVER (PARTITION BY segment ORDER BY month) - 1 AS t,
             count(*) OVER (PARTITION BY segment) AS n,
             avg(CAST(sales AS DOUBLE)) OVER (PARTITION BY segment) AS ym,
             stddev_pop(CAST(sales AS DOUBLE)) OVER (PARTITION BY segment) AS ys
      FROM monthly)""", MONTHLY_CTE)

FIXED_CTE = """
prof AS (
  SELECT t.customer, CAST(sum(t.sales) AS DOUBLE) AS sales, """ + _avg("t.margin_rate") + """ AS margin_rate,
         """ + _avg("t.discount") + """ AS discount, CAST(c.c_custkey % 4 AS INTEGER) AS cluster
  FROM txm t JOIN customer c ON c.c_name = t.customer
  GROUP BY t.customer, c.c_custkey
),
cstats AS (
  SELECT cluster, """ + _avg("sales", 6) + """ AS avg_sales, """ + _avg("margin_rate") + """ AS avg_margin,
         """ + _avg("discount") + """ AS avg_discount, count(*) AS n_customers
  FROM prof GROUP BY cluster
),
win AS (
  SELECT arg_max(cluster, (avg_margin, -cluster)) AS champ, arg_max(cluster, (avg_discount, -cluster)) AS seek,
         arg_max(cluster, (avg_sales, -cluster)) AS vol
  FROM cstats
),
named AS (
  SELECT s.*, CASE WHEN s.cluster = w.vol THEN 'Volume Accounts' WHEN s.cluster = w.seek THEN 'Discount Seekers'
                   WHEN s.cluster = w.champ THEN 'Champions' ELSE 'At-Risk' END AS persona
  FROM cstats s, win w
)"""

ORACLE["persona_naming"] = with_tx("""
SELECT cluster, persona,
       CASE persona WHEN 'Champions' THEN 'Protect & Upsell' WHEN 'Discount Seekers' THEN 'Reprice & Cap Discounts'
                    WHEN 'Volume Accounts' THEN 'Retention Strategy' WHEN 'At-Risk' THEN 'Immediate Intervention'
                    ELSE 'Analyze Behavior' END AS action_signal,
       round(avg_sales, 4) AS avg_sales, round(avg_margin, 6) AS avg_margin, round(avg_discount, 6) AS avg_discount,
       n_customers
FROM named""", FIXED_CTE)

ORACLE["roi_recovery"] = with_tx("""
SELECT round(cm, 6) AS champions_margin, round(sm, 6) AS seekers_margin, round(ss, 4) AS seekers_sales,
       round(CASE WHEN cm IS NULL OR sm IS NULL THEN 0.0 ELSE greatest(0.0, (cm - sm) * ss) END, 2) AS recovery_usd
FROM (SELECT """ + _avg("CASE WHEN n.persona = 'Champions' THEN p.margin_rate END") + """ AS cm,
             """ + _avg("CASE WHEN n.persona = 'Discount Seekers' THEN p.margin_rate END") + """ AS sm,
             sum(p.sales) FILTER (WHERE n.persona = 'Discount Seekers') AS ss
      FROM prof p JOIN named n ON n.cluster = p.cluster)""", FIXED_CTE)

ALERT_CTE = """
lastm AS (
  SELECT segment, pct, CASE WHEN pct >= 0.05 THEN 'up' WHEN pct <= -0.05 THEN 'down' ELSE 'flat' END AS trend
  FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY month DESC) AS r FROM mom2) WHERE r = 1
),
churn AS (
  SELECT count(*) FILTER (WHERE round(avg_margin, 9) < 0.10 OR round(avg_discount, 9) >= 0.25) AS n FROM cstats
),
found AS (
  SELECT 'fc-' || segment AS alert_id, 'critical' AS type, segment || ' Revenue Drop' AS title,
         'Forecast predicts a ' || printf('%+.1f', round(pct * 100, 1)) || '% change next period. '
           || 'Immediate sales intervention recommended.' AS description,
         'View Forecast' AS action
  FROM lastm WHERE trend = 'down' OR pct < 0
  UNION ALL
  SELECT 'persona-churn', 'warning', 'High Churn Risk Detected',
         CAST(n AS VARCHAR) || ' customer segments show behavior patterns consistent with imminent churn.',
         'Audit Personas'
  FROM churn WHERE n > 0
)"""

ORACLE["alerts"] = with_tx("""
SELECT * FROM found
UNION ALL
SELECT 'stable', 'info', 'System Optimal',
       'All business segments are performing within predicted variance. No critical anomalies detected.',
       'View Report'
WHERE (SELECT count(*) FROM found) = 0""", MONTHLY_CTE, MOM_CTE, FIXED_CTE, ALERT_CTE)

ORACLE["alert_count"] = with_tx("""
SELECT count(*) AS priority_alerts FROM found""", MONTHLY_CTE, MOM_CTE, FIXED_CTE, ALERT_CTE)

ORACLE["executive_overview"] = with_tx("""
WITH_MARK
SELECT k.segment, k.portfolio_margin_health, k.risk_alerts, k.at_risk_sales, k.recovery_opportunity, k.n_rows,
       round(r.recent_revenue, 4) AS recent_revenue, r.recent_months
FROM (SELECT segment, round(avg(margin_rate) * 100, 1) AS portfolio_margin_health,
             count(*) FILTER (WHERE margin_rate < 0.05) AS risk_alerts,
             round(CAST(coalesce(sum(sales) FILTER (WHERE margin_rate < 0.05), 0) AS DOUBLE), 4) AS at_risk_sales,
             round(CAST(coalesce(sum(sales) FILTER (WHERE margin_rate < 0.05), 0) AS DOUBLE) * 0.15, 6)
               AS recovery_opportunity,
             count(*) AS n_rows
      FROM txm GROUP BY segment) k
LEFT JOIN (SELECT segment, CAST(sum(sales) AS DOUBLE) AS recent_revenue, count(*) AS recent_months
           FROM monthly WHERE month IN (SELECT DISTINCT month FROM monthly ORDER BY month DESC LIMIT 6)
           GROUP BY segment) r ON r.segment = k.segment""".replace("WITH_MARK\n", ""), MONTHLY_CTE)

# ------------------------------------------------------------------ fixed models
ORACLE["segment_forecast_fixed"] = with_tx("SELECT * FROM fcst", MONTHLY_CTE, FORECAST_CTE)

_GLOBAL = """
SELECT step, round(sum(yhat), 2) AS yhat, round(sum(yhat_lower), 2) AS yhat_lower, round(sum(yhat_upper), 2) AS yhat_upper,
       round(avg(r2_validation), 3) AS r2, min(month) AS first_label, max(month) AS last_label, count(*) AS n_segments
FROM fcst {where} GROUP BY step"""
ORACLE["forecast_global_fixed"] = with_tx(_GLOBAL.format(where=""), MONTHLY_CTE, FORECAST_CTE)
ORACLE["forecast_single_segment_fixed"] = with_tx(_GLOBAL.format(where="WHERE segment = 'AUTOMOBILE'"), MONTHLY_CTE, FORECAST_CTE)

ORACLE["forecast_vs_current_fixed"] = with_tx(f"""
SELECT segment, next_period_revenue, confidence_lower, confidence_upper, current_revenue,
       round(pct, 6) AS pct_change_vs_current, {_TREND.format(p='pct')} AS trend_direction, r2_validation
FROM fvc""", MONTHLY_CTE, FORECAST_CTE, FVC_CTE)

ORACLE["aggregate_outlook_fixed"] = with_tx(f"""
SELECT round(n, 2) AS total_next_period_revenue, round(c, 2) AS total_current_revenue, round(p, 6) AS aggregate_pct_change,
       {_TREND.format(p='p')} AS aggregate_trend
FROM (SELECT n, c, CASE WHEN c > 0 THEN (n - c) / c ELSE 0.0 END AS p
      FROM (SELECT sum(next_period_revenue) AS n, sum(current_revenue) AS c FROM fvc))""", MONTHLY_CTE, FORECAST_CTE, FVC_CTE)

_HISTORY = ("SELECT segment, month, CAST(sales AS DOUBLE) AS sales, false AS is_forecast, 0 AS step FROM monthly "
            "WHERE month IN " + _LAST12.format(n=12))
ORACLE["forecast_chart_fixed"] = with_tx(
    _HISTORY + " UNION ALL SELECT segment, month, yhat, true, step FROM fcst", MONTHLY_CTE, FORECAST_CTE)
ORACLE["forecast_chart_display_fixed"] = with_tx(
    "SELECT segment, month, round(sales, 4) AS sales, is_forecast, step FROM (" + _HISTORY + """
    UNION ALL
    SELECT segment, CAST(month + to_months(CAST(i - 1 AS INTEGER)) AS DATE), yhat * (1 + CAST(g AS DOUBLE) * (i - 1)), true, CAST(i AS INTEGER)
    FROM (SELECT *, CASE segment WHEN 'AUTOMOBILE' THEN 0.02 WHEN 'BUILDING' THEN 0.01 WHEN 'MACHINERY' THEN 0.03 ELSE 0.0 END AS g
          FROM fcst WHERE step = 1), range(1, 4) r(i))""", MONTHLY_CTE, FORECAST_CTE)

# Ridge by its normal equations: centred sums, alpha on the diagonal, and Gauss-Jordan elimination, a pivot a step.
_TERMS = ["CAST(t AS DOUBLE)", "CAST(t AS DOUBLE) * t"] + [f"{f}(2 * pi() * {k} / 12 * t)" for k in (1, 2, 3) for f in ("sin", "cos")]
RIDGE_CTE = f"""
dsg AS (
  SELECT segment, n AS n_months, t < n - least(6, CAST(floor(n / 3) AS INTEGER)) AS is_train,
         (y - ym) / (CASE WHEN ys < 1e-6 THEN 1.0 ELSE ys END) AS y_s, {', '.join(f'{x} AS x{i}' for i, x in enumerate(_TERMS))}
  FROM (SELECT segment, CAST(sales AS DOUBLE) AS y, row_number() OVER (PARTITION BY segment ORDER BY month) - 1 AS t,
               count(*) OVER (PARTITION BY segment) AS n, avg(CAST(sales AS DOUBLE)) OVER (PARTITION BY segment) AS ym,
               stddev_pop(CAST(sales AS DOUBLE)) OVER (PARTITION BY segment) AS ys
        FROM monthly)
  WHERE n >= 12
),
sides AS (SELECT 'full' AS split, * FROM dsg UNION ALL SELECT 'train', * FROM dsg WHERE is_train),
mid AS (SELECT segment, split, count(*) AS n, avg(y_s) AS my, {', '.join(f'avg(x{i}) AS m{i}' for i in range(8))} FROM sides GROUP BY 1, 2),
aug AS (
  SELECT segment, split, 0 AS k, {', '.join(
      f"sum((x{i} - m{i}) * ({f'x{j} - m{j}' if j < 8 else 'y_s - my'})) + {1.0 if i == j else 0.0} AS a{i}_{j}" for i in range(8) for j in range(9))}
  FROM sides JOIN mid USING (segment, split) GROUP BY 1, 2
),
gj AS (
  SELECT segment, split, k, {', '.join('[' + ', '.join(f'a{i}_{j}' for j in range(9)) + ']' + f' AS r{i}' for i in range(8))} FROM aug
  UNION ALL
  SELECT segment, split, k + 1, {', '.join(
      f"CASE WHEN k = {i} THEN [" + ', '.join(f'r{i}[{j}] / r{i}[{i + 1}]' for j in range(1, 10)) + "] ELSE ["
      + ', '.join(f'r{i}[{j}] - r{i}[k + 1] * p[{j}] / p[k + 1]' for j in range(1, 10)) + f"] END AS r{i}" for i in range(8))}
  FROM (SELECT *, CASE k {' '.join(f'WHEN {i} THEN r{i}' for i in range(8))} END AS p FROM gj WHERE k < 8)
),
ridge AS (
  SELECT segment, split, n, {', '.join(f'r{i}[9] AS b{i}' for i in range(8))}, my - ({' + '.join(f'r{i}[9] * m{i}' for i in range(8))}) AS b
  FROM gj JOIN mid USING (segment, split) WHERE k = 8
),
fitted AS (
  SELECT s.*, r.b + {' + '.join(f'r.b{i} * s.x{i}' for i in range(8))} AS yhat
  FROM ridge r JOIN (SELECT 'full' AS split, * FROM dsg UNION ALL SELECT 'train', * FROM dsg WHERE NOT is_train) s USING (segment, split)
)"""
_NAMES = ["t", "t2", "sin1", "cos1", "sin2", "cos2", "sin3", "cos3"]
ORACLE["forecast_coefficients"] = with_tx(f"""
SELECT segment, split, n, round(b, 6) + 0.0 AS intercept, {', '.join(f'round(b{i}, 6) + 0.0 AS coef_{x}' for i, x in enumerate(_NAMES))}
FROM ridge""", MONTHLY_CTE, RIDGE_CTE).replace("WITH ", "WITH RECURSIVE ", 1)
ORACLE["forecast_backtest"] = with_tx("""
SELECT f.segment, f.n_months, round(h.r2, 3) AS r2_validation, round(f.s, 6) AS resid_std_s
FROM (SELECT segment, max(n_months) AS n_months, stddev_pop(y_s - yhat) AS s FROM fitted WHERE split = 'full' GROUP BY 1) f
LEFT JOIN (SELECT segment, CASE WHEN sst = 0 THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sse / sst END AS r2
           FROM (SELECT segment, sum((y_s - yhat) * (y_s - yhat)) AS sse, var_pop(y_s) * count(*) AS sst
                 FROM fitted WHERE split = 'train' GROUP BY 1)) h USING (segment)""", MONTHLY_CTE, RIDGE_CTE).replace("WITH ", "WITH RECURSIVE ", 1)

# Centres of two restarts: those of the query.
_CENTERS = [(0, 0, 1.0, 0.5, -0.5), (0, 1, -1.0, 0.25, 0.75), (0, 2, 0.125, -1.0, 0.0), (0, 3, -0.25, 0.0, -1.25),
            (1, 0, 0.0, 0.0, 0.0), (1, 1, 2.0, -0.5, 0.5), (1, 2, -0.5, 1.5, 0.25), (1, 3, 0.75, 0.75, 1.0)]
NEAREST_CTE = f"""
zall AS (SELECT customer, (s - avg(s) OVER ()) / stddev_pop(s) OVER () AS z1, (m - avg(m) OVER ()) / stddev_pop(m) OVER () AS z2,
                (d - avg(d) OVER ()) / stddev_pop(d) OVER () AS z3
         FROM (SELECT customer, CAST(sum(sales) AS DOUBLE) AS s, {_avg("margin_rate")} AS m, {_avg("discount")} AS d FROM txm GROUP BY customer)),
near AS (SELECT customer, z1, z2, z3, restart, min(d) AS d, arg_min(c, (d, c)) AS cluster
         FROM (SELECT z.*, restart, c, (z1 - c1) * (z1 - c1) + (z2 - c2) * (z2 - c2) + (z3 - c3) * (z3 - c3) AS d
               FROM zall z CROSS JOIN (VALUES {', '.join(map(str, _CENTERS))}) v(restart, c, c1, c2, c3))
         GROUP BY customer, z1, z2, z3, restart)"""
ORACLE["lloyd_step_fixed"] = with_tx("""
SELECT restart, cluster, count(*) AS n, round(sum(d), 5) AS cost, round(avg(z1), 6) + 0.0 AS z_sales, round(avg(z2), 6) + 0.0 AS z_margin_rate,
       round(avg(z3), 6) + 0.0 AS z_discount
FROM near GROUP BY 1, 2""", NEAREST_CTE)
ORACLE["saved_cluster_scores"] = with_tx("SELECT customer, cluster FROM near WHERE restart = 0", NEAREST_CTE)
ORACLE["cluster_stats_fixed"] = with_tx("""
SELECT cluster, round(avg_sales, 4) AS avg_sales, round(avg_margin, 6) AS avg_margin, round(avg_discount, 6) AS avg_discount,
       n_customers FROM cstats""", FIXED_CTE)
ORACLE["silhouette_exact_fixed"] = with_tx("""
SELECT round(avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette,
       count(*) AS n_rows, CAST(count(DISTINCT cluster) AS BIGINT) AS n_clusters
FROM (SELECT customer, max(mine) AS cluster, max(m) FILTER (WHERE mine = other) AS n,
             max(d / greatest(m - 1, 1)) FILTER (WHERE mine = other) AS a, min(d / m) FILTER (WHERE mine <> other) AS b
      FROM (SELECT x.customer, x.cluster AS mine, y.cluster AS other, count(*) AS m,
                   sum(sqrt((x.z1 - y.z1) * (x.z1 - y.z1) + (x.z2 - y.z2) * (x.z2 - y.z2) + (x.z3 - y.z3) * (x.z3 - y.z3))) AS d
            FROM z x CROSS JOIN z y GROUP BY 1, 2, 3)
      GROUP BY customer)""", FIXED_CTE, """
z AS (SELECT customer, cluster, (s - avg(s) OVER ()) / stddev_pop(s) OVER () AS z1, (m - avg(m) OVER ()) / stddev_pop(m) OVER () AS z2,
             (d - avg(d) OVER ()) / stddev_pop(d) OVER () AS z3
      FROM (SELECT customer, cluster, CAST(sales AS DOUBLE) AS s, CAST(margin_rate AS DOUBLE) AS m, CAST(discount AS DOUBLE) AS d FROM prof))""")
ORACLE["persona_assignments_fixed"] = with_tx("""
SELECT p.customer, p.cluster, n.persona FROM prof p JOIN named n ON n.cluster = p.cluster""", FIXED_CTE)
ORACLE["persona_traits_fixed"] = with_tx(f"""
SELECT n.persona, n.cluster, {_label('n.avg_sales', 'n.avg_discount', 'n.avg_margin')} AS persona_label,
       CASE WHEN n.avg_margin < 0.10 OR n.avg_discount >= 0.25 THEN 'high'
            WHEN n.avg_margin < 0.15 OR n.avg_discount >= 0.15 THEN 'medium' ELSE 'low' END AS churn_risk,
       round(n.avg_sales, 2) AS avg_customer_sales, round(n.avg_discount, 4) AS avg_discount,
       round(n.avg_margin, 4) AS avg_margin, n.n_customers AS cluster_size, t.region AS top_region
FROM named n
JOIN (SELECT cluster, region, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, region) AS rk
      FROM tx JOIN prof USING (customer) GROUP BY 1, 2) t ON t.cluster = n.cluster AND t.rk = 1""", FIXED_CTE)

_LINEAR = ("0.45 + CAST(discount AS DOUBLE) * -0.9 + CAST(quantity AS DOUBLE) * 0.0005 + rpu * 0.00001 + segment_enc * -0.01 "
           "+ region_enc * 0.002 + industry_enc * 0.001 + product_enc * -0.0003")
CEIL_CTE = f"""
ceil AS (
  SELECT segment, region, round(coalesce(max(discount) FILTER (WHERE {_LINEAR} > 0.05), 0.0), 2) AS ceiling
  FROM (SELECT segment, region, CAST(round(i * 0.01, 2) AS DOUBLE) AS discount, quantity, revenue_per_unit AS rpu,
               segment_enc, region_enc, industry_enc, product_enc
        FROM reps, range(0, 81) r(i))
  GROUP BY 1, 2
)"""
ORACLE["discount_ceilings_fixed"] = with_tx("SELECT * FROM ceil", ENC_CTE, REPS_CTE, CEIL_CTE)


def _trees(d: str, q: str, rpu: str, seg: str, ind: str, reg: str, prod: str) -> str:
    """The three fixed trees on a discount of grid or deal."""
    x = f"({d} * CAST({q} AS DOUBLE))"
    return (f"0.30 + (CASE WHEN {d} > 0.3 THEN -0.30 WHEN {d} <= 0.045 THEN 0.05 WHEN {x} <= 1.255 THEN -0.02 ELSE -0.08 END)"
            f" + (CASE WHEN {q} <= 24.5 THEN (CASE WHEN {reg} <= 1.5 THEN 0.03 WHEN {d} <= 0.255 THEN 0.01 ELSE -0.04 END)"
            f" WHEN {rpu} <= 1500 THEN -0.03 WHEN {x} <= 8.003 THEN 0.02 ELSE -0.09 END)"
            f" + (CASE WHEN {seg} <= 2.5 THEN (CASE WHEN {ind} <= 9.5 THEN 0.012 ELSE -0.006 END) WHEN {d} <= 0.125 THEN 0.004"
            f" WHEN {prod} <= 2.5 THEN -0.05 ELSE -0.11 END)")


_GRID = "CAST(i AS DOUBLE) / 100"
TREE_CEIL_CTE = f"""
ceil AS (
  SELECT segment, region, round(coalesce(max({_GRID}) FILTER (WHERE CAST({_trees(_GRID, 'quantity', 'revenue_per_unit', 'segment_enc', 'industry_enc', 'region_enc', 'product_enc')} AS DOUBLE) > 0.05), 0.0), 2) AS ceiling
  FROM reps, range(0, 81) r(i) GROUP BY 1, 2
)"""
CODED_CTE = """
coded AS (
  SELECT d.*, d.sales / d.quantity AS rpu, es.code AS seg, ei.code AS ind, er.code AS reg, ep.code AS prod
  FROM deals d
  JOIN enc es ON es."column" = 'segment' AND es.value = d.segment
  JOIN enc er ON er."column" = 'region' AND er.value = d.region
  JOIN enc ei ON ei."column" = 'industry' AND ei.value = d.industry
  JOIN enc ep ON ep."column" = 'product' AND ep.value = d.product
)"""
ORACLE["discount_ceilings_trees_fixed"] = with_tx("SELECT * FROM ceil", ENC_CTE, REPS_CTE, TREE_CEIL_CTE)
ORACLE["saved_model_scores"] = with_tx(f"""
SELECT deal_id, p AS predicted_margin_rate, CASE WHEN p >= 0.15 THEN 'green' WHEN p >= 0.05 THEN 'caution' ELSE 'red' END AS margin_flag,
       ceiling AS max_safe_discount, discount <= ceiling AS within_ceiling
FROM (SELECT c.*, l.ceiling, round(greatest(-1.0, least(1.0, CAST({_trees('discount', 'quantity', 'rpu', 'seg', 'ind', 'reg', 'prod')} AS DOUBLE))), 4) + 0.0 AS p
      FROM coded c JOIN ceil l ON l.segment = c.segment AND l.region = c.region)""", ENC_CTE, REPS_CTE, TREE_CEIL_CTE, DEALS_CTE, CODED_CTE)
ORACLE["discount_sweep_model_fixed"] = with_tx(f"""
SELECT segment, region, d AS discount, count(*) AS n, CAST(sum(CAST(p AS DECIMAL(10,4))) AS DOUBLE) AS total_margin, min(p) AS least_margin, max(p) AS most_margin
FROM (SELECT segment, region, {_GRID} AS d,
             round(greatest(-1.0, least(1.0, CAST({_trees(_GRID, 'quantity', 'rpu', 'seg', 'ind', 'reg', 'prod')} AS DOUBLE))), 4) + 0.0 AS p
      FROM (SELECT DISTINCT segment, region, industry, product, quantity, sales, rpu, seg, ind, reg, prod FROM coded), range(0, 81) r(i))
GROUP BY 1, 2, 3""", ENC_CTE, DEALS_CTE, CODED_CTE)
_CUTS = {"CAST(quantity AS DOUBLE)": ("quantity", (5.5, 12.5, 24.5, 40.5)), "CAST(discount AS DOUBLE)": ("discount", (0.005, 0.025, 0.045, 0.075)),
         "CAST(sales AS DOUBLE) / greatest(quantity, 1e-6)": ("revenue_per_unit", (1000.0, 1250.0, 1500.0, 1750.0)),
         "CAST(discount AS DOUBLE) * quantity": ("discount_x_quantity", (0.255, 0.755, 1.255, 2.505)), "code": ("segment_enc", (0.5, 1.5, 2.5, 3.5))}
ORACLE["split_gains_fixed"] = with_tx("""
SELECT feature, cut, round(gain, 3) AS gain, rows_left, rows_right FROM gains
WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, cut) = 1""", ENC_CTE, """
y AS (SELECT t.*, e.code, CAST(margin_rate AS DOUBLE) - (SELECT avg(CAST(margin_rate AS DOUBLE)) FROM txm) AS r
      FROM txm t JOIN enc e ON e."column" = 'segment' AND e.value = t.segment)""", "cut AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS feature, CAST({c} AS DOUBLE) AS cut, sum(r) FILTER (WHERE {x} <= {c}) AS gl, sum(r) FILTER (WHERE {x} > {c}) AS gr, "
    f"count(*) FILTER (WHERE {x} <= {c}) AS rows_left, count(*) FILTER (WHERE {x} > {c}) AS rows_right FROM y"
    for x, (name, cuts) in _CUTS.items() for c in cuts) + ")", """
gains AS (SELECT *, gl * gl / (rows_left + 1) + gr * gr / (rows_right + 1) - (gl + gr) * (gl + gr) / (rows_left + rows_right + 1) AS gain
          FROM cut WHERE rows_left >= 10 AND rows_right >= 10)""")


def _percent(x: str, n: int) -> str:
    return f"(CAST(round(CAST({x} AS DECIMAL(18,6)) * 100, {n}) AS DECIMAL(18,{n})) || '%')"


SCORED_CTE = f"""
scored AS (
  SELECT d.*, round(greatest(-1.0, least(1.0, {_LINEAR.replace('segment_enc', 'es.code').replace('region_enc', 'er.code')
                                               .replace('industry_enc', 'ei.code').replace('product_enc', 'ep.code')})), 4) + 0.0 AS p, c.ceiling
  FROM (SELECT *, sales / quantity AS rpu FROM todo) d
  JOIN enc es ON es."column" = 'segment' AND es.value = d.segment
  JOIN enc er ON er."column" = 'region' AND er.value = d.region
  JOIN enc ei ON ei."column" = 'industry' AND ei.value = d.industry
  JOIN enc ep ON ep."column" = 'product' AND ep.value = d.product
  JOIN ceil c ON c.segment = d.segment AND c.region = d.region
)"""
_SCORES = f"""
SELECT deal_id, segment, region, industry, product, CAST(quantity AS DOUBLE) AS quantity, sales, discount, p AS predicted_margin_rate,
       CASE WHEN p >= 0.15 THEN 'green' WHEN p >= 0.05 THEN 'caution' ELSE 'red' END AS margin_flag,
       CASE WHEN p >= 0.15 THEN 'healthy' WHEN p >= 0.05 THEN 'at_risk' ELSE 'critical' END AS margin_rating,
       p > 0 AS is_profitable, ceiling AS max_safe_discount,
       CASE WHEN p >= 0.15 THEN 'Margin is healthy at ' || {_percent('p', 1)} || '. Deal is within acceptable range.' || sfx
            WHEN p >= 0.05 THEN 'Margin is thin at ' || {_percent('p', 1)} || '. Current discount (' || {_percent('discount', 0)}
                                || ') is approaching the risk zone.' || sfx
            ELSE 'Predicted margin (' || {_percent('p', 1)} || ') is below the 5% threshold. Discount of ' || {_percent('discount', 0)}
                 || ' is too aggressive for this deal.' || sfx || ' Revise terms or escalate for approval.' END AS recommendation,
       round(least(discount / CASE WHEN ceiling <> 0 THEN ceiling ELSE 0.01 END, 1.0), 6) AS discount_use,
       discount <= ceiling AS within_ceiling, '' AS warnings
FROM (SELECT *, ' Safe ceiling for ' || segment || '/' || region || ': ' || {_percent('ceiling', 0)} || '.' AS sfx FROM scored)"""
ORACLE["deal_scores_fixed"] = with_tx(_SCORES, ENC_CTE, REPS_CTE, CEIL_CTE, DEALS_CTE, "todo AS (SELECT * FROM deals)", SCORED_CTE)

_TOP_ORDER = ORACLE["top_at_risk"].split("ORDER BY")[1].split("LIMIT")[0]
ORACLE["at_risk_scored_fixed"] = with_tx(_SCORES, ENC_CTE, REPS_CTE, CEIL_CTE, f"""
todo AS (SELECT order_id AS deal_id, segment, region, industry, product, CAST(quantity AS INTEGER) AS quantity,
                CAST(sales AS DOUBLE) AS sales, CAST(discount AS DOUBLE) AS discount
         FROM txm WHERE margin_rate < 0.05 ORDER BY {_TOP_ORDER} LIMIT 50)""", SCORED_CTE)
ORACLE["top_at_risk_by_region"] = with_tx(_RISK_SELECT + f"""
QUALIFY row_number() OVER (PARTITION BY region ORDER BY {_TOP_ORDER}) <= 50""")

ORACLE["rule_recovery_mapped"] = (ORACLE["rule_recovery"].replace("'Tech'", "'Brand#11'").replace("'Finance'", "'Brand#22'")
                                  .replace("'Healthcare'", "'Brand#3'").replace("'Enterprise API'", "'ECONOMY'").replace("'Basic'", "'STANDARD'"))
ORACLE["discount_sweep_mapped"] = (ORACLE["discount_sweep"].replace("'Enterprise API'", "'ECONOMY'").replace("'Basic'", "'STANDARD'")
                                   .replace("'Enterprise'", "'AUTOMOBILE'").replace("'Small Business'", "'BUILDING'")
                                   .replace("'Europe'", "'EUROPE'").replace("'APAC'", "'ASIA'"))

# ------------------------------------------------------------------ ingestion pieces
ORACLE["parse_date_forms"] = with_tx("""
SELECT order_id, line_number, CAST((CAST(order_id AS BIGINT) * 10 + line_number) % 16 AS INTEGER) AS form, order_date FROM tx""")
ORACLE["date_key"] = with_tx("""
SELECT try_cast(k AS BIGINT) AS date_key, count(*) AS rows
FROM (SELECT regexp_replace(date_raw, '[-/]', '', 'g') AS k FROM raw) GROUP BY 1""", RAW_CTE)
ORACLE["missing_critical"] = with_tx("""
SELECT name AS dropped, name IN ('Date', 'Amount', 'Qty') AS rejected, (SELECT count(*) FROM raw) AS rows
FROM (VALUES ('order_id'), ('Date'), ('Client'), ('Tier'), ('Country'), ('SKU'), ('Amount'), ('Qty'), ('Discount Rate'),
             ('net_profit'), ('Sector')) v(name)""", RAW_CTE)
ORACLE["fill_model_columns"] = with_tx("""
SELECT 'Unknown' AS industry, CASE WHEN quantity > 1 THEN product ELSE 'Unknown' END AS product, count(*) AS rows
FROM typed GROUP BY 1, 2""", RAW_CTE, TYPED_CTE)
ORACLE["quoted_orders"] = with_tx("""
SELECT order_id, CAST(line_number AS INTEGER) AS line_number, customer || ', ' || segment || ', ' || region AS who, CAST(sales AS DOUBLE) AS sales FROM tx""")
ORACLE["sniffed_orders"] = ORACLE["normalized_headers"]
ORACLE["csv_export"] = with_tx("""
SELECT concat_ws(',', order_id, order_date, customer, segment, region, product, margin) AS line FROM listing""", LISTING_CTE)

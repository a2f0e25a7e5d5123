"""SQL texts equivalent to the registered queries, for an independent engine (DuckDB).

Rounding goes through DECIMAL so that a value such as 0.145 rounds half up, as Spark does.
"""

from __future__ import annotations

from ..schema import CORRELATED_COLUMNS, CORRELATED_COLUMNS_SHORT, CORRELATED_COLUMNS_WIDE, DESCRIBED_COLUMNS, OUTLIER_COLUMNS_A

LAST_COMPLETE_MONTH = "2001-07"
MONTH_CUTOFF = "2001-07-31"
WEEK_CUTOFF = "2001-07-29"

FACT = """
base AS (
  SELECT *, date_diff('day', o_orderdate, l_shipdate) AS ship_days,
    ((date_diff('day', o_orderdate, l_shipdate) % 7) + 7) % 7 AS real_days,
    CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 4 END AS sched_days,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS sales,
    CAST(l_quantity AS BIGINT) AS qty,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS disc,
    CAST(p_retailprice AS DECIMAL(18,2)) AS price
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN part ON l_partkey = p_partkey
),
orders_fact AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_card_id,
    o_custkey AS order_customer_id, o_custkey AS customer_id, sales,
    qty AS order_item_quantity, l_discount + 0.0 AS order_item_discount_rate, disc AS order_item_discount,
    price AS product_price, CAST(sales - disc - qty * price AS DECIMAL(18,4)) AS benefit_per_order,
    CAST(sales - disc - qty * price AS DOUBLE) / CAST(sales AS DOUBLE) AS order_item_profit_ratio,
    o_orderdate AS order_date, l_shipdate AS shipping_date,
    CAST(real_days AS INTEGER) AS days_for_shipping_real, sched_days AS days_for_shipment_scheduled,
    CAST(real_days - sched_days AS INTEGER) AS shipping_delay_days,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Same Day' WHEN '2-HIGH' THEN 'First Class'
      WHEN '3-MEDIUM' THEN 'Second Class' ELSE 'Standard Class' END AS shipping_mode,
    CASE WHEN l_orderkey % 50 = 0 THEN 'CANCELED' WHEN l_orderkey % 50 = 1 THEN 'SUSPECTED_FRAUD'
      WHEN o_orderstatus = 'F' THEN 'COMPLETE' WHEN o_orderstatus = 'O' THEN 'PENDING'
      ELSE 'PROCESSING' END AS order_status,
    CASE WHEN l_orderkey % 50 IN (0, 1) THEN 'Shipping canceled' WHEN real_days > sched_days THEN 'Late delivery'
      WHEN real_days = sched_days THEN 'Shipping on time' ELSE 'Advance shipping' END AS delivery_status,
    CASE WHEN real_days > sched_days THEN 1 ELSE 0 END AS late_delivery_risk,
    CASE WHEN l_orderkey % 50 NOT IN (0, 1) AND real_days > sched_days THEN 1 ELSE 0 END AS is_late,
    c_mktsegment AS customer_segment, n_name AS order_region, n_name AS order_country, r_name AS market,
    p_brand AS category_name, p_type AS department_name, p_name AS product_name, l_returnflag AS type,
    strftime(o_orderdate, '%Y-%m') AS ym, dayname(o_orderdate) AS order_dow
  FROM base
)"""

RAW = (
    FACT
    + """,
raw AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_card_id,
    o_custkey AS order_customer_id, l_discount + 0.0 AS order_item_discount_rate, disc AS order_item_discount,
    price AS product_price, CAST(sales - disc - qty * price AS DECIMAL(18,4)) AS benefit_per_order,
    sched_days AS days_for_shipment_scheduled,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Same Day' WHEN '2-HIGH' THEN 'First Class'
      WHEN '3-MEDIUM' THEN 'Second Class' ELSE 'Standard Class' END AS shipping_mode,
    CASE WHEN l_orderkey % 50 = 0 THEN 'CANCELED' WHEN l_orderkey % 50 = 1 THEN 'SUSPECTED_FRAUD'
      WHEN o_orderstatus = 'F' THEN 'COMPLETE' WHEN o_orderstatus = 'O' THEN 'PENDING'
      ELSE 'PROCESSING' END AS order_status,
    CASE WHEN l_orderkey % 50 IN (0, 1) THEN 'Shipping canceled' WHEN real_days > sched_days THEN 'Late delivery'
      WHEN real_days = sched_days THEN 'Shipping on time' ELSE 'Advance shipping' END AS delivery_status,
    CASE WHEN real_days > sched_days THEN 1 ELSE 0 END AS late_delivery_risk,
    c_mktsegment AS customer_segment, r_name AS market, p_type AS department_name, p_name AS product_name,
    l_returnflag AS type,
    CASE WHEN l_orderkey % 503 = 3 THEN -sales ELSE sales END AS sales,
    CASE WHEN l_orderkey % 509 = 5 THEN 0 WHEN l_orderkey % 509 = 6 THEN -1 ELSE qty END AS order_item_quantity,
    CAST(ship_days AS INTEGER) AS days_for_shipping_real,
    CASE WHEN l_linenumber % 3 = 0 THEN '  ' || n_name || ' ' ELSE n_name END AS order_region,
    CASE WHEN l_linenumber % 2 = 0 THEN p_brand || ' ' ELSE p_brand END AS category_name,
    CASE WHEN l_orderkey % 211 = 0 THEN 'unknown'
      WHEN l_orderkey % 2 = 0 THEN strftime(o_orderdate, '%-m/%-d/%Y %-H:%M')
      ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS order_date,
    CASE WHEN l_orderkey % 223 = 0 THEN '' ELSE strftime(l_shipdate, '%-m/%-d/%Y %-H:%M') END AS shipping_date,
    CASE WHEN o_custkey % 97 = 0 THEN NULL ELSE CAST(10000 + o_custkey % 80000 AS DOUBLE) END AS customer_zipcode,
    c_name AS customer_fname,
    CASE WHEN l_orderkey % 7 = 0 THEN CAST(10000 + l_orderkey % 80000 AS DOUBLE) END AS order_zipcode
  FROM base, LATERAL (SELECT unnest(range(CASE WHEN l_orderkey % 101 = 7 THEN 2 ELSE 1 END)) AS copy)
)"""
)


def on_fact(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([FACT, *ctes]) + "\n" + body


def on_raw(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([RAW, *ctes]) + "\n" + body


def r(expression: str, digits: int = 2) -> str:
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(38,14)), {digits}) AS DOUBLE)"


def share(part: str, whole: str, digits: int = 2) -> str:
    return r(f"100.0::DOUBLE * CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0)", digits)


def quot(part: str, whole: str, digits: int = 2) -> str:
    return r(f"CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0)", digits)


DIM_PRODUCT = "dimp AS (SELECT DISTINCT product_card_id, product_name, category_name, department_name, product_price FROM orders_fact)"
DIM_CUSTOMER = "dimc AS (SELECT DISTINCT customer_id, customer_segment FROM orders_fact)"
MONTHS = "months AS (SELECT ym, sum(sales) AS s FROM orders_fact GROUP BY ym)"
LATE = "count(*) FILTER (WHERE late_delivery_risk = 1)"
CLEAN_DATES = """
  COALESCE(try_strptime({c}, '%m/%d/%Y %H:%M'), try_strptime({c}, '%Y-%m-%d %H:%M:%S'), try_strptime({c}, '%Y-%m-%d'))"""


def _dates(column: str) -> str:
    return CLEAN_DATES.format(c=column).strip()


def _checks(check: str, items: list[tuple[str, str]], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{check}' AS \"check\", '{name}' AS column_name, CAST({value} AS DOUBLE) AS value FROM {source}"
        for name, value in items
    )


RAW_NAMES = (
    "order_id line_no product_card_id order_customer_id order_item_discount_rate order_item_discount product_price"
    " benefit_per_order days_for_shipment_scheduled shipping_mode order_status delivery_status late_delivery_risk"
    " customer_segment market department_name product_name type sales order_item_quantity days_for_shipping_real"
    " order_region category_name order_date shipping_date customer_zipcode customer_fname order_zipcode"
).split()
DROPPED = ("customer_fname", "order_zipcode")
SLIM_NAMES = [c for c in RAW_NAMES if c not in DROPPED]


def _deduped(zip_fill: int) -> str:
    names = ", ".join(
        f"CAST(COALESCE(customer_zipcode, {zip_fill}) AS INTEGER) AS customer_zipcode" if c == "customer_zipcode" else c
        for c in SLIM_NAMES
    )
    return f"uniq AS (SELECT DISTINCT {names} FROM raw)"


DECIMALS = ("sales", "order_item_discount", "product_price", "benefit_per_order")
TRIMMED = ("shipping_mode", "order_status", "delivery_status", "customer_segment", "market", "department_name", "type", "order_region", "category_name")


def _prepared(clip: bool, valid_only: bool) -> str:
    parts = []
    for c in SLIM_NAMES:
        if c in TRIMMED:
            parts.append(f"trim({c}) AS {c}")
        elif c in ("order_date", "shipping_date"):
            parts.append(f"{_dates(c)} AS {c}")
        elif c == "days_for_shipping_real" and clip:
            parts.append(f"CASE WHEN {c} < 0 THEN 0 ELSE {c} END AS {c}")
        elif c in DECIMALS:
            parts.append(f"CAST({c} AS DOUBLE) AS {c}")
        else:
            parts.append(c)
    where = " WHERE sales >= 0 AND order_item_quantity > 0" if valid_only else ""
    return f"prep AS (SELECT {', '.join(parts)} FROM uniq{where})"


def _fences(source: str, columns: tuple[str, ...]) -> str:
    parts = []
    for c in columns:
        q1, q3 = (f"quantile_cont(CAST({c} AS DOUBLE), {p})" for p in (0.25, 0.75))
        parts.append(f"{q1} - 1.5 * ({q3} - {q1}) AS lo_{c}, {q3} + 1.5 * ({q3} - {q1}) AS hi_{c}")
    return f"fences AS (SELECT {', '.join(parts)} FROM {source})"


def _outside(c: str) -> str:
    return f"COALESCE(CAST({c} AS DOUBLE) < lo_{c} OR CAST({c} AS DOUBLE) > hi_{c}, FALSE)"


CLEAN_A = [
    _deduped(-1),
    _prepared(clip=True, valid_only=False),
    _fences("prep", OUTLIER_COLUMNS_A),
    "cleaned AS (SELECT prep.*, order_status IN ('CANCELED','SUSPECTED_FRAUD') AS is_cancelled_or_fraud, "
    + ", ".join(f"{_outside(c)} AS outlier_{c}" for c in OUTLIER_COLUMNS_A)
    + """, CAST(year(order_date) AS INTEGER) AS order_year, CAST(month(order_date) AS INTEGER) AS order_month,
      strftime(order_date, '%Y-%m') AS order_year_month, dayname(order_date) AS order_dow,
      days_for_shipping_real - days_for_shipment_scheduled AS shipping_delay_days
    FROM prep, fences)""",
]
OUTLIERS_B = ("sales", "order_item_quantity", "days_for_shipping_real", "benefit_per_order")
WEEK = "strftime(CAST(date_trunc('week', order_date) AS DATE), '%Y-%m-%d') || '/' || strftime(CAST(date_trunc('week', order_date) AS DATE) + 6, '%Y-%m-%d')"
CLEAN_B = [
    _deduped(0),
    _prepared(clip=False, valid_only=True),
    _fences("prep", OUTLIERS_B),
    "cleaned AS (SELECT prep.*, "
    + ", ".join(f"{_outside(c)} AS outlier_{c}" for c in OUTLIERS_B)
    + f""", CAST(year(order_date) AS INTEGER) AS order_year, strftime(order_date, '%Y-%m') AS order_month,
      COALESCE({WEEK}, '') AS order_week, strftime(order_date, '%Y-%m') AS order_yyyymm,
      CASE WHEN delivery_status = 'Late delivery' THEN 1 ELSE 0 END AS is_late,
      CASE WHEN order_status IN ('CANCELED','SUSPECTED_FRAUD') THEN 1 ELSE 0 END AS is_cancelled,
      days_for_shipping_real - days_for_shipment_scheduled AS shipping_delay_days
    FROM prep, fences)""",
]

# --- series ------------------------------------------------------------------------------

MONTH_GRID = """monthly AS (
  SELECT {key} AS series_key, CAST(date_trunc('month', order_date) AS DATE) AS period, CAST(sum(order_item_quantity) AS DOUBLE) AS u
  FROM orders_fact GROUP BY 1, 2),
series_all AS (
  SELECT g.series_key, g.period, COALESCE(m.u, 0) AS y
  FROM (SELECT series_key, CAST(unnest(generate_series(CAST(min(period) AS TIMESTAMP), (SELECT CAST(max(period) AS TIMESTAMP) FROM monthly), INTERVAL 1 MONTH)) AS DATE) AS period
        FROM monthly GROUP BY series_key) g
  LEFT JOIN monthly m ON m.series_key = g.series_key AND m.period = g.period)"""
WEEK_GRID = """weekly AS (
  SELECT {key} AS series_key, CAST(date_trunc('week', order_date) + INTERVAL 6 DAY AS DATE) AS period, CAST(sum(order_item_quantity) AS DOUBLE) AS u
  FROM orders_fact GROUP BY 1, 2),
series_all AS (
  SELECT g.series_key, g.period, COALESCE(w.u, 0) AS y
  FROM (SELECT series_key, CAST(unnest(generate_series(CAST(min(period) AS TIMESTAMP), (SELECT CAST(max(period) AS TIMESTAMP) FROM weekly), INTERVAL 7 DAY)) AS DATE) AS period
        FROM weekly GROUP BY series_key) g
  LEFT JOIN weekly w ON w.series_key = g.series_key AND w.period = g.period
  WHERE g.period < (SELECT max(period) FROM weekly))"""


def _split_ctes(key: str = "category_name") -> list[str]:
    return [
        MONTH_GRID.format(key=key),
        f"series AS (SELECT * FROM series_all WHERE period <= DATE '{MONTH_CUTOFF}')",
        "aged AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY period DESC) AS age FROM series)",
        "test AS (SELECT series_key, period, y, 7 - age AS step FROM aged WHERE age <= 6)",
        "naive AS (SELECT series_key, y AS y_hat FROM aged WHERE age = 7)",
        "ma AS (SELECT series_key, avg(y) AS y_hat FROM aged WHERE age BETWEEN 7 AND 10 GROUP BY series_key)",
        "pred AS (SELECT t.series_key, t.period, 'naive_last_value' AS model, t.y, n.y_hat FROM test t JOIN naive n USING (series_key)"
        " UNION ALL SELECT t.series_key, t.period, 'moving_average_4', t.y, m.y_hat FROM test t JOIN ma m USING (series_key))",
        f"acc AS (SELECT series_key, model, {r('avg(abs(y - y_hat))')} AS mae, {r('sqrt(avg((y - y_hat) * (y - y_hat)))')} AS rmse FROM pred GROUP BY 1, 2)",
    ]


# The six months after the last of each series.
AHEAD = """SELECT series_key, n, CAST(CAST(last AS TIMESTAMP) + to_months(CAST(h AS INTEGER)) AS DATE) AS period
  FROM (SELECT series_key, count(*) AS n, max(period) AS last FROM series GROUP BY 1), (SELECT unnest(range(1, 7)) AS h)"""


def _both_series() -> list[str]:
    """Complete months of all categories and of the total."""
    total = MONTH_GRID.format(key="'all'").replace("monthly", "monthly_total").replace("series_all", "total_all")
    cut = f"WHERE period <= DATE '{MONTH_CUTOFF}'"
    both = f"series AS (SELECT * FROM series_all {cut} UNION ALL SELECT * FROM total_all {cut})"
    return [MONTH_GRID.format(key="category_name"), total, both]


SCORED = """scored AS (SELECT 'fixed_rule' AS model, late_delivery_risk AS label,
  CAST((4 - days_for_shipment_scheduled) * 100 + order_item_quantity AS BIGINT) AS score,
  CASE WHEN (4 - days_for_shipment_scheduled) * 100 + order_item_quantity >= 150 THEN 1 ELSE 0 END AS prediction FROM orders_fact)"""
CONFUSION = """conf AS (SELECT CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS DOUBLE) AS tp,
  CAST(count(*) FILTER (WHERE label = 0 AND prediction = 1) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE label = 1 AND prediction = 0) AS DOUBLE) AS fn,
  CAST(count(*) FILTER (WHERE label = 0 AND prediction = 0) AS DOUBLE) AS tn FROM scored)"""
AUC = """ranked AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM scored),
auc AS (SELECT (sum(rk) FILTER (WHERE label = 1) - CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) * (count(*) FILTER (WHERE label = 1) + 1) / 2)
  / (CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) * count(*) FILTER (WHERE label = 0)) AS v FROM ranked)"""
METRICS = [
    ("accuracy", r("(tp + tn) / (tp + fp + fn + tn)", 4)),
    ("precision", r("COALESCE(tp / NULLIF(tp + fp, 0), 0)", 4)),
    ("recall", r("COALESCE(tp / NULLIF(tp + fn, 0), 0)", 4)),
    ("f1_score", r("COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0)", 4)),
]
IDENTITY_TEXT = (
    "'42|' || order_id || '|' || line_no || '|' || product_card_id || '|' || order_item_quantity || '|' || sales"
    " || '|' || order_item_discount || '|' || strftime(shipping_date, '%Y-%m-%d %H:%M:%S')"
)
BUCKETED = f"""bucketed AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY late_delivery_risk ORDER BY
  CAST('0x' || substr(md5({IDENTITY_TEXT}), 1, 15) AS BIGINT)) <= (count(*) OVER (PARTITION BY late_delivery_risk)) * 20 // 100
  THEN 0 ELSE 99 END AS bucket FROM orders_fact)"""


def _report_row(name: str, precision: str, recall: str, f1: str, support: str) -> str:
    return (
        f"SELECT 'fixed_rule' AS model, '{name}' AS class, {r(precision, 4)} AS \"precision\", {r(recall, 4)} AS recall,"
        f" {r(f1, 4)} AS f1_score, CAST({support} AS BIGINT) AS support FROM per_class"
    )


def _corr(columns: tuple[str, ...], digits: int) -> str:
    cells = []
    for a in columns:
        for b in columns:
            cells.append(
                f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))', digits)} AS r FROM wide"
            )
    names = ", ".join(columns)
    return on_fact(" UNION ALL ".join(cells), f"wide AS MATERIALIZED (SELECT {names} FROM orders_fact)")


def _describe(c: str) -> str:
    v = f"CAST({c} AS DOUBLE)"
    return (
        f"SELECT '{c}' AS column_name, count({c}) AS count, {r(f'avg({v})')} AS mean, {r(f'stddev_samp({v})')} AS std,"
        f" {r(f'min({v})')} AS min, {r(f'quantile_cont({v}, 0.25)')} AS p25, {r(f'quantile_cont({v}, 0.5)')} AS p50,"
        f" {r(f'quantile_cont({v}, 0.75)')} AS p75, {r(f'max({v})')} AS max FROM orders_fact"
    )


def _histogram(column: str, bins: int) -> str:
    return on_fact(
        f"""SELECT CAST(b.bin AS BIGINT) AS bin, {r('lo + b.bin * w', 6)} AS lo, {r('lo + (b.bin + 1) * w', 6)} AS hi,
          CAST(COALESCE(c.n, 0) AS BIGINT) AS n
        FROM (SELECT unnest(range({bins})) AS bin) b CROSS JOIN lim LEFT JOIN c ON c.bin = b.bin""",
        f"lim AS (SELECT min(CAST({column} AS DOUBLE)) AS lo, (max(CAST({column} AS DOUBLE)) - min(CAST({column} AS DOUBLE))) / {bins} AS w FROM orders_fact)",
        f"c AS (SELECT least(CAST(floor((CAST({column} AS DOUBLE) - lo) / w) AS BIGINT), {bins - 1}) AS bin, count(*) AS n FROM orders_fact, lim GROUP BY 1)",
    )


def _boxplot(column: str, by: str | None) -> str:
    key, group, on = (f"{by}, ", f" GROUP BY {by}", f"USING ({by})") if by else ("", "", "ON TRUE")
    return on_fact(
        f"""SELECT {key}min(v) AS min, any_value(q1) AS q1, any_value(q2) AS median, any_value(q3) AS q3, max(v) AS max,
          min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_lo,
          max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_hi,
          count(*) FILTER (WHERE v NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
        FROM vals JOIN box {on}{group}""",
        f"vals AS (SELECT {key}CAST({column} AS DOUBLE) AS v FROM orders_fact)",
        f"box AS (SELECT {key}quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM vals{group})",
    )


def _growth(n: int) -> str:
    return (
        f"SELECT {n} AS drop_tail_months, min(ym) AS first_month, max(ym) AS last_month, {r('min_by(s, ym)')} AS first_month_sales,"
        f" {r('max_by(s, ym)')} AS last_month_sales, {share('max_by(s, ym) - min_by(s, ym)', 'min_by(s, ym)')} AS sales_growth_pct"
        f" FROM (SELECT *, row_number() OVER (ORDER BY ym DESC) AS age FROM months) WHERE age > {n}"
    )


def _top(column: str) -> str:
    return f"SELECT {column}, sum(sales) AS s, sum(sum(sales)) OVER () AS t FROM orders_fact GROUP BY {column} ORDER BY s DESC, {column} LIMIT 1"


def _top_share(column: str) -> str:
    return on_fact(f"SELECT {column}, {r('s')} AS sales, {share('s', 't')} AS revenue_share_pct FROM top", f"top AS ({_top(column)})")


def _demand(key: str, zero_fill: bool = True) -> list[str]:
    filled = (
        "SELECT p.k, m.ym, COALESCE(c.u, 0) AS u FROM (SELECT DISTINCT k FROM cells) p CROSS JOIN (SELECT DISTINCT ym FROM cells) m"
        " LEFT JOIN cells c ON c.k = p.k AND c.ym = m.ym"
        if zero_fill
        else "SELECT k, ym, u FROM cells"
    )
    return [
        f"cells AS (SELECT {key} AS k, ym, sum(order_item_quantity) AS u FROM orders_fact WHERE ym <= '{LAST_COMPLETE_MONTH}' GROUP BY 1, 2)",
        f"filled AS ({filled})",
        f"""profile AS (SELECT k AS {key}, {quot('sum(u)', '(SELECT count(DISTINCT ym) FROM cells)')} AS avg_units_per_month,
          {r('stddev_samp(u) / NULLIF(avg(u), 0)', 3)} AS demand_coefficient_of_variation, CAST(sum(u) AS BIGINT) AS total_units_sold
          FROM filled GROUP BY k HAVING stddev_samp(u) / NULLIF(avg(u), 0) IS NOT NULL)""",
    ]


def _bands(value: str, probabilities: tuple[float, ...], labels: tuple[str, ...], source: str) -> str:
    chain = " ".join(
        f"WHEN {value} <= (SELECT quantile_cont(CAST({value} AS DOUBLE), {p}) FROM {source}) THEN '{label}'"
        for p, label in zip(probabilities, labels)
    )
    return f"CASE {chain} ELSE '{labels[-1]}' END"


MOVERS = ("Slow Mover", "Medium Mover", "Fast Mover")
MOVER_BAND = _bands("avg_units_per_month", (0.33, 0.66), MOVERS, "profile")
RISK_BAND = _bands("demand_coefficient_of_variation", (0.66,), ("Lower Variability", "High Variability (Higher Risk Proxy)"), "profile")
PRODUCT_CV = [
    """cv AS (SELECT product_name, stddev_samp(u) / avg(u) AS c FROM
      (SELECT product_name, ym, sum(order_item_quantity) AS u FROM orders_fact GROUP BY 1, 2) GROUP BY 1)""",
    f"""prod AS (SELECT f.product_name, CAST(sum(order_item_quantity) AS BIGINT) AS total_qty_sold, {r('sum(sales)')} AS total_sales,
      count(DISTINCT order_id) AS n_orders, COALESCE({r('any_value(c)')}, 0) AS demand_cv
      FROM orders_fact f LEFT JOIN cv USING (product_name) GROUP BY f.product_name)""",
    f"banded AS (SELECT *, {_bands('total_qty_sold', (0.3, 0.7), MOVERS, 'prod')} AS mover_class FROM prod)",
    """flagged AS (SELECT *, CASE WHEN mover_class = 'Fast Mover' AND demand_cv > (SELECT quantile_cont(demand_cv, 0.5) FROM prod)
      THEN 'High (fast-moving + volatile demand)' ELSE 'Lower' END AS stockout_risk_flag FROM banded)""",
]

_KPI_COMMON = f"""{r('sum(sales)')} AS total_revenue, count(DISTINCT order_id) AS total_orders,
  CAST(sum(order_item_quantity) AS BIGINT) AS total_units_sold, {quot('sum(sales)', 'count(DISTINCT order_id)')} AS average_order_value,
  {r('avg(days_for_shipping_real)')} AS average_delivery_time_days"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    # sources and sinks
    stored = "order_id, line_no, product_card_id, sales, order_item_quantity, order_date, order_region, days_for_shipping_real"
    q["read_csv_raw"] = on_raw(
        "SELECT order_id, product_card_id, order_date, order_region, sales, customer_zipcode, customer_fname FROM raw"
    )
    q["read_csv_clean"] = on_fact(f"SELECT {stored}, CAST(year(order_date) AS INTEGER) AS order_year FROM orders_fact")
    q["read_parquet_clean"] = on_fact(
        "SELECT CAST(year(order_date) AS INTEGER) AS order_year, count(*) AS n, CAST(sum(sales) AS DOUBLE) AS sales,"
        " CAST(sum(order_item_quantity) AS BIGINT) AS units FROM orders_fact GROUP BY 1"
    )
    q["write_clean"] = on_fact(
        "SELECT form, CAST(year(order_date) AS INTEGER) AS order_year, count(*) AS n, CAST(sum(sales) AS DOUBLE) AS sales"
        " FROM orders_fact, (VALUES ('csv'), ('parquet')) AS t(form) GROUP BY 1, 2"
    )
    q["fact_view"] = on_fact(
        "SELECT market, count(*) AS n, count(DISTINCT order_id) AS orders, CAST(sum(sales) AS DOUBLE) AS sales"
        " FROM orders_fact GROUP BY market"
    )
    q["dim_product"] = on_fact(
        "SELECT * REPLACE (CAST(product_price AS DOUBLE) AS product_price) FROM dimp", DIM_PRODUCT
    )
    q["dim_customer"] = on_fact("SELECT * FROM dimc", DIM_CUSTOMER)
    q["dim_date"] = """SELECT CAST(d AS DATE) AS date, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
      strftime(d, '%Y-%m') AS year_month
      FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d
            FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""
    q["dim_key_check"] = on_fact(
        "SELECT product_name, count(*) AS n_versions FROM dimp GROUP BY product_name HAVING count(*) > 1", DIM_PRODUCT
    )
    q["monthly_kpi"] = on_fact(
        f"""SELECT ym AS order_year_month, {r('sum(sales)')} AS revenue, count(DISTINCT order_id) AS orders,
        CAST(sum(order_item_quantity) AS BIGINT) AS units, count(*) AS n_line_items, {share(LATE, 'count(*)')} AS late_pct
        FROM orders_fact GROUP BY ym"""
    )

    # cleaning and quality
    q["dq_shape"] = on_raw(_checks("shape", [("rows", "(SELECT count(*) FROM raw)"), ("columns", str(len(RAW_NAMES)))], "(SELECT 1)"))
    q["dq_grain_check"] = on_fact(
        _checks(
            "grain",
            [
                ("n_rows", "n"),
                ("n_unique_orders", "o"),
                ("n_unique_line_keys", "k"),
                ("overstatement_pct", r("(n / CAST(o AS DOUBLE) - 1) * 100", 1)),
                ("avg_items_per_order", quot("n", "o", 3)),
            ],
            "g",
        ),
        "g AS (SELECT count(*) AS n, count(DISTINCT order_id) AS o, (SELECT count(*) FROM (SELECT DISTINCT order_id, line_no FROM orders_fact)) AS k FROM orders_fact)",
    )
    q["dq_missing_values"] = on_raw(
        f"SELECT * FROM ({_checks('missing_values', [(c, f'(SELECT count(*) FROM raw WHERE {c} IS NULL)') for c in RAW_NAMES], '(SELECT 1)')}) WHERE value > 0"
    )
    q["clean_drop_columns"] = on_raw("SELECT order_id, line_no, product_card_id FROM raw")
    q["clean_fill_nulls"] = on_raw(
        "SELECT order_id, line_no, product_card_id, CAST(COALESCE(customer_zipcode, -1) AS INTEGER) AS customer_zipcode FROM raw"
    )
    q["dq_duplicate_rows"] = on_raw(
        _checks(
            "duplicate_rows",
            [("all_columns", "(SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw))")],
            "(SELECT 1)",
        )
    )
    q["clean_dedupe"] = on_raw(
        "SELECT * REPLACE (CAST(sales AS DOUBLE) AS sales) FROM"
        " (SELECT DISTINCT order_id, line_no, product_card_id, sales, order_item_quantity, order_date, order_region FROM raw)"
    )
    q["order_level_view"] = on_fact(
        """SELECT order_id, line_no, product_card_id, CAST(sales AS DOUBLE) AS sales, order_item_quantity, shipping_date, order_status
        FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY line_no, product_card_id, sales, order_item_quantity, shipping_date) AS rn
              FROM orders_fact) WHERE rn = 1"""
    )
    q["clean_parse_dates"] = on_raw(
        f"SELECT order_id, line_no, product_card_id, {_dates('order_date')} AS order_date, {_dates('shipping_date')} AS shipping_date FROM raw"
    )
    q["dq_unparseable_dates"] = on_raw(
        _checks("unparseable_dates", [("order_date", "o"), ("shipping_date", "s"), ("total", "o + s")], "d"),
        f"d AS (SELECT count(*) FILTER (WHERE {_dates('order_date')} IS NULL) AS o, count(*) FILTER (WHERE {_dates('shipping_date')} IS NULL) AS s FROM raw)",
    )
    for name, op in (("dq_invalid_numeric", "<"), ("dq_invalid_numeric_strict", "<=")):
        conditions = [("sales", "<"), ("order_item_quantity", op), ("product_price", "<"), ("days_for_shipping_real", "<")]
        q[name] = on_raw(
            _checks("invalid_numeric", [(c, f"(SELECT count(*) FROM raw WHERE {c} {o} 0)") for c, o in conditions], "(SELECT 1)")
        )
    q["clean_filter_valid"] = on_raw(
        "SELECT order_id, line_no, product_card_id, CAST(sales AS DOUBLE) AS sales, order_item_quantity FROM raw"
        " WHERE sales >= 0 AND order_item_quantity > 0"
    )
    q["clean_clip_days"] = on_raw(
        "SELECT order_id, line_no, product_card_id, CASE WHEN days_for_shipping_real < 0 THEN 0 ELSE days_for_shipping_real END"
        " AS days_for_shipping_real FROM raw"
    )
    q["clean_trim_text"] = on_raw(
        "SELECT order_id, line_no, product_card_id, trim(order_region) AS order_region, trim(category_name) AS category_name FROM raw"
    )
    q["dq_status_counts"] = on_fact(
        "SELECT 'order_status' AS column_name, order_status AS status, count(*) AS n FROM orders_fact GROUP BY 2"
        " UNION ALL SELECT 'delivery_status', delivery_status, count(*) FROM orders_fact GROUP BY 2"
    )
    q["flag_cancelled"] = on_fact(
        "SELECT order_id, line_no, product_card_id, order_status,"
        " order_status IN ('CANCELED','SUSPECTED_FRAUD') AS is_cancelled_or_fraud FROM orders_fact"
    )
    q["flag_iqr_outliers"] = on_fact(
        "SELECT order_id, line_no, product_card_id, "
        + ", ".join(f"{_outside(c)} AS outlier_{c}" for c in OUTLIER_COLUMNS_A)
        + " FROM orders_fact, fences",
        _fences("orders_fact", OUTLIER_COLUMNS_A),
    )
    q["iqr_outlier_summary"] = on_fact(
        f"""SELECT 'benefit_per_order' AS column_name, {r('any_value(lo_benefit_per_order)')} AS lower_bound,
        {r('any_value(hi_benefit_per_order)')} AS upper_bound,
        count(*) FILTER (WHERE {_outside('benefit_per_order')}) AS n_outliers,
        {share(f"count(*) FILTER (WHERE {_outside('benefit_per_order')})", 'count(*)')} AS pct_outliers
        FROM orders_fact, fences""",
        _fences("orders_fact", ("benefit_per_order",)),
    )
    flagged = (*OUTLIER_COLUMNS_A, "benefit_per_order")
    q["outlier_rates"] = on_fact(
        " UNION ALL ".join(
            f"SELECT 'outlier_{c}' AS column_name, {share(f'count(*) FILTER (WHERE {_outside(c)})', 'count(*)')} AS outlier_rate_pct FROM orders_fact, fences"
            for c in flagged
        ),
        _fences("orders_fact", flagged),
    )
    q["derive_calendar"] = on_fact(
        f"""SELECT order_id, line_no, product_card_id, order_date, CAST(year(order_date) AS INTEGER) AS order_year,
        CAST(month(order_date) AS INTEGER) AS order_month, ym AS order_year_month, order_dow, {WEEK} AS order_week,
        ym AS order_yyyymm FROM orders_fact"""
    )
    q["derive_dow_monthnum"] = on_fact(
        "SELECT order_id, line_no, product_card_id, order_date, CAST(isodow(order_date) - 1 AS INTEGER) AS order_dow_num,"
        " CAST(month(order_date) AS INTEGER) AS order_month_num FROM orders_fact"
    )
    q["derive_is_late"] = on_fact("SELECT order_id, line_no, product_card_id, delivery_status, is_late FROM orders_fact")
    q["derive_delay_days"] = on_fact(
        "SELECT order_id, line_no, product_card_id, days_for_shipping_real, days_for_shipment_scheduled, shipping_delay_days FROM orders_fact"
    )
    q["clean_run"] = on_raw("SELECT * FROM cleaned", *CLEAN_A)
    q["clean_run_alt"] = on_raw("SELECT * FROM cleaned", *CLEAN_B)
    q["clean_refresh"] = on_raw(
        """SELECT order_year, coalesce(order_year > 1997, FALSE) AS rewritten, count(*) AS n, CAST(sum(CAST(sales AS DECIMAL(18,2))) AS DOUBLE) AS sales,
        count(*) FILTER (WHERE is_cancelled_or_fraud) AS cancelled FROM cleaned GROUP BY 1, 2""",
        *CLEAN_A,
    )
    slim = ", ".join(SLIM_NAMES)
    def log(a: bool) -> list[str]:
        return [
            _checks("raw_shape", [("rows", "(SELECT count(*) FROM raw)"), ("columns", str(len(RAW_NAMES)))], "(SELECT 1)"),
            _checks(
                "grain",
                [
                    ("n_rows", "n"),
                    ("n_unique_orders", "o"),
                    ("n_unique_line_keys", "k"),
                    ("overstatement_pct", r("(n / CAST(o AS DOUBLE) - 1) * 100", 1)),
                    ("avg_items_per_order", quot("n", "o", 3)),
                ],
                "(SELECT count(*) AS n, count(DISTINCT order_id) AS o, (SELECT count(*) FROM (SELECT DISTINCT order_id, line_no FROM raw)) AS k FROM raw)",
            ),
            f"SELECT * FROM ({_checks('missing_values', [(c, f'(SELECT count(*) FROM raw WHERE {c} IS NULL)') for c in (RAW_NAMES if a else SLIM_NAMES)], '(SELECT 1)')}) WHERE value > 0",
            _checks(
                "duplicate_rows",
                [("all_columns", f"(SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT {slim} FROM raw))")],
                "(SELECT 1)",
            ),
            _checks(
                "unparseable_dates",
                [("order_date", "o"), ("shipping_date", "s"), ("total", "o + s")],
                f"(SELECT count(*) FILTER (WHERE {_dates('order_date')} IS NULL) AS o, count(*) FILTER (WHERE {_dates('shipping_date')} IS NULL) AS s FROM uniq)",
            ),
            _checks(
                "invalid_numeric",
                [(c, f"(SELECT count(*) FROM uniq WHERE {c} {'<' if a or c != 'order_item_quantity' else '<='} 0)") for c in ("sales", "order_item_quantity", "product_price", "days_for_shipping_real")],
                "(SELECT 1)",
            ),
            _checks("cancelled_or_fraud_rows", [("order_status", "(SELECT count(*) FROM cleaned WHERE order_status IN ('CANCELED','SUSPECTED_FRAUD'))")], "(SELECT 1)"),
            "SELECT 'order_status', order_status, CAST(count(*) AS DOUBLE) FROM cleaned GROUP BY 2",
            "SELECT 'delivery_status', delivery_status, CAST(count(*) AS DOUBLE) FROM cleaned GROUP BY 2",
            _checks("iqr_outliers", [(c, f"(SELECT count(*) FROM cleaned WHERE outlier_{c})") for c in (OUTLIER_COLUMNS_A if a else OUTLIERS_B)], "(SELECT 1)"),
            _checks(
                "cleaned_shape",
                [("rows", "(SELECT count(*) FROM cleaned)"), ("columns", str(len(SLIM_NAMES) + (1 + 4 + 4 + 1 if a else 4 + 4 + 2 + 1)))],
                "(SELECT 1)",
            ),
        ]
    q["quality_log"] = on_raw(" UNION ALL ".join(log(True)), *CLEAN_A)
    q["quality_log_alt"] = on_raw(" UNION ALL ".join(log(False)), *CLEAN_B)

    # business queries
    q["q01_totals"] = on_fact(
        f"""SELECT {r('sum(sales)')} AS total_sales, count(DISTINCT order_id) AS total_orders,
        CAST(sum(order_item_quantity) AS BIGINT) AS total_units_sold,
        {quot('sum(sales)', 'count(DISTINCT order_id)')} AS avg_order_value FROM orders_fact"""
    )
    q["q02_top_products"] = on_fact(
        f"""SELECT category_name, product_name, {r('s')} AS product_sales, rank() OVER (ORDER BY s DESC) AS sales_rank
        FROM (SELECT d.category_name, d.product_name, sum(f.sales) AS s FROM dimp d
              JOIN orders_fact f ON d.product_card_id = f.product_card_id GROUP BY 1, 2)
        ORDER BY s DESC, category_name, product_name LIMIT 20""",
        DIM_PRODUCT,
    )
    q["q03_region_revenue"] = on_fact(
        f"SELECT order_region, {r('s')} AS region_sales, {share('s', 'sum(s) OVER ()')} AS pct_of_total_sales"
        " FROM (SELECT order_region, sum(sales) AS s FROM orders_fact GROUP BY 1)"
    )
    q["q04_segment_sales"] = on_fact(
        f"""SELECT customer_segment, {r('s')} AS segment_sales, n AS segment_orders, dense_rank() OVER (ORDER BY s DESC) AS segment_rank
        FROM (SELECT d.customer_segment, sum(f.sales) AS s, count(DISTINCT f.order_id) AS n FROM dimc d
              JOIN orders_fact f ON d.customer_id = f.order_customer_id GROUP BY 1)""",
        DIM_CUSTOMER,
    )
    q["q05_shipping_mode_mix"] = on_fact(
        f"SELECT shipping_mode, n AS n_line_items, {share('n', 'sum(n) OVER ()')} AS pct_of_line_items"
        " FROM (SELECT shipping_mode, count(*) AS n FROM orders_fact GROUP BY 1)"
    )
    q["q06_avg_shipping_duration"] = on_fact(
        f"""SELECT shipping_mode, {r('avg(days_for_shipping_real)')} AS avg_actual_days,
        {r('avg(days_for_shipment_scheduled)')} AS avg_scheduled_days, {r('avg(shipping_delay_days)')} AS avg_delay_days
        FROM orders_fact GROUP BY 1"""
    )
    q["q07_pct_late"] = on_fact(
        f"SELECT count(*) AS total_line_items, {LATE} AS late_line_items, {share(LATE, 'count(*)')} AS pct_late FROM orders_fact"
    )
    q["q08_region_late_rate"] = on_fact(
        f"""SELECT * FROM (SELECT order_region, count(*) AS n_line_items, {share(LATE, 'count(*)')} AS late_delivery_rate_pct
        FROM orders_fact GROUP BY 1) WHERE n_line_items > 500 ORDER BY late_delivery_rate_pct DESC, order_region LIMIT 10"""
    )
    q["q09_high_sales_late_products"] = on_fact(
        f"""SELECT * FROM (SELECT d.product_name, {r('sum(f.sales)')} AS total_sales, {share(LATE, 'count(*)')} AS late_rate_pct,
          count(*) AS n_line_items FROM orders_fact f JOIN dimp d USING (product_card_id) GROUP BY 1)
        WHERE late_rate_pct > 50 AND total_sales > (SELECT CAST(sum(sales) AS DOUBLE) / count(DISTINCT product_card_id) FROM orders_fact)
        ORDER BY total_sales DESC, product_name LIMIT 15""",
        DIM_PRODUCT,
    )
    q["q10_mom_growth"] = on_fact(
        f"""SELECT ym AS order_month, {r('s')} AS total_sales, {r('p')} AS prev_month_sales, {share('s - p', 'p')} AS mom_growth_pct
        FROM (SELECT ym, s, lag(s) OVER (ORDER BY ym) AS p FROM months)""",
        MONTHS,
    )
    q["q11_top3_per_category"] = on_fact(
        f"""SELECT category_name, product_name, {r('s')} AS total_sales, rn FROM (
          SELECT *, row_number() OVER (PARTITION BY category_name ORDER BY s DESC, product_name) AS rn
          FROM (SELECT d.category_name, d.product_name, sum(f.sales) AS s FROM orders_fact f JOIN dimp d USING (product_card_id) GROUP BY 1, 2))
        WHERE rn <= 3""",
        DIM_PRODUCT,
    )
    q["q12_cumulative_revenue"] = on_fact(
        f"""SELECT ym AS order_month, {r('s')} AS total_sales,
        {r('sum(s) OVER (ORDER BY ym ROWS UNBOUNDED PRECEDING)')} AS cumulative_sales,
        {r('lead(s) OVER (ORDER BY ym)')} AS next_month_sales FROM months""",
        MONTHS,
    )
    q["query_preview"] = on_fact(
        f"""SELECT order_region, {r('s')} AS region_sales, {share('s', 't')} AS pct_of_total_sales
        FROM (SELECT order_region, sum(sales) AS s, sum(sum(sales)) OVER () AS t FROM orders_fact GROUP BY 1)
        ORDER BY s DESC, order_region LIMIT 15"""
    )

    # indicators
    q["kpi_summary"] = on_fact(
        f"""SELECT k.*, g.sales_growth_pct AS sales_growth_rate_pct_first_vs_last_complete_month,
        c.category_name AS top_category, {share('c.s', 'c.t')} AS top_category_revenue_share_pct,
        rg.order_region AS top_region, {share('rg.s', 'rg.t')} AS top_region_revenue_share_pct,
        d.department_name AS top_department_proxy_supplier
        FROM (SELECT {_KPI_COMMON}, {share('count(*) FILTER (WHERE late_delivery_risk = 0)', 'count(*)')} AS on_time_delivery_rate_pct,
          {share(LATE, 'count(*)')} AS late_delivery_rate_pct,
          {share("count(*) FILTER (WHERE order_status = 'CANCELED')", 'count(*)')} AS cancellation_rate_pct FROM orders_fact) k,
          ({_growth(4)}) g, ({_top('category_name')}) c, ({_top('order_region')}) rg, ({_top('department_name')}) d""",
        MONTHS,
    )
    q["write_json_results"] = q["kpi_summary"]
    on_time = "count(*) FILTER (WHERE delivery_status IN ('Shipping on time', 'Advance shipping'))"
    canceled_orders = "count(DISTINCT CASE WHEN order_status = 'CANCELED' THEN order_id END)"
    q["kpi_summary_alt"] = on_fact(
        f"""SELECT k.*, g.sales_growth_pct AS sales_growth_rate_pct_first_vs_last_month,
        c.category_name AS top_category, rg.order_region AS top_region
        FROM (SELECT {_KPI_COMMON}, {quot('sum(order_item_discount)', 'count(order_item_discount)')} AS average_discount_per_item,
          {share(on_time, 'count(*)')} AS on_time_delivery_rate_pct, {share('sum(is_late)', 'count(*)')} AS late_delivery_rate_pct,
          {share(canceled_orders, 'count(DISTINCT order_id)')} AS cancellation_rate_pct FROM orders_fact) k,
          ({_growth(1)}) g, ({_top('category_name')}) c, ({_top('order_region')}) rg""",
        MONTHS,
    )
    on_time_rows = (
        f"SELECT 'risk_flag' AS definition, {share('count(*) FILTER (WHERE late_delivery_risk = 0)', 'count(*)')} AS value FROM orders_fact"
        f" UNION ALL SELECT 'delivery_status', {share(on_time, 'count(*)')} FROM orders_fact"
    )
    cancel_line = "count(*) FILTER (WHERE order_status = 'CANCELED')"
    cancel_rows = (
        f"SELECT 'line_items' AS definition, {share(cancel_line, 'count(*)')} AS value FROM orders_fact"
        f" UNION ALL SELECT 'orders', {share(canceled_orders, 'count(DISTINCT order_id)')} FROM orders_fact"
    )
    q["kpi_on_time_rate"] = on_fact(on_time_rows)
    q["kpi_cancellation_rate"] = on_fact(cancel_rows)
    q["kpi_sales_growth"] = on_fact(f"{_growth(1)} UNION ALL {_growth(4)}", MONTHS)
    q["kpi_top_category_share"] = _top_share("category_name")
    q["kpi_top_region_share"] = _top_share("order_region")
    late_fraction = f"CAST({LATE} AS DOUBLE) / count(*)"
    measures = f"""{r('sum(sales)')} AS revenue, count(DISTINCT order_id) AS orders,
        CAST(sum(order_item_quantity) AS BIGINT) AS units, {quot('sum(sales)', 'count(DISTINCT order_id)')} AS avg_order_value,
        {r(late_fraction, 6)} AS late_pct, {r(f'1 - {late_fraction}', 6)} AS on_time_pct,
        {r('avg(days_for_shipping_real)', 6)} AS avg_days, {r('avg(days_for_shipment_scheduled)', 6)} AS avg_scheduled,
        {r('avg(shipping_delay_days)', 6)} AS avg_delay, {quot(canceled_orders, 'count(DISTINCT order_id)', 6)} AS cancellation_pct"""
    q["bi_measures_by_dim"] = on_fact(f"SELECT market, shipping_mode, {measures} FROM orders_fact GROUP BY 1, 2")

    def cube(*dims: str) -> str:
        level = ", ".join(f"CASE WHEN grouping({d}) = 0 THEN '{d}' END" for d in dims)
        named = "(SELECT *, ym AS order_year_month FROM orders_fact)"
        # A cent's half is common among few orders; a double's own digits round as such.
        average = "CAST(sum(sales) AS DOUBLE) / NULLIF(count(DISTINCT order_id), 0)"
        exact = r(f"CAST({average} AS VARCHAR)")
        return on_fact(f"SELECT concat_ws(',', {level}) AS level, {', '.join(dims)}, {measures.replace(quot('sum(sales)', 'count(DISTINCT order_id)'), exact)} FROM {named} GROUP BY CUBE ({', '.join(dims)})")

    q["bi_measures_cube"] = cube("order_region", "customer_segment", "order_year_month")
    q["bi_measures_cube_products"] = cube("category_name", "type")
    q["bi_mom_growth_calendar"] = on_fact(
        f"""SELECT c.ym AS month, {r('m.s')} AS revenue, {r('p.s')} AS prev_month_revenue, {quot('m.s - p.s', 'p.s', 6)} AS growth
        FROM (SELECT strftime(d, '%Y-%m') AS ym, strftime(d - INTERVAL 1 MONTH, '%Y-%m') AS pm FROM
              (SELECT unnest(generate_series(CAST(min(ym) || '-01' AS TIMESTAMP), CAST(max(ym) || '-01' AS TIMESTAMP), INTERVAL 1 MONTH)) AS d FROM months)) c
        LEFT JOIN months m ON m.ym = c.ym LEFT JOIN months p ON p.ym = c.pm""",
        MONTHS,
    )

    # suppliers and inventory
    q["supplier_scorecard"] = on_fact(
        f"SELECT department_name, {r('sum(sales)')} AS revenue, {share('sum(late_delivery_risk)', 'count(*)')} AS late_rate_pct,"
        " count(*) AS n_line_items FROM orders_fact GROUP BY 1"
    )
    q["supplier_scorecard_ranked"] = on_fact(
        f"""SELECT department_name, n AS order_volume, {r('s')} AS sales_contribution, avg_fulfillment_days, late_delivery_pct,
        {share('s', 'sum(s) OVER ()')} AS sales_contribution_pct, row_number() OVER (ORDER BY s DESC, department_name) AS performance_rank,
        CASE WHEN late_delivery_pct <= 45 THEN 'Lower Risk' WHEN late_delivery_pct <= 55 THEN 'Moderate Risk' ELSE 'Higher Risk' END AS risk_category
        FROM (SELECT department_name, count(*) AS n, sum(sales) AS s, {r('avg(days_for_shipping_real)')} AS avg_fulfillment_days,
              {share('sum(is_late)', 'count(*)')} AS late_delivery_pct FROM orders_fact GROUP BY 1)"""
    )
    q["demand_profile"] = on_fact("SELECT * FROM profile", *_demand("product_card_id"))
    q["demand_profile_active_months"] = on_fact("SELECT * FROM profile", *_demand("product_card_id", False))
    q["mover_class"] = on_fact(
        f"SELECT product_card_id, avg_units_per_month, {MOVER_BAND} AS mover_class FROM profile", *_demand("product_card_id")
    )
    q["stockout_risk_proxy"] = on_fact(
        f"SELECT product_card_id, demand_coefficient_of_variation, {RISK_BAND} AS stockout_risk_proxy FROM profile",
        *_demand("product_card_id"),
    )
    q["inventory_profile"] = on_fact(
        f"SELECT *, {MOVER_BAND} AS mover_class, {RISK_BAND} AS stockout_risk_proxy FROM profile", *_demand("product_name")
    )
    q["inventory_summary"] = on_fact(
        """SELECT 'n_products_profiled' AS metric, CAST(count(*) AS DOUBLE) AS value FROM classed
        UNION ALL SELECT 'fast_movers_count', CAST(count(*) AS DOUBLE) FROM classed WHERE mover_class = 'Fast Mover'
        UNION ALL SELECT 'slow_movers_count', CAST(count(*) AS DOUBLE) FROM classed WHERE mover_class = 'Slow Mover'
        UNION ALL SELECT 'fast_mover: ' || product_name, avg_units_per_month FROM
          (SELECT * FROM classed ORDER BY avg_units_per_month DESC, product_name LIMIT 5)""",
        *_demand("product_name"),
        f"classed AS (SELECT *, {MOVER_BAND} AS mover_class FROM profile)",
    )
    q["product_demand_cv"] = on_fact("SELECT * FROM prod", *PRODUCT_CV)
    q["mover_class_qty"] = on_fact("SELECT product_name, total_qty_sold, mover_class FROM banded", *PRODUCT_CV)
    q["stockout_risk_flag"] = on_fact("SELECT product_name, demand_cv, mover_class, stockout_risk_flag FROM flagged", *PRODUCT_CV)
    q["top_fast_movers"] = on_fact("SELECT * FROM flagged ORDER BY total_qty_sold DESC, product_name LIMIT 20", *PRODUCT_CV)
    q["bottom_slow_movers"] = on_fact("SELECT * FROM banded ORDER BY total_qty_sold, product_name DESC LIMIT 10", *PRODUCT_CV)

    # exploratory feeds
    q["eda_monthly_sales"] = on_fact(f"SELECT ym AS order_year_month, {r('s')} AS sales FROM months", MONTHS)
    q["eda_top_categories"] = on_fact(
        f"SELECT category_name, {r('s')} AS sales FROM (SELECT category_name, sum(sales) AS s FROM orders_fact GROUP BY 1) ORDER BY s DESC, category_name LIMIT 12"
    )
    q["eda_region_sales"] = on_fact(f"SELECT order_region, {r('sum(sales)')} AS sales FROM orders_fact GROUP BY 1")
    q["eda_shipping_mode_stats"] = on_fact(
        f"SELECT shipping_mode, count(*) AS n_line_items, {r('avg(days_for_shipping_real)', 6)} AS avg_days FROM orders_fact GROUP BY 1"
    )
    q["eda_days_boxplot"] = _boxplot("days_for_shipping_real", "shipping_mode")
    q["eda_sales_boxplot"] = _boxplot("sales", None)
    q["eda_discount_histogram"] = _histogram("order_item_discount", 50)
    q["eda_days_histogram"] = _histogram("days_for_shipping_real", 20)
    q["eda_late_rate_by_region"] = on_fact(
        f"SELECT order_region, {share('sum(late_delivery_risk)', 'count(*)', 6)} AS late_pct FROM orders_fact GROUP BY 1 ORDER BY late_pct DESC, order_region LIMIT 10"
    )
    q["eda_late_rate_top_volume"] = on_fact(
        f"""SELECT order_region, {share('sum(is_late)', 'count(*)', 6)} AS late_pct FROM orders_fact
        WHERE order_region IN (SELECT order_region FROM (SELECT order_region, count(*) AS n FROM orders_fact GROUP BY 1 ORDER BY n DESC, order_region LIMIT 10))
        GROUP BY 1"""
    )
    q["eda_segment_sales"] = on_fact(
        f"SELECT customer_segment, {r('sum(sales)')} AS sales, count(DISTINCT order_id) AS orders FROM orders_fact GROUP BY 1"
    )
    q["eda_correlation"] = _corr(CORRELATED_COLUMNS_WIDE, 6)
    q["eda_order_status"] = on_fact("SELECT order_status, count(*) AS n_line_items FROM orders_fact GROUP BY 1")
    q["eda_late_trend"] = on_fact(
        f"SELECT ym AS order_year_month, {share('sum(late_delivery_risk)', 'count(*)', 6)} AS late_pct FROM orders_fact GROUP BY 1"
    )
    q["eda_scatter_sample"] = on_fact(
        f"""SELECT order_item_discount_rate, {r('order_item_profit_ratio', 6)} AS order_item_profit_ratio, late_delivery_risk
        FROM (SELECT * FROM (SELECT *, md5({IDENTITY_TEXT}) AS k FROM orders_fact)
          ORDER BY k, order_id, line_no, product_card_id, order_item_quantity, sales, order_item_discount, shipping_date LIMIT 5000)"""
    )

    # statistics
    q["stats_describe"] = on_fact(" UNION ALL ".join(_describe(c) for c in DESCRIBED_COLUMNS))
    q["stats_correlation"] = _corr(CORRELATED_COLUMNS, 3)
    q["stats_correlation_alt"] = _corr(CORRELATED_COLUMNS_SHORT, 3)
    # The F tail with an even second degree of freedom is a finite sum of beta terms; with an
    # odd one the same sum runs to the next integer, which changes p by less than one in the
    # last digit shown at these sizes.
    q["stats_anova"] = on_fact(
        f"""SELECT k, n, {r('f', 4)} AS f_statistic, {r('p', 6)} AS p_value, CAST(0.05 AS DOUBLE) AS alpha, p < 0.05 AS reject_h0
        FROM (SELECT k, n, f, 1 - (SELECT sum(exp(((k - 1) / 2.0) * ln(x) + lgamma((k - 1) / 2.0 + j) - lgamma((k - 1) / 2.0) - lgamma(j + 1.0) + j * ln(1 - x)))
              FROM (SELECT unnest(range(CAST(CEIL((n - k) / 2.0) AS BIGINT))) AS j)) AS p
          FROM (SELECT *, (k - 1) * f / ((n - k) + (k - 1) * f) AS x FROM
            (SELECT count(*) AS k, CAST(sum(c) AS BIGINT) AS n,
              (sum(c * (m - g) * (m - g)) / (count(*) - 1)) / (sum(c * v) / (sum(c) - count(*))) AS f
             FROM (SELECT count(*) AS c, avg(days_for_shipping_real) AS m, var_pop(days_for_shipping_real) AS v,
                   (SELECT avg(days_for_shipping_real) FROM orders_fact) AS g FROM orders_fact GROUP BY shipping_mode))))"""
    )
    # Four degrees of freedom: the chi-square tail is exp(-x/2) (1 + x/2).
    chi = [
        "cells AS (SELECT customer_segment AS a, late_delivery_risk AS b, count(*) AS o FROM orders_fact GROUP BY 1, 2)",
        """grid AS (SELECT ra.a, cb.b, CAST(ra.n AS DOUBLE) * cb.n / t.n AS e, COALESCE(c.o, 0) AS o FROM
          (SELECT a, sum(o) AS n FROM cells GROUP BY a) ra CROSS JOIN (SELECT b, sum(o) AS n FROM cells GROUP BY b) cb
          CROSS JOIN (SELECT sum(o) AS n FROM cells) t LEFT JOIN cells c ON c.a = ra.a AND c.b = cb.b)""",
        "x AS (SELECT sum((o - e) * (o - e) / e) AS x, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof FROM grid)",
    ]
    q["stats_chi_square"] = on_fact(
        f"""SELECT {r('x', 4)} AS chi2_statistic, dof, {r('exp(-x / 2) * (1 + x / 2)', 6)} AS p_value, CAST(0.05 AS DOUBLE) AS alpha,
        exp(-x / 2) * (1 + x / 2) < 0.05 AS reject_h0 FROM x""",
        *chi,
    )
    q["stats_crosstab"] = on_fact(
        "SELECT customer_segment, count(*) FILTER (WHERE late_delivery_risk = 0) AS n_0,"
        " count(*) FILTER (WHERE late_delivery_risk = 1) AS n_1 FROM orders_fact GROUP BY 1"
    )
    # t quantile by its expansion in the normal quantile z = 1.959963984540054.
    z = 1.959963984540054
    t = f"({z} + {(z**3 + z) / 4} / (n - 1) + {(5 * z**5 + 16 * z**3 + 3 * z) / 96} / ((n - 1) * (n - 1)))"
    mean_ci = (
        "ci AS (SELECT count(shipping_delay_days) AS n, avg(shipping_delay_days) AS m,"
        " stddev_samp(shipping_delay_days) / sqrt(count(shipping_delay_days)) AS s FROM orders_fact)"
    )
    q["stats_mean_ci"] = on_fact(
        f"SELECT n, {r('m', 4)} AS mean, {r('s', 6)} AS sem, {r(f'm - {t} * s', 4)} AS ci_lower, {r(f'm + {t} * s', 4)} AS ci_upper FROM ci",
        mean_ci,
    )

    # forecasting
    q["ts_monthly_demand"] = on_fact(
        f"""SELECT category_name AS series_key, CAST(date_trunc('month', order_date) AS DATE) AS period,
        CAST(sum(order_item_quantity) AS BIGINT) AS quantity, {r('sum(sales)')} AS sales FROM orders_fact GROUP BY 1, 2"""
    )
    q["ts_weekly_demand"] = on_fact("SELECT series_key, period, y FROM series_all", WEEK_GRID.format(key="product_name"))
    q["ts_exclude_tail"] = on_fact(
        f"SELECT series_key, period, y FROM series_all WHERE period <= DATE '{WEEK_CUTOFF}'", WEEK_GRID.format(key="'all'")
    )
    q["ts_excluded_periods"] = on_fact(
        f"""SELECT series_key, count(*) AS n_excluded, min(period) AS first_excluded, max(period) AS last_excluded
        FROM series_all WHERE period > DATE '{MONTH_CUTOFF}' GROUP BY 1""",
        MONTH_GRID.format(key="'all'"),
    )
    q["ts_time_split"] = on_fact(
        "SELECT series_key, period, y, CASE WHEN age <= 6 THEN 'test' ELSE 'train' END AS part,"
        " CAST(CASE WHEN age <= 6 THEN 7 - age END AS INTEGER) AS step FROM aged",
        *_split_ctes(),
    )
    q["ts_naive_forecast"] = on_fact("SELECT * FROM pred WHERE model = 'naive_last_value'", *_split_ctes())
    q["ts_moving_average_forecast"] = on_fact("SELECT * FROM pred WHERE model = 'moving_average_4'", *_split_ctes())
    q["ts_accuracy"] = on_fact("SELECT * FROM acc", *_split_ctes())
    q["ts_best_baseline"] = on_fact(
        f"""SELECT series_key, best_model, rmse, {r('100 * (1 - mae / NULLIF(base, 0))', 1)} AS improvement_over_baseline_pct FROM (
          SELECT series_key, model AS best_model, rmse, mae, row_number() OVER (PARTITION BY series_key ORDER BY rmse, model) AS rn,
            max(CASE WHEN model = 'naive_last_value' THEN mae END) OVER (PARTITION BY series_key) AS base FROM acc) WHERE rn = 1""",
        *_split_ctes(),
    )
    change = r("100 * (n.y_hat - m.y_hat) / NULLIF(m.y_hat, 0)", 1)
    q["ts_planning_signal_naive"] = on_fact(
        f"""SELECT *, CASE WHEN pct_change IS NULL THEN NULL WHEN pct_change > 5 THEN 'increase' WHEN abs(pct_change) <= 5 THEN 'hold' ELSE 'taper' END AS signal
        FROM (SELECT series_key, {r('n.y_hat', 1)} AS next_avg, {r('m.y_hat', 1)} AS recent_avg, {change} AS pct_change
              FROM naive n JOIN ma m USING (series_key))""",
        *_split_ctes(),
    )
    q["ts_actual_vs_forecast_baselines"] = on_fact(
        """SELECT series_key, period, CASE WHEN age <= 6 THEN 'actual_test' ELSE 'actual_train' END AS series, y AS value FROM aged
        UNION ALL SELECT series_key, period, model, y_hat FROM pred""",
        *_split_ctes(),
    )
    q["ts_forward_periods"] = on_fact(
        f"""SELECT series_key, period, CASE WHEN n >= 24 THEN 'holt_winters' ELSE 'too_short' END AS kind, n >= 24 AS has_value
        FROM test JOIN (SELECT series_key, count(*) AS n FROM aged WHERE age > 6 GROUP BY 1) USING (series_key)
        UNION ALL SELECT series_key, period, 'forward', TRUE FROM ({AHEAD})""",
        *_split_ctes(),
    )
    fitted = "CASE WHEN n >= 24 THEN 'holt_winters' ELSE 'too_short' END AS model, n >= 24 AS has_value"
    q["ts_refit_forward_periods"] = on_fact(f"SELECT series_key, period, {fitted} FROM ({AHEAD})", *_both_series())
    q["forecast_lookup_periods"] = on_fact(
        f"""SELECT asked, series_key, period, {fitted} FROM ({AHEAD})
        JOIN (VALUES ('brand#7', 'brand#7'), ('nothing', 'all')) AS t(asked, wanted) ON lower(series_key) = wanted""",
        *_both_series(),
    )
    q["ts_flatline_check"] = on_fact(
        f"""SELECT series_key, period, y, {r('cv', 4)} AS rolling_cv, COALESCE(n = 8 AND cv < 0.01, FALSE) AS is_flat
        FROM (SELECT *, count(*) OVER w AS n, stddev_samp(y) OVER w / NULLIF(avg(y) OVER w, 0) AS cv FROM series_all
              WINDOW w AS (PARTITION BY series_key ORDER BY period ROWS 7 PRECEDING))""",
        WEEK_GRID.format(key="category_name"),
    )

    # late-delivery models
    numeric = {
        "A": ["days_for_shipment_scheduled", "sales", "order_item_quantity", "order_item_discount_rate", "product_price"],
        "B": ["days_for_shipment_scheduled", "order_item_quantity", "order_item_discount_rate", "product_price", "sales"],
    }
    casts = {v: ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cs) for v, cs in numeric.items()}
    q["ml_feature_table"] = on_fact(
        f"SELECT {casts['A']}, shipping_mode, order_region, market, category_name, department_name, customer_segment, type, order_dow,"
        " CAST(late_delivery_risk AS DOUBLE) AS label FROM orders_fact"
    )
    q["ml_feature_table_alt"] = on_fact(
        f"SELECT {casts['B']}, CAST(isodow(order_date) - 1 AS DOUBLE) AS order_dow_num, CAST(month(order_date) AS DOUBLE) AS order_month_num,"
        " shipping_mode, order_region, market, category_name, customer_segment, type, CAST(is_late AS DOUBLE) AS label"
        " FROM orders_fact WHERE delivery_status <> 'Shipping canceled'"
    )
    guarded = [
        ("days_for_shipping_real", True),
        ("days_for_shipment_scheduled", False),
        ("shipping_delay_days", True),
        ("sales", False),
        ("order_item_quantity", False),
        ("order_item_discount_rate", False),
        ("product_price", False),
        ("benefit_per_order", True),
        ("is_late", True),
    ]
    q["ml_leakage_guard"] = on_fact(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, {leak} AS rejected, {r(f'corr(CAST({c} AS DOUBLE), CAST(late_delivery_risk AS DOUBLE))', 4)} AS r_with_target FROM orders_fact"
            for c, leak in guarded
        )
    )
    q["ml_stratified_split"] = on_fact(
        "SELECT CASE WHEN bucket < 20 THEN 'test' ELSE 'train' END AS split, late_delivery_risk, count(*) AS n FROM bucketed GROUP BY 1, 2",
        BUCKETED,
    )
    q["ml_split_rows"] = on_fact(
        "SELECT order_id, line_no, late_delivery_risk FROM bucketed WHERE bucket < 20", BUCKETED
    )
    q["ml_save_load"] = on_fact(
        "SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_different, CAST(0 AS DOUBLE) AS max_difference FROM bucketed WHERE bucket < 20",
        BUCKETED,
    )
    q["ml_report_support"] = on_fact(
        """SELECT 'decision_tree' AS model, class, CAST(CASE class WHEN '0' THEN negatives WHEN '1' THEN n - negatives ELSE n END AS BIGINT) AS support
        FROM (SELECT count(*) AS n, count(*) FILTER (WHERE late_delivery_risk = 0) AS negatives FROM bucketed WHERE bucket < 20) AS t,
        (VALUES ('0'), ('1'), ('macro avg'), ('weighted avg')) AS c(class)""",
        BUCKETED,
    )
    q["ml_majority_baseline"] = on_fact(
        f"SELECT 'majority_class' AS model, {', '.join(f'{value} AS {name!r}'.replace(chr(39), chr(34)) for name, value in METRICS)} FROM conf",
        BUCKETED,
        """maj AS (SELECT CASE WHEN sum(late_delivery_risk) * 2 > count(*) THEN 1 ELSE 0 END AS m FROM bucketed WHERE bucket >= 20)""",
        "scored AS (SELECT late_delivery_risk AS label, m AS prediction FROM bucketed, maj WHERE bucket < 20)",
        CONFUSION,
    )
    q["ml_fixed_score"] = on_fact("SELECT * FROM scored", SCORED)
    metric_rows = " UNION ALL ".join(
        f"SELECT 'fixed_rule' AS model, '{name}' AS metric, {value} AS value FROM conf" for name, value in METRICS
    ) + f" UNION ALL SELECT 'fixed_rule', 'roc_auc', {r('v', 4)} FROM auc"
    q["ml_metrics"] = on_fact(metric_rows, SCORED, CONFUSION, AUC)
    q["ml_confusion_matrix"] = on_fact(
        " UNION ALL ".join(
            f"SELECT 'fixed_rule' AS model, {a} AS label, {b} AS prediction, CAST({cell} AS BIGINT) AS n FROM conf"
            for a, b, cell in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
        ),
        SCORED,
        CONFUSION,
    )
    q["ml_roc_curve"] = on_fact(
        f"""SELECT 'fixed_rule' AS model, score AS threshold, {quot('sum(neg) OVER w', 'sum(neg) OVER ()', 6)} AS fpr,
        {quot('sum(pos) OVER w', 'sum(pos) OVER ()', 6)} AS tpr
        FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score) WINDOW w AS (ORDER BY score DESC)""",
        SCORED,
    )
    macro = [f"({m}0 + {m}1) / 2" for m in ("p", "r", "f")]
    weighted = [f"({m}0 * s0 + {m}1 * s1) / (s0 + s1)" for m in ("p", "r", "f")]
    q["ml_classification_report"] = on_fact(
        " UNION ALL ".join(
            [
                _report_row("0", "p0", "r0", "f0", "s0"),
                _report_row("1", "p1", "r1", "f1", "s1"),
                _report_row("macro avg", *macro, "s0 + s1"),
                _report_row("weighted avg", *weighted, "s0 + s1"),
            ]
        ),
        SCORED,
        CONFUSION,
        """per_class AS (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fn + fp) AS f0, tn + fp AS s0,
          tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fp + fn) AS f1, tp + fn AS s1 FROM conf)""",
    )

    # lookups
    q["product_performance"] = on_fact(
        f"""SELECT lower(product_name) AS product_name, {r('sum(sales)')} AS total_sales, CAST(sum(order_item_quantity) AS BIGINT) AS total_units_sold,
        {r('avg(days_for_shipping_real)')} AS avg_delivery_days, {share('sum(late_delivery_risk)', 'count(*)')} AS late_delivery_rate_pct
        FROM orders_fact GROUP BY 1"""
    )
    region = f"""SELECT lower(order_region) AS region, {r('sum(sales)')} AS total_sales, count(DISTINCT order_id) AS total_orders,
        {share('sum(late_delivery_risk)', 'count(*)')} AS late_delivery_rate_pct, {r('avg(days_for_shipping_real)')} AS avg_delivery_days
        FROM orders_fact"""
    q["region_kpis"] = on_fact(f"{region} GROUP BY 1")
    q["region_kpis_one"] = on_fact(f"{region} WHERE lower(order_region) = 'nation_7' GROUP BY 1")

    # gathered results
    total_series = [cte.replace("category_name", "'all'") for cte in _split_ctes()]
    q["results_catalog"] = on_fact(
        f"""SELECT 'kpi_on_time' AS section, definition AS metric, value FROM ({on_time_rows})
        UNION ALL SELECT 'kpi_cancellation', definition, value FROM ({cancel_rows})
        UNION ALL SELECT 'mean_delay', 'mean', {r('m', 4)} FROM ci UNION ALL SELECT 'mean_delay', 'ci_lower', {r(f'm - {t} * s', 4)} FROM ci
        UNION ALL SELECT 'mean_delay', 'ci_upper', {r(f'm + {t} * s', 4)} FROM ci
        UNION ALL SELECT 'segment_vs_late', 'chi2_statistic', {r('x', 4)} FROM x
        UNION ALL SELECT 'segment_vs_late', 'dof', CAST(dof AS DOUBLE) FROM x
        UNION ALL SELECT 'forecast_' || model, 'mae', mae FROM acc UNION ALL SELECT 'forecast_' || model, 'rmse', rmse FROM acc
        UNION ALL SELECT 'late_model', metric, value FROM ({metric_rows})""",
        mean_ci,
        *chi,
        *total_series,
        SCORED,
        CONFUSION,
        AUC,
    )
    def counted(label: str, texts: dict[str, str]) -> str:
        return " UNION ALL ".join(
            f"SELECT '{name}' AS {label}, count(*) AS n_rows FROM ({sql})" for name, sql in texts.items()
        )

    q["write_query_results"] = counted("query", {k: v for k, v in q.items() if k[:1] == "q" and k[1:3].isdigit()})
    q["export_star_schema"] = counted(
        "table_name",
        {
            "fact_orders": on_fact("SELECT * FROM orders_fact"),
            "dim_product": q["dim_product"],
            "dim_customer": q["dim_customer"],
            "monthly_kpi": q["monthly_kpi"],
            "inventory": q["inventory_profile"],
            "supplier": q["supplier_scorecard_ranked"],
            "forecast": on_fact(AHEAD, *_split_ctes()),
            # Four models by five metrics.
            "model_comparison": "SELECT unnest(range(20))",
        },
    )
    categories = "shipping_mode order_region market category_name department_name customer_segment type order_dow".split()
    slots = " + ".join(f"count(DISTINCT {c}) FILTER (WHERE bucket >= 20)" for c in categories)
    q["ml_preprocess"] = on_fact(
        f"""SELECT CAST(5 + {slots} AS INTEGER) AS n_features, CAST(5 + {len(categories)} AS INTEGER) AS n_nonzero,
        count(*) FILTER (WHERE bucket < 20) AS n FROM bucketed""",
        BUCKETED,
    )
    return q

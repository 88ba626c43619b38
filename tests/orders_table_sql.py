"""The rows of ``orders_table`` and the cleaning rules in DuckDB SQL.

The driver runs these on DuckDB next to the Spark plans and compares results.
``with_ctes(body, *names)`` prepends the CTE chain needed by a query body.
"""

from __future__ import annotations


def _u(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR) || '-{salt}'), 1, 8))::BIGINT / 4294967296.0)"


def _title(expr: str) -> str:
    """Python str.title for ASCII: upper after a non-letter, lower after a letter."""
    return (
        "array_to_string(list_transform(string_split({e}, ''), lambda ch, i: "
        "CASE WHEN i = 1 OR NOT regexp_matches(substr({e}, i - 1, 1), '[A-Za-z]') "
        "THEN upper(ch) ELSE lower(ch) END), '')"
    ).format(e=expr)


CTE = {}

CTE["o_base"] = f"""
o_base AS (
  SELECT o.o_orderkey AS ok, o.o_custkey AS ck, o.o_orderstatus AS st, o.o_orderpriority AS pri,
         o.o_totalprice AS price, o.o_orderdate AS odate, li.items, li.d2, p.p_type,
         n.n_name, n.n_regionkey,
         CASE WHEN n.n_regionkey <= 1 THEN 1 WHEN n.n_regionkey <= 3 THEN 2 ELSE 3 END AS t,
         CAST(round(300.0 * li.d2) AS INTEGER) AS disc
  FROM orders o
  JOIN (SELECT l_orderkey, count(*) AS items, min(l_discount) + max(l_discount) AS d2,
               min(l_partkey) AS pk
        FROM lineitem GROUP BY l_orderkey) li ON o.o_orderkey = li.l_orderkey
  JOIN part p ON li.pk = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

CTE["o_lab"] = f"""
o_lab AS (
  SELECT *, floor(100 * {_u('ok', 'back')}) <
    CASE WHEN pri < '4'
      THEN 4 + 6 * habit + 3 * t + (CASE st WHEN 'P' THEN 9 WHEN 'O' THEN 4 ELSE 0 END) + floor(disc / 12.0)
      ELSE habit END AS is_back
  FROM (SELECT *, floor(8 * {_u('ck', 'habit')}) AS habit FROM o_base)
)"""

CTE["cod_raw"] = """
o_hist AS (
  SELECT *,
    CAST(count(*) OVER w AS INTEGER) AS prior_n,
    CAST(coalesce(sum(is_back::INT) OVER w, 0) AS INTEGER) AS prior_r
  FROM (SELECT *,
          CASE WHEN ok % 131 <> 0 THEN date_diff('day', DATE '1995-01-01', CAST(odate AS DATE)) END AS oday,
          CASE WHEN ok % 97 <> 0 THEN 'CUST' || CAST(ck + 10000 AS VARCHAR) END AS cust_id FROM o_lab)
  WINDOW w AS (PARTITION BY cust_id ORDER BY oday NULLS FIRST, ok
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
cod_raw_keyed AS (
  SELECT
    'ORD' || CAST(ok + 100000 AS VARCHAR) AS OrderID,
    cust_id AS CustomerID,
    CAST(oday AS INTEGER) AS OrderDay,
    CASE WHEN ok % 101 = 0 THEN 'rural'
         ELSE ['Tier-', 'Tier ', 'tier', 'T', 'TIER-'][(ok % 5 + 1)::INT] || t END AS CityTier,
    CASE WHEN ok % 73 = 0 THEN NULL WHEN ok % 6 = 0 THEN upper(n_name) WHEN ok % 6 = 1 THEN lower(n_name)
         WHEN ok % 6 = 2 THEN ' ' || n_name || '  ' ELSE n_name END AS State,
    CASE WHEN ok % 61 = 0 THEN 'Unknown' WHEN ok % 9 = 0 THEN 'Fashion' WHEN ok % 9 = 1 THEN 'Electronics'
         ELSE p_type END AS Category,
    CASE WHEN ok % 157 = 0 THEN 'on request'
         ELSE ['', 'Rs ', 'INR ', 'Rs.'][(ok % 4 + 1)::INT] || format('{:,}', CAST(round(price / 33.0) AS BIGINT))
    END AS OrderValue,
    CASE WHEN ok % 53 = 0 THEN NULL WHEN ok % 59 = 0 THEN 'free' WHEN ok % 307 = 0 THEN '101%'
         WHEN ok % 311 = 0 THEN '250' ELSE CAST(disc AS VARCHAR) || (CASE WHEN ok % 2 = 0 THEN '%' ELSE '' END)
    END AS DiscountPct,
    CASE WHEN pri < '4' THEN 'COD' ELSE 'Prepaid' END AS PaymentMethod,
    CASE WHEN ok % 23 = 0 THEN NULL WHEN ok % 3 = 0 THEN 'Phone' WHEN ok % 3 = 1 THEN 'Tablet'
         ELSE 'Browser' END AS Device,
    CASE WHEN ok % 19 = 0 THEN NULL WHEN st = 'F' THEN 'Complete' WHEN st = 'O' THEN 'Partial'
         WHEN st = 'P' THEN 'Vague' END AS AddressQuality,
    CAST(ok % 24 AS INTEGER) AS OrderHour,
    CAST(items AS INTEGER) AS Items,
    prior_n AS PriorOrders,
    prior_r AS PriorReturns,
    CASE WHEN is_back THEN 'Returned' ELSE 'Delivered' END AS DeliveryStatus,
    ok AS OrderKey,
    ok % 211 = 0 AS is_dup
  FROM o_hist
),
cod_raw AS (
  SELECT * EXCLUDE (OrderKey, is_dup) FROM cod_raw_keyed
  UNION ALL
  SELECT * EXCLUDE (OrderKey, is_dup) FROM cod_raw_keyed WHERE is_dup
)"""

# Cleaning, reference step order: exact de-duplication first, then parse/normalise.
CTE["cod_clean"] = f"""
dedup AS (SELECT DISTINCT * FROM cod_raw),
parsed AS (
  SELECT OrderID, CustomerID, OrderDay, CityTier AS CityTierRaw, State AS StateRaw, Category,
    CASE WHEN regexp_matches(trim(replace(regexp_replace(OrderValue, '^\\s*(Rs\\.?|INR)\\s*', ''), ',', '')),
                             '^-?[0-9]+(\\.[0-9]+)?$')
         THEN TRY_CAST(trim(replace(regexp_replace(OrderValue, '^\\s*(Rs\\.?|INR)\\s*', ''), ',', '')) AS DOUBLE)
    END AS OrderValue,
    TRY_CAST(nullif(trim(replace(DiscountPct, '%', '')), '') AS DOUBLE) AS disc0,
    PaymentMethod, Device, AddressQuality, OrderHour, Items, PriorOrders, PriorReturns,
    DeliveryStatus
  FROM dedup
),
disc_median AS (SELECT median(disc0) AS med FROM parsed WHERE disc0 <= 100),
cod_clean AS (
  SELECT OrderID, CustomerID, OrderDay,
    CASE WHEN regexp_extract(CityTierRaw, '([123])', 1) <> ''
         THEN 'Tier-' || regexp_extract(CityTierRaw, '([123])', 1) END AS CityTier,
    coalesce({_title('trim(StateRaw)')}, 'Unknown') AS State,
    Category, OrderValue,
    CASE WHEN disc0 > 100 THEN (SELECT med FROM disc_median) ELSE disc0 END AS DiscountPct,
    PaymentMethod,
    coalesce(Device, 'Unknown') AS Device,
    coalesce(AddressQuality, 'Unknown') AS AddressQuality,
    OrderHour, Items, PriorOrders, PriorReturns, DeliveryStatus,
    CASE WHEN DeliveryStatus = 'Returned' THEN 1 ELSE 0 END AS RTO,
    CASE WHEN PriorOrders > 0 THEN PriorReturns / PriorOrders ELSE 0.0 END AS PriorRTORate,
    CASE WHEN PriorOrders = 0 THEN 1 ELSE 0 END AS FirstTime,
    CASE WHEN PaymentMethod = 'COD' THEN 1 ELSE 0 END AS IsCOD
  FROM parsed
  WHERE OrderValue IS NOT NULL
)"""

CTE["cod"] = """
cod AS (SELECT * FROM cod_clean WHERE IsCOD = 1)"""

# The rule score of orders_table.rule_scored.
CTE["cod_scored_sql"] = """
cod_scored_sql AS (
  SELECT *, CAST(round_even(900.0::DOUBLE - 600.0::DOUBLE * Risk, 0) AS INTEGER) AS Score
  FROM (
    SELECT *, CASE WHEN r IS NOT NULL THEN least(0.97::DOUBLE, r) END AS Risk
    FROM (SELECT *, 0.04::DOUBLE + 0.55::DOUBLE * ((PriorReturns + 1.0::DOUBLE) / (PriorOrders + 3.0::DOUBLE))
            + 0.03::DOUBLE * TRY_CAST(substr(CityTier, 6, 1) AS INTEGER)
            + (CASE AddressQuality WHEN 'Complete' THEN 0.0 WHEN 'Vague' THEN 0.1 ELSE 0.05 END)::DOUBLE
            + DiscountPct / 400.0::DOUBLE AS r
          FROM cod)
  )
)"""

DEPENDS = {
    "o_base": [],
    "o_lab": ["o_base"],
    "cod_raw": ["o_lab"],
    "cod_clean": ["cod_raw"],
    "cod": ["cod_clean"],
    "cod_scored_sql": ["cod"],
}


def _closure(names):
    seen: list[str] = []

    def visit(n):
        for d in DEPENDS[n]:
            visit(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_ctes(body: str, *names: str) -> str:
    """``WITH <needed ctes> <body>``; body is a SELECT that may add its own CTEs after a
    leading comma-free ``SELECT``. Extra CTEs can be passed as a dict via ``extra``."""
    parts = [CTE[n].strip() for n in _closure(names)]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def with_ctes_extra(extra: str, body: str, *names: str) -> str:
    """Like :func:`with_ctes`, with more CTE definitions appended (``extra`` is
    ``name AS (...), name2 AS (...)``)."""
    parts = [CTE[n].strip() for n in _closure(names)] + [extra.strip()]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()

"""DuckDB oracle SQL for the registered queries (same column names as the Spark side)."""

from __future__ import annotations

from parcelwise.plans import order_rows

_ROWS = order_rows("orders_table_sql")
with_ctes, with_ctes_extra = _ROWS.with_ctes, _ROWS.with_ctes_extra

ORACLE: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLE[name] = text


def hbits(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR) || '-{salt}'), 1, 8))::BIGINT)"


RAW_COLS = ("OrderID, CustomerID, OrderDay, CityTier, State, Category, OrderValue, DiscountPct, "
            "PaymentMethod, Device, AddressQuality, OrderHour, Items, PriorOrders, PriorReturns, "
            "DeliveryStatus")
SCORED_OUT = ("OrderID, CustomerID, CityTier, Category, OrderValue, PriorOrders, PriorReturns, RTO, "
              "round(Risk, 6) AS Risk, Score")
TIER_CASE = ("CASE WHEN Score >= {hi} THEN 'Free COD' WHEN Score < {lo} THEN 'Prepaid-only' "
             "WHEN Score IS NOT NULL THEN 'COD + fee' END")

# ------------------------------------------------------------------ 2.1 sources and sinks
sql("read_orders_csv", with_ctes("SELECT * FROM cod_raw", "cod_raw"))
sql("read_orders_any", with_ctes("""
SELECT * FROM cod_raw WHERE OrderHour >= 12
UNION ALL
SELECT * REPLACE ('say "' || Category || '",' || chr(10) || 'please' AS Category, NULL::VARCHAR AS Device)
FROM cod_raw WHERE OrderHour < 12""", "cod_raw"))
sql("write_raw", with_ctes(
    "SELECT " + ", ".join(f"CAST({c.strip()} AS VARCHAR) AS {c.strip()}" for c in RAW_COLS.split(","))
    + " FROM cod_raw", "cod_raw"))
sql("write_scored", with_ctes(
    f"SELECT {SCORED_OUT}, {TIER_CASE.format(lo=580, hi=720)} AS Tier FROM cod_scored_sql",
    "cod_scored_sql"))
sql("preview_raw", with_ctes("SELECT * FROM cod_raw ORDER BY OrderID LIMIT 10", "cod_raw"))
sql("preview_customers", with_ctes("""
SELECT CustomerID, count(*) AS Orders, round_even(avg(OrderValue), 2) AS AvgValue,
       round_even(avg(DiscountPct), 2) AS AvgDiscount, round_even(avg(IsCOD), 2) AS PctCOD,
       round_even(avg(RTO), 2) AS ReturnRate
FROM cod_clean GROUP BY CustomerID ORDER BY CustomerID LIMIT 6""", "cod_clean"))
sql("reuse_frames", with_ctes("""
SELECT count(*) AS clean_rows, count(*) FILTER (WHERE IsCOD = 1) AS cod_rows,
       (SELECT count(*) FROM cod_raw) AS raw_rows FROM cod_clean""", "cod_clean"))
sql("handoff_scored", with_ctes(
    f"SELECT OrderID, round(Risk, 6) AS Risk, Score, {TIER_CASE.format(lo=580, hi=720)} AS Tier "
    "FROM cod_scored_sql", "cod_scored_sql"))

# ------------------------------------------------------------------ 2.2 cleaning
_PARSE_VALUE = ("CASE WHEN regexp_matches(trim(replace(regexp_replace(OrderValue, '^\\s*(Rs\\.?|INR)\\s*', ''), ',', '')), "
                "'^-?[0-9]+(\\.[0-9]+)?$') THEN TRY_CAST(trim(replace(regexp_replace(OrderValue, "
                "'^\\s*(Rs\\.?|INR)\\s*', ''), ',', '')) AS DOUBLE) END")
_PARSE_DISC = "TRY_CAST(nullif(trim(replace(DiscountPct, '%', '')), '') AS DOUBLE)"
_TITLE_STATE = ("array_to_string(list_transform(string_split(trim(State), ''), lambda ch, i: "
                "CASE WHEN i = 1 OR NOT regexp_matches(substr(trim(State), i - 1, 1), '[A-Za-z]') "
                "THEN upper(ch) ELSE lower(ch) END), '')")

sql("clean_dedup", with_ctes("SELECT DISTINCT * FROM cod_raw", "cod_raw"))
sql("clean_currency", with_ctes(
    f"SELECT OrderID, OrderValue AS value_text, {_PARSE_VALUE} AS OrderValue FROM cod_raw", "cod_raw"))
sql("clean_percent", with_ctes(
    f"SELECT OrderID, DiscountPct AS discount_text, {_PARSE_DISC} AS DiscountPct FROM cod_raw", "cod_raw"))
sql("clean_cap_discount", with_ctes("""
SELECT OrderID, CASE WHEN disc0 > 100 THEN (SELECT med FROM disc_median) ELSE disc0 END AS DiscountPct
FROM parsed""", "cod_clean"))
sql("clean_clip_discount", with_ctes(
    "SELECT OrderID, greatest(least(disc0, 100.0), 0.0) AS DiscountPct FROM parsed", "cod_clean"))
sql("clean_city_tier", with_ctes("""
SELECT OrderID, CityTier AS tier_text,
  CASE WHEN regexp_extract(CityTier, '([123])', 1) <> '' THEN 'Tier-' || regexp_extract(CityTier, '([123])', 1) END
    AS CityTier
FROM cod_raw""", "cod_raw"))
sql("clean_state", with_ctes(
    f"SELECT OrderID, State AS state_text, coalesce({_TITLE_STATE}, 'Unknown') AS State FROM cod_raw",
    "cod_raw"))
sql("clean_fill_unknown", with_ctes(
    "SELECT OrderID, coalesce(Device, 'Unknown') AS Device, coalesce(AddressQuality, 'Unknown') AS AddressQuality "
    "FROM cod_raw", "cod_raw"))
sql("clean_drop_null_value", with_ctes(
    "SELECT OrderID, OrderValue FROM parsed WHERE OrderValue IS NOT NULL", "cod_clean"))
sql("clean_audit", with_ctes_extra("""
a_raw AS (SELECT count(*) AS n, count(DISTINCT CityTier) AS tiers, count(DISTINCT State) AS states FROM cod_raw),
a_p AS (
  SELECT count(*) AS n_dedup,
    count(*) FILTER (WHERE OrderValue IS NULL) AS value_null,
    count(*) FILTER (WHERE disc0 IS NULL) AS disc_null,
    count(*) FILTER (WHERE disc0 > 100) AS disc_bad,
    median(disc0) FILTER (WHERE disc0 <= 100) AS disc_median,
    count(DISTINCT CASE WHEN regexp_extract(CityTierRaw, '([123])', 1) <> ''
                        THEN 'Tier-' || regexp_extract(CityTierRaw, '([123])', 1) END) AS tiers_after,
    count(*) FILTER (WHERE regexp_extract(CityTierRaw, '([123])', 1) = '' OR CityTierRaw IS NULL) AS tier_null,
    count(DISTINCT coalesce(array_to_string(list_transform(string_split(trim(StateRaw), ''), lambda ch, i:
        CASE WHEN i = 1 OR NOT regexp_matches(substr(trim(StateRaw), i - 1, 1), '[A-Za-z]')
        THEN upper(ch) ELSE lower(ch) END), ''), 'Unknown')) AS states_after,
    count(*) FILTER (WHERE Device IS NULL) AS device_null,
    count(*) FILTER (WHERE AddressQuality IS NULL) AS address_null
  FROM parsed),
a_norm AS (SELECT count(*) AS n_norm FROM (SELECT DISTINCT * EXCLUDE (CityTierRaw, StateRaw, Device, AddressQuality),
    CASE WHEN regexp_extract(CityTierRaw, '([123])', 1) <> '' THEN 'Tier-' || regexp_extract(CityTierRaw, '([123])', 1) END AS t,
    coalesce(array_to_string(list_transform(string_split(trim(StateRaw), ''), lambda ch, i:
        CASE WHEN i = 1 OR NOT regexp_matches(substr(trim(StateRaw), i - 1, 1), '[A-Za-z]')
        THEN upper(ch) ELSE lower(ch) END), ''), 'Unknown') AS s,
    coalesce(Device, 'Unknown') AS dv, coalesce(AddressQuality, 'Unknown') AS aq FROM parsed)),
a AS (SELECT * FROM a_raw, a_p, a_norm)
""", """
SELECT 'dedup' AS step, 'rows' AS metric, CAST(n AS DOUBLE) AS before, CAST(n_dedup AS DOUBLE) AS after FROM a
UNION ALL SELECT 'dedup', 'duplicates_removed', 0, n - n_dedup FROM a
UNION ALL SELECT 'dedup', 'more_copies_if_normalised_first', 0, n_dedup - n_norm FROM a
UNION ALL SELECT 'order_value', 'unparsable', 0, value_null FROM a
UNION ALL SELECT 'discount', 'unparsable', 0, disc_null FROM a
UNION ALL SELECT 'discount', 'above_100_set_to_median', disc_bad, 0 FROM a
UNION ALL SELECT 'discount', 'median_used', disc_median, disc_median FROM a
UNION ALL SELECT 'city_tier', 'distinct_values', tiers, tiers_after FROM a
UNION ALL SELECT 'city_tier', 'unrecognised', 0, tier_null FROM a
UNION ALL SELECT 'state', 'distinct_values', states, states_after FROM a
UNION ALL SELECT 'device', 'missing_to_unknown', device_null, 0 FROM a
UNION ALL SELECT 'address_quality', 'missing_to_unknown', address_null, 0 FROM a
UNION ALL SELECT 'drop_null_value', 'rows', n_dedup, n_dedup - value_null FROM a
""", "cod_clean"))
sql("clean_schema_guard", with_ctes(
    "SELECT DeliveryStatus, PriorOrders, PriorReturns, PaymentMethod, OrderValue, DiscountPct, CityTier, "
    "State, Device, AddressQuality FROM cod_raw", "cod_raw"))
sql("clean_orders", with_ctes("SELECT * FROM cod_clean", "cod_clean"))
sql("feat_rto", with_ctes("SELECT OrderID, DeliveryStatus, RTO FROM cod_clean", "cod_clean"))
sql("feat_prior_rate", with_ctes(
    "SELECT OrderID, PriorOrders, PriorReturns, round(PriorRTORate, 6) AS PriorRTORate FROM cod_clean",
    "cod_clean"))
sql("feat_flags", with_ctes("SELECT OrderID, FirstTime, IsCOD FROM cod_clean", "cod_clean"))
sql("feat_ids", "SELECT 'ORD' || CAST(o_orderkey + 100000 AS VARCHAR) AS OrderID, "
                "'CUST' || CAST(o_custkey + 10000 AS VARCHAR) AS CustomerID FROM orders")
sql("feat_status_label", with_ctes(
    "SELECT OrderID, RTO, CASE WHEN RTO = 1 THEN 'Returned' ELSE 'Delivered' END AS StatusLabel FROM cod_clean",
    "cod_clean"))
sql("feat_round_int", with_ctes(
    "SELECT OrderID, CAST(round_even(OrderValue, 0) AS INTEGER) AS OrderValueInt, "
    "CAST(round_even(DiscountPct, 0) AS INTEGER) AS DiscountInt FROM cod_clean", "cod_clean"))
sql("filter_cod", with_ctes("SELECT * FROM cod", "cod"))
sql("filter_has_history", with_ctes("SELECT * FROM cod WHERE PriorOrders > 0", "cod"))
sql("design_matrix", with_ctes(
    "SELECT OrderID, OrderValue, DiscountPct, PriorOrders, round(PriorRTORate, 6) AS PriorRTORate, FirstTime, "
    "OrderHour, Items, CityTier, State, Category, Device, AddressQuality, RTO FROM cod", "cod"))

# ------------------------------------------------------------------ 2.3 joins
sql("join_customer_attrs", """
SELECT 'ORD' || CAST(o.o_orderkey + 100000 AS VARCHAR) AS OrderID,
       'CUST' || CAST(o.o_custkey + 10000 AS VARCHAR) AS CustomerID,
       'Tier-' || CAST(CASE WHEN n.n_regionkey <= 1 THEN 1 WHEN n.n_regionkey <= 3 THEN 2 ELSE 3 END AS VARCHAR)
         AS CityTier,
       n.n_name AS State
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""")
sql("join_lookup_tier", with_ctes("""
SELECT OrderID, regexp_extract(CityTier, '([0-9])', 1) AS tier_code,
  CASE regexp_extract(CityTier, '([0-9])', 1) WHEN '1' THEN 'Tier-1' WHEN '2' THEN 'Tier-2'
       WHEN '3' THEN 'Tier-3' END AS CityTier
FROM cod_raw""", "cod_raw"))
sql("join_tier_dimension", with_ctes("""
SELECT d.CityTier, coalesce(p.orders, 0) AS orders, CAST(coalesce(p.returns, 0) AS BIGINT) AS returns
FROM (VALUES ('Tier-1'), ('Tier-2'), ('Tier-3')) d(CityTier)
LEFT JOIN (SELECT CityTier, count(*) AS orders, CAST(sum(RTO) AS BIGINT) AS returns
           FROM cod WHERE CityTier IS NOT NULL GROUP BY CityTier) p ON d.CityTier = p.CityTier""", "cod"))
sql("join_scores_back", with_ctes(
    "SELECT OrderID, CustomerID, CityTier, Category, round(Risk, 6) AS Risk, Score FROM cod_scored_sql",
    "cod_scored_sql"))
sql("join_rate_policy_grid", with_ctes_extra("""
lh AS (SELECT low::INTEGER AS low, high::INTEGER AS high, CASE WHEN low >= high THEN low + 10 ELSE high END AS cut
       FROM range(300, 701, 10) l(low), range(600, 901, 10) h(high))""", """
SELECT low, high,
  count(*) FILTER (WHERE Score >= cut) AS free_orders,
  count(*) FILTER (WHERE Score >= low AND Score < cut) AS fee_orders,
  count(*) FILTER (WHERE Score < low) AS prepaid_orders,
  round(avg(RTO) FILTER (WHERE Score >= cut), 6) AS free_rate,
  round(avg(RTO) FILTER (WHERE Score >= low AND Score < cut), 6) AS fee_rate,
  round(avg(RTO) FILTER (WHERE Score < low), 6) AS prepaid_rate
FROM lh, cod_scored_sql GROUP BY low, high""", "cod_scored_sql"))

# ------------------------------------------------------------------ 2.4 aggregates
sql("kpi_headline", with_ctes("""
SELECT count(*) AS orders, count(DISTINCT CustomerID) AS shoppers, round(avg(RTO), 6) AS overall_rate,
       round(avg(RTO) FILTER (WHERE IsCOD = 1), 6) AS cod_rate,
       round(avg(RTO) FILTER (WHERE IsCOD <> 1), 6) AS prepaid_rate
FROM cod_clean""", "cod_clean"))


def rate_by_sql(src: str, lvl: str, name: str, min_n: int = 20) -> str:
    return f"""
SELECT {lvl} AS {name}, round(avg(RTO), 6) AS return_rate, count(*) AS n,
       round((SELECT avg(RTO) FROM {src}), 6) AS overall_rate,
       CASE WHEN avg(RTO) > (SELECT avg(RTO) FROM {src}) THEN 'above' ELSE 'below' END AS vs_overall,
       row_number() OVER (ORDER BY round(avg(RTO), 6), {lvl}) AS display_rank
FROM {src} WHERE {lvl} IS NOT NULL GROUP BY {lvl} HAVING count(*) >= {min_n}
"""


DISC_BAND = ("CASE WHEN DiscountPct > -1 AND DiscountPct <= 10 THEN '0-10%' "
             "WHEN DiscountPct > 10 AND DiscountPct <= 25 THEN '11-25%' "
             "WHEN DiscountPct > 25 AND DiscountPct <= 40 THEN '26-40%' "
             "WHEN DiscountPct > 40 AND DiscountPct <= 100 THEN '40%+' END")
PRIOR_BAND = ("CASE WHEN PriorRTORate > -0.01 AND PriorRTORate <= 0.0 THEN 'Never returned' "
              "WHEN PriorRTORate > 0.0 AND PriorRTORate <= 0.25 THEN 'Returned 1-25%' "
              "WHEN PriorRTORate > 0.25 AND PriorRTORate <= 0.5 THEN 'Returned 26-50%' "
              "WHEN PriorRTORate > 0.5 AND PriorRTORate <= 1.01 THEN 'Returned >50%' END")
HISTORY_DEPTH = ("CASE WHEN PriorOrders > -1 AND PriorOrders <= 0 THEN '1st order' "
                 "WHEN PriorOrders > 0 AND PriorOrders <= 2 THEN '2nd-3rd' "
                 "WHEN PriorOrders > 2 AND PriorOrders <= 5 THEN '4th-6th' "
                 "WHEN PriorOrders > 5 AND PriorOrders <= 10 THEN '7th-11th' "
                 "WHEN PriorOrders > 10 AND PriorOrders <= 9999 THEN '12th+' END")

sql("rate_by_payment", with_ctes(rate_by_sql("cod_clean", "PaymentMethod", "PaymentMethod"), "cod_clean"))
sql("rate_by_tier", with_ctes(rate_by_sql("cod", "CityTier", "CityTier"), "cod"))
sql("rate_by_category", with_ctes(rate_by_sql("cod", "Category", "Category"), "cod"))
sql("rate_by_address", with_ctes(rate_by_sql("cod", "AddressQuality", "AddressQuality", 10), "cod"))
sql("rate_first_vs_repeat", with_ctes_extra(
    "cod_who AS (SELECT *, CASE WHEN FirstTime = 1 THEN 'First-time buyer' ELSE 'Repeat buyer' END AS Who FROM cod)",
    rate_by_sql("cod_who", "Who", "Who", 0), "cod"))
sql("rate_by_discount_band", with_ctes_extra(
    f"cod_b AS (SELECT *, {DISC_BAND} AS DiscountBand FROM cod)",
    rate_by_sql("cod_b", "DiscountBand", "DiscountBand", 0), "cod"))
sql("rate_by_value_quartile", with_ctes_extra("""
qs AS (SELECT min(OrderValue) AS q0, quantile_cont(OrderValue, 0.25) AS q1, quantile_cont(OrderValue, 0.5) AS q2,
              quantile_cont(OrderValue, 0.75) AS q3, max(OrderValue) AS q4 FROM cod),
cod_q AS (SELECT cod.*, CASE WHEN OrderValue >= q0 AND OrderValue <= q1 THEN 'Cheapest 25%'
                             WHEN OrderValue > q1 AND OrderValue <= q2 THEN 'Lower-mid'
                             WHEN OrderValue > q2 AND OrderValue <= q3 THEN 'Upper-mid'
                             WHEN OrderValue > q3 AND OrderValue <= q4 THEN 'Priciest 25%' END AS ValueQuartile
          FROM cod, qs)""", rate_by_sql("cod_q", "ValueQuartile", "ValueQuartile", 0), "cod"))
sql("rate_by_prior_band", with_ctes_extra(
    f"cod_h AS (SELECT *, {PRIOR_BAND} AS PriorBand FROM cod WHERE PriorOrders > 0)",
    rate_by_sql("cod_h", "PriorBand", "PriorBand", 0), "cod"))
sql("rate_by_history_depth", with_ctes_extra(
    f"cod_d AS (SELECT *, {HISTORY_DEPTH} AS HistoryDepth FROM cod)",
    rate_by_sql("cod_d", "HistoryDepth", "HistoryDepth", 0), "cod"))
sql("rate_by_grouping_sets", with_ctes("""
SELECT lens, level, return_rate, n FROM (
  SELECT CASE WHEN grouping(CityTier) = 0 THEN 'CityTier' WHEN grouping(Category) = 0 THEN 'Category'
              WHEN grouping(AddressQuality) = 0 THEN 'AddressQuality' ELSE 'Device' END AS lens,
         coalesce(CityTier, Category, AddressQuality, Device) AS level,
         round(avg(RTO), 6) AS return_rate, count(*) AS n
  FROM cod GROUP BY GROUPING SETS ((CityTier), (Category), (AddressQuality), (Device))
) WHERE level IS NOT NULL""", "cod"))
sql("pivot_tier_category", with_ctes("""
SELECT CityTier, Category, round(avg(RTO), 6) AS return_rate, count(*) AS n
FROM cod WHERE CityTier IS NOT NULL AND Category IS NOT NULL GROUP BY CityTier, Category""", "cod"))
_CORR = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(CASE WHEN var_pop({c}) > 0 AND var_pop(RTO) > 0 "
    f"THEN corr({c}, RTO) END, 6) AS corr FROM cod WHERE {c} IS NOT NULL"
    for c in ["PriorRTORate", "FirstTime", "DiscountPct", "OrderValue", "PriorOrders", "Items", "OrderHour"])
sql("corr_with_rto", with_ctes(_CORR, "cod"))
sql("cat_mean_value", with_ctes(
    "SELECT Category, round(avg(OrderValue), 4) AS avg_value, count(*) AS n FROM cod_clean "
    "WHERE Category IS NOT NULL GROUP BY Category", "cod_clean"))
sql("customer_table", with_ctes("""
SELECT CustomerID, count(*) AS Orders, round(avg(OrderValue), 6) AS AvgValue, round(avg(DiscountPct), 6) AS AvgDiscount,
       round(avg(IsCOD), 6) AS PctCOD, round(avg(RTO), 6) AS ReturnRate
FROM cod_clean WHERE CustomerID IS NOT NULL GROUP BY CustomerID""", "cod_clean"))
for _name, _same in [("refresh_kpi", "kpi_headline"), ("refresh_customers", "customer_table"),
                     ("refresh_rate_by_payment", "rate_by_payment"), ("refresh_rate_by_tier", "rate_by_tier")]:
    sql(_name, ORACLE[_same])  # refreshed equals rebuilt
sql("distinct_levels", with_ctes(" UNION ".join(
    f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS level FROM cod_clean WHERE {c} IS NOT NULL"
    for c in ["PaymentMethod", "CityTier", "State", "Category", "Device", "AddressQuality"]), "cod_clean"))
sql("mode_state", with_ctes(
    "SELECT State AS mode, count(*) AS n FROM cod WHERE State IS NOT NULL GROUP BY State "
    "ORDER BY count(*) DESC, State LIMIT 1", "cod"))
sql("hist_score", with_ctes_extra(
    "mm AS (SELECT CAST(min(Score) AS DOUBLE) AS lo, CAST(max(Score) AS DOUBLE) AS hi FROM cod_scored_sql)", """
SELECT bin, round(lo + (hi - lo) * bin / 40, 6) AS lo, round(lo + (hi - lo) * (bin + 1) / 40, 6) AS hi, n FROM (
  SELECT CAST(CASE WHEN hi - lo > 0 THEN least(floor((Score - lo) * 40.0 / (hi - lo)), 39) ELSE 0 END AS INTEGER) AS bin,
         any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n
  FROM cod_scored_sql, mm WHERE Score IS NOT NULL GROUP BY 1)""", "cod_scored_sql"))
sql("validation_report", with_ctes("""
SELECT count(*) AS rows, count(DISTINCT CustomerID) AS shoppers,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cod_raw)) AS duplicates,
       (SELECT round(avg(CASE WHEN DeliveryStatus = 'Returned' THEN 1 ELSE 0 END), 6) FROM (SELECT DISTINCT * FROM cod_raw)) AS overall_rate,
       (SELECT round(avg(CASE WHEN DeliveryStatus = 'Returned' THEN 1 ELSE 0 END), 6) FROM (SELECT DISTINCT * FROM cod_raw) WHERE PaymentMethod = 'COD') AS cod_rate,
       (SELECT round(avg(CASE WHEN DeliveryStatus = 'Returned' THEN 1 ELSE 0 END), 6) FROM (SELECT DISTINCT * FROM cod_raw) WHERE PaymentMethod = 'Prepaid') AS prepaid_rate
FROM cod_raw""", "cod_raw"))

CLUES = ["PaymentMethod", "CityTier", "Category", "AddressQuality", "State", "Device"]
_CELLS = " UNION ALL ".join(
    f"SELECT '{c}' AS clue, CAST({c} AS VARCHAR) AS level, RTO FROM cod_clean WHERE {c} IS NOT NULL" for c in CLUES)
CHI_CTE = f"""
cells AS (SELECT clue, level, count(*) FILTER (WHERE RTO = 0) AS o0, count(*) FILTER (WHERE RTO = 1) AS o1
          FROM ({_CELLS}) WHERE RTO IS NOT NULL GROUP BY clue, level),
tot AS (SELECT clue, sum(o0) AS c0, sum(o1) AS c1, count(*) AS r FROM cells GROUP BY clue),
j AS (SELECT cells.*, c0, c1, r, c0 + c1 AS n,
             (CASE WHEN c0 > 0 THEN 1 ELSE 0 END) + (CASE WHEN c1 > 0 THEN 1 ELSE 0 END) AS k
      FROM cells JOIN tot USING (clue)),
j2 AS (SELECT *, (r - 1) * (k - 1) AS dof, (o0 + o1) * c0 / n AS e0, (o0 + o1) * c1 / n AS e1 FROM j),
terms AS (SELECT *,
  (CASE WHEN e0 > 0 THEN pow(abs(o0 - e0) - CASE WHEN dof = 1 THEN least(0.5, abs(o0 - e0)) ELSE 0 END, 2) / e0 ELSE 0 END)
  + (CASE WHEN e1 > 0 THEN pow(abs(o1 - e1) - CASE WHEN dof = 1 THEN least(0.5, abs(o1 - e1)) ELSE 0 END, 2) / e1 ELSE 0 END)
  AS t FROM j2),
chi AS (SELECT clue, CASE WHEN any_value(dof) > 0 THEN sum(t) ELSE 0.0 END AS chi2, CAST(any_value(dof) AS INTEGER) AS dof,
               CAST(any_value(n) AS BIGINT) AS n, CAST(any_value(r) AS INTEGER) AS n_levels, any_value(k) AS k
        FROM terms GROUP BY clue),
chi_v AS (SELECT clue, round(chi2, 6) AS chi2, dof, n, n_levels,
                 round(sqrt((chi2 / n) / greatest(least(n_levels - 1, k - 1), 1)), 6) AS cramers_v FROM chi)"""

sql("crosstab_rto", with_ctes_extra(CHI_CTE, "SELECT clue, level, o0, o1 FROM cells", "cod_clean"))
sql("chi_square", with_ctes_extra(CHI_CTE, "SELECT * FROM chi_v", "cod_clean"))
sql("cramers_v", with_ctes_extra(CHI_CTE, "SELECT clue, cramers_v, n_levels FROM chi_v", "cod_clean"))
sql("best_of", with_ctes_extra(CHI_CTE, """
SELECT arg_max(clue, (cramers_v, clue)) AS best_clue, max(cramers_v) AS best_cramers_v FROM chi_v""", "cod_clean"))
sql("sort_metrics", with_ctes_extra(CHI_CTE, """
SELECT clue, round(cramers_v, 3) AS cramers_v_3, row_number() OVER (ORDER BY cramers_v DESC, clue) AS display_rank
FROM chi_v""", "cod_clean"))

# ------------------------------------------------------------------ 2.5 windows, sorts, sets
sql("win_prior_history", with_ctes("""
SELECT OrderID, CustomerID, OrderDay,
  CAST(count(*) OVER w AS INTEGER) AS PriorOrdersCalc,
  CAST(coalesce(sum(RTO) OVER w, 0) AS INTEGER) AS PriorReturnsCalc
FROM cod_clean
WINDOW w AS (PARTITION BY CustomerID ORDER BY OrderDay NULLS FIRST, CAST(substr(OrderID, 4) AS BIGINT)
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "cod_clean"))

_SPLIT = f"""
split AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY RTO ORDER BY {hbits('OrderID', '42')}, OrderID) AS BIGINT) AS split_rank,
         count(*) OVER (PARTITION BY RTO) AS n_class
  FROM {{src}})"""
sql("win_stratified_split", with_ctes_extra(_SPLIT.format(src="cod"), """
SELECT OrderID, RTO, split_rank, CASE WHEN split_rank <= ceil(n_class * 0.25) THEN 1 ELSE 0 END AS is_test
FROM split""", "cod"))
sql("win_random_split", with_ctes_extra(f"""
split AS (SELECT OrderID, CAST(row_number() OVER (ORDER BY {hbits('OrderID', '42')}, OrderID) AS BIGINT) AS split_rank,
                 count(*) OVER () AS n FROM cod_clean)""", """
SELECT OrderID, split_rank, CASE WHEN split_rank <= ceil(n * 0.25) THEN 1 ELSE 0 END AS is_test FROM split""",
    "cod_clean"))
sql("win_stratified_folds", with_ctes_extra(_SPLIT.format(src="cod"), """
SELECT OrderID, RTO, CAST(split_rank % 5 AS INTEGER) AS fold FROM split""", "cod"))


def tree_sql(rows: str, num: list[str], cat: list[str], a: str, b: str, measure: str, depth: int = 6) -> str:
    """CTEs ``t0 .. t<depth>``: the rows of ``rows`` (with is_test) and the tree node (from 1,
    children 2n and 2n + 1) that each has reached after that many levels; ``a`` and ``b`` are what
    is summed over the training rows."""
    n = len(num)
    xs = ", ".join(f"x{i}" for i in range(n))
    ss = ", ".join(f"s{i}" for i in range(len(cat)))
    filled = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM {rows} WHERE is_test = 0), 0) AS x{i}"
                       for i, c in enumerate(num))
    if measure == "gini":
        w = [f"(SELECT count(*) / (2.0::DOUBLE * count(*) FILTER ({c} = 1)) FROM t0 WHERE is_test = 0)" for c in (a, b)]
        x, y = f"({{0}}a::DOUBLE * {w[0]})", f"({{0}}b::DOUBLE * {w[1]})"
        one = f"(({x} * {x} + {y} * {y}) / ({x} + {y}))"
        valid = "ta > 0 AND tb > 0 AND la + lb > 0 AND ta - la + tb - lb > 0"
    else:
        one, valid = "({0}b::DOUBLE * {0}b::DOUBLE / {0}a::DOUBLE)", "la > 0 AND ta - la > 0"
    out = [f"t0 AS MATERIALIZED (SELECT *, {filled}, " + ", ".join(f"{c} AS s{i}" for i, c in enumerate(cat))
           + f", 1 AS node FROM {rows})"]
    for k in range(depth):
        here = f"FROM t{k} WHERE is_test = 0 AND node >= {1 << k} AND node < {2 << k}"
        each = [f"SELECT node, {j} AS col, x{j} AS v, NULL::VARCHAR AS lev, sum({a}) AS a, sum({b}) AS b {here} GROUP BY node, x{j}"
                for j in range(n)]
        each += [f"SELECT node, {n + j} AS col, NULL::DOUBLE AS v, s{j} AS lev, sum({a}) AS a, sum({b}) AS b {here} GROUP BY node, s{j}"
                 for j in range(len(cat))]
        out.append(f"u{k} AS MATERIALIZED (" + " UNION ALL ".join(each) + ")")
        out.append(f"""w{k} AS MATERIALIZED (SELECT node, col, lev, (v + lead(v) OVER run) / 2 AS thr,
            CASE WHEN col < {n} THEN sum(a) OVER run ELSE sum(a) OVER every - a END AS la,
            CASE WHEN col < {n} THEN sum(b) OVER run ELSE sum(b) OVER every - b END AS lb,
            sum(a) OVER every AS ta, sum(b) OVER every AS tb FROM u{k}
            WINDOW run AS (PARTITION BY node, col ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   every AS (PARTITION BY node, col))""")
        out.append(f"""c{k} AS MATERIALIZED (SELECT node, col, lev, thr, la, lb, ta - la AS ra, tb - lb AS rb FROM w{k}
            WHERE (thr IS NOT NULL OR lev IS NOT NULL) AND {valid})""")
        out.append(f"""b{k} AS MATERIALIZED (SELECT node, col, lev, thr FROM c{k} QUALIFY row_number() OVER (PARTITION BY node
            ORDER BY {one.format('l')} + {one.format('r')} DESC, col, coalesce(thr, 0), coalesce(lev, '')) = 1)""")
        out.append(f"""t{k + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN r.node ELSE 2 * r.node
            + (CASE WHEN b.col < {n} THEN list_value({xs})[b.col + 1] > b.thr
               ELSE coalesce(list_value({ss})[b.col - {n - 1}] = b.lev, false) END)::INT END AS node
            FROM t{k} r LEFT JOIN b{k} b ON r.node = b.node)""")
    return ",\n".join(out)


_NUM = ["OrderValue", "DiscountPct", "PriorOrders", "PriorRTORate", "FirstTime", "OrderHour", "Items"]
_CAT = ["CityTier", "State", "Category", "Device", "AddressQuality"]
_HELD = """
held AS (SELECT *, CASE WHEN split_rank <= ceil(n_class * 0.25) THEN 1 ELSE 0 END AS is_test,
         (RTO = 0)::INT AS is0, (RTO = 1)::INT AS is1 FROM split)"""
sql("model_tree", with_ctes_extra(
    _SPLIT.format(src="cod") + "," + _HELD + ",\n" + tree_sql("held", _NUM, _CAT, "is0", "is1", "gini") + """,
cw AS (SELECT count(*) / (2.0::DOUBLE * count(*) FILTER (is0 = 1)) AS w0, count(*) / (2.0::DOUBLE * count(*) FILTER (is1 = 1)) AS w1
       FROM t6 WHERE is_test = 0),
leaf AS (SELECT node, sum(is1)::DOUBLE * any_value(w1) / (sum(is0)::DOUBLE * any_value(w0) + sum(is1)::DOUBLE * any_value(w1)) AS risk
         FROM t6 CROSS JOIN cw WHERE is_test = 0 GROUP BY node)""", """
SELECT OrderID, RTO, round(risk, 6) AS Risk, (risk > 0.5)::INT::DOUBLE AS prediction
FROM t6 JOIN leaf ON t6.node = leaf.node WHERE is_test = 1""", "cod"))
sql("top_low_mid_high", with_ctes_extra(f"""
ranked AS (SELECT OrderID, CustomerID, CityTier, Category, OrderValue, PriorOrders, PriorReturns, Score,
                  row_number() OVER (ORDER BY Score, {hbits('OrderID', 'mid')}, OrderID) - 1 AS pos,
                  count(*) OVER () AS n
           FROM cod_scored_sql WHERE Score IS NOT NULL)""", """
SELECT OrderID, CustomerID, CityTier, Category, OrderValue, PriorOrders, PriorReturns, Score,
  CASE WHEN pos < 2 THEN 'lowest' WHEN pos >= n - 2 THEN 'highest' ELSE 'middle' END AS part
FROM ranked WHERE pos < 2 OR pos >= n - 2 OR pos = n // 2 - 1 OR pos = n // 2""", "cod_scored_sql"))

_BASKET = f"""
basket AS (
  SELECT OrderID,
    coalesce(CityTier, 'Tier unknown') AS tier, 'cat ' || coalesce(Category, 'unknown') AS cat,
    coalesce(AddressQuality, 'Unknown') || ' address' AS addr, 'dev ' || coalesce(Device, 'Unknown') AS dev,
    coalesce(CASE WHEN DiscountPct > -1 AND DiscountPct <= 10 THEN 'disc 0-10%'
                  WHEN DiscountPct > 10 AND DiscountPct <= 25 THEN 'disc 11-25%'
                  WHEN DiscountPct > 25 AND DiscountPct <= 40 THEN 'disc 26-40%'
                  WHEN DiscountPct > 40 AND DiscountPct <= 100 THEN 'disc 40%+' END, 'disc unknown') AS disc,
    CASE WHEN FirstTime = 1 THEN 'first-timer' ELSE 'repeat buyer' END AS first,
    CASE WHEN RTO = 1 THEN 'RETURNED' ELSE 'delivered' END AS out,
    RTO
  FROM cod)"""
_TRAITS = ["tier", "cat", "addr", "dev", "disc", "first"]
_RULES = _BASKET + """,
detail AS (SELECT tier, cat, addr, dev, disc, first, count(*) AS n, sum(RTO) AS r FROM basket
           GROUP BY tier, cat, addr, dev, disc, first),
totals AS (SELECT sum(n) AS N, sum(r) AS R FROM detail),
cube_t AS (SELECT tier, cat, addr, dev, disc, first, sum(n) AS nA, sum(r) AS rA
           FROM detail GROUP BY CUBE (tier, cat, addr, dev, disc, first)),
rules AS (
  SELECT array_to_string(list_sort(list_filter([tier, cat, addr, dev, disc, first], lambda x: x IS NOT NULL)), ' + ') AS combo,
         CAST(len(list_filter([tier, cat, addr, dev, disc, first], lambda x: x IS NOT NULL)) AS INTEGER) AS n_antecedents,
         rA / N AS support, rA / nA AS confidence, (rA / nA) / (R / N) AS lift
  FROM cube_t, totals),
rules_out AS (
  SELECT combo, n_antecedents, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift
  FROM rules WHERE n_antecedents >= 2 AND support >= 0.02 AND lift >= 1.0)"""
sql("top_rules", with_ctes_extra(_RULES, "SELECT * FROM rules_out ORDER BY lift DESC, combo LIMIT 12", "cod"))
sql("set_union_all", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS lens, {c} AS level, round(avg(RTO), 6) AS return_rate, count(*) AS n "
    f"FROM cod WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in ["CityTier", "Category", "AddressQuality", "Device"]), "cod"))
sql("set_distinct", with_ctes("SELECT DISTINCT CustomerID, CityTier FROM cod_clean", "cod_clean"))

# ------------------------------------------------------------------ 2.7 metrics on a fixed score
sql("score_map", with_ctes("SELECT OrderID, round(Risk, 6) AS Risk, Score FROM cod_scored_sql", "cod_scored_sql"))
_AUC = """
sc AS (SELECT {s} AS s, count(*) FILTER (WHERE RTO = 1) AS pos, count(*) FILTER (WHERE RTO <> 1) AS neg
       FROM cod_scored_sql WHERE {s} IS NOT NULL AND RTO IS NOT NULL GROUP BY {s}),
cum AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
        FROM sc)"""
sql("metric_auc", with_ctes_extra(_AUC.format(s="round(Risk, 9)"), """
SELECT round(sum(pos * neg_before + 0.5 * pos * neg) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) AS auc FROM cum""",
    "cod_scored_sql"))
sql("metric_auc_score", with_ctes_extra(_AUC.format(s="-Score"), """
SELECT round(sum(pos * neg_before + 0.5 * pos * neg) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) AS auc FROM cum""",
    "cod_scored_sql"))
sql("metric_roc_curve", with_ctes_extra("""
sc AS (SELECT Score, count(*) FILTER (WHERE RTO = 1) AS pos, count(*) FILTER (WHERE RTO <> 1) AS neg
       FROM cod_scored_sql WHERE Score IS NOT NULL GROUP BY Score),
cum AS (SELECT *, sum(pos) OVER (ORDER BY Score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
               sum(neg) OVER (ORDER BY Score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM sc)""", """
SELECT Score AS threshold, round(fp / (SELECT sum(neg) FROM sc), 6) AS fpr, round(tp / (SELECT sum(pos) FROM sc), 6) AS tpr
FROM cum""", "cod_scored_sql"))
_CONF = """
pred AS (SELECT *, CASE WHEN Risk >= 0.5 THEN 1 WHEN Risk IS NOT NULL THEN 0 END AS Pred FROM cod_scored_sql),
cm AS (SELECT count(*) FILTER (WHERE RTO = 1 AND Pred = 1) AS tp, count(*) FILTER (WHERE RTO = 0 AND Pred = 1) AS fp,
              count(*) FILTER (WHERE RTO = 0 AND Pred = 0) AS tn, count(*) FILTER (WHERE RTO = 1 AND Pred = 0) AS fn
       FROM pred)"""
sql("metric_prf", with_ctes_extra(_CONF, """
SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM cm""", "cod_scored_sql"))
sql("metric_confusion", with_ctes_extra(_CONF, """
SELECT 0 AS actual, 0 AS predicted, tn AS n FROM cm UNION ALL SELECT 0, 1, fp FROM cm
UNION ALL SELECT 1, 0, fn FROM cm UNION ALL SELECT 1, 1, tp FROM cm""", "cod_scored_sql"))
sql("metric_report", with_ctes_extra(_CONF + """,
pr AS (SELECT coalesce(tn / nullif(tn + fn, 0), 0.0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0.0) AS r0,
              coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0.0) AS f0,
              coalesce(tp / nullif(tp + fp, 0), 0.0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r1,
              coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1,
              CAST(tn + fp AS DOUBLE) AS s0, CAST(tp + fn AS DOUBLE) AS s1 FROM cm)""", """
SELECT 'Delivered' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, CAST(s0 AS BIGINT) AS support FROM pr
UNION ALL SELECT 'Returned', round(p1, 6), round(r1, 6), round(f1, 6), CAST(s1 AS BIGINT) FROM pr
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), CAST(s0 + s1 AS BIGINT) FROM pr
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / (s0 + s1), 6), round((r0 * s0 + r1 * s1) / (s0 + s1), 6),
                 round((f0 * s0 + f1 * s1) / (s0 + s1), 6), CAST(s0 + s1 AS BIGINT) FROM pr""", "cod_scored_sql"))
sql("metric_accuracy", with_ctes_extra(_CONF + "," + _SPLIT.format(src="pred"), """
SELECT CASE WHEN split_rank <= ceil(n_class * 0.25) THEN 1 ELSE 0 END AS is_test,
       round(avg((RTO = Pred)::INT), 6) AS accuracy, count(*) AS n
FROM split GROUP BY 1""", "cod_scored_sql"))
sql("split_stats", with_ctes_extra(_SPLIT.format(src="cod"), """
SELECT CASE WHEN split_rank <= ceil(n_class * 0.25) THEN 1 ELSE 0 END AS is_test, count(*) AS n,
       round(avg(RTO), 6) AS rto_rate FROM split GROUP BY 1""", "cod"))
sql("calibration", with_ctes("""
SELECT CityTier, round(avg(Risk), 6) AS mean_predicted, round(avg(RTO), 6) AS actual_rate, count(*) AS n
FROM cod_scored_sql GROUP BY CityTier""", "cod_scored_sql"))
sql("reason_codes", with_ctes_extra("""
rs AS (SELECT OrderID, list_filter([
    CASE WHEN PriorOrders = 0 THEN '+history:none'
         WHEN PriorReturns / greatest(PriorOrders, 1) > 0.3 THEN printf('+history:%d/%d', PriorReturns, PriorOrders)
         WHEN PriorReturns = 0 AND PriorOrders >= 3 THEN printf('-history:%d/%d', PriorReturns, PriorOrders) END,
    CASE AddressQuality WHEN 'Vague' THEN '+address:vague' WHEN 'Complete' THEN '-address:complete' END,
    CASE CityTier WHEN 'Tier-3' THEN '+tier:3' WHEN 'Tier-1' THEN '-tier:1' END,
    CASE WHEN Category IN ('Fashion', 'Footwear') THEN '+category:' || Category
         WHEN Category IN ('Electronics', 'Health') THEN '-category:' || Category END,
    CASE WHEN DiscountPct >= 40 THEN '+discount:deep' END
  ], lambda x: x IS NOT NULL)[1:5] AS reasons FROM cod)""", """
SELECT OrderID, array_to_string(reasons, '; ') AS reasons, CAST(len(reasons) AS INTEGER) AS n_reasons FROM rs""",
    "cod"))

# ------------------------------------------------------------------ 2.8 policy
sql("policy_tier", with_ctes(
    f"SELECT OrderID, Score, {TIER_CASE.format(lo=580, hi=720)} AS Tier FROM cod_scored_sql", "cod_scored_sql"))


def summary_sql(lo: int, hi: int) -> str:
    return with_ctes_extra(f"""
t AS (SELECT *, {TIER_CASE.format(lo=lo, hi=hi)} AS Tier FROM cod_scored_sql WHERE Score IS NOT NULL),
agg AS (SELECT Tier, count(*) AS orders, avg(RTO) AS rr, avg(Score) AS sc, avg(OrderValue) AS ov FROM t GROUP BY Tier),
dim AS (SELECT * FROM (VALUES ('Free COD', 0), ('COD + fee', 1), ('Prepaid-only', 2)) d(Tier, tier_order)),
summ AS (
  SELECT dim.Tier, CAST(dim.tier_order AS INTEGER) AS tier_order, CAST(coalesce(orders, 0) AS BIGINT) AS orders,
         round(rr, 6) AS return_rate, round(sc, 6) AS avg_score, round(ov, 6) AS avg_order,
         round(coalesce(orders, 0) / (SELECT count(*) FROM t), 6) AS share
  FROM dim LEFT JOIN agg ON dim.Tier = agg.Tier)""", "SELECT * FROM summ", "cod_scored_sql")


sql("policy_summary", summary_sql(580, 720))
sql("policy_guard", summary_sql(720, 730))
sql("policy_monotonic", summary_sql(580, 720).replace("SELECT * FROM summ", """
SELECT Tier, tier_order, return_rate, lag(return_rate) OVER (ORDER BY tier_order) AS prev_rate,
       coalesce(return_rate > lag(return_rate) OVER (ORDER BY tier_order), true) AS rises FROM summ"""))
_MONEY = with_ctes_extra(f"""
t AS (SELECT *, {TIER_CASE.format(lo=580, hi=720)} AS Tier FROM cod_scored_sql WHERE Score IS NOT NULL),
a AS (SELECT sum(RTO) AS r, sum(RTO) FILTER (WHERE Tier = 'Prepaid-only') AS pp_r,
             count(*) FILTER (WHERE Tier = 'Prepaid-only') AS pp_n,
             avg(OrderValue) FILTER (WHERE Tier = 'Prepaid-only') AS pp_v,
             count(*) FILTER (WHERE Tier = 'COD + fee') AS fee_n FROM t),
m AS (SELECT round(coalesce(r, 0) * 250.0, 6) AS baseline_loss,
             round(coalesce(pp_r, 0) * 0.9 * 250.0, 6) AS saved,
             round((pp_n - coalesce(pp_r, 0)) * 0.25 * coalesce(pp_v, 0.0) * 0.2, 6) AS lost_margin,
             round(fee_n * 50.0 * 0.85, 6) AS fee_income,
             round(coalesce(pp_r, 0) * 0.9 * 250.0 + fee_n * 50.0 * 0.85
                   - (pp_n - coalesce(pp_r, 0)) * 0.25 * coalesce(pp_v, 0.0) * 0.2, 6) AS net FROM a)""",
    "SELECT {cols} FROM m", "cod_scored_sql")
sql("policy_baseline_loss", _MONEY.replace("{cols}", "CAST(baseline_loss AS DOUBLE) AS baseline_loss"))
sql("policy_saved", _MONEY.replace("{cols}", "CAST(saved AS DOUBLE) AS saved"))
sql("policy_lost_margin", _MONEY.replace("{cols}", "CAST(lost_margin AS DOUBLE) AS lost_margin"))
sql("policy_fee_income", _MONEY.replace("{cols}", "CAST(fee_income AS DOUBLE) AS fee_income"))
sql("policy_net", _MONEY.replace("{cols}", "CAST(baseline_loss AS DOUBLE) AS baseline_loss, CAST(saved AS DOUBLE) AS saved, "
                                 "CAST(lost_margin AS DOUBLE) AS lost_margin, CAST(fee_income AS DOUBLE) AS fee_income, "
                                 "CAST(net AS DOUBLE) AS net"))
sql("policy_sweep", with_ctes_extra("""
lh AS (SELECT low::INTEGER AS low, high::INTEGER AS high, CASE WHEN low >= high THEN low + 10 ELSE high END AS cut
       FROM range(300, 701, 10) l(low), range(600, 901, 10) h(high)),
a AS (SELECT low, high, sum(RTO) AS r, coalesce(sum(RTO) FILTER (WHERE Score < low), 0) AS pp_r,
             count(*) FILTER (WHERE Score < low) AS pp_n, coalesce(avg(OrderValue) FILTER (WHERE Score < low), 0.0) AS pp_v,
             count(*) FILTER (WHERE Score >= low AND Score < cut) AS fee_n
      FROM lh, cod_scored_sql WHERE Score IS NOT NULL GROUP BY low, high),
g AS (SELECT a.*, fee::DOUBLE AS fee, cost::DOUBLE AS cost
      FROM a, range(0, 151, 5) f(fee), range(100, 601, 10) c(cost))""", """
SELECT low, high, fee, cost, round(r * cost, 6) AS baseline_loss, round(pp_r * 0.9::DOUBLE * cost, 6) AS saved,
       round((pp_n - pp_r) * 0.25::DOUBLE * pp_v * 0.2::DOUBLE, 6) AS lost_margin,
       round(fee_n * fee * 0.85::DOUBLE, 6) AS fee_income,
       round(pp_r * 0.9::DOUBLE * cost + fee_n * fee * 0.85::DOUBLE - (pp_n - pp_r) * 0.25::DOUBLE * pp_v * 0.2::DOUBLE, 6) AS net
FROM g""", "cod_scored_sql"))

# ------------------------------------------------------------------ 2.11 rules
sql("basket_build", with_ctes_extra(_BASKET, """
SELECT OrderID, concat_ws(' | ', tier, cat, addr, dev, disc, first, out) AS basket FROM basket""", "cod"))
sql("rules_cube", with_ctes_extra(_RULES, "SELECT * FROM rules_out", "cod"))
sql("rules_returned", with_ctes_extra(_RULES, "SELECT * FROM rules_out", "cod"))
sql("frequent_itemsets", with_ctes_extra(_BASKET + """,
cube7 AS (SELECT tier, cat, addr, dev, disc, first, out, count(*) AS freq FROM basket
          GROUP BY CUBE (tier, cat, addr, dev, disc, first, out))""", """
SELECT array_to_string(list_sort(list_filter([tier, cat, addr, dev, disc, first, out], lambda x: x IS NOT NULL)), ' + ') AS itemset,
       CAST(len(list_filter([tier, cat, addr, dev, disc, first, out], lambda x: x IS NOT NULL)) AS INTEGER) AS size,
       freq
FROM cube7 WHERE freq >= ceil(0.02 * (SELECT count(*) FROM basket))
  AND len(list_filter([tier, cat, addr, dev, disc, first, out], lambda x: x IS NOT NULL)) > 0""", "cod"))
sql("fmt_rules", with_ctes_extra(_RULES, """
SELECT combo, format('{:.1f}', support * 100) || '%' AS how_common,
       CAST(CAST(round_even(confidence * 100, 0) AS INTEGER) AS VARCHAR) || '%' AS return_follows,
       round(lift, 2) AS times_riskier, lift
FROM (SELECT * FROM rules_out ORDER BY lift DESC, combo LIMIT 12)""", "cod"))

# ------------------------------------------------------------------ 2.7 preparation, KNN
_NUM = ["OrderValue", "DiscountPct", "PriorOrders", "PriorRTORate", "FirstTime", "OrderHour", "Items"]
sql("prep_scale", with_ctes_extra(
    "dm AS (SELECT OrderID, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _NUM) + " FROM cod)",
    "SELECT OrderID, " + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM dm)) / nullif((SELECT stddev_pop({c}) FROM dm), 0), 6) AS z_{c}"
        for c in _NUM) + " FROM dm", "cod"))
sql("class_weights", with_ctes("""
SELECT RTO, count(*) AS n, round((SELECT count(*) FROM cod) / (2.0 * count(*)), 6) AS weight
FROM cod GROUP BY RTO""", "cod"))
sql("knn_join", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
pairs AS (SELECT a.vec_id AS q, b.vec_id AS t, b.label AS label, list_distance(a.x, b.x) AS d
          FROM e a, e b WHERE a.vec_id <> b.vec_id),
r AS (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY d, t) AS rn FROM pairs)
SELECT q AS vec_id, CAST(sum(label) AS INTEGER) AS n_positive,
       CASE WHEN sum(label) / count(*) > 0.5 THEN 1 ELSE 0 END AS pred
FROM r WHERE rn <= 25 GROUP BY q""")

# ------------------------------------------------------------------ 2.9 silhouette
_HABITS = ["Orders", "AvgValue", "AvgDiscount", "PctCOD", "ReturnRate"]
_APART = " + ".join(f"(a.z{i} - b.z{i}) * (a.z{i} - b.z{i})" for i in range(len(_HABITS)))
sql("silhouette_labels", with_ctes_extra("""
shoppers AS (SELECT row_number() OVER (ORDER BY CustomerID) AS id, count(*) AS Orders, avg(OrderValue) AS AvgValue,
    avg(DiscountPct) AS AvgDiscount, avg(IsCOD) AS PctCOD, avg(RTO) AS ReturnRate
  FROM cod_clean WHERE CustomerID IS NOT NULL GROUP BY CustomerID),
zs AS (SELECT id, """ + ", ".join(
    f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0.0) AS z{i}" for i, c in enumerate(_HABITS)) + """
  FROM shoppers),
groups AS (SELECT id, 0 AS labelling, CASE WHEN ReturnRate > 0 THEN 1 ELSE 0 END AS g FROM shoppers
  UNION ALL SELECT id, 1, CASE WHEN PctCOD = 0 THEN 0 WHEN PctCOD = 1 THEN 2 ELSE 1 END FROM shoppers),
apart AS (SELECT a.id, l.labelling, l.g, sum(sqrt(""" + _APART + """)) AS d, count(*) AS n
  FROM zs a, zs b JOIN groups l ON l.id = b.id GROUP BY a.id, l.labelling, l.g),
sides AS (SELECT m.labelling, m.id, max(CASE WHEN s.g = m.g THEN s.n END) AS n,
    max(CASE WHEN s.g = m.g THEN s.d / greatest(s.n - 1, 1) END) AS inside, min(CASE WHEN s.g <> m.g THEN s.d / s.n END) AS outside
  FROM groups m JOIN apart s ON s.id = m.id AND s.labelling = m.labelling GROUP BY m.labelling, m.id)""", """
SELECT CAST(labelling AS INTEGER) AS labelling, round(avg(CASE WHEN n = 1 OR outside IS NULL OR greatest(inside, outside) = 0 THEN 0.0
       ELSE (outside - inside) / greatest(inside, outside) END), 6) AS silhouette
FROM sides GROUP BY labelling""", "cod_clean"))

# ------------------------------------------------------------------ 2.10 regression baseline
_CAT_ONLY = f"""
sp AS (SELECT OrderID, Category, CAST(OrderValue AS DOUBLE) AS y,
              row_number() OVER (ORDER BY {hbits('OrderID', '42')}, OrderID) AS rk, count(*) OVER () AS n
       FROM cod_clean),
tr AS (SELECT * FROM sp WHERE rk > ceil(n * 0.25)),
te AS (SELECT * FROM sp WHERE rk <= ceil(n * 0.25)),
cm AS (SELECT Category, avg(y) AS m FROM tr GROUP BY Category),
pred AS (SELECT te.OrderID, te.Category, te.y, coalesce(cm.m, (SELECT avg(y) FROM tr)) AS p
         FROM te LEFT JOIN cm ON te.Category IS NOT DISTINCT FROM cm.Category),
fit AS (SELECT sum(pow(y - p, 2)) AS sse, var_pop(y) * count(y) AS sst, avg(abs(y - p)) AS mae
        FROM pred)"""
sql("reg_category_only", with_ctes_extra(_CAT_ONLY, "SELECT OrderID, Category, y, round(p, 6) AS p FROM pred",
                                         "cod_clean"))
sql("metric_r2", with_ctes_extra(_CAT_ONLY, "SELECT round(1.0 - sse / sst, 6) AS r2 FROM fit",
                                 "cod_clean"))
sql("metric_mae", with_ctes_extra(_CAT_ONLY, "SELECT round(mae, 6) AS mae FROM fit", "cod_clean"))

_REG_NUM = ["DiscountPct", "Items", "OrderHour", "FirstTime", "PriorOrders"]
_REG_CAT = ["Category", "CityTier", "Device", "AddressQuality", "PaymentMethod"]
sql("reg_tree", with_ctes_extra(f"""
numbered AS (SELECT *, CAST(OrderValue AS DOUBLE) AS y, CAST(OrderValue AS DECIMAL(20,4)) AS y_dec, 1::BIGINT AS one,
             CAST(row_number() OVER (ORDER BY {hbits('OrderID', '42')}, OrderID) AS BIGINT) AS split_rank, count(*) OVER () AS n_all
             FROM cod_clean),
held AS (SELECT *, CASE WHEN split_rank <= ceil(n_all * 0.25) THEN 1 ELSE 0 END AS is_test FROM numbered),
""" + tree_sql("held", _REG_NUM, _REG_CAT, "one", "y_dec", "squares") + """,
leaf AS (SELECT node, sum(y_dec)::DOUBLE / count(*) AS p FROM t6 WHERE is_test = 0 AND y IS NOT NULL GROUP BY node),
pred AS (SELECT y, p FROM t6 JOIN leaf ON t6.node = leaf.node WHERE is_test = 1)""", """
SELECT 'Decision Tree' AS model, round(1.0 - sum(pow(y - p, 2)) / (var_pop(y) * count(y)), 6) AS r2,
       round(avg(abs(y - p)), 6) AS mae FROM pred""", "cod_clean"))
_LEVELS = ", ".join(f"(SELECT list(DISTINCT {c} ORDER BY {c}) FILTER ({c} IS NOT NULL) FROM cod) AS l{i}" for i, c in enumerate(_CAT))
_HOT = " || ".join(f"list_transform(l{i}, lambda v: CASE WHEN {c} = v THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)" for i, c in enumerate(_CAT))
sql("prep_onehot", with_ctes_extra(f"lev AS (SELECT {_LEVELS})",
                                   f"SELECT OrderID, {_HOT} AS onehot FROM cod CROSS JOIN lev", "cod"))
_FILLED = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM cod)) AS x{i}" for i, c in enumerate(_NUM))
_STATS = ", ".join(f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}" for i in range(len(_NUM)))
_SCALED = ", ".join(f"round(coalesce((x{i} - m{i}) / nullif(s{i}, 0), 0), 6)" for i in range(len(_NUM)))
sql("prep_pipeline", with_ctes_extra(f"""
lev AS (SELECT {_LEVELS}), filled AS (SELECT *, {_FILLED} FROM cod), st AS (SELECT {_STATS} FROM filled)""",
    f"SELECT OrderID, [{_SCALED}] || {_HOT} AS features, RTO FROM filled CROSS JOIN lev CROSS JOIN st", "cod"))
sql("rate_by", with_ctes(rate_by_sql("cod", "Device", "Device", 20), "cod"))
sql("basket_onehot", with_ctes_extra(_BASKET, """
SELECT OrderID, CAST(len(list_distinct([tier, cat, addr, dev, disc, first, out])) AS INTEGER) AS n_items,
       array_to_string(list_sort(list_distinct([tier, cat, addr, dev, disc, first, out])), ' | ') AS items_present
FROM basket""", "cod"))
sql("rules_lift", with_ctes_extra(_BASKET + """,
cube7 AS (SELECT tier, cat, addr, dev, disc, first, out, count(*) AS freq FROM basket
          GROUP BY CUBE (tier, cat, addr, dev, disc, first, out)),
nb AS (SELECT count(*) AS N FROM basket),
fi AS (SELECT list_sort(list_filter([tier, cat, addr, dev, disc, first, out], lambda x: x IS NOT NULL)) AS items, freq
       FROM cube7, nb WHERE freq >= ceil(0.02 * N)
         AND len(list_filter([tier, cat, addr, dev, disc, first, out], lambda x: x IS NOT NULL)) > 0),
cons AS (SELECT items, freq, unnest(items) AS c FROM fi WHERE len(items) >= 2),
r AS (SELECT list_filter(items, lambda x: x <> c) AS ante, c, freq AS f_s FROM cons),
m AS (SELECT r.ante, r.c, r.f_s, fa.freq AS f_a, fc.freq AS f_c FROM r
      JOIN fi fa ON fa.items = r.ante JOIN fi fc ON fc.items = [r.c])""", """
SELECT array_to_string(ante, ' + ') AS antecedent, c AS consequent, round(f_s / N, 6) AS support,
       round(f_s / f_a, 6) AS confidence, round((f_s / f_a) / (f_c / N), 6) AS lift
FROM m, nb WHERE (f_s / f_a) / (f_c / N) >= 1.0""", "cod"))

# p-value: upper tail of chi-square(dof) = 1 - P(dof/2, chi2/2), P by its power series
# sum_n exp(-x + (a + n) ln x - lgamma(a + n + 1)) (DuckDB has lgamma but no chi-square)
_PVALUE = CHI_CTE + """,
gser AS (SELECT clue, chi2, dof, sum(exp(-chi2 / 2 + (dof / 2.0 + g.n) * ln(chi2 / 2) - lgamma(dof / 2.0 + g.n + 1))) AS P
          FROM chi, generate_series(0, 40000) g(n) WHERE dof > 0 AND chi2 > 0 GROUP BY clue, chi2, dof),
pv AS (SELECT chi.clue, CASE WHEN chi.dof > 0 AND chi.chi2 > 0 THEN greatest(0.0, 1.0 - gser.P) ELSE 1.0 END AS p
       FROM chi LEFT JOIN gser USING (clue))"""
sql("association_table", with_ctes_extra(_PVALUE, """
SELECT clue, round(cramers_v, 3) AS cramers_v_3, cramers_v, chi2, dof, n_levels, round(p, 6) AS p_value,
       p < 0.05 AS real_link FROM chi_v JOIN pv USING (clue)""", "cod_clean"))
sql("chi_square_pvalue", with_ctes_extra(_PVALUE, """
SELECT chi_v.*, round(p, 6) AS p_value, p < 0.05 AS real_link FROM chi_v JOIN pv USING (clue)""", "cod_clean"))

sql("preview_cleaning", with_ctes("""
SELECT f.OrderID, f.OrderValue AS OrderValue_raw, f.DiscountPct AS DiscountPct_raw, f.CityTier AS CityTier_raw,
       f.State AS State_raw, f.Device AS Device_raw, f.AddressQuality AS AddressQuality_raw,
       c.OrderValue, c.DiscountPct, c.CityTier, c.State, c.Device, c.AddressQuality
FROM (SELECT DISTINCT * FROM cod_raw ORDER BY OrderID LIMIT 8) f LEFT JOIN cod_clean c USING (OrderID)""", "cod_clean"))
sql("pivot_tier_category_wide", with_ctes("""
SELECT t.CityTier, """ + ", ".join(
    f"round(avg(RTO) FILTER (WHERE Category = '{c}'), 6) AS {c}" for c in ("Electronics", "Fashion", "Unknown")) + """
FROM (VALUES ('Tier-1'), ('Tier-2'), ('Tier-3')) t(CityTier) LEFT JOIN cod ON cod.CityTier = t.CityTier
GROUP BY t.CityTier""", "cod"))

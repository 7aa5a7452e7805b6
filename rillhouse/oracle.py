"""The registered queries restated in SQL over the driver's tables."""

from __future__ import annotations

# --- trade ----------------------------------------------------------------------

_TRADE = """
dic(dic_code, dic_name) AS (
  VALUES ('A', 'search'), ('N', 'promotion'), ('1-URGENT', 'wallet'), ('2-HIGH', 'card')
),
od AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CAST(CAST(l_extendedprice AS DECIMAL(16,2)) * 100 AS BIGINT),
           CAST(l_shipdate AS DATE)) AS id,
         CAST(l_orderkey AS VARCHAR) AS order_id,
         CAST(l_partkey AS VARCHAR) AS sku_id,
         p_name AS sku_name,
         CAST(l_shipdate AS VARCHAR) AS create_time,
         CAST(l_suppkey AS VARCHAR) AS source_id,
         l_returnflag AS source_type,
         CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) AS sku_num,
         CAST(CAST(floor(l_quantity) AS DECIMAL(14,2)) * CAST(l_extendedprice AS DECIMAL(16,2))
           AS VARCHAR) AS split_original_amount,
         CAST(CAST(l_extendedprice AS DECIMAL(16,2)) AS VARCHAR) AS split_total_amount,
         CAST(CAST(l_discount AS DECIMAL(16,2)) AS VARCHAR) AS split_activity_amount,
         CAST(CAST(l_tax AS DECIMAL(16,2)) AS VARCHAR) AS split_coupon_amount,
         CAST(CAST(epoch(l_shipdate) AS BIGINT) AS VARCHAR) AS od_ts,
         l_discount >= 0.05 AS has_activity, l_tax >= 0.04 AS has_coupon,
         l_suppkey, l_partkey
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
),
act AS (
  SELECT id AS act_id, CAST(l_suppkey % 5 AS VARCHAR) AS activity_id,
         CAST(l_suppkey % 7 AS VARCHAR) AS activity_rule_id
  FROM od WHERE has_activity
),
cou AS (
  SELECT id AS cou_id, CAST(l_partkey % 11 AS VARCHAR) AS coupon_id FROM od WHERE has_coupon
),
oi AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS oi_id, CAST(o_custkey AS VARCHAR) AS user_id,
         CAST(o_custkey % 25 AS VARCHAR) AS province_id, NULL AS operate_time,
         '1001' AS order_status, 'insert' AS type, NULL AS old,
         CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) AS oi_ts
  FROM orders
  UNION ALL
  SELECT CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR),
         CAST(o_custkey % 25 AS VARCHAR), CAST(o_orderdate AS VARCHAR),
         CASE WHEN o_orderstatus = 'F' THEN '1002' ELSE '1003' END, 'update',
         CASE WHEN o_orderstatus IN ('F', 'P') THEN '{"order_status":"1001"}'
              ELSE '{"total_amount":"0"}' END,
         CAST(CAST(epoch(o_orderdate) AS BIGINT) + 3600 AS VARCHAR)
  FROM orders WHERE o_orderstatus IN ('F', 'P') OR o_orderkey % 2 = 0
),
pre AS (
  SELECT od.id, od.order_id, oi.user_id, oi.order_status, od.sku_id, od.sku_name,
         oi.province_id, act.activity_id, act.activity_rule_id, cou.coupon_id,
         substr(od.create_time, 1, 10) AS date_id, od.create_time,
         substr(oi.operate_time, 1, 10) AS operate_date_id, oi.operate_time,
         od.source_id, od.source_type, dic.dic_name AS source_type_name, od.sku_num,
         od.split_original_amount, od.split_activity_amount, od.split_coupon_amount,
         od.split_total_amount, oi.type, oi.old, od.od_ts, oi.oi_ts
  FROM od JOIN oi ON od.order_id = oi.oi_id
  LEFT JOIN act ON od.id = act.act_id
  LEFT JOIN cou ON od.id = cou.cou_id
  LEFT JOIN dic ON od.source_type = dic.dic_code
),
detail AS (
  SELECT id, order_id, user_id, sku_id, sku_name, province_id, activity_id, activity_rule_id,
         coupon_id, date_id, create_time, source_id, source_type AS source_type_code,
         source_type_name, sku_num, split_original_amount, split_activity_amount,
         split_coupon_amount, split_total_amount, od_ts AS ts
  FROM pre WHERE type = 'insert'
),
cancel AS (
  SELECT id, order_id, user_id, sku_id, sku_name, province_id, activity_id, activity_rule_id,
         coupon_id, operate_date_id AS date_id, operate_time AS cancel_time, source_id,
         source_type AS source_type_code, source_type_name, sku_num, split_original_amount,
         split_activity_amount, split_coupon_amount, split_total_amount, oi_ts AS ts
  FROM pre
  WHERE type = 'update' AND json_extract_string(old, '$.order_status') IS NOT NULL
    AND order_status = '1003'
),
pi AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderpriority AS payment_type,
         NULL AS callback_time, false AS paid,
         CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) AS ts
  FROM orders WHERE o_orderstatus IN ('F', 'P')
  UNION ALL
  SELECT CAST(o_orderkey AS VARCHAR), o_orderpriority, CAST(o_orderdate AS VARCHAR), true,
         CAST(CAST(epoch(o_orderdate) AS BIGINT) + 7200 AS VARCHAR)
  FROM orders WHERE o_orderstatus = 'F'
),
pay AS (
  SELECT d.id AS order_detail_id, d.order_id, d.user_id, d.sku_id, d.sku_name, d.province_id,
         d.activity_id, d.activity_rule_id, d.coupon_id, pi.payment_type AS payment_type_code,
         dic.dic_name AS payment_type_name, pi.callback_time, d.source_id, d.source_type_code,
         d.source_type_name, d.sku_num, d.split_original_amount, d.split_activity_amount,
         d.split_coupon_amount, d.split_total_amount AS split_payment_amount, pi.ts, pi.paid
  FROM pi JOIN detail d ON pi.order_id = d.order_id
  LEFT JOIN dic ON pi.payment_type = dic.dic_code
)
"""

#: Distance in event time up to which the bounded stream joins match.
HORIZON_DAYS = 365
_FAR = f"CAST({{}} AS BIGINT) - CAST({{}} AS BIGINT)) <= {HORIZON_DAYS} * 86400"

# Coupons come 60 days later for each coupon number.
_TRADE_HORIZON = (
    _TRADE.replace("JOIN oi ON od.order_id = oi.oi_id", f"JOIN oi ON od.order_id = oi.oi_id AND abs({_FAR.format('oi_ts', 'od_ts')}")
    .replace("ON od.id = cou.cou_id", f"ON od.id = cou.cou_id AND CAST(coupon_id AS BIGINT) * 60 <= {HORIZON_DAYS}")
    .replace("JOIN detail d ON pi.order_id = d.order_id", f"JOIN detail d ON pi.order_id = d.order_id AND abs({_FAR.format('pi.ts', 'd.ts')}")
)

_CART = """
dic(dic_code, dic_name) AS (
  VALUES ('A', 'search'), ('N', 'promotion'), ('1-URGENT', 'wallet'), ('2-HIGH', 'card')
),
cart AS (
  SELECT concat_ws('-', user_id, event_id % 20) AS id, CAST(user_id AS VARCHAR) AS user_id,
         CAST(event_id % 20 AS VARCHAR) AS sku_id, CAST(event_id % 7 AS VARCHAR) AS source_id,
         CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS source_type_code,
         CASE event_type
           WHEN 'click' THEN CAST(floor(value) AS BIGINT)
           WHEN 'view' THEN CAST(floor(value) AS BIGINT) - CAST(floor(value / 2) AS BIGINT)
         END AS added,
         CAST(event_id AS VARCHAR) AS ts, event_type
  FROM events
),
cart_add AS (
  SELECT id, user_id, sku_id, source_id, source_type_code, dic_name AS source_type_name,
         CAST(added AS VARCHAR) AS sku_num, ts
  FROM cart LEFT JOIN dic ON source_type_code = dic_code
  WHERE event_type = 'click' OR (event_type = 'view' AND added > 0)
)
"""


def _latest(body: str, relation: str, key: str, version: str, drop: str = "") -> str:
    exclude = f"rn, {drop}" if drop else "rn"
    return f"""WITH {body}
SELECT * EXCLUDE ({exclude}) FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {version}) AS rn FROM {relation}
) WHERE rn = 1"""


# --- traffic --------------------------------------------------------------------

_LOG = """
ev AS (
  SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS mid, event_type, epoch_us(ts) // 1000 AS ts,
         CASE WHEN event_type = 'signup' THEN '1' ELSE '0' END AS is_new,
         CASE WHEN event_type NOT IN ('view', 'signup')
              THEN concat('p', event_id % 10) END AS last_page_id
  FROM events
),
good AS (
  SELECT * FROM ev WHERE seq % 97 <> 0 AND seq % 101 <> 0 AND seq % 103 <> 0
),
days AS (
  SELECT *, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS dt FROM good
),
firsts AS (
  SELECT *, first_value(CASE WHEN is_new = '1' THEN dt
      ELSE strftime(make_timestamp(ts * 1000) - INTERVAL 1 DAY, '%Y-%m-%d') END)
    OVER (PARTITION BY mid ORDER BY ts, seq) AS first_day
  FROM days
),
fixed AS (
  SELECT seq, mid, event_type, ts, last_page_id,
         CASE WHEN is_new = '1' AND dt <> first_day THEN '0' ELSE is_new END AS is_new
  FROM firsts
),
parts AS (
  SELECT *,
    concat('"common":{"is_new":"', is_new, '","mid":"', mid, '"}') AS j_common,
    concat('"page":{', CASE WHEN last_page_id IS NOT NULL
        THEN concat('"last_page_id":"', last_page_id, '",') ELSE '' END,
      '"page_id":"', event_type, '"}') AS j_page,
    CASE WHEN seq % 10 = 0 THEN ',"start":{"entry":"icon"}' ELSE '' END AS j_start,
    CASE WHEN event_type = 'error' THEN concat(',"err":{"code":', seq % 7, '}') ELSE '' END AS j_err,
    CASE seq % 4 WHEN 0 THEN '' WHEN 1 THEN ',"displays":[{"item":"d1"}]'
      WHEN 2 THEN ',"displays":[{"item":"d1"},{"item":"d2"}]'
      ELSE ',"displays":[{"item":"d1"},{"item":"d2"},{"item":"d3"}]' END AS j_displays,
    CASE seq % 3 WHEN 0 THEN '' WHEN 1 THEN ',"actions":[{"item":"a1"}]'
      ELSE ',"actions":[{"item":"a1"},{"item":"a2"}]' END AS j_actions,
    concat(',"ts":', ts, '}') AS j_ts
  FROM fixed
),
page_log AS (
  SELECT mid, is_new, last_page_id, ts, seq,
         concat('{', j_common, ',', j_page, j_ts) AS value
  FROM parts WHERE seq % 10 <> 0
),
start_log AS (
  SELECT mid, is_new, ts, seq,
         concat('{', j_common, ',', j_page, j_start, j_displays, j_actions, j_ts) AS value
  FROM parts WHERE seq % 10 = 0
),
error_log AS (
  SELECT mid, is_new, ts, seq,
         concat('{', j_common, ',', j_page, j_start, j_err, j_displays, j_actions, j_ts) AS value
  FROM parts WHERE event_type = 'error'
),
display_log AS (
  SELECT mid, is_new, ts, seq, concat('d', i) AS item,
         concat('{', j_common, ',', j_page, ',"display":{"item":"d', i, '"}', j_ts) AS value
  FROM parts, (VALUES (1), (2), (3)) AS n(i) WHERE seq % 10 <> 0 AND i <= seq % 4
),
action_log AS (
  SELECT mid, is_new, ts, seq, concat('a', i) AS item,
         concat('{', j_common, ',', j_page, ',"action":{"item":"a', i, '"}', j_ts) AS value
  FROM parts, (VALUES (1), (2)) AS n(i) WHERE seq % 10 <> 0 AND i <= seq % 3
),
dirty_log AS (
  SELECT seq, CASE WHEN seq % 97 = 0 THEN concat('{"common":{"mid":"', mid, '"')
                   WHEN seq % 101 = 0 THEN '[1]'
                   ELSE concat('{"page":{},"ts":', ts, '}') END AS value
  FROM ev WHERE seq % 97 = 0 OR seq % 101 = 0 OR seq % 103 = 0
)
"""

WITHIN_MS = 6 * 3600 * 1000
#: Lag of the late pages, and the watermark's delay.
LAG_MS = 3 * 3600 * 1000
#: A delay that is too short for the late pages.
LATE_MS = 3600 * 1000

_VIEWS = """
views AS (
  SELECT CAST(user_id AS VARCHAR) AS mid,
         CASE WHEN event_type NOT IN ('view', 'signup')
              THEN concat('p', event_id % 10) END AS last_page_id,
         epoch_us(ts) // 1000 AS ts, event_id AS seq
  FROM events
)
"""


def _visitors(body: str, relation: str) -> str:
    return f"""WITH {body},
entries AS (
  SELECT mid, last_page_id, ts, seq, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS dt
  FROM {relation} WHERE last_page_id IS NULL
)
SELECT * EXCLUDE (before) FROM (
  SELECT *, lag(dt) OVER (PARTITION BY mid ORDER BY ts, seq) AS before FROM entries
) WHERE before IS NULL OR before <> dt"""


def _jumps(body: str, relation: str, part: str, extra: str = "") -> str:
    match = f"(next_entry AND next_ts - ts < {WITHIN_MS})"
    timeout = f"(next_ts IS NULL OR next_ts - ts >= {WITHIN_MS})"
    wanted = {"match": match, "timeout": timeout, "all": f"({match} OR {timeout})"}[part]
    return f"""WITH {body},
ahead AS (
  SELECT mid, last_page_id, ts, seq,
         lead(ts) OVER w AS next_ts, lead(last_page_id IS NULL) OVER w AS next_entry
  FROM {relation} WINDOW w AS (PARTITION BY mid ORDER BY ts, seq)
)
SELECT mid, last_page_id, ts, seq FROM ahead
WHERE last_page_id IS NULL AND {wanted}{extra}"""


# --- change records and dimensions ------------------------------------------------

_CDC = """
ev AS (
  SELECT event_id AS seq, event_type, epoch_us(ts) // 1000 AS ms,
         event_id % 97 = 0 AS cut, event_id % 101 = 0 AS list, event_id % 103 = 0 AS bad_data
  FROM events
)
"""

_DIM = """
changes AS (
  SELECT 'region' AS source_table, 'dim_region' AS sink_table, 'insert' AS type, '1' AS ts,
         concat('{"r_regionkey":"', r_regionkey, '","r_name":"', r_name, '"}') AS data
  FROM region
  UNION ALL
  SELECT 'nation', 'dim_nation', 'insert', '1',
         concat('{"id":"', n_nationkey, '","n_name":"', n_name, '"}') FROM nation
  UNION ALL
  SELECT 'customer', 'dim_customer', type, ts,
         concat('{"c_custkey":"', c_custkey, '","c_nationkey":"', c_nationkey,
                '","c_mktsegment":"', segment, '"}')
  FROM customer_changes
  UNION ALL
  SELECT 'supplier', 'dim_supplier', 'insert', '1',
         concat('{"s_suppkey":"', s_suppkey, '","s_name":"', s_name, '","s_acctbal":"',
                CAST(s_acctbal AS DECIMAL(16,2)), '"}')
  FROM supplier
)
"""

_CUSTOMERS = """
customer_changes AS (
  SELECT c_custkey, c_nationkey, c_mktsegment AS segment, 'bootstrap-insert' AS type, '1' AS ts
  FROM customer
  UNION ALL
  SELECT c_custkey, c_nationkey, concat(c_mktsegment, '-2'), 'update', '2'
  FROM customer WHERE c_acctbal < 5000
  UNION ALL
  SELECT c_custkey, c_nationkey, c_mktsegment, 'delete', '3'
  FROM customer WHERE c_mktsegment = 'MACHINERY'
)
"""

_CUSTOMER_LATEST = f"""WITH {_CUSTOMERS},
newest AS (
  SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY ts DESC) AS rn
  FROM customer_changes
)
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
       segment AS c_mktsegment
FROM newest WHERE rn = 1"""

_CONFIG = """
changes AS (
  SELECT concat('src_', user_id) AS source_table,
         concat('dim_', user_id, '_', event_type) AS sink_table,
         CASE event_type WHEN 'view' THEN 'id,name' WHEN 'click' THEN 'sku_id, sku_name '
           WHEN 'signup' THEN 'sku_id,sku_name,price' ELSE 'sku_id' END AS sink_columns,
         CASE WHEN event_type <> 'view' THEN 'sku_id' END AS sink_pk,
         CASE WHEN event_type = 'click' THEN 'COMMENT ''clicked''' END AS sink_extend,
         event_type = 'error' AS deleted, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
  FROM events
),
config AS (SELECT * FROM changes WHERE rn = 1 AND NOT deleted)
"""


_CONFIG_BY_TIME = _CONFIG.replace(
    "ORDER BY event_id DESC", "ORDER BY epoch_us(ts) // 86400000000 DESC, event_id DESC"
)

_SKEWED_VIEWS = _VIEWS.replace(
    "CAST(user_id AS VARCHAR) AS mid",
    "CASE WHEN event_id % 2 = 0 THEN 'hot' ELSE CAST(user_id AS VARCHAR) END AS mid",
)

# All dimension tables; rows of the first batch lack a column that was configured later.
_DIMENSIONS = f"""WITH {_CUSTOMERS},
newest AS (
  SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY ts DESC) AS rn FROM customer_changes
)
SELECT 'dim_customer' AS sink_table, CAST(c_custkey AS VARCHAR) AS key,
       concat('{{"c_custkey":"', c_custkey, CASE WHEN ts = '1' THEN '' ELSE concat('","c_nationkey":"', c_nationkey) END,
              '","c_mktsegment":"', segment, '"}}') AS data
FROM newest WHERE rn = 1
UNION ALL
SELECT 'dim_region', CAST(r_regionkey AS VARCHAR),
       concat('{{"r_regionkey":"', r_regionkey, '","r_name":"', r_name, '"}}') FROM region
UNION ALL
SELECT 'dim_nation', CAST(n_nationkey AS VARCHAR),
       concat('{{"id":"', n_nationkey, '","n_name":"', n_name, '"}}') FROM nation
UNION ALL
SELECT 'dim_supplier', CAST(s_suppkey AS VARCHAR),
       concat('{{"s_suppkey":"', s_suppkey, '","s_name":"', s_name, '","s_acctbal":"',
              CAST(s_acctbal AS DECIMAL(16,2)), '"}}') FROM supplier"""


def _all() -> dict[str, str]:
    pay_all = "* EXCLUDE (paid)"
    return {
        "trade_order_pre_process": f"WITH {_TRADE} SELECT * FROM pre",
        "trade_order_pre_process_latest": _latest(
            _TRADE,
            "pre",
            "id",
            "CAST(oi_ts AS BIGINT) DESC, type DESC, order_status DESC, user_id DESC",
        ),
        "trade_order_detail": f"WITH {_TRADE} SELECT * FROM detail",
        "trade_cancel_detail": f"WITH {_TRADE} SELECT * FROM cancel",
        "trade_pay_detail_all": f"WITH {_TRADE} SELECT {pay_all} FROM pay",
        "trade_pay_detail_success": f"WITH {_TRADE} SELECT {pay_all} FROM pay WHERE paid",
        "trade_pay_detail_latest": _latest(
            _TRADE,
            "pay",
            "order_detail_id",
            "CAST(ts AS BIGINT) DESC, callback_time DESC NULLS LAST, "
            "payment_type_code DESC, user_id DESC",
            "paid",
        ),
        "trade_cart_add": f"WITH {_CART} SELECT * FROM cart_add",
        "trade_cart_add_latest": _latest(_CART, "cart_add", "id", "CAST(ts AS BIGINT) DESC"),
        "cdc_filter_markers": f"""WITH {_CDC}
SELECT 'shop' AS database, 'events' AS "table", 'insert' AS type, CAST(seq AS VARCHAR) AS id,
       event_type AS name, CAST(ms AS VARCHAR) AS ts, seq
FROM ev WHERE NOT cut AND NOT list AND NOT bad_data AND seq % 50 <> 0""",
        "cdc_dirty_split": f"""WITH {_CDC}
SELECT seq, CASE WHEN cut THEN concat('{{"table":"events","type":"insert","data":{{"id":', seq)
                 WHEN list THEN '[1]'
                 ELSE '{{"table":"events","type":"insert","data":[1]}}' END AS value
FROM ev WHERE cut OR list OR bad_data""",
        "dim_config_latest": f"""WITH {_CONFIG}
SELECT source_table, sink_table, sink_columns, sink_pk, sink_extend FROM config""",
        "dim_config_by_time": f"""WITH {_CONFIG_BY_TIME}
SELECT source_table, sink_table, sink_columns, sink_pk, sink_extend FROM config""",
        "dim_config_dirty": """
SELECT event_id AS seq, CASE WHEN event_id % 97 = 0 THEN concat('{"after":{"source_table":"src_', user_id)
  WHEN event_id % 101 = 0 THEN '[1]' ELSE '{"after":{}}' END AS value
FROM events WHERE event_id % 97 = 0 OR event_id % 101 = 0 OR event_id % 103 = 0""",
        "traffic_user_jump_skewed": _jumps(_SKEWED_VIEWS, "views", "all"),
        "trade_order_detail_skewed": """
SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'hot' ELSE CAST(l_orderkey AS VARCHAR) END AS order_key,
       CASE WHEN l_linenumber % 2 = 0 THEN 'H' ELSE o_orderstatus END AS status,
       count(*) AS lines, count(p_name) AS named
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
GROUP BY ALL""",
        "dim_ddl": f"""WITH {_CONFIG}
SELECT source_table, concat('CREATE TABLE IF NOT EXISTS ', sink_table, ' (',
    CASE event_type WHEN 'view' THEN 'id STRING, name STRING'
      WHEN 'click' THEN 'sku_id STRING, sku_name STRING'
      WHEN 'signup' THEN 'sku_id STRING, sku_name STRING, price STRING'
      ELSE 'sku_id STRING' END,
    ') USING parquet TBLPROPERTIES (''primary_key'' = ''', coalesce(sink_pk, 'id'), ''')',
    CASE WHEN sink_extend IS NOT NULL THEN concat(' ', sink_extend) ELSE '' END) AS ddl
FROM config""",
        "dim_whitelist": """
SELECT event_id, concat('{',
    CASE event_type
      WHEN 'view' THEN concat('"id":"', event_id, '","name":"', event_type, '"')
      WHEN 'click' THEN concat('"sku_id":"', user_id, '","sku_name":"sku-', user_id, '"')
      WHEN 'signup' THEN concat('"sku_id":"', user_id, '","sku_name":"sku-', user_id,
                                '","price":"', CAST(floor(value) AS BIGINT), '"')
      ELSE concat('"sku_id":"', user_id, '"') END, '}') AS data
FROM events""",
        "dim_routed_rows": f"WITH {_CUSTOMERS}, {_DIM} SELECT * FROM changes",
        "dim_routed_as_of": """
WITH ev AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events),
versions AS (
  SELECT user_id, event_type, ms FROM ev
  QUALIFY row_number() OVER (PARTITION BY user_id, ms ORDER BY event_id DESC) = 1),
records AS (
  SELECT event_id, user_id, event_type AS name, value, ms + event_id % 5 * 21600000 AS at FROM ev)
SELECT concat('src_', r.user_id) AS source_table, concat('dim_', r.user_id, '_', v.event_type) AS sink_table,
       CAST(r.at AS VARCHAR) AS ts, concat('{',
    CASE v.event_type
      WHEN 'view' THEN concat('"id":"', event_id, '","name":"', name, '"')
      WHEN 'click' THEN concat('"sku_id":"', r.user_id, '","sku_name":"sku-', r.user_id, '"')
      WHEN 'signup' THEN concat('"sku_id":"', r.user_id, '","sku_name":"sku-', r.user_id,
                                '","price":"', CAST(floor(value) AS BIGINT), '"')
      ELSE concat('"sku_id":"', r.user_id, '"') END, '}') AS data
FROM records r ASOF JOIN versions v ON r.user_id = v.user_id AND r.at >= v.ms
WHERE v.event_type <> 'error'""",
        "upsert_topic_latest": f"{_CUSTOMER_LATEST} AND type <> 'delete'",
        "dim_upsert_latest": _CUSTOMER_LATEST,
        "dim_upsert_deletes": f"{_CUSTOMER_LATEST} AND type <> 'delete'",
        "log_page": f"WITH {_LOG} SELECT * FROM page_log",
        "log_start": f"WITH {_LOG} SELECT * FROM start_log",
        "log_display": f"WITH {_LOG} SELECT * FROM display_log",
        "log_action": f"WITH {_LOG} SELECT * FROM action_log",
        "log_error": f"WITH {_LOG} SELECT * FROM error_log",
        "log_dirty": f"WITH {_LOG} SELECT * FROM dirty_log",
        "log_is_new_fixed": f"WITH {_LOG} SELECT mid, is_new, ts, seq FROM fixed",
        "traffic_unique_visitor": _visitors(_VIEWS, "views"),
        "traffic_unique_visitor_from_log": _visitors(_LOG, "page_log"),
        "traffic_user_jump": _jumps(_VIEWS, "views", "all"),
        "traffic_user_jump_match": _jumps(_VIEWS, "views", "match"),
        "traffic_user_jump_timeout": _jumps(_VIEWS, "views", "timeout"),
        "traffic_user_jump_from_log": _jumps(_LOG, "page_log", "all"),
        "date_util": """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS second,
       strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day_east8,
       epoch_us(date_trunc('day', ts)) // 1000 - 28800000 AS day_ms,
       epoch_us(date_trunc('second', ts)) // 1000 - 28800000 AS second_ms
FROM events""",
    }


def _streams() -> dict[str, str]:
    """Streaming queries, which end in the state of their batch counterparts."""
    batch = _all()
    outputs = " UNION ALL ".join(
        f"SELECT '{name}' AS output, mid, is_new, seq, value FROM {name}_log"
        for name in ("page", "start", "display", "action", "error")
    )
    mark = f"(SELECT max(ts) - {LAG_MS} FROM views)"
    closed = f" AND (next_ts < {mark} OR ts + {WITHIN_MS} < {mark})"
    return {
        "stream_cart_add": batch["trade_cart_add"],
        "stream_log_split": f"""WITH {_LOG} {outputs}
UNION ALL SELECT 'dirty', NULL, NULL, seq, value FROM dirty_log""",
        "stream_unique_visitor": batch["traffic_unique_visitor"],
        "stream_day_visit": f"SELECT mid, dt, ts, seq FROM ({batch['traffic_unique_visitor']})",
        "stream_user_jump_closed": f"""SELECT mid, ts, seq FROM (
{_jumps(_VIEWS, "views", "all", closed)})""",
        "stream_order_pre_process_latest": batch["trade_order_pre_process_latest"],
        "stream_pay_detail_latest": batch["trade_pay_detail_latest"],
        "stream_order_detail_latest": batch["trade_order_detail"],
        "stream_cancel_detail_latest": batch["trade_cancel_detail"],
        "stream_late_rows": f"""WITH {_VIEWS},
arrived AS (
  SELECT ts, (ts + CASE WHEN seq % 7 = 0 THEN {LAG_MS} ELSE 0 END - low) * 5 // (high - low) AS arrival
  FROM views, (SELECT min(ts) AS low, max(ts) + {LAG_MS} + 1 AS high FROM views)),
marks AS (
  SELECT arrival, max(max(ts)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {LATE_MS} AS mark
  FROM arrived GROUP BY arrival)
SELECT CAST(arrival AS INTEGER) AS arrival, count(*) AS pages, count(*) FILTER (WHERE ts <= mark) AS dropped
FROM arrived JOIN marks USING (arrival) GROUP BY arrival""",
        "stream_order_detail_from_topic": batch["trade_order_detail"],
        "stream_order_horizon": f"WITH {_TRADE_HORIZON} SELECT * FROM pre",
        "stream_pay_horizon": f"WITH {_TRADE_HORIZON} SELECT * EXCLUDE (paid) FROM pay",
        "stream_dim_upsert": _DIMENSIONS,
    }


def oracle_sql() -> dict[str, str]:
    return {**_all(), **_streams()}

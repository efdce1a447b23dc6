"""The registered queries as SQL for the checking engine, over the same tables."""

from __future__ import annotations

import hashlib

from tallywright import schema
from tallywright.sources import sample_accounts as accounts

SQL: dict[str, str] = {}

# The grammars of numbers and ISO dates, written here anew.
NUMBER = r"[ \t\n\v\f\r]*[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?[ \t\n\v\f\r]*"
ISO_DATE = r"[ \t\n\v\f\r]*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T].*)?[ \t\n\v\f\r]*"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def r2(x: str) -> str:
    """Rounding of a named column to two places, in the steps of ``numbers.round2``."""
    high = f"({x} * 134217729.0::DOUBLE - ({x} * 134217729.0::DOUBLE - {x}))"
    cents = f"({x} * 100.0::DOUBLE)"
    error = f"(({high} * 100.0::DOUBLE - {cents}) + ({x} - {high}) * 100.0::DOUBLE)"
    whole = f"floor({cents})"
    over = f"({cents} - {whole} - 0.5::DOUBLE)"
    up = (
        f"({over} > 0 OR ({over} = 0 AND ({error} > 0 OR"
        f" ({error} = 0 AND abs({whole} % 2) = 1))))"
    )
    return f"(({whole} + CASE WHEN {up} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / 100.0::DOUBLE)"


def _number(x: str, scale: int) -> str:
    return f"coalesce(CAST(CAST({x} AS DECIMAL(38,{scale})) AS VARCHAR), 'null')"


def _records(source: str, order: str, fields: dict[str, str], by: str) -> str:
    """A JSON list of records per tenant, as a scalar subquery."""
    parts = " || ',' || ".join(f"'\"{n}\":' || {v}" for n, v in fields.items())
    return (
        f"(SELECT coalesce('[' || string_agg('{{' || {parts} || '}}', ',' ORDER BY {order}) || ']',"
        f" '[]') FROM {source} x WHERE {by})"
    )


# Facts --------------------------------------------------------------------------------------

PRICE = "CAST(l_extendedprice AS DECIMAL(14,2))"
DISCOUNT = "CAST(l_discount AS DECIMAL(4,2))"
SALES = f"""sales AS (
    SELECT c_mktsegment AS tenant, o_orderdate AS date, {PRICE} * (1 - {DISCOUNT}) AS revenue,
        p_brand AS product, r_name AS region, c_name AS customer
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey)"""
CAMPAIGNS = """campaigns AS (
    SELECT CAST(user_id % 5 AS VARCHAR) AS tenant, ts AS date,
        'C' || CAST(CAST(props->>'$.k' AS INT) % 10 AS VARCHAR) AS campaign,
        CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END AS spend,
        CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS impressions,
        CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS clicks,
        CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS conversions,
        CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END AS revenue
    FROM events)"""


def _sum(x: str) -> str:
    return f"CAST(sum({x}) AS DOUBLE)"


# Sales --------------------------------------------------------------------------------------


def _sales_totals(by: str) -> str:
    columns, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""WITH {SALES}, t AS (
    SELECT {columns}{_sum('revenue')} AS revenue, count(*) AS n,
        {_sum('revenue')} / count(*) AS average FROM sales {group})
SELECT {columns}{r2('revenue')} AS total_revenue, n AS total_orders,
    {r2('average')} AS average_order_value FROM t"""


def _mom_growth(by: str) -> str:
    columns, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f"""WITH {SALES}, m AS (
    SELECT {columns}strftime(date, '%Y-%m') AS month, {_sum('revenue')} AS revenue FROM sales
    GROUP BY ALL), g AS (
    SELECT {columns}month, revenue, lag(revenue) OVER (w) AS previous,
        row_number() OVER ({part} ORDER BY month DESC) AS place FROM m
    WINDOW w AS ({part} ORDER BY month)), p AS (
    SELECT {columns}month, CASE WHEN previous = 0 THEN 0.0::DOUBLE
        ELSE (revenue - previous) / previous * 100.0::DOUBLE END AS growth FROM g WHERE place = 1)
SELECT {columns}month, {r2('growth')} AS mom_growth_percent FROM p"""


def _top(key: str, by_tenant: bool) -> str:
    if not by_tenant:
        return f"""WITH {SALES} SELECT {key}, {_sum('revenue')} AS revenue FROM sales
GROUP BY {key} ORDER BY revenue DESC, {key} LIMIT 5"""
    return f"""WITH {SALES}, s AS (
    SELECT tenant, {key}, {_sum('revenue')} AS revenue FROM sales GROUP BY ALL)
SELECT tenant, {key}, revenue,
    row_number() OVER (PARTITION BY tenant ORDER BY revenue DESC, {key}) AS rank
FROM s QUALIFY rank <= 5"""


SQL["sales_totals"] = _sales_totals("")
SQL["sales_totals_by_tenant"] = _sales_totals("tenant")
SQL["sales_monthly_revenue"] = f"""WITH {SALES}
SELECT strftime(date, '%Y-%m') AS month, {_sum('revenue')} AS revenue FROM sales GROUP BY 1"""
SQL["sales_mom_growth"] = _mom_growth("")
SQL["sales_mom_growth_by_tenant"] = _mom_growth("tenant")
for _key in ("product", "customer"):
    SQL[f"sales_top_{_key}s"] = _top(_key, False)
    SQL[f"sales_top_{_key}s_by_tenant"] = _top(_key, True)
SQL["sales_top_customers_by_summaries"] = _top("customer", False)
SQL["sales_top_customers_by_tenant_and_summaries"] = _top("customer", True)
SQL["sales_region_revenue"] = f"""WITH {SALES}
SELECT region, {_sum('revenue')} AS revenue FROM sales GROUP BY region"""
SQL["sales_breakdown_one_scan"] = f"""WITH {SALES} SELECT 'total' AS section,
    CAST(NULL AS VARCHAR) AS key, {_sum('revenue')} AS revenue, count(*) AS orders FROM sales
UNION ALL SELECT 'month', strftime(date, '%Y-%m'), {_sum('revenue')}, count(*) FROM sales GROUP BY 2
""" + "\n".join(
    f"UNION ALL SELECT '{k}', {k}, {_sum('revenue')}, count(*) FROM sales GROUP BY 2"
    for k in ("product", "region", "customer")
)

SQL["replaced_uploads"] = f"""WITH {SALES}, newest AS (
    SELECT * FROM sales QUALIFY date = max(date) OVER (PARTITION BY customer))
SELECT customer AS tenant, 'total' AS section, CAST(NULL AS VARCHAR) AS key,
    {_sum('revenue')} AS revenue, count(*) AS orders FROM newest GROUP BY customer
UNION ALL SELECT customer, 'month', strftime(date, '%Y-%m'), {_sum('revenue')}, count(*)
    FROM newest GROUP BY 1, 3
""" + "\n".join(
    f"UNION ALL SELECT customer, '{k}', {k}, {_sum('revenue')}, count(*) FROM newest GROUP BY 1, 3"
    for k in ("product", "region")
)


def _sales_json(with_by: bool, sections: list[str]) -> str:
    """Reports over a table ``sales`` with a column ``tenant``, as rows of text."""
    lists = ", ".join(
        f"""{k}_list AS (SELECT tenant, {k} AS key, sum(revenue) AS revenue,
            row_number() OVER (PARTITION BY tenant ORDER BY sum(revenue) DESC, {k}) AS place
            FROM sales WHERE {k} IS NOT NULL GROUP BY tenant, {k})"""
        for k in sections
    )
    mine = "x.tenant = f.tenant"

    def top(k: str) -> str:
        if k not in sections:
            return ""
        records = _records(
            f"{k}_list", "place", {k: "to_json(key)", "revenue": _number("revenue", 6)},
            f"{mine} AND place <= 5",
        )
        return f""" || ',"top_{k}s":' || {records}"""

    trend = _records(
        "m", "month", {"date": "to_json(month)", "revenue": _number("revenue", 6)}, mine
    )
    by = "tenant, " if with_by else ""
    return f"""t AS (
    SELECT tenant, {_sum('revenue')} AS revenue, count(*) AS n,
        {_sum('revenue')} / count(*) AS average FROM sales GROUP BY tenant), m AS (
    SELECT tenant, strftime(date, '%Y-%m') AS month, sum(revenue) AS revenue,
        CAST(sum(revenue) AS DOUBLE) AS amount FROM sales GROUP BY ALL), g AS (
    SELECT tenant, amount, lag(amount) OVER (PARTITION BY tenant ORDER BY month) AS previous,
        row_number() OVER (PARTITION BY tenant ORDER BY month DESC) AS place FROM m), {lists}, f AS (
    SELECT t.*, (amount - previous) / previous * 100.0::DOUBLE AS growth
    FROM t JOIN g ON t.tenant = g.tenant AND place = 1)
SELECT {by}0 AS part, CAST(0 AS BIGINT) AS position,
    '{{"total_revenue":' || {_number(r2('revenue'), 2)} || ',"total_orders":' || CAST(n AS VARCHAR)
    || ',"average_order_value":' || {_number(r2('average'), 2)}
    || ',"monthly_revenue_trend":' || {trend}
    || ',"mom_growth_percent":' || {_number(r2('growth'), 2)}{top('product')}
    || ',"region_wise_sales":[' AS text FROM f
UNION ALL SELECT {by}1, place - 1, CASE WHEN place > 1 THEN ',' ELSE '' END || '{{"region":'
    || to_json(key) || ',"revenue":' || {_number('revenue', 6)} || '}}' FROM region_list
UNION ALL SELECT {by}2, 0, ']'{top('customer')} || '}}' FROM f"""


SQL["sales_report"] = f"WITH {SALES}, {_sales_json(True, ['product', 'region', 'customer'])}"
SQL["confirmed_report"] = f"""WITH sales AS (
    SELECT '' AS tenant, o_orderdate AS date, CAST(o_totalprice AS DECIMAL(14,2)) AS revenue,
        o_orderstatus AS product, o_orderpriority AS region FROM orders
), {_sales_json(False, ['product', 'region'])}"""

# Marketing ----------------------------------------------------------------------------------

RATIOS = {
    "ctr_percent": ("clicks", "impressions", 100),
    "cpc": ("spend", "clicks", 0),
    "cpa": ("spend", "conversions", 0),
    "conversion_rate_percent": ("conversions", "clicks", 100),
    "roas": ("revenue", "spend", 0),
    "roi_percent": ("(revenue - spend)", "spend", 100),
}


def _mkt_totals(by: str, source: str = "campaigns") -> str:
    columns, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    sums = ", ".join(f"{_sum(m)} AS {m}" for m in schema.MEASURES)
    ratios = ", ".join(
        f"CASE WHEN {low} > 0 THEN {top} / {low}{' * 100.0::DOUBLE' if times else ''} END AS {name}"
        for name, (top, low, times) in RATIOS.items()
    )
    return f"""mt AS (SELECT {columns}{sums} FROM {source} {group}),
mr AS (SELECT *, {ratios} FROM mt),
totals AS (SELECT {columns}{r2('spend')} AS total_spend, CAST(clicks AS BIGINT) AS total_clicks,
    CAST(impressions AS BIGINT) AS total_impressions,
    CAST(conversions AS BIGINT) AS total_conversions, {r2('revenue')} AS total_revenue,
    {', '.join(f'{r2(n)} AS {n}' for n in RATIOS)} FROM mr)"""


def _mkt_campaigns(by: str, clicks: str = "sum(clicks)") -> str:
    columns = f"{by}, " if by else ""
    return f"""mc AS (SELECT {columns}campaign, {_sum('spend')} AS spend,
    CAST({clicks} AS DOUBLE) AS clicks, {_sum('conversions')} AS conversions,
    {_sum('revenue')} AS revenue FROM campaigns GROUP BY {columns}campaign),
mq AS (SELECT *, CASE WHEN spend > 0 THEN revenue / spend END AS quotient FROM mc),
performance AS (SELECT {columns}campaign, spend, clicks, conversions, revenue,
    {r2('quotient')} AS roas FROM mq)"""


BEST = "arg_min(campaign, struct_pack(a := -roas, b := campaign)) FILTER (roas IS NOT NULL)"
WORST = "arg_max(campaign, struct_pack(a := -roas, b := campaign)) FILTER (roas IS NOT NULL)"
SQL["mkt_totals"] = f"WITH {CAMPAIGNS}, {_mkt_totals('')} SELECT * FROM totals"
SQL["mkt_totals_by_tenant"] = f"WITH {CAMPAIGNS}, {_mkt_totals('tenant')} SELECT * FROM totals"
SQL["mkt_campaigns"] = f"WITH {CAMPAIGNS}, {_mkt_campaigns('')} SELECT * FROM performance"
SQL["mkt_count_fallback"] = (
    f"WITH {CAMPAIGNS}, {_mkt_campaigns('', 'count(date)')} SELECT * FROM performance"
)
SQL["mkt_best_worst"] = f"""WITH {CAMPAIGNS}, {_mkt_campaigns('tenant')}
SELECT tenant, {BEST} AS best_campaign, {WORST} AS worst_campaign FROM performance GROUP BY tenant"""
SQL["mkt_monthly_trend"] = f"""SELECT strftime(l_shipdate, '%Y-%m') AS month,
    {_sum(f'{PRICE} * {DISCOUNT}')} AS spend, {_sum(f'{PRICE} * (1 - {DISCOUNT})')} AS revenue
FROM lineitem GROUP BY 1"""


def _mkt_json() -> str:
    mine = "x.tenant = totals.tenant"
    entry = " || ',' || ".join(
        f"""'"{n}":' || {v}"""
        for n, v in {
            "campaign": "to_json(campaign)",
            **{m: _number(m, 6) for m in ("spend", "clicks", "conversions", "revenue")},
            "roas": _number("roas", 2),
        }.items()
    )
    months = _records(
        "mm",
        "month",
        {"date": "to_json(month)", "spend": _number("spend", 6), "revenue": _number("revenue", 6)},
        mine,
    )
    whole = ("total_clicks", "total_impressions", "total_conversions")
    order = ("total_spend", *whole, "total_revenue", *RATIOS)
    numbers = " || ',' || ".join(
        f"""'"{n}":' || {f'CAST({n} AS VARCHAR)' if n in whole else _number(n, 2)}""" for n in order
    )
    return f"""{_mkt_totals('tenant')}, {_mkt_campaigns('tenant')}, bw AS (
    SELECT tenant, {BEST} AS best, {WORST} AS worst FROM performance GROUP BY tenant), mm AS (
    SELECT tenant, strftime(date, '%Y-%m') AS month, sum(spend) AS spend, sum(revenue) AS revenue
    FROM campaigns GROUP BY ALL), placed AS (SELECT *, row_number() OVER (PARTITION BY tenant
        ORDER BY roas DESC NULLS LAST, campaign) AS place FROM performance), documents AS (
SELECT tenant, 0 AS part, CAST(0 AS BIGINT) AS position,
    '{{' || {numbers} || ',"campaign_performance":[' AS text FROM totals
UNION ALL SELECT tenant, 1, place - 1,
    CASE WHEN place > 1 THEN ',' ELSE '' END || '{{' || {entry} || '}}' FROM placed
UNION ALL SELECT totals.tenant, 2, 0, '],"best_campaign":' || to_json(best)
    || ',"worst_campaign":' || to_json(worst) || ',"monthly_trend":' || {months} || '}}'
FROM totals JOIN bw ON totals.tenant = bw.tenant)"""


SQL["mkt_report"] = f"WITH {CAMPAIGNS}, {_mkt_json()} SELECT * FROM documents"
SQL["reports_by_domain"] = f"""
SELECT tenant, 'sales' AS domain, part, position, text FROM ({SQL['sales_report']})
UNION ALL SELECT tenant, 'marketing', part, position, text FROM ({SQL['mkt_report']})"""

# Coercion and mapping -----------------------------------------------------------------------

_MISSING = ", ".join(map(_text, schema.NA_TOKENS))
_WHOLE = r"[ \t\n\v\f\r]*[-+]?[0-9]+[ \t\n\v\f\r]*"
_PLAIN = r"[ \t\n\v\f\r]*[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)[ \t\n\v\f\r]*"
UPLOAD_COLUMNS = (
    "id", "padded", "price", "mixed", "flag", "shipped", "impossible", "dirty", "nothing", "rarely", "huge",
    "powers", "blend",
)


def _inferred(by: str, columns: tuple[str, ...]) -> str:
    """Kinds of all cells as rows, then per column."""
    cells = " UNION ALL ".join(
        f"SELECT file, {n} AS position, {_text(c)} AS name,"
        f" CASE WHEN {c} NOT IN ({_MISSING}) THEN {c} END AS cell FROM cells" for n, c in enumerate(columns)
    )
    keys = f"{by}, " if by else ""
    return f"""WITH cells AS ({accounts.UPLOAD_SQL}), long AS ({cells}), known AS (
    SELECT *, CASE WHEN regexp_full_match(cell, {_text(_WHOLE)}) AND TRY_CAST(trim(cell) AS BIGINT) IS NOT NULL
            THEN 1 WHEN regexp_full_match(cell, {_text(NUMBER)}) AND isfinite(TRY_CAST(cell AS DOUBLE)) THEN 2
            WHEN cell IN ('True', 'TRUE', 'true', 'False', 'FALSE', 'false') THEN 4
            WHEN regexp_full_match(cell, {_text(ISO_DATE)}) AND TRY_CAST(cell AS TIMESTAMP) IS NOT NULL THEN 8
            WHEN cell IS NOT NULL THEN 16 END AS kind,
        CASE WHEN regexp_full_match(cell, {_text(_PLAIN)})
            THEN length(ltrim(split_part(ltrim(trim(cell), '+-'), '.', 1), '0')) END AS whole,
        CASE WHEN regexp_full_match(cell, {_text(_PLAIN)})
            THEN length(split_part(trim(cell), '.', 2)) END AS places FROM long), folded AS (
    SELECT {keys}position, name, CAST(coalesce(bit_or(kind), 0) AS INTEGER) AS kinds, count(*) AS n_rows,
        count(*) - count(kind) AS n_missing, CAST(max(whole) AS INTEGER) AS whole_digits,
        CAST(max(places) AS INTEGER) AS scale FROM known GROUP BY {keys}position, name)
SELECT {keys}CAST(position AS INTEGER) AS position, name AS "column", CASE WHEN kinds = 1 THEN 'bigint' WHEN kinds IN (0, 2, 3)
    THEN 'double' WHEN kinds = 4 THEN 'boolean' WHEN kinds = 8 THEN 'timestamp_ntz' ELSE 'string' END AS type,
    kinds, n_rows, n_missing, whole_digits, scale FROM folded"""


SQL["inferred_types"] = _inferred("", ("file", *UPLOAD_COLUMNS))
SQL["inferred_types_by_file"] = _inferred("file", UPLOAD_COLUMNS)
SQL["typed_upload"] = f"""WITH cells AS ({accounts.UPLOAD_SQL}) SELECT file, item, CAST(id AS BIGINT) AS id,
    CAST(trim(padded) AS BIGINT) AS padded, CAST(price AS DOUBLE) AS price, CAST(mixed AS DOUBLE) AS mixed,
    CAST(flag AS BOOLEAN) AS flag, CAST(shipped AS TIMESTAMP) AS shipped, impossible,
    CASE WHEN dirty NOT IN ({_MISSING}) THEN dirty END AS dirty, CAST(NULL AS DOUBLE) AS nothing,
    rarely, CAST(huge AS DOUBLE) AS huge, CAST(powers AS DOUBLE) AS powers, blend FROM cells"""
SQL["spanning_upload"] = """SELECT conv_id, turn, CAST(length(said) AS BIGINT) AS chars, md5(said) AS digest
FROM (SELECT conv_id, turn, role || ', "' || text || '"' || chr(10) AS said FROM conversations)"""

SQL["coerce_numeric"] = f"""WITH c AS (
    SELECT (l_orderkey + l_linenumber) % 16 AS kind, {accounts.DIRTY_NUMBER} AS cell FROM lineitem
), v AS (SELECT kind, CASE WHEN regexp_full_match(cell, {_text(NUMBER)})
    THEN TRY_CAST(cell AS DOUBLE) END AS value FROM c
), f AS (SELECT kind, CASE WHEN isfinite(value) THEN value END AS value FROM v)
SELECT kind, count(*) AS n, count(value) AS ok,
    CAST(sum(CAST(coalesce(value, 0) AS DECIMAL(18,4))) AS DOUBLE) AS total FROM f GROUP BY kind"""
SQL["coerce_dates"] = f"""WITH c AS (
    SELECT o_orderkey % 9 AS kind, {accounts.DIRTY_DATE} AS cell FROM orders
), v AS (SELECT kind, coalesce(CASE WHEN regexp_full_match(cell, {_text(ISO_DATE)})
    THEN TRY_CAST(cell AS TIMESTAMP) END, try_strptime(cell, '%m/%d/%Y')) AS moment FROM c)
SELECT kind, count(*) AS n, count(moment) AS ok, CAST(min(moment) AS VARCHAR) AS first,
    CAST(max(moment) AS VARCHAR) AS last FROM v GROUP BY kind"""
SQL["dates_by_file"] = f"""WITH c AS ({accounts.DATE_FILES_SQL}), f AS (
    SELECT file, arg_min(date, row) AS cell FROM c WHERE date IS NOT NULL GROUP BY file), p AS (
    SELECT c.file, CASE WHEN cell LIKE '____-%' THEN try_strptime(date, '%Y-%m-%d')
        WHEN cell LIKE '____/%' THEN try_strptime(date, '%Y/%m/%d')
        WHEN CAST(substr(cell, 1, 2) AS INT) > 12
        THEN try_strptime(replace(date, '.', '/'), '%d/%m/%Y')
        ELSE try_strptime(replace(date, '.', '/'), '%m/%d/%Y') END AS moment
    FROM c JOIN f ON c.file = f.file)
SELECT file, count(*) AS n, count(*) - count(moment) AS dropped, CAST(min(moment) AS VARCHAR) AS first,
    CAST(max(moment) AS VARCHAR) AS last FROM p GROUP BY file"""
SQL["na_tokens"] = f"""WITH c AS (SELECT l_linenumber, {accounts.DIRTY_CELL} AS cell FROM lineitem)
SELECT l_linenumber, CASE WHEN cell NOT IN ({', '.join(map(_text, schema.NA_TOKENS))}) THEN cell END
    AS cell, count(*) AS n FROM c GROUP BY ALL"""

_ALIAS_ROWS = ", ".join(
    f"({_text(d)}, {_text(f)}, {i}, {_text(a)})"
    for d, fields in schema.ALIASES.items()
    for f, names in fields.items()
    for i, a in enumerate(names)
)
# Ratcliff-Obershelp by its definition: the longest common block of two ranges, the earliest in
# the first text and then in the second among equals, then the same left and right of it.
_BEST_BLOCK = """list_max(flatten([[{
        'k': len([k for k in range(1, least(ahi - i, bhi - j) + 1)
                  if substr(a, i, k) = substr(b, j, k)]),
        'i': -i, 'j': -j} for j in range(blo, bhi)] for i in range(alo, ahi)]))"""
SQL["map_columns"] = f"""WITH RECURSIVE headers AS (
    SELECT 'user ' || CAST(user_id AS VARCHAR) AS file, event_id AS col_pos,
        ' ' || upper(event_type) AS col, 'marketing' AS domain FROM events
    UNION ALL SELECT 'nation ' || CAST(c_nationkey AS VARCHAR), c_custkey, c_name, 'sales'
    FROM customer), aliases(domain, field, alias_pos, alias) AS (VALUES {_ALIAS_ROWS}),
pairs AS (SELECT DISTINCT lower(trim(col)) AS a, alias AS b FROM headers JOIN aliases USING (domain)),
blocks AS (
    SELECT a, b, 1 AS alo, length(a) + 1 AS ahi, 1 AS blo, length(b) + 1 AS bhi,
        CAST(0 AS BIGINT) AS size FROM pairs
    UNION ALL
    SELECT a, b, side.alo, side.ahi, side.blo, side.bhi, side.size FROM (
        SELECT a, b, unnest([
            {{'alo': alo, 'ahi': -best.i, 'blo': blo, 'bhi': -best.j, 'size': best.k}},
            {{'alo': best.k - best.i, 'ahi': ahi, 'blo': best.k - best.j, 'bhi': bhi,
              'size': CAST(0 AS BIGINT)}}]) AS side
        FROM (SELECT *, {_BEST_BLOCK} AS best FROM blocks WHERE alo < ahi AND blo < bhi)
        WHERE best.k > 0)),
scores AS (SELECT a, b, 2.0::DOUBLE * sum(size) / (length(a) + length(b)) AS score
    FROM blocks GROUP BY a, b),
ranked AS (SELECT file, field, col, col_pos, score, row_number() OVER (PARTITION BY file, field
        ORDER BY score DESC, col_pos, alias_pos) AS place
    FROM headers JOIN aliases USING (domain) JOIN scores ON lower(trim(col)) = a AND alias = b)
SELECT file, field, CASE WHEN score > 0.6::DOUBLE THEN col END AS source_column,
    CASE WHEN score > 0.6::DOUBLE THEN col_pos END AS col_pos, score
FROM ranked WHERE place = 1"""
SQL["mapped_files"] = f"""WITH f AS (SELECT l_returnflag AS file, l_shipdate AS date,
    CAST(l_extendedprice AS DECIMAL(14,2)) AS revenue, l_linestatus AS product FROM lineitem)
SELECT file, 'total' AS section, CAST(NULL AS VARCHAR) AS key, {_sum('revenue')} AS revenue,
    count(*) AS orders FROM f GROUP BY file
UNION ALL SELECT file, 'month', strftime(date, '%Y-%m'), {_sum('revenue')}, count(*) FROM f
    GROUP BY 1, 3
UNION ALL SELECT file, 'product', product, {_sum('revenue')}, count(*) FROM f GROUP BY 1, 3"""

# Uploads ------------------------------------------------------------------------------------

_EVENT_JSON = """'{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g')
    || '"{user},"event_type":' || to_json(event_type) || ',"value":' || CAST(value AS VARCHAR)
    || ',"props":' || to_json(props) || '}'"""
SQL["upload_profile"] = f"""SELECT 'marketing' AS analyst_type,
    'event_id,ts,user_id,event_type,value,props' AS columns_found,
    'campaign=,clicks=,conversions=,date=,impressions=,revenue=,spend=' AS suggested_mapping,
    (SELECT count(*) FROM events) AS row_count,
    string_agg({_EVENT_JSON.replace('{user}', ',"user_id":' + "' || user_id || '")}, chr(10)
        ORDER BY event_id) AS preview
FROM (SELECT * FROM events ORDER BY event_id LIMIT 5)"""
SQL["upload_profiles_by_file"] = f"""WITH e AS (
    SELECT *, count(*) OVER (PARTITION BY user_id) AS row_count,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events)
SELECT user_id, any_value(row_count) AS row_count,
    string_agg({_EVENT_JSON.replace('{user}', '')}, chr(10) ORDER BY event_id) AS preview
FROM e WHERE place <= 5 GROUP BY user_id"""
SQL["upload_preview"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5"
SQL["latest_upload"] = """SELECT user_id, event_id, event_type FROM events QUALIFY
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
SQL["latest_data"] = """SELECT o_custkey, o_orderkey FROM orders o WHERE o_orderdate = (
    SELECT max(o_orderdate) FROM orders n WHERE n.o_custkey = o.o_custkey)"""

# Accounts and billing -----------------------------------------------------------------------

USERS = f"""users AS (SELECT c_custkey AS id, {accounts.ACCOUNT_EMAIL} AS email,
    c_mktsegment AS company_name, {accounts.ACCOUNT_FLAG} AS is_subscribed,
    {accounts.ACCOUNT_PLAN} AS subscription_plan FROM customer)"""
EVENTS = """account_events AS (SELECT user_id, ts, event_id,
    CASE event_type WHEN 'signup' THEN 'order_created' WHEN 'click' THEN 'created'
        WHEN 'purchase' THEN 'active' END AS status,
    CASE WHEN event_type IN ('signup', 'click') THEN
        CASE WHEN CAST(props->>'$.k' AS INT) < 50 THEN 'monthly' ELSE 'yearly' END END AS plan
    FROM events), state AS (
SELECT user_id, arg_max(status, struct_pack(ts := ts, id := event_id)) AS status,
    arg_max(plan, struct_pack(ts := ts, id := event_id)) FILTER (plan IS NOT NULL) AS plan,
    bool_or(status = 'active') AS is_subscribed
FROM account_events WHERE status IS NOT NULL GROUP BY user_id)"""
PLANS = "plans(plan, amount, cycles) AS (VALUES {})".format(
    ", ".join(f"({_text(p)}, {a}, {c})" for p, a, c in schema.PLANS)
)


def _hmac(message: str, key: bytes) -> str:
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in key).hex() for p in (0x36, 0x5C))
    digest = f"unhex(sha256(unhex('{inner}') || encode({message})))"
    return f"sha256(unhex('{outer}') || {digest})"


ORDER_ID, PAYMENT_ID = "'order_' || o_orderkey", "'pay_' || o_custkey"
_RIGHT = _hmac(f"{ORDER_ID} || '|' || {PAYMENT_ID}", accounts.SIGNING_KEY)
_SWAPPED = _hmac(f"{PAYMENT_ID} || '|' || {ORDER_ID}", accounts.SIGNING_KEY)
PAYMENTS = f"""payments AS (SELECT o_orderkey, o_orderstatus, {_RIGHT} AS order_signature,
    {_SWAPPED} AS subscription_signature FROM orders), signed AS (SELECT *,
    CASE WHEN o_orderstatus = 'P' THEN subscription_signature ELSE order_signature END AS signature
    FROM payments)"""

SQL["user_profiles"] = f"WITH {USERS} SELECT email, company_name FROM users"
SQL["user_lookup"] = f"""WITH {USERS} SELECT event_id, email, id, company_name
FROM events JOIN users ON user_id = id WHERE event_type = 'purchase'"""
SQL["subscription_gate"] = f"""WITH {USERS} SELECT o_orderkey, o_custkey AS id FROM orders
WHERE EXISTS (SELECT 1 FROM users WHERE id = o_custkey AND is_subscribed)"""
SQL["new_signups"] = """SELECT user_id, event_id FROM events WHERE event_type = 'signup'
    AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal > 0)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"""
SQL["order_batch"] = f"""WITH {USERS}, {PLANS} SELECT id AS user_id, subscription_plan AS plan,
    amount, amount * 100 AS amount_minor, 'INR' AS currency,
    'order_' || CAST(id AS VARCHAR) || '_' || plan AS receipt, 1 AS payment_capture, cycles
FROM users JOIN plans ON subscription_plan = plan"""
SQL["order_rejects"] = f"""WITH {USERS} SELECT id AS user_id, subscription_plan AS plan FROM users
WHERE subscription_plan IS NULL OR subscription_plan NOT IN ('monthly', 'yearly')"""
SQL["payment_signatures"] = f"WITH {PAYMENTS} SELECT o_orderkey, signature FROM signed"
SQL["accepted_payments"] = f"""WITH {PAYMENTS} SELECT o_orderkey, o_orderstatus FROM signed
WHERE signature = order_signature"""
SQL["rejected_subscription_payments"] = f"""WITH {PAYMENTS}
SELECT o_orderkey, o_orderstatus FROM signed WHERE signature <> subscription_signature"""
SQL["subscription_state"] = f"""WITH {EVENTS}
SELECT user_id, status, plan, is_subscribed FROM state"""
SQL["subscription_stream"] = SQL["subscription_state"]
SQL["subscription_status"] = f"""WITH {USERS}, {EVENTS} SELECT email,
    coalesce(users.is_subscribed, FALSE) OR coalesce(state.is_subscribed, FALSE) AS is_subscribed,
    coalesce(plan, subscription_plan) AS plan, status FROM users LEFT JOIN state ON id = user_id"""

SQL["payments_to_state"] = f"""WITH {USERS}, {PAYMENTS}, all_events AS (
    SELECT user_id, ts, CAST(event_id AS VARCHAR) AS id, CASE event_type
        WHEN 'signup' THEN 'order_created' WHEN 'click' THEN 'created' WHEN 'purchase' THEN 'active'
        END AS status, CASE WHEN event_type IN ('signup', 'click') THEN
        CASE WHEN CAST(props->>'$.k' AS INT) < 50 THEN 'monthly' ELSE 'yearly' END END AS plan
    FROM events UNION ALL
    SELECT o_custkey, o_orderdate, 'pay_' || o_custkey, 'active', NULL
    FROM orders JOIN signed USING (o_orderkey) WHERE signature = order_signature), state AS (
SELECT user_id, arg_max(status, struct_pack(ts := ts, n := length(id), id := id)) AS status,
    arg_max(plan, struct_pack(ts := ts, n := length(id), id := id)) FILTER (plan IS NOT NULL)
        AS plan, bool_or(status = 'active') AS is_subscribed
FROM all_events WHERE status IS NOT NULL GROUP BY user_id)
SELECT email, coalesce(users.is_subscribed, FALSE) OR coalesce(state.is_subscribed, FALSE)
    AS is_subscribed, coalesce(plan, subscription_plan) AS plan, status
FROM users LEFT JOIN state ON id = user_id"""

# Prompts ------------------------------------------------------------------------------------

CHATS = """asked AS (SELECT conv_id, max(turn) AS asked_at, arg_max(text, turn) AS question
    FROM conversations WHERE role = 'user' GROUP BY conv_id), questions AS (
SELECT conv_id, CAST(conv_id % 7 AS VARCHAR) AS tenant, question, asked_at FROM asked)"""
_CHAT_TEXT = (
    "CASE WHEN part = 0 THEN 'Business marketing campaign KPI data:' || chr(10) ELSE '' END || text"
    f" || CASE WHEN part = 2 THEN chr(10) || chr(10) || {_text(schema.CHAT_QUESTION)} || question"
    f" || chr(10) || chr(10) || {_text(schema.CHAT_CLOSING)} ELSE '' END"
)
SQL["insight_prompts"] = f"""WITH {CAMPAIGNS}, {_mkt_json()}
SELECT tenant, part, position, {_text(schema.SYSTEM_PROMPTS['marketing'])} AS system_prompt,
    CASE WHEN part = 0 THEN {_text(schema.INSIGHT_HEADER)} ELSE '' END || text AS prompt
FROM documents"""
SQL["chat_prompts"] = f"""WITH {CAMPAIGNS}, {_mkt_json()}, {CHATS}
SELECT conv_id, tenant, part, position, {_CHAT_TEXT} AS prompt
FROM questions JOIN documents USING (tenant)"""
SQL["chat_unready"] = f"""WITH {CAMPAIGNS}, {CHATS} SELECT conv_id, tenant, question
FROM questions WHERE tenant NOT IN (SELECT tenant FROM campaigns)"""
SQL["chat_history"] = f"""WITH {CAMPAIGNS}, {_mkt_json()}, {CHATS},
prompts AS (SELECT conv_id, asked_at, part, position, {_CHAT_TEXT} AS prompt
    FROM questions JOIN documents USING (tenant)),
before AS (SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c
    JOIN prompts p ON c.conv_id = p.conv_id AND c.turn < asked_at AND part = 0)
SELECT conv_id, turn, 0 AS part, CAST(0 AS BIGINT) AS position, role, text FROM before UNION ALL
SELECT conv_id, coalesce((SELECT max(turn) FROM before b WHERE b.conv_id = p.conv_id), -1) + 1,
    part, position, 'user', prompt FROM prompts p"""
SQL["insight_replies"] = """WITH r AS (SELECT conv_id, turn, conv_id % 6 AS shape, text,
    CAST(to_json(struct_pack(summary := text, problems := [role, 'late'],
        recommendations := ['wait'])) AS VARCHAR) AS long_body,
    CAST(to_json(struct_pack(summary := text)) AS VARCHAR) AS short_body FROM conversations
), raws AS (SELECT conv_id, turn, CASE shape
    WHEN 0 THEN chr(10) || '```json' || chr(10) || long_body || chr(10) || '```' || chr(10)
    WHEN 1 THEN '```' || chr(10) || long_body || '```' WHEN 2 THEN short_body
    WHEN 3 THEN '  ' || long_body || chr(10) WHEN 4 THEN '[1, 2]' ELSE text END AS raw FROM r
), cleaned AS (SELECT conv_id, turn, raw, regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '^```json', ''), '^```', ''),
    '```$', ''), '^\\s+|\\s+$', '', 'g') AS body FROM raws
), parsed AS (SELECT conv_id, turn, raw, json_valid(body) AS parsed,
    CASE WHEN json_valid(body) THEN body ELSE '{}' END AS doc FROM cleaned
), parts AS (SELECT *, json_extract_string(doc, '$.summary') AS summary,
    array_to_string(CAST(json_extract(doc, '$.problems') AS VARCHAR[]), '|') AS problems,
    array_to_string(CAST(json_extract(doc, '$.recommendations') AS VARCHAR[]), '|') AS advice
    FROM parsed)
SELECT conv_id, turn, parsed, CASE WHEN parsed THEN summary ELSE raw END AS summary,
    CASE WHEN parsed THEN problems ELSE '' END AS problems,
    CASE WHEN parsed THEN advice ELSE '' END AS recommendations
FROM parts"""

# Dirty data ---------------------------------------------------------------------------------

_DIRTY_SALES = f"""dirty AS (SELECT CASE WHEN regexp_full_match(date, '{ISO_DATE}')
        THEN TRY_CAST(date AS TIMESTAMP) END AS date,
    CASE WHEN regexp_full_match(revenue, '{NUMBER}') THEN TRY_CAST(revenue AS DOUBLE) END AS amount,
    product, region FROM ({accounts.DIRTY_SALES_SQL})),
sales AS (SELECT date, CAST(amount AS DECIMAL(18,6)) AS revenue, product, region FROM dirty
    WHERE date IS NOT NULL AND isfinite(amount))"""
SQL["dirty_sales"] = f"""WITH {_DIRTY_SALES}
SELECT 'total' AS section, CAST(NULL AS VARCHAR) AS key, {_sum('revenue')} AS revenue,
    count(*) AS orders FROM sales
UNION ALL SELECT 'month', strftime(date, '%Y-%m'), {_sum('revenue')}, count(*) FROM sales GROUP BY 2
""" + "\n".join(
    f"UNION ALL SELECT '{k}', {k}, {_sum('revenue')}, count(*) FROM sales"
    f" WHERE {k} IS NOT NULL GROUP BY 2"
    for k in ("product", "region")
)
SQL["dirty_campaigns"] = f"""WITH c AS ({accounts.DIRTY_CAMPAIGNS_SQL}), n AS (SELECT campaign,
    CASE WHEN regexp_full_match(spend, '{NUMBER}') THEN TRY_CAST(spend AS DOUBLE) END AS spend,
    CASE WHEN regexp_full_match(revenue, '{NUMBER}') THEN TRY_CAST(revenue AS DOUBLE) END AS revenue
    FROM c WHERE date IS NOT NULL AND campaign IS NOT NULL), s AS (SELECT campaign,
    CAST(sum(CAST(coalesce(spend, 0) AS DECIMAL(18,6))) AS DOUBLE) AS spend,
    CAST(count(*) AS DOUBLE) AS n,
    CAST(sum(CAST(coalesce(revenue, 0) AS DECIMAL(18,6))) AS DOUBLE) AS revenue
    FROM n GROUP BY campaign), q AS (
SELECT *, CASE WHEN spend > 0 THEN revenue / spend END AS quotient FROM s)
SELECT campaign, spend, n AS clicks, n AS conversions, revenue, {r2('quotient')} AS roas FROM q"""
SQL["mkt_trend_fallback"] = f"""SELECT strftime(l_shipdate, '%Y-%m') AS month,
    CAST(count(*) AS DOUBLE) AS spend, {_sum(f'{PRICE} * (1 - {DISCOUNT})')} AS revenue
FROM lineitem GROUP BY 1"""

"""DuckDB mirrors of the canonical tables, for the independent SQL oracle.

``with_ctes("SELECT ...", "orders_c", ...)`` prefixes a query with the CTEs
it names (and their dependencies).  Label arrays come from the same Python
lists as the Spark side so both read identical fixtures.
"""

from __future__ import annotations

from ..functions import rules
from . import canonical as K


def q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def sql_list(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def pick(xs, idx_expr: str) -> str:
    return f"({sql_list(xs)})[(({idx_expr}) % {len(xs)}) + 1]"


def shipping_class_sql(col: str) -> str:
    parts = [f"WHEN regexp_matches({col}, {q(p)}, 'i') THEN {q(label)}" for p, label in rules.SHIPPING_RULES]
    valid = ", ".join(q(v) for v in rules.SHIPPING_VALID)
    return ("CASE " + " ".join(parts) + f" WHEN {col} IN ({valid}) THEN {col}"
            f" ELSE {q(rules.SHIPPING_UNKNOWN)} END")


def free_shipping_sql(col: str) -> str:
    return f"coalesce(regexp_matches({col}, {q(rules.FREE_SHIPPING_PATTERN)}, 'i'), false)"


def map_sql(col: str, mapping: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {q(k)} THEN {q(v)}" for k, v in mapping.items()) + " END"


def status_group_sql(col: str) -> str:
    return map_sql(col, rules.STATUS_GROUPS)


def payment_label_sql(col: str) -> str:
    return f"coalesce({map_sql(col, rules.PAYMENT_LABELS)}, {col}, {q(rules.PAYMENT_UNKNOWN)})"


def status_label_sql(key: str, code: str) -> str:
    return (f"CASE WHEN {code} = 'F' THEN {q(K.STATUS_BY_CODE['F'])} "
            f"WHEN {code} = 'P' THEN {q(K.STATUS_BY_CODE['P'])} "
            f"ELSE {pick(K.OPEN_STATUS_LABELS, key)} END")


def cents_text_sql(cents: str, negative: str) -> str:
    return (f"(CASE WHEN {negative} THEN '-' ELSE '' END || CAST(({cents}) // 100 AS VARCHAR) || '.' "
            f"|| lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0'))")


def stage_id_sql(key: str) -> str:
    five = f"CASE WHEN length(CAST({key} AS VARCHAR)) < 5 THEN lpad(CAST({key} AS VARCHAR), 5, '0') ELSE CAST({key} AS VARCHAR) END"
    return f"CASE WHEN {key} % 2 = 0 THEN 'CLT_S' || {five} ELSE 'CLT_S0' || {five} END"


def customer_code_sql(key: str) -> str:
    return (f"'CLT_S0' || CASE WHEN length(CAST({key} AS VARCHAR)) < 5 THEN lpad(CAST({key} AS VARCHAR), 5, '0') "
            f"ELSE CAST({key} AS VARCHAR) END")


REALIZED_IN = "(" + ", ".join(q(c) for c in K.REALIZED_CODES) + ")"
NBSP_SQL = "chr(160)"

_UNIT_CENTS = ("(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) // CAST(l_quantity AS BIGINT))")
_SHIP_RAW = pick(K.RAW_SHIPPING_LABELS, "l_orderkey + l_linenumber")

CTES: dict[str, tuple[list[str], str]] = {
    "geo_c": ([], f"""
        SELECT n_nationkey AS region_id, lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS region_code,
               n_name AS region, r_name AS zone,
               {K.LAT0} + CAST(n_nationkey AS DOUBLE) * {K.LAT_STEP} AS latitude,
               {K.LON0} + CAST(n_nationkey AS DOUBLE) * {K.LON_STEP} AS longitude,
               CASE WHEN n_nationkey % 8 = 7 THEN 'unknown' ELSE 'valid_wilaya' END AS geography_status
        FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "orders_c": ([], f"""
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
               o_orderstatus AS status_code, {status_label_sql('o_orderkey', 'o_orderstatus')} AS order_status,
               o_orderpriority AS payment_method_group,
               CAST(o_totalprice AS DECIMAL(12,2)) AS order_total_amount
        FROM orders"""),
    "realized_c": (["orders_c"], f"SELECT * FROM orders_c WHERE status_code IN {REALIZED_IN}"),
    "custdim_c": (["geo_c"], """
        SELECT c_custkey AS customer_id, c_mktsegment AS customer_type, g.*
        FROM customer JOIN geo_c g ON c_nationkey = g.region_id"""),
    "orders_cust_c": (["orders_c", "custdim_c"], """
        SELECT o.*, d.* EXCLUDE (customer_id) FROM orders_c o JOIN custdim_c d USING (customer_id)"""),
    "lines_c": ([], f"""
        SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_partkey AS sku, l_quantity AS quantity,
               CAST({cents_text_sql(_UNIT_CENTS, "l_returnflag = 'R'")} AS DECIMAL(12,2)) AS unit_price,
               CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(12,2))
                    ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS line_total,
               coalesce(CAST({cents_text_sql(_UNIT_CENTS, "l_returnflag = 'R'")} AS DECIMAL(12,2)) < 0, false)
                 AS has_negative_price,
               l_returnflag = 'R' AS returned, l_shipdate AS ship_date,
               {_SHIP_RAW} AS shipping_label,
               {shipping_class_sql(_SHIP_RAW)} AS shipping_method,
               {free_shipping_sql(_SHIP_RAW)} AS free_shipping,
               CASE WHEN l_partkey % 17 = 0 THEN 'review' ELSE 'ok' END AS sku_quality
        FROM lineitem"""),
    "products_c": ([], """
        SELECT p_partkey AS sku, p_name AS product_name, p_type AS category, p_brand AS subcategory FROM part"""),
    "lines_prod_c": (["lines_c", "products_c"], """
        SELECT l.*, p.* EXCLUDE (sku) FROM lines_c l LEFT JOIN products_c p USING (sku)"""),
    "customers_c": (["custdim_c", "orders_c"], f"""
        SELECT d.*, a.first_order_date, a.last_order_date, a.orders_count, a.total_amount,
               {customer_code_sql('d.customer_id')} AS customer_code
        FROM custdim_c d LEFT JOIN (
            SELECT customer_id, CAST(min(order_date) AS DATE) AS first_order_date,
                   CAST(max(order_date) AS DATE) AS last_order_date,
                   count(*) AS orders_count, sum(order_total_amount) AS total_amount
            FROM orders_c GROUP BY customer_id) a USING (customer_id)"""),
    "raw_catalogue_c": ([], f"""
        WITH b AS (
        SELECT CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE CAST(p_partkey AS VARCHAR) END AS "SkU",
               CASE WHEN p_partkey % 4 = 0 THEN ' ' || replace(p_name, ' ', '  ' || chr(9)) || {NBSP_SQL}
                    ELSE p_name END AS "Nom",
               p_type AS categorie,
               CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN p_brand
                    ELSE p_type || ' > ' || p_brand END AS "Sous-catégorie",
               CASE WHEN p_partkey % 10 = 0 THEN NULL
                    ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) END AS "Prix unitaire",
               {pick(K.STOCK_STATUSES, 'p_partkey')} AS stock_status,
               p_name || ' size ' || CAST(p_size AS VARCHAR) AS short_desc,
               p_partkey AS _key
        FROM part)
        SELECT * EXCLUDE (_key) FROM b UNION ALL SELECT * EXCLUDE (_key) FROM b WHERE _key % 50 = 0"""),
    "raw_transactions_c": ([], f"""
        WITH b AS (
        SELECT 'ORD' || CAST(l_orderkey AS VARCHAR) AS order_id_stage,
               {stage_id_sql('o_custkey')} AS "Code Client",
               CASE WHEN l_orderkey % 101 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END
                 AS order_date,
               n_name AS wilaya_raw, c_mktsegment AS customer_type_inferred,
               CAST(l_partkey AS VARCHAR) AS sku,
               CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL
                    WHEN l_orderkey % 3 = 0 THEN '  ' || replace(p_name, ' ', ' ' || chr(9) || ' ') || {NBSP_SQL}
                    ELSE p_name END AS product_name,
               p_type AS category,
               CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN NULL ELSE p_brand END AS subcategory,
               CASE WHEN l_partkey % 17 = 0 THEN 'review' ELSE 'ok' END AS sku_quality,
               CASE WHEN (l_orderkey + 2 * l_linenumber) % 97 = 0 THEN NULL
                    ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS quantity,
               CASE WHEN (3 * l_orderkey + l_linenumber) % 89 = 0 THEN NULL
                    ELSE {cents_text_sql(_UNIT_CENTS, "l_returnflag = 'R'")} END AS unit_price,
               CAST(CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(12,2))
                    ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS VARCHAR) AS line_total,
               {status_label_sql('l_orderkey', 'o_orderstatus')} AS order_status,
               o_orderpriority AS payment_method_group,
               {pick(K.RAW_PAYMENT_LABELS, 'l_orderkey')} AS "Titre moyen du paiement",
               {_SHIP_RAW} AS "Titre de la méthode d’expédition",
               format('{{:,.2f}}', CAST(o_totalprice AS DECIMAL(12,2))) || ' DA' AS "Montant total de la commande",
               format('{{:,.2f}}', CAST((l_orderkey % 7) * 350 AS DECIMAL(12,2))) || ' DA'
                 AS "Montant de l’expédition commande",
               CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' kg' AS "Poids total",
               l_orderkey AS _key
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON l_partkey = p_partkey)
        SELECT * EXCLUDE (_key) FROM b UNION ALL SELECT * EXCLUDE (_key) FROM b WHERE _key % 50 = 0"""),
    "raw_orders_c": ([], f"""
        WITH b AS (
        SELECT 'ORD' || CAST(o_orderkey AS VARCHAR) AS order_id_stage,
               {stage_id_sql('o_custkey')} AS customer_id_stage,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_date,
               {status_label_sql('o_orderkey', 'o_orderstatus')} AS order_status,
               o_orderpriority AS payment_method_group,
               CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS order_total_amount,
               0 AS ingest_pos, o_orderkey AS _key
        FROM orders)
        SELECT * EXCLUDE (_key) FROM b
        UNION ALL
        SELECT order_id_stage, customer_id_stage, order_date, order_status, payment_method_group,
               CAST(CAST(CAST(order_total_amount AS DECIMAL(12,2)) + 1 AS DECIMAL(12,2)) AS VARCHAR), 1
        FROM b WHERE _key % 50 = 0"""),
}


def with_ctes(sql: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return sql
    body = ",\n".join(f"{n} AS ({CTES[n][1]}\n)" for n in order)
    stripped = sql.lstrip()
    if stripped[:4].upper() == "WITH":
        return f"WITH {body},\n{stripped[4:].lstrip()}"
    return f"WITH {body}\n{sql}"

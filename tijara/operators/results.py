"""Dashboard result tables (O-12.*): each endpoint payload becomes a table
computed by one batch job over the canonical tables.  Formulas for fields
known only from their consumer are ours (SURVEY §7.6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as C
from . import sales as S
from .regions import complete_month_cutoff


def overview_kpis(valid_orders: DataFrame) -> DataFrame:
    """O-12.1: revenue, orders, average basket, clients and growth of the last
    complete month vs the one before (one aggregation, scalar cutoff)."""
    cutoff = complete_month_cutoff(valid_orders.agg(F.max("order_date")).scalar())
    m = C.month_start("order_date")
    amt = F.col("order_total_amount")
    row = valid_orders.agg(
        F.sum(amt).alias("_rev"), F.count("order_id").alias("orders"),
        F.countDistinct("customer_id").alias("clients"),
        F.sum(F.when(m == cutoff, amt)).alias("_cur"),
        F.sum(F.when(m == F.add_months(cutoff, -1), amt)).alias("_prev"))
    return row.select(F.coalesce(F.col("_rev"), F.lit(0)).cast("double").alias("revenue"), "orders",
                      C.ratio(F.col("_rev"), F.col("orders")).alias("average_basket"), "clients",
                      C.growth_pct(F.coalesce("_cur", F.lit(0)), F.coalesce("_prev", F.lit(0))).alias("growth_pct"))


def top_products_realized(valid_lines: DataFrame, n: int = 1) -> DataFrame:
    """O-12.7 / O-12.8: products of realized orders by line revenue, with
    distinct orders and units; top n (ties on the label)."""
    g = (valid_lines.filter(F.col("product_name").isNotNull())
         .groupBy(F.col("product_name").alias("label"))
         .agg(F.sum("line_total").cast("double").alias("revenue"), F.countDistinct("order_id").alias("orders"),
              F.sum("quantity").alias("units")))
    return g.orderBy(F.col("revenue").desc(), F.col("label")).limit(n)


def sales_page(valid_orders: DataFrame, customer_dim: DataFrame, lines: DataFrame) -> DataFrame:
    """O-12.3 + O-9.3: breakdowns (customer type, payment, delivery) stacked
    with a ``breakdown`` column and the rank by revenue; every label is there, a
    page that draws fewer filters by rank.  The rank window runs over the
    aggregated table, partitioned by breakdown."""
    from pyspark.sql import Window
    parts = [
        S.sales_by_customer_type(valid_orders, customer_dim).drop("customers")
        .withColumn("breakdown", F.lit("customer_types")),
        S.kpis_by(valid_orders, "payment_method_group").withColumn("breakdown", F.lit("payment_methods")),
        S.sales_by_delivery(valid_orders, lines).withColumn("breakdown", F.lit("delivery_methods")),
    ]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    w = Window.partitionBy("breakdown").orderBy(F.col("revenue").desc(), F.col("label"))
    share = F.col("revenue") / F.sum("revenue").over(Window.partitionBy("breakdown"))  # O-6.23 bar share
    return u.withColumn("rank", F.row_number().over(w).cast("bigint")).withColumn("bar_share", share)


def scope(orders: DataFrame, valid_orders: DataFrame, lines: DataFrame, customers: DataFrame, generated_at=None) -> DataFrame:
    """O-12.11: rows used per dataset, notes, warnings, date and a run id drawn
    from the content (1-row lineage table)."""
    s = orders.agg(F.count("*").alias("orders"), F.sum("order_total_amount").alias("_amount")).select(
        "orders", "_amount", valid_orders.agg(F.count("*")).scalar().alias("realized_orders"),
        lines.agg(F.count("*")).scalar().alias("transactions"),
        customers.agg(F.count("*")).scalar().alias("customers"),
        (F.current_timestamp() if generated_at is None else generated_at).alias("generated_at"))
    content = F.concat_ws("|", *[F.col(c).cast("string") for c in ("orders", "realized_orders", "transactions", "customers",
                                                                  "_amount", "generated_at")])
    return s.select("orders", "realized_orders", "transactions", "customers", F.lit("orders|transactions|customers").alias("datasets"),
                    F.lit("realized orders only in sales results").alias("notes"),
                    F.when(F.col("realized_orders") == 0, "no realized orders in scope").otherwise("").alias("warnings"),
                    "generated_at", F.concat(F.lit("run-"), F.substring(F.md5(content), 1, 12)).alias("run_id"))


def sales_summary(valid_orders: DataFrame) -> DataFrame:
    """O-12.3 envelope in one aggregation: totals, basket, growth of the last
    complete month, period and number of partial months."""
    cutoff = complete_month_cutoff(valid_orders.agg(F.max("order_date")).scalar())
    m = C.month_start("order_date")
    amt = F.col("order_total_amount")
    row = valid_orders.agg(
        F.sum(amt).alias("_rev"), F.count("order_id").alias("total_orders"),
        F.sum(F.when(m == cutoff, amt)).alias("_cur"), F.sum(F.when(m == F.add_months(cutoff, -1), amt)).alias("_prev"),
        F.min("order_date").cast("date").alias("period_start"), F.max("order_date").cast("date").alias("period_end"),
        F.countDistinct(F.when(m > cutoff, m)).alias("partial_months"))
    return row.select(F.coalesce(F.col("_rev"), F.lit(0)).cast("double").alias("total_revenue"), "total_orders",
                      C.ratio(F.col("_rev"), F.col("total_orders")).alias("average_basket"),
                      C.growth_pct(F.coalesce("_cur", F.lit(0)), F.coalesce("_prev", F.lit(0))).alias("growth_pct"),
                      "period_start", "period_end", "partial_months")


def table_shapes(frames: dict[str, DataFrame]) -> DataFrame:
    """O-2.1: one row per dataset column with its type and the dataset's rows."""
    out = None
    for name, df in frames.items():
        cols = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type")) for c, t in df.dtypes])
        row = (df.agg(F.count("*").alias("rows")).select("rows", F.explode(cols).alias("c"))
               .select(F.lit(name).alias("dataset"), "c.column", "c.type", "rows"))
        out = row if out is None else out.unionByName(row)
    return out


def no_data_status(valid_orders: DataFrame) -> DataFrame:
    """O-12.12: 'no_data' with a warning when the population is empty."""
    n = valid_orders.agg(F.count("*").alias("n"))
    return n.select(F.when(F.col("n") == 0, "no_data").otherwise("ok").alias("status"),
                    F.when(F.col("n") == 0, "no realized orders in scope").alias("warning"))


def issue_message():
    return F.concat(F.col("title"), F.lit(": "), F.col("count").cast("string"), F.lit(" "), F.col("unit"))


def alerts(checks: DataFrame, observed_at) -> DataFrame:
    """O-12.10: one row per violated rule.  ``checks`` is the union of (code,
    severity, title, unit, count) produced by the source checks."""
    return checks.filter(F.col("count") > 0).select(
        "code", "severity", "title", issue_message().alias("message"), observed_at.alias("observed_at"),
        F.col("count").cast("double").alias("value"), "unit", "count")


def readiness(issue_counts: DataFrame) -> DataFrame:
    """O-12.14: 'ready' without issues, 'ready_with_warnings' when only
    warnings, else 'needs_attention'."""
    agg = issue_counts.agg(
        F.count_if((F.col("count") > 0) & (F.col("severity") == "error")).alias("errors"),
        F.count_if((F.col("count") > 0) & (F.col("severity") == "warning")).alias("warnings"))
    status = (F.when(F.col("errors") > 0, "needs_attention")
              .when(F.col("warnings") > 0, "ready_with_warnings").otherwise("ready"))
    return agg.select(status.alias("status"), "errors", "warnings")


def preview_redacted(df, order_cols: list[str], personal: list[str], n: int = 10) -> DataFrame:
    """O-2.16: first ``n`` rows in a fixed order with personal fields masked
    (letters -> X/x, digits -> n); internal ids kept."""
    out = df.orderBy(*order_cols).limit(n)
    return out.withColumns({c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(f"`{c}`"), "[A-Z]", "X"),
                                                                 "[a-z]", "x"), "[0-9]", "n") for c in personal})


def trend_meta(valid_orders: DataFrame, granularity: str = "monthly") -> DataFrame:
    """O-12.2 envelope fields: available range, data_through and how many
    periods of the trend are partial."""
    from .timeseries import revenue_trend
    t = revenue_trend(valid_orders, granularity)
    d = valid_orders.agg(F.min("order_date").cast("date").alias("available_start"),
                         F.max("order_date").cast("date").alias("available_end"))
    p = t.agg(F.struct(F.count_if("is_partial").alias("partial_periods"), F.count("*").alias("periods"))).scalar()
    return d.select("*", p["partial_periods"].alias("partial_periods"), p["periods"].alias("periods"),
                    F.col("available_end").alias("data_through"))


def subset_violations(df: DataFrame, col: str, allowed: list[str]) -> DataFrame:
    """O-10.4 / O-4.1 assertion: rows whose value is outside the allowed set
    (0 means the assertion holds); one aggregation, no collect of rows."""
    return df.agg(F.count_if(~F.coalesce(F.col(col).isin(*allowed), F.lit(False)) & F.col(col).isNotNull())
                  .alias("violations"), F.count("*").alias("rows"))


def drill_down(result: DataFrame, **selection) -> DataFrame:
    """O-12.18: approved aggregate metrics for one selection (a filter on a
    result table, never raw rows)."""
    out = result
    for k, v in selection.items():
        out = out.filter(F.col(k) == F.lit(v))
    return out

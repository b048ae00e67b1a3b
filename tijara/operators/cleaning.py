"""Dataset cleaning as DataFrame -> DataFrame steps (O-3.*, O-5.1, O-5.6, O-5.7, O-6.17).

All steps are narrow projections except the dedupes (one aggregation each,
partial before the shuffle, so a hot duplicate group is pre-reduced map-side)
and the enrichment joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import rules
from ..session import disk_spared, ensure_checkpoint_dir, write_shared
from .profile import REPEATED_BROADCAST
from .quantiles import quantiles

MONEY_COLUMNS = {"unit_price", "line_total", "order_total_amount", "shipping_cost", "Prix unitaire"}


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """O-3.1: rename the columns present in ``mapping``."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def parse_money_columns(df: DataFrame, cols) -> DataFrame:
    """O-3.4 on each of ``cols`` that exists."""
    return df.withColumns({c: C.parse_money(c) for c in cols if c in df.columns})


def cast_typed(df: DataFrame, date_fmt: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """O-3.5 .. O-3.7: columns whose name contains 'date' -> timestamp, the
    fixed numeric list -> number (money as decimal(12,2)), text stays string.
    Bad values become null (try_* casts, ANSI-safe)."""
    out = {}
    types = dict(df.dtypes)
    for c in df.columns:
        if "date" in c and types[c] == "string":
            out[c] = C.parse_timestamp(c, date_fmt)
        elif c in rules.NUMERIC_COLUMNS and types[c] == "string":
            out[c] = C.parse_number(c, "decimal(12,2)" if c in MONEY_COLUMNS else "double")
    return df.withColumns(out) if out else df


def dedupe_rows(df: DataFrame) -> DataFrame:
    """O-3.18: exact-duplicate removal (null equals null).

    Rows are grouped by a digest of all their columns, so a query that goes on
    with some of the columns moves only those and the digest."""
    # Equal rows agree in every column, so any of them stands for the others.
    keep = [F.first(v).alias(f"_c{i}") for i, v in enumerate(_values(df))]
    key = C.row_key(df)
    g = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(key)]).agg(*keep)
    return g.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns)])


def _values(df: DataFrame) -> list[Column]:
    """The columns, -0.0 as 0.0."""
    return [(F.col(f"`{c}`") + F.lit(0.0).cast(t) if t in ("float", "double") else F.col(f"`{c}`")).alias(c) for c, t in df.dtypes]


def dedupe_in_place(df: DataFrame, passing: DataFrame | None = None) -> DataFrame:
    """O-3.18 for a query that goes on with whole rows: ``dedupe_rows`` of those
    that may have a copy, all others stay where they are.

    Equal rows have equal hashes, so a row whose hash occurs once has no copy;
    only hashes are moved to find that out, and ``df`` is read once more for the
    rest.  With more than ``REPEATED_BROADCAST`` repeated hashes, all rows are
    moved.  ``passing``: the same rows, observed; each passes once."""
    plain = [c for c, t in df.dtypes if "map<" not in t]
    watched = df if passing is None else passing
    if not plain:
        return dedupe_rows(watched)
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    ensure_checkpoint_dir(df.sparkSession)
    with disk_spared(df.sparkSession):
        again = df.groupBy(hashed.alias("_of")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_of").checkpoint()
    if again.limit(REPEATED_BROADCAST + 1).count() > REPEATED_BROADCAST:
        return dedupe_rows(watched)
    again = F.broadcast(again)
    copies = dedupe_rows(df.join(again, hashed == F.col("_of"), "left_semi"))
    if passing is not None:
        with disk_spared(df.sparkSession):
            copies = copies.checkpoint()
    once = watched.join(again, hashed == F.col("_of"), "left_anti")
    return once.select(*_values(once)).unionByName(copies)


def normalize_names(df: DataFrame, cols=("product_name",)) -> DataFrame:
    """O-3.8 on the named columns that exist."""
    return df.withColumns({c: C.normalize_space(c) for c in cols if c in df.columns})


def drop_incomplete(df: DataFrame, cols=tuple(rules.REQUIRED_LINE_MEASURES)) -> DataFrame:
    """O-3.17: drop rows missing any required measure."""
    return df.dropna(subset=[c for c in cols if c in df.columns])


def incomplete_rows(df: DataFrame, cols=tuple(rules.REQUIRED_LINE_MEASURES)) -> DataFrame:
    """Quarantine: the rows ``drop_incomplete`` removes."""
    cond = None
    for c in cols:
        if c in df.columns:
            cond = F.col(c).isNull() if cond is None else (cond | F.col(c).isNull())
    return df.filter(cond)


def dedupe_keys(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """O-3.19 keep-first per key, as an aggregation (``min_by`` over a struct).

    A window ``row_number`` would put every row of a hot key into one task;
    ``min_by`` is a partial aggregate, so each map task keeps one candidate
    per key and only those candidates are shuffled."""
    others = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in order_by]))
    return df.groupBy(*keys).agg(best.alias("_first")).select(*keys, "_first.*")


def duplicate_key_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """O-3.20: every row of a key that occurs more than once.

    Key counts come from a partial aggregation; the rows are then selected by a
    semi join on the (small) set of repeated keys -- AQE splits a hot key."""
    rep = df.groupBy(*keys).count().filter("count > 1").select(*keys)
    return df.join(rep, keys, "left_semi")


def clean_catalogue(raw: DataFrame, lines: DataFrame) -> DataFrame:
    """Raw catalogue export -> clean catalogue (O-3.1, 3.5-3.8, 3.15, 3.18, 5.6, 6.17).

    ``lines`` needs ``sku`` (bigint) and ``unit_price``."""
    df = rename(raw, rules.CATALOGUE_RENAMES)
    df = cast_typed(df)
    df = dedupe_rows(df)
    df = normalize_names(df)
    df = df.withColumn("sku", F.col("sku").try_cast("bigint"))
    df = with_ever_sold(df, lines)
    rec = recovered_prices(df, lines)
    df = (df.join(rec, "sku", "left")
          .withColumn("unit_price", F.coalesce(F.col("unit_price").cast("double"), F.col("recovered_unit_price")))
          .drop("recovered_unit_price"))
    # D3: split the path first, then fill (the reverse order would null the fill).
    return df.withColumn("subcategory", F.coalesce(C.path_part("subcategory", 1), F.lit("Unknown")))


def with_ever_sold(catalogue: DataFrame, lines: DataFrame) -> DataFrame:
    """O-5.6: flag catalogue keys that appear in the sold lines."""
    sold = lines.select("sku").distinct().withColumn("ever_sold", F.lit(True))
    return (catalogue.join(sold, "sku", "left")
            .withColumn("ever_sold", F.coalesce(F.col("ever_sold"), F.lit(False))))


def recovered_prices(catalogue: DataFrame, lines: DataFrame) -> DataFrame:
    """O-5.7 + O-6.17: exact median sold unit price for catalogue keys with no
    price (distributed ranks: a hot key's prices are never one task's)."""
    missing = catalogue.filter(F.col("unit_price").isNull() & F.col("sku").isNotNull()).select("sku").distinct()
    sold = lines.join(missing, "sku", "left_semi")
    med = quantiles(sold, ["sku"], F.col("unit_price").cast("double"), [0.5], linear=True)
    return med.select("sku", F.col("q")[0].alias("recovered_unit_price"))


def enrich_lines(lines: DataFrame, catalogue: DataFrame) -> DataFrame:
    """O-5.1 + O-3.13: fill product_name / subcategory from the catalogue (deduplicated
    by key first, D1; null keys never match, D2), then has_negative_price and
    'Unknown' fills."""
    cat = (dedupe_keys(catalogue.filter(F.col("sku").isNotNull()).select("sku", "product_name", "subcategory"),
                       ["sku"], ["product_name", "subcategory"])
           .withColumnsRenamed({"product_name": "product_name_catalogue",
                                "subcategory": "subcategory_catalogue"}))
    out = (lines.join(cat, "sku", "left")
           .withColumn("product_name", F.coalesce("product_name", "product_name_catalogue"))
           .withColumn("subcategory", F.coalesce("subcategory", "subcategory_catalogue"))
           .withColumn("has_negative_price", C.negative_flag("unit_price"))
           .drop("product_name_catalogue", "subcategory_catalogue"))
    return out.fillna("Unknown", subset=["subcategory", "product_name"])


def _raw_metrics() -> list[Column]:
    """What the rules change in the raw export, as aggregates over it."""
    money = [F.col("Montant total de la commande"), F.col("Montant de l’expédition commande")]
    name, pay, ship = F.col("product_name"), F.col("Titre moyen du paiement"), F.col("Titre de la méthode d’expédition")
    return [F.count("*").alias("raw_rows"), F.count_if(money[0].isNotNull() | money[1].isNotNull()).alias("money_rows"),
            (F.count(money[0]) + F.count(money[1])).alias("money_cells"), changed_count(name, C.normalize_space(name)).alias("names"),
            changed_count(pay, C.payment_label(pay)).alias("payments"), changed_count(ship, C.shipping_class(ship)).alias("shipping")]


def clean_with_actions(raw: DataFrame, catalogue_raw: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """O-12.13: the clean transactions, written, and what cleaning did: (code,
    affected_rows, affected_cells).  The counts are observed while the rows pass
    on their way to a written table, so nothing is read for them.  (A stage
    that is run again after an executor is lost may be counted again.)"""
    before, typed = Observation("raw"), Observation("typed")
    df = dedupe_in_place(typed_transactions(raw), typed_transactions(raw.observe(before, *_raw_metrics())))
    bad = None
    for c in rules.REQUIRED_LINE_MEASURES:
        bad = F.col(c).isNull() if bad is None else (bad | F.col(c).isNull())
    df = df.observe(typed, F.count("*").alias("rows"), F.count_if(bad).alias("incomplete"))
    with disk_spared(raw.sparkSession):
        if catalogue_raw is not None:
            df = write_shared(df, "typed-transactions")
        clean = write_shared(finish_transactions(df, catalogue_raw, catalogue_raw is not None), "clean-transactions")
    b, t = before.get, typed.get
    rows = [("money_text", b["money_rows"], b["money_cells"]), ("whitespace", b["names"], b["names"]),
            ("payment_labels", b["payments"], b["payments"]), ("shipping_classes", b["shipping"], b["shipping"]),
            ("duplicates_removed", b["raw_rows"] - t["rows"], 0), ("incomplete_removed", t["incomplete"], 0)]
    return clean, raw.sparkSession.createDataFrame(rows, "code string, affected_rows long, affected_cells long")


def clean_transactions(raw: DataFrame, catalogue_raw: DataFrame | None = None) -> DataFrame:
    """Raw transactions export -> clean transactions, in the documented order:
    rename, money text, typing, payment labels, dedupe, names, incomplete rows,
    enrichment, shipping flag + class, payment fill."""
    return finish_transactions(dedupe_rows(typed_transactions(raw)), catalogue_raw)


def typed_transactions(raw: DataFrame) -> DataFrame:
    """The steps before the dedupe: rename, money text, typing."""
    df = raw.drop("payment_method_group")
    df = rename(df, rules.TRANSACTION_RENAMES)
    df = parse_money_columns(df, ["shipping_cost", "order_total_amount"])
    df = cast_typed(df)
    return df.withColumn("sku", F.col("sku").try_cast("bigint"))


def finish_transactions(df: DataFrame, catalogue_raw: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """The steps after the dedupe.  Of ``stored`` rows, only those that lack a
    name or a subcategory are moved to the catalogue (the others read again)."""
    rest = None
    if catalogue_raw is not None and stored:
        lacking = F.col("product_name").isNull() | F.col("subcategory").isNull()
        df, rest = df.filter(lacking), drop_incomplete(normalize_names(df.filter(~lacking)))
    df = drop_incomplete(normalize_names(df))
    if catalogue_raw is not None:
        cat = rename(catalogue_raw, rules.CATALOGUE_RENAMES).withColumn("sku", F.col("sku").try_cast("bigint"))
        cat = normalize_names(cat)
        df = enrich_lines(df, cat)
    else:
        df = df.withColumn("has_negative_price", C.negative_flag("unit_price"))
    if rest is not None:
        df = df.unionByName(rest.withColumn("has_negative_price", C.negative_flag("unit_price")))
    return df.withColumns({
        "free_shipping": C.free_shipping("shipping_method"),
        "shipping_method": C.shipping_class("shipping_method"),
        "payment_method": C.payment_label("payment_method"),
    })


def repair_ids(df: DataFrame, col: str = "customer_id_stage") -> DataFrame:
    """O-3.16 on one column."""
    return df.withColumn(col, C.repair_customer_id(col))


def key_overlap(left: DataFrame, right: DataFrame, lkey: str, rkey: str) -> DataFrame:
    """O-5.9 / O-10.2 / O-10.3: distinct keys on each side, their intersection
    and both differences, as one row.  A full outer join of the two distinct
    key sets does it in one shuffle."""
    a = left.select(F.col(lkey).alias("k")).filter("k IS NOT NULL").distinct().withColumn("_l", F.lit(True))
    b = right.select(F.col(rkey).alias("k")).filter("k IS NOT NULL").distinct().withColumn("_r", F.lit(True))
    j = a.join(b, "k", "full")
    return j.agg(F.count_if(F.col("_l")).alias("left_keys"),
                 F.count_if(F.col("_r")).alias("right_keys"),
                 F.count_if(F.col("_l") & F.col("_r")).alias("matched"),
                 F.count_if(F.col("_l") & F.col("_r").isNull()).alias("left_only"),
                 F.count_if(F.col("_r") & F.col("_l").isNull()).alias("right_only"))


def changed_count(before: Column, after: Column) -> Column:
    """Cells a rule changed (O-12.13): ``before IS DISTINCT FROM after``."""
    return F.count_if(~before.eqNullSafe(after))

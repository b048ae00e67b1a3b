"""Scalar cleaning expressions (JVM-side, inside whole-stage codegen).

Every function takes and returns a ``Column``; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules

_PLAIN = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(mapping: dict[str, str]) -> Column:
    """A map literal; folded to a constant by Catalyst (O-5.8 map lookup by
    key without a join)."""
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def pick(labels: list[str | None], index: Column) -> Column:
    """``labels[index]`` (0-based) from a literal array."""
    arr = F.array(*[F.lit(x).cast("string") for x in labels])
    return F.element_at(arr, index.cast("int") + 1)


def parse_money(c) -> Column:
    """'1,234.50 DA' -> 1234.50 (decimal(12,2)); unparseable -> null (O-3.4)."""
    return F.regexp_replace(_col(c), " DA|,", "").try_cast("decimal(12,2)")


def parse_number(c, to: str = "double") -> Column:
    """Numeric coercion, bad text -> null (O-3.6)."""
    return _col(c).try_cast(to)


def parse_timestamp(c, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Date coercion, bad text -> null (O-3.5)."""
    return F.try_to_timestamp(_col(c), F.lit(fmt)).cast("timestamp_ntz")


def normalize_space(c) -> Column:
    """Collapse runs of Unicode whitespace and strip the ends (O-3.8)."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def payment_label(c) -> Column:
    """Exact-match standardization, unmatched kept, null -> Unknown (O-3.9)."""
    return F.coalesce(F.try_element_at(literal_map(rules.PAYMENT_LABELS), _col(c)), _col(c),
                      F.lit(rules.PAYMENT_UNKNOWN))


def free_shipping(c) -> Column:
    """Multilingual free-shipping flag on the raw label; null -> false (O-3.10)."""
    return F.coalesce(_col(c).rlike("(?iu)" + rules.FREE_SHIPPING_PATTERN), F.lit(False))


def shipping_class(c) -> Column:
    """Ordered multilingual regex classes, first match wins; text that already
    is a valid class is kept; the rest and null -> Unknown (O-3.11)."""
    out = None
    for pattern, label in rules.SHIPPING_RULES:
        cond = _col(c).rlike("(?iu)" + pattern)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    out = out.when(_col(c).isin(*rules.SHIPPING_VALID), _col(c))
    return out.otherwise(F.lit(rules.SHIPPING_UNKNOWN))


def status_group(c) -> Column:
    """9 statuses -> 6 groups, unmapped -> null (O-3.12)."""
    return F.try_element_at(literal_map(rules.STATUS_GROUPS), _col(c))


def is_realized(c) -> Column:
    """O-4.7: null-safe membership (null -> false)."""
    return F.coalesce(_col(c).isin(*rules.REALIZED_STATUSES), F.lit(False))


def path_part(c, index: int = 1, sep: str = ">") -> Column:
    """``split(c, sep)[index]`` trimmed; out of range -> null (O-3.15)."""
    return F.trim(F.get(F.split(_col(c), sep), index))


def repair_customer_id(c) -> Column:
    """CLT_S + 5 digits -> CLT_S0 + 5 digits; 6-digit ids untouched (O-3.16)."""
    return F.regexp_replace(_col(c), rules.CUSTOMER_ID_PATTERN, rules.CUSTOMER_ID_REPLACEMENT)


def negative_flag(c) -> Column:
    """``c < 0`` with null -> false (O-3.14)."""
    return F.coalesce(_col(c) < 0, F.lit(False))


def ratio(num, den) -> Column:
    """Division that yields null on a zero or null denominator (O-3.21)."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def growth_pct(cur, prev) -> Column:
    """(cur - prev) / prev * 100, null when prev is 0 or null (O-7.5)."""
    cur, prev = _col(cur).cast("double"), _col(prev).cast("double")
    return F.try_divide(cur - prev, prev) * F.lit(100.0)


def round_dp(c, digits: int) -> Column:
    """Round half away from zero at ``digits`` decimals as ``round(x * 10^d) / 10^d``.

    The scaling multiply and divide are single IEEE operations, so every
    engine that rounds the scaled value half away from zero (the oracle SQL
    uses the same form) breaks exact ties identically."""
    scale = float(10 ** digits)
    return F.round(_col(c) * F.lit(scale), 0) / F.lit(scale)


def month_start(c) -> Column:
    """O-3.22: month bucket (first day of the month, a DATE)."""
    return F.trunc(_col(c).cast("date"), "MM")


def _key_text(c: Column, dtype: str) -> Column:
    """Text that two values of a column share when they are equal, and only then."""
    if dtype in ("float", "double"):
        c = c + F.lit(0.0).cast(dtype)  # -0.0 equals 0.0
    elif dtype == "timestamp":
        c = F.unix_micros(c)
    return c.cast("string")


def row_key(df: DataFrame, name: str = "_row") -> list[Column]:
    """Grouping columns that hold together exactly the rows equal in all columns
    (null equals null): the SHA-256 of the values, each behind its length.  What
    is shuffled is then 32 bytes a row.  Columns of nested or binary type stand
    for themselves."""
    plain = [(c, t) for c, t in df.dtypes if t in _PLAIN or t.startswith("decimal(")]
    rest = [F.col(f"`{c}`") for c, t in df.dtypes if (c, t) not in plain]
    if not plain:
        return rest
    # One expression over an array: spelled out for each column it outgrows what the JVM compiles.
    cells = F.transform(F.array(*[_key_text(F.col(f"`{c}`"), t) for c, t in plain]),
                        lambda x: F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")))
    return [F.unhex(F.sha2(F.concat_ws("", cells).cast("binary"), 256)).alias(name), *rest]

"""Query registry: name -> (Spark job, DuckDB oracle SQL or None).

Each job takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole input tables.  Column names are identical in both forms.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle import with_ctes

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def bigint_counts(sql: str) -> str:
    """DuckDB types ``count_if`` as HUGEINT; Spark's is BIGINT.  Wrap every
    call so both engines report the same column types."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = bigint_counts(sql[j + len(key):k])
        out.append(f"{sql[i:j]}CAST(count_if({inner}) AS BIGINT)")
        i = k + 1


def _matching(sql: str, open_idx: int) -> int:
    depth = 0
    for k in range(open_idx, len(sql)):
        if sql[k] == "(":
            depth += 1
        elif sql[k] == ")":
            depth -= 1
            if depth == 0:
                return k
    raise ValueError("unbalanced parentheses")


def scaled_rounding(sql: str) -> str:
    """``round(x, d)`` -> ``round((x) * 10^d) / 10^d``: the same explicit form
    as ``functions.cleaning.round_dp``, so exact ties round identically."""
    out, i = [], 0
    pat = re.compile(r"\bround\(")
    while True:
        m = pat.search(sql, i)
        if not m:
            out.append(sql[i:])
            return "".join(out)
        start, open_idx = m.start(), m.end() - 1
        close = _matching(sql, open_idx)
        inner = sql[open_idx + 1:close]
        depth, split = 0, None
        for k, ch in enumerate(inner):
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 0:
                split = k
        if split is None or not inner[split + 1:].strip().isdigit():
            out.append(sql[i:open_idx + 1] + scaled_rounding(inner) + ")")
        else:
            d = int(inner[split + 1:].strip())
            scale = f"{10 ** d}.0"
            out.append(f"{sql[i:start]}(round(({scaled_rounding(inner[:split])}) * {scale}) / {scale})")
        i = close + 1


def register(name: str, sql: str | None = None, *ctes: str):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, scaled_rounding(bigint_counts(with_ctes(sql, *ctes))) if sql else None)
        return fn
    return deco


def load_all() -> dict[str, tuple[QueryFn, str | None]]:
    # Importing the query modules fills REGISTRY.
    from . import q_sales, q_products, q_regions, q_clients, q_cleaning, q_profile, q_time, q_traffic, q_results, q_files, q_streaming, q_more  # noqa: F401
    return REGISTRY

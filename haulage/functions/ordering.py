"""Top-1 per group.

``first_by(df, keys, order, payload)`` keeps, for every group, the row that
sorts first under ``order`` and returns the keys and ``payload`` columns.

It is written as ``row_number() OVER (PARTITION BY keys ORDER BY order) = 1``,
which Catalyst turns into a ``WindowGroupLimit``: a *partial* top-1 runs inside
every map task before the shuffle, so a hot group (one order holding a large
share of the rows) arrives as at most one row per map task, and a final top-1
runs after it.

Order items are ``(column, "asc"|"desc", "first"|"last")``; the null placement
is always explicit because engines disagree on the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

OrderItem = tuple[str, str, str]


def asc(col: str, nulls: str = "last") -> OrderItem:
    return (col, "asc", nulls)


def desc(col: str, nulls: str = "last") -> OrderItem:
    return (col, "desc", nulls)


def order_sql(order: list[OrderItem]) -> str:
    return ", ".join(f"{name} {direction.upper()} NULLS {nulls.upper()}"
                     for name, direction, nulls in order)


def first_by(df: DataFrame, keys: list[str], order: list[OrderItem],
             payload: list[str] | None = None) -> DataFrame:
    """Keys and ``payload`` (default: every other column) of each group's first row."""
    rn = (f"row_number() OVER (PARTITION BY {', '.join(keys)} "
          f"ORDER BY {order_sql(order)}) AS _rn")
    top = df.selectExpr("*", rn).where("_rn = 1").drop("_rn")
    return top if payload is None else top.selectExpr(*keys, *payload)

"""Column functions of the cost model (pure expressions, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column

# ship weight of a rollup: exact, with a fixed scale so products keep 8 decimals
WEIGHT_TYPE = "decimal(18,4)"


def freight_charge_sql(total_weight: str, rate: str, minimum_cost: str,
                       carrier_key: str | None = None, zero_freight_carrier_key: int = 1,
                       guarded: bool = True) -> str:
    """Weight x rate, never below the tariff minimum, as a SQL expression over column names.

    Guarded form: free for the zero-freight carrier and when no rate is known.
    Unguarded form: GREATEST skips a NULL rate, so the minimum cost applies.
    """
    charge = f"greatest({total_weight} * {rate}, coalesce({minimum_cost}, 0))"
    if not guarded:
        return charge
    free = f"{rate} IS NULL"
    if carrier_key is not None:
        free = f"{carrier_key} = {int(zero_freight_carrier_key)} OR {free}"
    return f"CASE WHEN {free} THEN 0 ELSE {charge} END"


def money(c: Column) -> Column:
    """Final projection of an exact decimal amount."""
    return c.cast("double")

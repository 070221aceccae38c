"""Knobs for the cost model.

The defaults reproduce the business questions as originally written; every
alternative reading is a named, opt-in switch (see README "Readings").
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class CostConfig:
    # carrier surrogate key whose freight is free (the first carrier in code order)
    zero_freight_carrier_key: int = 1
    # "order": one tariff / one option survives per order (as written);
    # "shipment": one per (order, plant, carrier, origin, destination, service)
    grain: str = "order"
    # one product key per product id instead of one per (plant, product) row
    dedup_product: bool = False
    # apply the zero-freight carrier / missing-rate guard when pricing options
    guarded: bool = True

    def __post_init__(self) -> None:
        if self.grain not in ("order", "shipment"):
            raise ValueError(f"grain must be 'order' or 'shipment', got {self.grain!r}")

    def with_(self, **kw) -> "CostConfig":
        return replace(self, **kw)


def zero_freight_by_code(cfg: CostConfig, dim_carrier, carrier_code: str) -> CostConfig:
    """Point the zero-freight rule at a carrier code instead of a key position.

    Key 1 is simply the first carrier in code order, which depends on collation;
    resolving a code through the carrier dimension is a one-row lookup.
    """
    from pyspark.sql import functions as F
    row = (dim_carrier.where(F.col("carrier_id") == F.lit(carrier_code))
           .select("carrier_key").limit(1).collect())
    if not row:
        raise ValueError(f"unknown carrier code {carrier_code!r}")
    return replace(cfg, zero_freight_carrier_key=int(row[0][0]))


AS_WRITTEN = CostConfig()
BY_SHIPMENT = CostConfig(grain="shipment")
DEDUP = CostConfig(dedup_product=True)

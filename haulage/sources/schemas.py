"""Declared staging schemas (the seven input tables).

Decimal columns are ``decimal(12,4)``: a bare ``DECIMAL`` in Spark would be
``decimal(10,0)`` and silently round money and weights to whole numbers.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 4)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


PLANT_PORT = _schema(("plant_code", T.StringType()), ("port", T.StringType()))

VMI_CUSTOMERS = _schema(("plant_code", T.StringType()), ("customer_id", T.StringType()))

PRODUCTS_PER_PLANT = _schema(("plant_code", T.StringType()), ("product_id", T.LongType()))

WH_CAPACITIES = _schema(("plant_id", T.StringType()), ("daily_capacity", T.IntegerType()))

WH_COSTS = _schema(("plant_code", T.StringType()), ("cost_per_unit", MONEY))

FREIGHT_RATES = _schema(
    ("carrier_id", T.StringType()),
    ("origin_port_code", T.StringType()),
    ("destination_port_code", T.StringType()),
    ("min_weight_quantity", MONEY),
    ("max_weight_quantity", MONEY),
    ("service_code", T.StringType()),
    ("minimum_cost", MONEY),
    ("rate", MONEY),
    ("mode_description", T.StringType()),
    ("transportation_day_count", T.IntegerType()),
    ("carrier_type", T.StringType()),
)

ORDER_LIST = _schema(
    ("order_id", T.LongType()),
    ("order_date", T.DateType()),
    ("origin_port", T.StringType()),
    ("carrier", T.StringType()),
    ("transportation_day_count", T.IntegerType()),
    ("service_level", T.StringType()),
    ("ship_ahead_day_count", T.IntegerType()),
    ("ship_late_day_count", T.IntegerType()),
    ("customer", T.StringType()),
    ("product_id", T.LongType()),
    ("plant_code", T.StringType()),
    ("destination_port", T.StringType()),
    ("unit_quantity", T.IntegerType()),
    ("weight", MONEY),
)

STAGING = {
    "plant_port": PLANT_PORT,
    "vmi_customers": VMI_CUSTOMERS,
    "products_per_plant": PRODUCTS_PER_PLANT,
    "wh_capacities": WH_CAPACITIES,
    "wh_costs": WH_COSTS,
    "freight_rates": FREIGHT_RATES,
    "order_list": ORDER_LIST,
}

# code columns standardised by the clean layer (trim + upper case)
CODE_COLUMNS = {
    "plant_port": ("plant_code", "port"),
    "vmi_customers": ("plant_code", "customer_id"),
    "products_per_plant": ("plant_code",),
    "wh_capacities": ("plant_id",),
    "wh_costs": ("plant_code",),
    "freight_rates": ("carrier_id", "origin_port_code", "destination_port_code", "service_code"),
    "order_list": ("origin_port", "carrier", "service_level", "customer", "plant_code",
                   "destination_port"),
}

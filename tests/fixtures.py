"""Hand-made staging tables (edge cases) built directly as DataFrames."""

from datetime import date
from decimal import Decimal as D

from haulage.sources import schemas
from haulage.sources.staging import Staging


def staging(spark, **rows) -> Staging:
    return Staging(**{t: spark.createDataFrame(rows.get(t, []), schemas.STAGING[t])
                      for t in schemas.STAGING})


def _band(carrier, lo, hi, rate, minimum, service="SL_A", origin="PORT01", dest="PORT02"):
    return (carrier, origin, dest, D(lo), D(hi), service,
            None if minimum is None else D(minimum), None if rate is None else D(rate),
            "GROUND", 3, "TYPE_1")


TARIFFS = [
    _band("C02", "0", "50", "1.0", "5"),
    _band("C02", "50", "120", "0.5", "10"),
    _band("C02", "120", "200", "0.25", None),
    _band("C03", "0", "50", None, "3"),          # no rate: guarded -> 0, unguarded -> minimum
    _band("C03", "50", "120", "2.0", None),
    _band("C01", "0", "200", "9.0", "1"),        # carrier key 1: zero freight when guarded
]


def _line(order_id, carrier, qty, weight, service="SL_A", plant="PLANT01", product=100,
          customer="CUST_1", late=0, ahead=0):
    return (order_id, date(2024, 1, 1 + order_id % 28), "PORT01", carrier, 2, service, ahead, late,
            customer, product, plant, "PORT02", qty, D(weight))


ORDERS = [
    _line(1, "C02", 5, "10"),                     # weight 50 matches two bands -> higher band
    _line(2, "C02", 1, "10"),                     # order 2, shipment A: matched
    _line(2, "C02", 2, "1", service="SL_N"),      # order 2, shipment B: no tariff (unmatched)
    _line(3, "C02", 1, "250"),                    # above every band
    _line(4, "C03", 2, "10"),                     # NULL rate
    _line(5, "C01", 1, "10"),                     # zero-freight carrier
]


def edge_staging(spark, orders=ORDERS):
    return staging(
        spark,
        plant_port=[("PLANT01", "PORT01"), ("PLANT02", "PORT01")],
        vmi_customers=[("PLANT02", "CUST_9"), ("PLANT02", None)],
        products_per_plant=[("PLANT01", 100), ("PLANT02", 200)],
        wh_capacities=[("PLANT01", 100), ("PLANT02", 100)],
        wh_costs=[("PLANT01", D("1.0")), ("PLANT02", D("2.0")), (None, None)],
        freight_rates=TARIFFS,
        order_list=orders,
    )

"""A model that takes new order lines without being built anew."""

from dataclasses import replace

import pytest

from haulage.operators import costmodel
from haulage.operators.clean import clean
from haulage.plans.loads import CELL_BITS, LoadedModel
from haulage.plans.registry import all_queries
from haulage.session import scratch_path
from tests.fixtures import ORDERS, _line, edge_staging

FAR = 5 << CELL_BITS
FIRST = ORDERS[:4] + [_line(FAR, "C02", 1, "10", customer="CUST_7")]
#: a second line of a shipment, a new shipment of an old order, new codes, the same line twice
SECOND = [*ORDERS[4:], _line(1, "C02", 3, "10"), _line(2, "C02", 1, "2", service="SL_X"), _line(8, "C09", 2, "3", customer="CUST_8"),
          _line(8, "C09", 2, "3", customer="CUST_8"), (None, *_line(9, "C02", 1, "4")[1:])]
QUESTIONS = ("total_historical_cost", "avg_cost_per_order_unit", "capacity_fit", "total_historical_cost_by_shipment")


def _codes(star):
    names = {n: {r[0]: r[1] for r in df.collect()} for n, df in (
        ("plant", star.dim_plant.select("plant_key", "plant_code")), ("carrier", star.dim_carrier.select("carrier_key", "carrier_id")),
        ("customer", star.dim_customer.select("customer_key", "customer_id")), ("date", star.dim_date.select("date_key", "full_date")))}
    ships = sorted(repr((r.order_id, names["plant"][r.plant_id], names["carrier"][r.carrier_id], r.service_level, r.unit_quantity, r.total_weight))
                   for r in star.shipments.collect())
    found = star.fact_orders.collect()
    lines = sorted(repr((r.order_id, names["customer"][r.customer_id], names["date"][r.date_id], r.unit_quantity, r.weight)) for r in found)
    return ships, lines, sorted(r.order_key for r in found)


def test_two_loads_equal_one_and_a_failed_one_changes_nothing(spark, monkeypatch):
    def staged(orders):
        return clean(edge_staging(spark, orders))

    whole = LoadedModel(spark, scratch_path(spark, "whole"))
    with pytest.raises(ValueError):
        whole.star()
    assert whole.load(staged(FIRST + SECOND)) == 1
    model = LoadedModel(spark, scratch_path(spark, "parts"))
    assert model.load(staged(FIRST)) == 1
    before = _codes(model.star())

    def fails(lines):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(costmodel, "shipments", fails)  # lines are written by then
        with pytest.raises(RuntimeError):
            model.load(staged(SECOND[:2]))
    assert _codes(model.star()) == before
    assert model.load(staged(SECOND)) == 2
    ships, lines, keys = _codes(model.star())
    expected = _codes(whole.star())
    assert (ships, lines) == expected[:2]
    assert keys == list(range(1, len(FIRST + SECOND) + 1)) == expected[2]
    parts, one = model.open(), whole.open()
    for question in QUESTIONS:
        answers = [sorted(map(repr, all_queries()[question](spark, name).collect())) for name in (parts, one)]
        assert answers[0] == answers[1], question
    # the far cell was not touched by the second load
    touched = {r.cell for r in model.commits().where("load = 2 AND cell IS NOT NULL").collect()}
    assert touched == {0, -(1 << 62)}
    # a load without lines
    assert model.load(staged([])) == 3
    assert _codes(model.star()) == (ships, lines, keys)


def test_first_load_may_be_empty(spark):
    model = LoadedModel(spark, scratch_path(spark, "empty"))
    model.load(clean(edge_staging(spark, [])))
    assert _codes(model.star()) == ([], [], [])
    c = clean(edge_staging(spark, ORDERS))
    model.load(replace(c, vmi_customers=c.vmi_customers.limit(0)))
    assert len(_codes(model.star())[1]) == len(ORDERS)


def test_order_keys_of_two_loads_are_counted_without_shuffling_them(spark):
    from conftest import SF_SMALL
    from haulage.plans import ingest
    got = ingest.two_loads_capacity(spark, SF_SMALL)
    assert all(r.order_keys == r.order_lines for r in got.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "hashpartitioning(" in line and "order_key" in line.split("hashpartitioning(")[1].split("_stretch")[0]]

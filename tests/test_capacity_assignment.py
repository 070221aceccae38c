"""Feasible re-sourcing and the capacity-limited assignment: invariants and hand-made stars
(test_oracle holds the queries against SQL)."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from fixtures import ORDERS, _line, edge_staging
from haulage.config import CostConfig
from haulage.operators.costmodel import SHIPMENT_KEYS, shipments
from haulage.operators.clean import clean
from haulage.oracle import ASSIGNMENT_ROUNDS
from haulage.plans import extensions
from haulage.plans.star import build_star, star_for
from haulage.session import scratch_path

CFG = CostConfig(dedup_product=True)


@pytest.mark.parametrize("per_day", [False, True])
def test_assignment_invariants(spark, per_day):
    star = star_for(spark, SF_SMALL, dedup_product=True)
    got = extensions.capacity_assignment(star, CFG, per_day=per_day).cache()
    # whole: every shipment exactly once, assigned or not
    assert got.count() == star.shipments.count() == got.select(*SHIPMENT_KEYS).distinct().count()
    chosen = got.where("assigned_plant IS NOT NULL")
    # no plant (or plant-day) above its capacity in order lines
    lines = star.fact_orders.groupBy(*SHIPMENT_KEYS).agg(F.count(F.lit(1)).alias("lines"), F.min("date_id").alias("date_id"))
    scope = ["assigned_plant", "date_id"] if per_day else ["assigned_plant"]
    load = chosen.join(lines, SHIPMENT_KEYS).groupBy(*scope).agg(F.sum("lines").alias("lines"))
    assert load.join(star.dim_plant, F.col("assigned_plant") == F.col("plant_key")).where("lines > daily_capacity").count() == 0
    # every assignment is one of the feasible options, at its price
    opts = extensions.feasible_options(star, CFG).select(
        *SHIPMENT_KEYS, F.col("candidate_plant").alias("assigned_plant"), F.col("candidate_origin_port").alias("assigned_origin_port"),
        F.col("candidate_carrier").alias("assigned_carrier"), "freight_rate_id", F.col("total_cost").cast("double").alias("total_cost"))
    assert chosen.drop("unit_quantity", "assignment_round").join(opts, opts.columns, "left_anti").count() == 0
    got.unpersist()


@pytest.mark.parametrize("per_day", [False, True])
def test_oracle_writes_enough_rounds_out(spark, per_day):
    """The SQL's last round accepts nothing on the fixture, so no further one would."""
    star = star_for(spark, SF_SMALL, dedup_product=True)
    rounds = extensions.capacity_assignment(star, CFG, per_day=per_day).agg(F.max("assignment_round")).first()[0]
    assert rounds < ASSIGNMENT_ROUNDS


def small_star(spark, plants, orders, vmi=(), capacity=1):
    """A star of one product stocked by all plants: orders are (order_id, customer, date)."""
    star = star_for(spark, SF_SMALL, dedup_product=True)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    facts = frame([(i, o, d, 1, 1, c, 1, 1, 9, 1, "S", 1, 0, 0) for i, (o, c, d) in enumerate(orders)],
                  "order_key bigint, order_id bigint, date_id bigint, plant_id bigint, product_id bigint, customer_id bigint, "
                  "carrier_id bigint, origin_port_id bigint, destination_port_id bigint, transport_mode int, service_level string, "
                  "unit_quantity int, ship_ahead_days int, ship_late_days int").withColumn("weight", F.lit(1).cast("decimal(12,4)"))
    tariffs = frame([(1, 2, 1, 9, "S")], "freight_rate_id bigint, carrier_key bigint, origin_port_key bigint, "
                    "destination_port_key bigint, service_level string").withColumns({
                        "transport_mode": F.lit("AIR"), "min_weight": F.lit(0).cast("decimal(12,4)"), "max_weight": F.lit(100).cast("decimal(12,4)"),
                        "rate": F.lit(1).cast("decimal(12,4)"), "minimum_cost": F.lit(1).cast("decimal(12,4)"),
                        "transport_days": F.lit(1), "carrier_type": F.lit("T")})
    return replace(
        star, fact_orders=facts, shipments=shipments(facts), fact_freight_rates=tariffs,
        dim_plant=frame([(p, f"PLANT{p:02d}", capacity) for p in range(1, plants + 1)], "plant_key bigint, plant_code string, daily_capacity int")
        .withColumn("cost_per_unit", F.col("plant_key").cast("decimal(12,4)")),
        bridge_plant_product=frame([(p, 1) for p in range(1, plants + 1)], "plant_key bigint, product_key bigint"),
        bridge_plant_port=frame([(p, 1) for p in range(1, plants + 1)], "plant_key bigint, port_key bigint"),
        bridge_plant_customer=frame(list(vmi), "plant_key bigint, customer_key bigint"))


def test_rounds_go_on_until_every_plant_was_asked(spark):
    star = small_star(spark, 6, [(o, 1, 1) for o in range(6)])
    got = extensions.capacity_assignment(star, CFG).collect()
    assert sorted(r["assigned_plant"] for r in got) == [1, 2, 3, 4, 5, 6]
    seven = extensions.capacity_assignment(small_star(spark, 6, [(o, 1, 1) for o in range(7)]), CFG).collect()
    assert sum(r["assigned_plant"] is None for r in seven) == 1 and len(seven) == 7


def test_capacity_is_charged_in_order_lines(spark):
    star = small_star(spark, 1, [(1, 1, 1)] * 3 + [(2, 1, 1)] * 2, capacity=4)
    got = {r["order_id"]: r["assigned_plant"] for r in extensions.capacity_assignment(star, CFG).collect()}
    assert sorted(v or 0 for v in got.values()) == [0, 1]


@pytest.mark.parametrize("per_day", [False, True])
def test_a_shipment_that_does_not_fit_shuts_nobody_out(spark, per_day):
    # capacity 4; 3, 2 and 1 lines ask in that order, since their units make them dearer
    star = small_star(spark, 1, [(1, 1, 1)] * 3 + [(2, 1, 1)] * 2 + [(3, 1, 1)], capacity=4)
    facts = star.fact_orders.withColumn("unit_quantity", F.element_at(F.array(F.lit(1), F.lit(10), F.lit(100)), F.col("order_id").cast("int")))
    star = replace(star, fact_orders=facts, shipments=shipments(facts))
    got = {r["order_id"]: r["assigned_plant"] for r in extensions.capacity_assignment(star, CFG, per_day=per_day).collect()}
    assert got == {1: 1, 2: None, 3: 1}
    # nine lines without an alternative come first, but fit into no plant
    star = small_star(spark, 2, [(1, 5, 1)] * 9 + [(2, 9, 1)] * 3 + [(3, 9, 1)], vmi=[(2, 9)], capacity=4)
    got = {r["order_id"]: r["assigned_plant"] for r in extensions.capacity_assignment(star, CFG, per_day=per_day).collect()}
    assert got == {1: None, 2: 1, 3: 1}


def test_days_are_apart_and_shipments_of_several_days_stay_open(spark):
    star = small_star(spark, 1, [(1, 1, 1), (2, 1, 2), (3, 1, 1), (3, 1, 2)])
    got = {r["order_id"]: r["assigned_plant"] for r in extensions.capacity_assignment(star, CFG, per_day=True).collect()}
    assert got == {1: 1, 2: 1, 3: None}


def test_vmi_plant_must_list_every_customer_of_a_shipment(spark):
    star = small_star(spark, 3, [(1, 5, 1), (1, 9, 1), (2, 9, 1)], vmi=[(2, 9), (3, 5), (3, 9)])
    got = {(r["order_id"], r["candidate_plant"]) for r in extensions.candidate_plants(star).collect()}
    assert got == {(1, 1), (1, 3), (2, 1), (2, 2), (2, 3)}


def test_candidates_beyond_one_word_of_plants(spark):
    """150 plants: three words of bits; every second plant is VMI and lists customer 9 alone."""
    star = small_star(spark, 150, [(1, 5, 1), (2, 9, 1), (3, 9, 1), (3, 5, 1)], vmi=[(p, 9) for p in range(2, 151, 2)])
    star = replace(star, bridge_plant_product=star.bridge_plant_product.where("plant_key <> 63"))
    got = {}
    for r in extensions.candidate_plants(star).collect():
        got.setdefault(r["order_id"], set()).add(r["candidate_plant"])
    odd, every = set(range(1, 151, 2)) - {63}, set(range(1, 151)) - {63}
    assert got == {1: odd, 2: every, 3: odd}


def test_a_product_that_no_plant_stocks_has_no_candidates(spark):
    star = small_star(spark, 2, [(1, 1, 1), (1, 1, 1), (2, 1, 1)])
    facts = star.fact_orders.withColumn("product_id", F.when(F.col("order_key") == 0, F.lit(7)).otherwise(F.col("product_id")).cast("bigint"))
    assert {r["order_id"] for r in extensions.candidate_plants(replace(star, fact_orders=facts)).collect()} == {2}


def test_utilization_before_is_that_of_the_capacity_question(spark):
    import __spark_entry__ as E
    q = E.queries()
    before = {r["plant_code"]: r["daily_orders"] for r in q["capacity_utilization_dedup"](spark, SF_SMALL).collect()}
    shift = {r["plant_code"]: r["historical_lines"] for r in q["utilization_shift"](spark, SF_SMALL).collect()}
    assert {k: v for k, v in shift.items() if v} == before


@pytest.mark.parametrize("dedup", [False, True])
def test_re_sourcing_needs_no_numbered_order_lines(spark, dedup):
    from datetime import date
    staged = edge_staging(spark, [*ORDERS, _line(6, "C02", 2, "5", product=300, customer="CUST_9"), _line(6, "C02", 1, "5", product=300),
                                  _line(7, "C02", 1, "5", product=300, customer="CUST_9"), _line(8, "C02", 1, "5", product=400),
                                  (9, date(2024, 1, 1), *_line(9, "C02", 1, "2", customer=None)[2:]), _line(1, "C02", 3, "2", product=300)])
    staged = clean(replace(staged, products_per_plant=spark.createDataFrame(
        [("PLANT01", 100), ("PLANT01", 300), ("PLANT02", 300), ("PLANT02", 100), (None, 400), ("PLANT03", 100)], "plant_code string, product_id long")))
    star = build_star(staged, scratch_path(spark, "unnumbered"), dedup_product=dedup)
    questions = (extensions.feasible_options, extensions.feasible_assignment, extensions.utilization_shift, extensions.capacity_assignment)
    found = [sorted(map(repr, q(star, CFG).collect())) for q in questions]
    assert all(found) and not {"fact_orders", "shipments"} & set(vars(star))
    star.fact_orders
    assert [sorted(map(repr, q(star, CFG).collect())) for q in questions] == found


@pytest.mark.parametrize("per_day", [False, True])
def test_rounds_shuffle_no_shipments(spark, monkeypatch, per_day):
    """Shipments are brought together once; of a round's proposals only those around the last one that fits are put in order."""
    star, written = small_star(spark, 4, [(o, 1, 1) for o in range(30)], capacity=5), []
    # cost and regret grow with the units, so the plants' last cells hold a few of the proposals
    facts = star.fact_orders.withColumn("unit_quantity", F.expr("CAST(order_id * 3 + 1 AS INT)"))
    star = replace(star, fact_orders=facts, shipments=shipments(facts))

    def noted(df, label):
        out = real(df, label)
        written.append((label, df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0], out.count()))
        return out

    real = extensions.stored
    monkeypatch.setattr(extensions, "stored", noted)
    monkeypatch.setattr("haulage.functions.keys.stored", noted)
    got = extensions.capacity_assignment(star, CFG, per_day=per_day).collect()
    assert sorted(r["assignment_round"] or 0 for r in got) == [0] * 10 + [1] * 5 + [2] * 5 + [3] * 5 + [4] * 5
    proposals = [(plan, rows) for label, plan, rows in written if label == "proposals"]
    assert [rows for _, rows in proposals] == [30, 25, 20, 15, 10]
    assert not any("Exchange hashpartitioning(order_id" in plan for plan, _ in proposals[1:])
    ranges = [rows for label, _, rows in written if label == "ranges"]
    assert ranges and max(ranges) < 5, ranges


def _one_by_one(options, capacity):
    """The rounds in plain Python: {shipment: (plant, round)}."""
    left, where, turn = dict(capacity), {}, 0
    while True:
        turn += 1
        asking = {}
        for key, (lines, prices) in options.items():
            room = sorted((cost, p) for p, cost in prices.items() if lines <= left[p])
            if key not in where and room:
                regret = room[1][0] - room[0][0] if len(room) > 1 else None
                asking.setdefault(room[0][1], []).append((regret is not None, -(regret or 0), room[0][0], key, lines))
        if not asking:
            return where
        for plant, rows in asking.items():
            run, took = 0, 0
            for *_, key, lines in sorted(rows):
                run += lines
                if run <= left[plant]:
                    where[key], took = (plant, turn), run
            left[plant] -= took


@pytest.mark.parametrize("capacity", [3, 11, 40])
def test_rounds_equal_those_taken_one_by_one(spark, capacity):
    draw = random.Random(capacity)
    orders = [(o, 1, 1) for o in range(60) for _ in range(draw.choice((1, 1, 1, 2, 5)))]
    star = small_star(spark, 4, orders, capacity=capacity)
    units = [draw.choice((1, 1, 2, 30, 1000)) for _ in range(60)]
    stocked = {o: sorted(draw.sample(range(1, 5), draw.choice((1, 2, 3)))) for o in range(60)}
    by_order = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("order_id").cast("int") + 1)
    facts = star.fact_orders.withColumns({"unit_quantity": by_order(units), "product_id": F.col("order_id")})
    star = replace(star, fact_orders=facts, shipments=shipments(facts), bridge_plant_product=spark.createDataFrame(
        [(p, o) for o, ps in stocked.items() for p in ps], "plant_key bigint, product_key bigint"))
    priced = {}
    for r in extensions.feasible_options(star, CFG).collect():
        priced.setdefault(r["order_id"], {})[r["candidate_plant"]] = r["total_cost"]
    lines = {o: sum(x[0] == o for x in orders) for o in priced}
    want = _one_by_one({o: (lines[o], priced[o]) for o in priced}, {p: capacity for p in range(1, 5)})
    got = extensions.capacity_assignment(star, CFG).collect()
    assert len(got) == 60
    assert {r["order_id"]: (r["assigned_plant"], r["assignment_round"]) for r in got if r["assigned_plant"]} == want


def test_a_shipment_without_an_order_number_takes_room_only(spark):
    star = small_star(spark, 1, [(None, 1, 1), (2, 1, 1), (3, 1, 1)], capacity=3)
    got = {r["order_id"]: r["assigned_plant"] for r in extensions.capacity_assignment(star, CFG).collect()}
    assert got == {None: None, 2: 1, 3: 1}

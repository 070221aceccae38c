"""Cost-model semantics on hand-made edge cases (values worked out by hand)."""


from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from fixtures import _line, edge_staging
from haulage.config import CostConfig
from haulage.operators import costmodel
from haulage.operators.clean import clean
from haulage.plans import evaluation, inefficiency, optimization
from haulage.plans.star import build_star


@pytest.fixture(scope="module")
def star(spark):
    from haulage.session import scratch_path
    return build_star(clean(edge_staging(spark)), scratch_path(spark, "edge"))


def _by_order(df, col):
    return {r["order_id"]: r[col] for r in df.collect()}


def test_dimensions(star):
    assert [r.carrier_id for r in star.dim_carrier.orderBy("carrier_key").collect()] == \
        ["C01", "C02", "C03"]
    assert star.dim_plant.count() == 2            # blank cost row dropped, inner join
    cust = {r.customer_id: r.is_vmi_customer for r in star.dim_customer.collect()}
    assert cust["CUST_9"] is True and cust["CUST_1"] is False
    # a VMI row with a NULL customer still adds one NULL customer (set union keeps one NULL),
    # and a NULL id is never a VMI customer
    assert cust[None] is False
    keys = [r.customer_key for r in star.dim_customer.orderBy("customer_key").collect()]
    assert keys == list(range(1, len(keys) + 1))


def test_historical_order_grain(star):
    oc = evaluation.historical_costs(star, CostConfig())
    t = _by_order(oc, "transport_cost")
    # order 1: weight 50 -> band [50,120] (higher minimum wins): 50 * 0.5 = 25 > 10
    assert t[1] == D("25")
    # order 2: the unmatched shipment sorts first (NULLS FIRST) and is the one kept
    assert t[2] == 0 and _by_order(oc, "unit_quantity")[2] == 2
    assert t[3] == 0                              # above 200: no band
    assert t[4] == 0                              # NULL rate, guarded
    assert t[5] == 0                              # carrier key 1
    tot = evaluation.total_historical_cost(star, CostConfig()).first()
    assert tot.total_transport_cost == 25.0
    assert tot.total_warehouse_cost == 5 + 2 + 1 + 2 + 1
    assert tot.total_logistics_cost == 36.0


def test_historical_shipment_grain(star):
    oc = evaluation.historical_costs(star, CostConfig(grain="shipment"))
    rows = {(r.order_id, r.service_level): r.total_order_cost for r in oc.collect()}
    assert rows[(2, "SL_A")] == D("11")           # max(10 * 1.0, 5) + 1 unit * 1.0
    assert rows[(2, "SL_N")] == D("2")


def test_cheapest_guarded_and_unguarded(star):
    best = optimization.optimal_choices(star, CostConfig(), guarded=True)
    b = {r.order_id: (r.carrier_id, r.total_order_cost) for r in best.collect()}
    # order 1: C03 (NULL rate -> 0) and C01 (key 1 -> 0) tie at 5; lower carrier key wins
    assert b[1] == (1, D("5"))
    un = optimization.optimal_assignment(star, CostConfig())
    u = {r.order_id: (r.optimal_carrier, r.transport_cost) for r in un.collect()}
    # unguarded: C03 falls back to its minimum 3; C01 costs 9 * 50
    assert u[1] == (3, 3.0)


def test_cost_reduction_and_rebalance(star):
    cr = optimization.cost_reduction(star, CostConfig()).first()
    assert cr.historical_total_cost == 36.0
    assert cr.potential_savings == cr.historical_total_cost - cr.optimal_total_cost
    rr = optimization.route_rebalance(star, CostConfig())
    assert rr.where(F.col("change_in_orders") > 0).count() == 0


def test_lower_cost_routes_positive(star):
    lc = inefficiency.lower_cost_routes(star, CostConfig())
    assert lc.count() > 0
    assert lc.where(F.col("potential_savings") <= 0).count() == 0


def test_capacity_labels(spark):
    from haulage.plans.inefficiency import utilization_label
    df = spark.createDataFrame([(8, 10), (9, 10), (10, 10), (11, 10)], "n int, cap int")
    got = [r[0] for r in df.select(utilization_label(F.col("n"), F.col("cap"))).collect()]
    assert got == ["Capacity larger than production", "Near capacity", "Near capacity",
                   "Over capacity"]


def test_product_fan_out(spark):
    from haulage.session import scratch_path
    st = edge_staging(spark, orders=[_line(7, "C02", 1, "10", product=300)])
    st = st.__class__(**{**st.tables(), "products_per_plant": spark.createDataFrame(
        [("PLANT01", 300), ("PLANT02", 300)], "plant_code string, product_id long")})
    s = build_star(clean(st), scratch_path(spark, "fan"))
    assert s.fact_orders.count() == 2             # one line per product key (as written)
    d = build_star(clean(st), scratch_path(spark, "fan-dedup"), dedup_product=True)
    assert d.fact_orders.count() == 1


def test_empty_order_list(spark):
    from haulage.session import scratch_path
    s = build_star(clean(edge_staging(spark, orders=[])), scratch_path(spark, "empty"))
    tot = evaluation.total_historical_cost(s, CostConfig()).first()
    assert tot.total_logistics_cost is None
    avg = evaluation.avg_cost_per_order_unit(s, CostConfig()).first()
    assert avg.avg_cost_per_order is None and avg.avg_cost_per_unit is None


def test_zero_freight_carrier_by_code(star):
    from haulage.config import zero_freight_by_code
    cfg = zero_freight_by_code(CostConfig(), star.dim_carrier, "C02")
    assert cfg.zero_freight_carrier_key == 2
    t = _by_order(evaluation.historical_costs(star, cfg), "transport_cost")
    assert t[1] == 0                              # C02 is now the free carrier
    assert t[5] == D("90")                        # C01 pays: max(10 * 9.0, 1)


def test_dirty_inputs_are_counted_not_hidden(spark):
    from haulage.operators import quality
    from haulage.session import scratch_path
    dup = _line(8, "C02", 3, "10")
    orders = [dup, dup, _line(9, None, 1, "10"), _line(10, "C02", 1, "10", plant="PLANT09")]
    st = edge_staging(spark, orders=orders)
    st = st.__class__(**{**st.tables(), "wh_costs": spark.createDataFrame(
        [("PLANT01", D("1.0")), ("PLANT01", D("1.5")), ("PLANT02", D("2.0"))],
        "plant_code string, cost_per_unit decimal(12,4)")})
    c = clean(st)
    s = build_star(c, scratch_path(spark, "dirty"))
    # identical lines both kept and summed; NULL carrier and unknown plant drop out of the fact;
    # the duplicated plant cost fans out the plant dimension as an inner join does
    assert s.dim_plant.where("plant_code = 'PLANT01'").count() == 2
    dq = {r.rule: r.n_bad for r in quality.dq_orphans(c, s.dim_plant).collect()}
    assert dq["order_missing_carrier"] == 1
    assert dq["order_plant_without_capacity_or_cost"] == 1
    dd = {r.rule: r.n_bad for r in quality.dq_duplicates(c).collect()}
    assert dd["wh_costs_duplicate_plant"] == 1 and dd["order_list_identical_lines"] == 1
    # the two PLANT01 rows are two plant keys, hence two shipments of 2 lines x 3 units
    ships = s.shipments.where("order_id = 8").collect()
    assert sorted((r.plant_id, r.unit_quantity) for r in ships) == [(1, 6), (2, 6)]


@pytest.mark.parametrize("grain", ["order", "shipment"])
def test_cost_questions_read_the_stored_cube(star, grain):
    cfg = CostConfig(grain=grain)
    rows = evaluation.historical_costs(star, cfg)
    cells = {tuple(r[:4]): tuple(r[4:]) for r in star.cost_cube(cfg).collect()}
    assert cells == {tuple(r[:4]): tuple(r[4:]) for r in rows.groupBy(
        "plant_id", "carrier_id", "origin_port_id", "destination_port_id").agg(
        F.sum("transport_cost"), F.sum("warehouse_cost"), F.sum("total_order_cost"), F.sum("unit_quantity"),
        F.countDistinct("order_id")).collect()}
    assert star.cost_cube(cfg) is star.cost_cube(CostConfig(grain=grain))
    questions = [evaluation.total_historical_cost, evaluation.cost_by_plant_route, evaluation.cost_by_carrier,
                 inefficiency.highest_cost_routes, inefficiency.carrier_cost_by_route]
    for question in questions + ([evaluation.avg_cost_per_order_unit] if grain == "order" else []):
        plan = question(star, cfg)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") == 1 and "Join" not in plan, question.__name__
    # orders with several shipments count once in either grain
    avg = evaluation.avg_cost_per_order_unit(star, cfg).first()["avg_cost_per_order"]
    total, orders = rows.agg(F.sum("total_order_cost").cast("double"), F.countDistinct("order_id")).first()
    assert avg == round(total / orders, 2)


def _odd_staging(spark):
    """Lines without date, customer, order, service or amounts, products with several keys, a plant listed twice."""
    def but(line, at, value):
        return (*line[:at], value, *line[at + 1:])
    line = _line(20, "C02", 3, "10", product=300)
    orders = [line, line, but(line, 1, None), but(line, 8, None), but(line, 0, None), but(line, 5, None),
              but(line, 12, None), but(line, 13, None), _line(20, "C02", 2, "1", service="SL_N"),
              _line(20, "C03", 7, "9.5"), _line(21, "C02", 1, "10", product=999), _line(22, "C01", 4, "40", product=300),
              _line(23, "C02", 2_000_000_000, "0.0001", product=300)]
    st = edge_staging(spark, orders=orders)
    return clean(st.__class__(**{
        **st.tables(),
        "products_per_plant": spark.createDataFrame(
            [("PLANT01", 300), ("PLANT02", 300), (None, 300), ("PLANT01", 100), ("PLANT01", None)], "plant_code string, product_id long"),
        "wh_costs": spark.createDataFrame(
            [("PLANT01", D("1.0")), ("PLANT01", D("1.5")), ("PLANT02", None)], "plant_code string, cost_per_unit decimal(12,4)")}))


@pytest.mark.parametrize("dedup", [False, True])
def test_rollup_needs_no_numbered_order_lines(spark, dedup):
    from haulage.session import scratch_path
    star = build_star(_odd_staging(spark), scratch_path(spark, "later"), dedup_product=dedup)
    for grain in ("order", "shipment"):
        for question in (evaluation.cost_by_plant_route, evaluation.avg_cost_per_order_unit):
            question(star, CostConfig(grain=grain)).collect()
    assert "fact_orders" not in vars(star)        # nothing numbered or wrote the order lines
    want = costmodel.shipments(star.fact_orders)
    assert star.shipments.dtypes == want.dtypes
    rows = sorted(map(repr, want.collect()))
    assert rows and sorted(map(repr, star.shipments.collect())) == rows
    assert star.fact_orders is star.fact_orders and star.tables()["fact_orders"] is star.fact_orders
    with pytest.raises(AttributeError):
        star.no_such_table


@pytest.mark.parametrize("dedup", [False, True])
def test_lines_per_day_need_no_numbered_order_lines(spark, dedup):
    from haulage.plans import extensions
    from haulage.session import scratch_path
    star = build_star(_odd_staging(spark), scratch_path(spark, "days"), dedup_product=dedup)
    found = sorted(map(repr, extensions.capacity_by_day(star, CostConfig()).collect()))
    assert not {"fact_orders", "shipments"} & set(vars(star))
    # the same of the numbered lines
    star.fact_orders
    assert found and sorted(map(repr, extensions.capacity_by_day(star, CostConfig()).collect())) == found


@pytest.mark.parametrize("grain", ["order", "shipment"])
def test_cost_cube_shuffles_the_rollup_once(spark, grain):
    from haulage.session import scratch_path
    cfg = CostConfig(grain=grain)
    star = build_star(_odd_staging(spark), scratch_path(spark, "once"))
    # a plant key with two rows, as a key registry gives to a plant listed twice
    plants = star.dim_plant.unionByName(star.dim_plant.withColumn("cost_per_unit", F.col("cost_per_unit") + 1))
    cube = costmodel.cost_cube(star.shipments, star.fact_freight_rates, plants, cfg)
    found = sorted(map(repr, map(tuple, cube.collect())))
    want = costmodel.order_costs(star.shipments, star.fact_freight_rates, plants, cfg).groupBy(*costmodel.CUBE_KEYS).agg(
        F.sum("transport_cost"), F.sum("warehouse_cost"), F.sum("total_order_cost"), F.sum("unit_quantity"),
        F.countDistinct("order_id"))
    assert [t for _, t in cube.dtypes] == [t for _, t in want.dtypes]
    assert found and found == sorted(map(repr, map(tuple, want.collect())))
    final = cube._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    by_order = [line for line in final.splitlines() if "Exchange hashpartitioning(" in line and "order_id" in line]
    assert len(by_order) == 1, by_order


def test_customers_meet_orders_and_not_lines(spark):
    from conftest import SF_SMALL
    from haulage.sources.testdata import ParquetTables, order_list
    plan = order_list(ParquetTables(spark, SF_SMALL))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert [i for i, j in enumerate(joins) if "l_orderkey" in j] < [i for i, j in enumerate(joins) if "o_custkey" in j]

"""Keys that stay put between loads."""

from dataclasses import replace

from pyspark.sql import functions as F

from haulage.functions.key_registry import KeyRegistry
from haulage.functions.keys import nulls_last
from haulage.operators.clean import clean
from haulage.plans.star import build_star
from haulage.session import scratch_path
from tests.fixtures import edge_staging


def _number(registry, spark, rows):
    df = spark.createDataFrame(rows, "code string, n int")
    return {(r.code, r.n): r.key for r in registry.number(df, "key", nulls_last("code", "n"), ["code"]).collect()}


def test_no_old_key_moves(spark):
    registry = KeyRegistry(spark, scratch_path(spark, "keys"))
    assert registry.known("key") is None
    first = _number(registry, spark, [("b", 1), ("d", 1), (None, 1), ("d", 2)])
    assert first == {("b", 1): 1, ("d", 1): 2, ("d", 2): 2, (None, 1): 3}
    second = _number(registry, spark, [("a", 1), ("c", 1), ("d", 5), (None, 2)])
    assert second == {("a", 1): 4, ("c", 1): 5, ("d", 5): 2, (None, 2): 3}
    assert _number(registry, spark, []) == {}
    assert _number(registry, spark, [("c", 9)]) == {("c", 9): 5}
    known = sorted(tuple(r) for r in registry.known("key").select("key", "code").collect())
    assert known == [(1, "b"), (2, "d"), (3, None), (4, "a"), (5, "c")]


def test_first_load_may_be_empty(spark):
    registry = KeyRegistry(spark, scratch_path(spark, "keys"))
    assert _number(registry, spark, []) == {}
    assert _number(registry, spark, [("x", 1), ("w", 1)]) == {("w", 1): 1, ("x", 1): 2}


def test_two_loads_of_a_model(spark):
    c = clean(edge_staging(spark))
    codes = [o.order_id for o in c.order_list.select("order_id").distinct().collect()]
    half = replace(c, order_list=c.order_list.where(c.order_list.order_id.isin(codes[::2])))
    registry = KeyRegistry(spark, scratch_path(spark, "keys"))
    natural = {"dim_plant": ["plant_code"], "dim_port": ["port"], "dim_carrier": ["carrier_id"], "dim_customer": ["customer_id"],
               "dim_date": ["full_date"]}

    def keys(star):
        return {n: {tuple(r[1:]): r[0] for r in star.tables()[n].select(n.replace("dim_", "") + "_key", *k).collect()} for n, k in natural.items()}

    before = keys(build_star(half, scratch_path(spark, "a"), keys=registry))
    star = build_star(c, scratch_path(spark, "b"), keys=registry)
    after = keys(star)
    for name in natural:
        assert before[name].items() <= after[name].items()
        assert sorted(after[name].values()) == list(range(1, len(after[name]) + 1))
    # the same orders as in a model with keys of its own
    plain = build_star(c, scratch_path(spark, "c"))

    def lines(s):
        customers = s.dim_customer.select("customer_key", s.dim_customer.customer_id.alias("customer"))
        found = s.fact_orders.join(customers, s.fact_orders.customer_id == customers.customer_key)
        return sorted(map(repr, found.select("order_id", "customer", "weight").collect()))

    assert lines(star) == lines(plain)


def test_a_dimension_is_read_once_for_its_keys(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(code):
        read.add(1)
        return code

    keys = KeyRegistry(spark, scratch_path(spark, "once"))
    for codes, expected in ((["a", "b", "c"], 3), (["b", "d"], 2)):
        rows = spark.createDataFrame([(c,) for c in codes], "code string").select(noted("code").alias("code"))
        found = keys.number(rows, "k", nulls_last("code"), ["code"]).collect()
        assert len(found) == expected
    assert read.value == 5
    assert {(r.code, r.k) for r in keys.known("k").collect()} == {("a", 1), ("b", 2), ("c", 3), ("d", 4)}

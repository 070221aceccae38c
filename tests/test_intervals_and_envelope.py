"""Band lookup by dyadic cells and the lower envelopes of lanes."""

import random
from dataclasses import replace
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from haulage.config import CostConfig
from haulage.functions.intervals import levels_for, lookup
from haulage.operators import costmodel
from haulage.operators.envelope import envelope, lane_envelopes, pieces
from haulage.plans.optimization import optimal_assignment, optimal_choices
from haulage.plans.star import star_for
from haulage.sources.schemas import STAGING  # noqa: F401  (the package must import alone)

TARIFFS = ("freight_rate_id bigint, carrier_key bigint, origin_port_key bigint, destination_port_key bigint, "
           "service_level string, min_weight decimal(12,4), max_weight decimal(12,4), rate decimal(12,4), minimum_cost decimal(12,4)")
SHIPS = ("order_id bigint, plant_id bigint, carrier_id bigint, origin_port_id bigint, destination_port_id bigint, "
         "service_level string, unit_quantity bigint, total_weight decimal(18,4)")


def tariff(i, lo, hi, carrier=2, lane=1, rate="1", least="1"):
    return (i, carrier, lane, 1, "S", *(None if v is None else D(str(v)) for v in (lo, hi, rate, least)))


def ship(i, weight, carrier=2, lane=1):
    return (i, 1, carrier, lane, 1, "S", 1, None if weight is None else D(str(weight)))


def matches(ships, tariffs):
    return sorted((s[0], t[0]) for s in ships for t in tariffs
                  if s[3] == t[2] and s[7] is not None and None not in t[5:7] and t[5] <= s[7] <= t[6])


def mixed(rng):
    """Bands of very unlike lengths, shared bounds, empty and open bands, and weights on their bounds."""
    tariffs = [tariff(i, lo, lo + rng.choice([0, 0.0001, 0.5, 1, 3]), lane=1) for i, lo in enumerate(rng.choices(range(2000), k=700))]
    tariffs += [tariff(1000 + i, rng.randint(0, 500), rng.randint(400, 99_999_999), lane=rng.randint(1, 3)) for i in range(30)]
    tariffs += [tariff(2000, 5, 4), tariff(2001, None, 5), tariff(2002, 5, None), tariff(2003, -50, -10)]
    weights = [rng.choice([rng.randint(0, 2100), rng.random() * 2000, 5, 0.0001, -20, 99_999_999]) for _ in range(400)]
    return tariffs, [ship(i, None if i == 7 else round(w, 4), lane=rng.randint(1, 4)) for i, w in enumerate(weights)]


def test_lookup_equals_brute_force(spark):
    tariffs, ships = mixed(random.Random(3))
    bands = costmodel._tariffs(spark.createDataFrame(tariffs, TARIFFS))
    rows = spark.createDataFrame(ships, SHIPS)
    levels = levels_for(bands, ["origin_port_key", "destination_port_key", "_service"], *costmodel.BAND)
    assert len(levels) > 1
    want = matches(ships, tariffs)
    inner = lookup(rows, bands, levels, costmodel.LANE, "total_weight", *costmodel.BAND)
    assert sorted((r["order_id"], r["freight_rate_id"]) for r in inner.collect()) == want
    outer = lookup(rows, bands, levels, costmodel.LANE, "total_weight", *costmodel.BAND, row_keys=costmodel.SHIPMENT_KEYS)
    assert sorted((r["order_id"], r["freight_rate_id"] or -1) for r in outer.collect()) == sorted(
        want + [(s[0], -1) for s in ships if s[0] not in {a for a, _ in want}])
    # one level for all is right as well
    one = lookup(rows, bands, [(0, 9)], costmodel.LANE, "total_weight", *costmodel.BAND, row_keys=costmodel.SHIPMENT_KEYS)
    assert sorted(r["order_id"] for r in one.collect()) == sorted(r["order_id"] for r in outer.collect())


def test_ten_thousand_bands_on_one_lane_without_broadcast(spark):
    """The cell is part of the hash keys, and a shipment meets a few bands of its lane, not all."""
    tariffs = [tariff(i, 10 * i, 10 * i + 9.9999) for i in range(10_000)]
    ships = [ship(i, (37 * i) % 100_500 + 0.5) for i in range(5_000)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = costmodel.rated_shipments(spark.createDataFrame(ships, SHIPS), spark.createDataFrame(tariffs, TARIFFS))
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r["order_id"], r["freight_rate_id"]) for r in rows if r["freight_rate_id"] is not None) == matches(ships, tariffs)
    assert len(rows) == len(ships)
    exchanges = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert any("_cell" in x for x in exchanges) and any("_at" in x for x in exchanges)


def charge(t, w, guarded):
    lo, hi, rate, least = t[5:]
    if guarded and (t[1] == 1 or rate is None):
        return D(0)
    return max(least or D(0), D("-Infinity") if rate is None else rate * w)


@pytest.mark.parametrize("guarded", [True, False])
def test_envelope_is_the_cheapest_tariff_at_every_weight(spark, guarded):
    rng = random.Random(11)
    tariffs = []
    for i in range(60):
        lo = rng.randint(0, 40)
        tariffs.append(tariff(i, lo, lo + rng.randint(-1, 30) / 2, rng.randint(1, 4), rng.randint(1, 3),
                              rng.choice([None, 0, 0.5, 1, 1.2345, 7, -0.5]), rng.choice([None, 0, 1, 10, 30.0001])))
    tariffs += [tariff(90, None, 5), tariff(91, 5, None)]
    found = lane_envelopes(spark.createDataFrame(tariffs, TARIFFS), 1, guarded).collect()
    for lane in (1, 2, 3):
        mine = [t for t in tariffs if t[2] == lane and None not in t[5:7]]
        edges = {x + d for t in mine for x in t[5:7] for d in (D(0), D("0.0001"), D("-0.0001"))} | {D(k) / 7 for k in range(500)}
        for w in sorted(e.quantize(D("0.0001")) for e in edges):
            here = [r for r in found if r["origin_port_key"] == lane and r["from_weight"] <= w <= r["to_weight"]]
            best = min(((charge(t, w, guarded), t[1], t[0]) for t in mine if t[5] <= w <= t[6]), default=None)
            assert [(r["carrier_key"], r["freight_rate_id"]) for r in here] == ([best[1:]] if best else [])


def test_many_tariffs_of_a_lane_are_computed_in_parts(spark, monkeypatch):
    monkeypatch.setattr("haulage.operators.envelope.PART", 7)
    tariffs = spark.createDataFrame([tariff(i, 0, 100, i % 5 + 2, 1, 1 + i / 10, 100 - i) for i in range(80)], TARIFFS)
    in_parts = lane_envelopes(tariffs, 1, True)
    monkeypatch.undo()
    key = ["from_weight", "carrier_key", "freight_rate_id"]
    assert in_parts.select(*key).orderBy("from_weight").collect() == lane_envelopes(tariffs, 1, True).select(*key).orderBy("from_weight").collect()


def test_envelope_edges():
    assert envelope([]) == [] and pieces(5, 4, 1, 1, (1, 1), False, ()) == []
    assert lane_of(envelope([pieces(0, 9, 10_000, 5, (2, 1), False, ()), pieces(0, 9, 10_000, 5, (2, 0), False, ())])) == [(0, 9, (2, 0))]


def lane_of(found):
    out = []
    for p in found:
        if out and out[-1][2] == p[4]:
            out[-1] = (out[-1][0], p[1], p[4])
        else:
            out.append((p[0], p[1], p[4]))
    return out


def test_optimal_choice_needs_no_option_rows(spark):
    star = star_for(spark, SF_SMALL)
    best = optimal_choices(star, CostConfig(grain="shipment"))
    assert best.groupBy(*costmodel.OPTION_SHIPMENT_KEYS).count().where("count > 1").isEmpty()
    assert "Window" not in best._jdf.queryExecution().executedPlan().toString()


def test_plants_without_a_cost_rank_by_carrier(spark):
    """Their totals are NULL, so the first carrier is chosen whatever it charges: as by option rows."""
    star = star_for(spark, SF_SMALL)
    odd = replace(star, dim_plant=star.dim_plant.withColumn("cost_per_unit", F.when(F.col("plant_key") % 2 == 0, F.col("cost_per_unit"))))
    cfg = CostConfig(grain="shipment")
    got = optimal_choices(odd, cfg)
    options = costmodel.carrier_options(odd.shipments, odd.fact_freight_rates, odd.dim_plant, cfg)
    want = costmodel.cheapest_option(options, cfg).select(*got.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_empty_tariffs_and_shipments(spark):
    star = star_for(spark, SF_SMALL)
    bare = replace(star, fact_freight_rates=star.fact_freight_rates.where("false"))
    assert optimal_assignment(bare, CostConfig()).isEmpty()
    assert costmodel.rated_shipments(star.shipments, bare.fact_freight_rates).where("freight_rate_id IS NOT NULL").isEmpty()
    assert costmodel.rated_shipments(star.shipments.where("false"), star.fact_freight_rates).isEmpty()

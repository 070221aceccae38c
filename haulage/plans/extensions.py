"""Questions the project promises without shipping SQL for them.

* usage_frequency        - most used plants, routes and carriers
* avg_transport_days     - average transportation time per route (orders and tariffs)
* capacity_by_day        - plant load per calendar day (the per-day reading of capacity)
* delivery_performance   - late / early share per carrier and route
* feasible_options       - re-sourcing a shipment to any plant that stocks all its
                           products, reaches a port and may serve its customer
* feasible_assignment    - the cheapest feasible option per shipment
* utilization_shift      - plant load (order lines) before and after the feasible assignment
* capacity_assignment    - greedy assignment of shipments to feasible options within
                           plant capacity (a heuristic, run until nothing is left to try)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulage.config import CostConfig
from haulage.functions.ordering import asc, first_by, order_sql
from haulage.functions.intervals import lookup
from haulage.functions.keys import nulls_last, scalable_running_sum
from haulage.functions.pricing import WEIGHT_TYPE, freight_charge_sql, money
from haulage.operators.costmodel import BAND, SHIPMENT_KEYS, tariff_levels
from haulage.operators.facts import lines_per_day, shipment_lines
from haulage.plans.inefficiency import utilization_label
from haulage.plans.star import Star
from haulage.session import stored


def _ratio(num, den):
    return num.cast("double") / F.nullif(den, F.lit(0)).cast("double")


USAGE_KINDS = {"plant": ["plant_id"], "route": ["origin_port_id", "destination_port_id"], "carrier": ["carrier_id"]}


def usage_frequency(star: Star, cfg: CostConfig) -> DataFrame:
    """Shipments, orders and units per plant, per route and per carrier, ranked within kind.

    Shipments are first summed up per order and key, so orders need no distinct count and no
    row is copied per kind.
    """
    def kind(name: str, keys: list[str]) -> DataFrame:
        per_order = star.shipments.groupBy(*keys, "order_id").agg(
            F.count(F.lit(1)).alias("shipments"), F.sum("unit_quantity").alias("units"))
        found = per_order.groupBy(*keys).agg(F.sum("shipments").alias("shipments"), F.count(F.lit(1)).alias("orders"),
                                             F.sum("units").alias("units"))
        every = [k for ks in USAGE_KINDS.values() for k in ks]
        return found.select(F.lit(name).alias("usage_kind"),
                            *[(F.col(k) if k in keys else F.lit(None).cast("long")).alias(k) for k in every],
                            "shipments", "orders", "units")

    g = reduce(DataFrame.unionByName, [kind(n, k) for n, k in USAGE_KINDS.items()])
    w = Window.partitionBy("usage_kind").orderBy(F.col("shipments").desc())
    return g.select("*", F.rank().over(w).cast("long").alias("usage_rank"))


def avg_transport_days(star: Star, cfg: CostConfig) -> DataFrame:
    """Average days per route: as booked on order lines, and as quoted by tariffs."""
    lanes = star.fact_orders.groupBy("origin_port_id", "destination_port_id").agg(
        F.count(F.lit(1)).alias("order_lines"),
        _ratio(F.sum("transport_mode"), F.count("transport_mode")).alias("avg_order_days"))
    quoted = star.fact_freight_rates.groupBy(
        F.col("origin_port_key").alias("origin_port_id"),
        F.col("destination_port_key").alias("destination_port_id")).agg(
        F.count(F.lit(1)).alias("tariffs"),
        _ratio(F.sum("transport_days"), F.count("transport_days")).alias("avg_tariff_days"))
    return lanes.join(quoted, ["origin_port_id", "destination_port_id"], "left").select(
        "origin_port_id", "destination_port_id", "order_lines", "avg_order_days",
        F.coalesce("tariffs", F.lit(0)).alias("tariffs"), "avg_tariff_days")


def _lines_per_day(star: Star) -> DataFrame:
    """(plant_id, full_date, lines): no line's number is needed for it."""
    if star.lines_unnumbered():
        return lines_per_day(star.clean.order_list, star.dim_plant, star.dim_product)
    dates = star.dim_date.select(F.col("date_key").alias("date_id"), "full_date")
    return star.fact_orders.groupBy("plant_id", "date_id").agg(F.count(F.lit(1)).alias("lines")).join(dates, "date_id")


def capacity_by_day(star: Star, cfg: CostConfig) -> DataFrame:
    """Order lines per plant and calendar day against the daily capacity."""
    plants = star.dim_plant.select(F.col("plant_key").alias("plant_id"), "plant_code",
                                   "daily_capacity")
    j = _lines_per_day(star).withColumnRenamed("lines", "daily_orders").join(plants, "plant_id")
    return j.select("plant_code", "full_date", "daily_capacity", "daily_orders",
                    utilization_label(F.col("daily_orders"), F.col("daily_capacity"))
                    .alias("Interpretation"))


def delivery_performance(star: Star, cfg: CostConfig) -> DataFrame:
    """Share of late and early order lines and average lateness per carrier and route."""
    late = F.col("ship_late_days") > 0
    early = F.col("ship_ahead_days") > 0
    g = star.fact_orders.groupBy("carrier_id", "origin_port_id", "destination_port_id").agg(
        F.count(F.lit(1)).alias("order_lines"),
        F.count(F.when(late, F.lit(1))).alias("late_lines"),
        F.count(F.when(early, F.lit(1))).alias("early_lines"),
        F.sum("ship_late_days").alias("_late_days"))
    return g.select("carrier_id", "origin_port_id", "destination_port_id", "order_lines",
                    "late_lines", "early_lines",
                    _ratio(F.col("late_lines"), F.col("order_lines")).alias("late_share"),
                    _ratio(F.col("early_lines"), F.col("order_lines")).alias("early_share"),
                    _ratio(F.col("_late_days"), F.col("order_lines")).alias("avg_late_days"))


# ---------------------------------------------------------------- feasible re-sourcing

WORD = 62  # plants per bitset word
#: Customers with a list of plants up to which these go to every task.
LISTED = 500_000


def _plant_bits(word: int) -> str:
    """The plants of a group's rows, as bits of one word."""
    return (f"coalesce(bit_or(CASE WHEN CAST((plant_key - 1) DIV {WORD} AS INT) = {word} "
            f"THEN shiftleft(1L, CAST((plant_key - 1) % {WORD} AS INT)) END), 0L)")


def _bitsets(bridge: DataFrame, key: str, words: int) -> DataFrame:
    """One row per ``key`` with the plants of ``bridge`` as bits of ``words`` columns."""
    return bridge.groupBy(key).agg(*[F.expr(f"{_plant_bits(w)} AS _{key}_{w}") for w in range(words)])


def candidate_plants(star: Star, every: bool = False) -> DataFrame:
    """(shipment, candidate plant) pairs with the shipment's lines, units, weight and its lines' first and last
    day: the plant stocks every product of the shipment, and a VMI plant serves it only if it lists every one of
    the shipment's customers.  ``every``: shipments without a candidate stay, with NULL.

    Plants are bits: a product has the plants that stock it, a customer those that may serve it
    (all but the VMI plants that do not list it).  One aggregate over the order lines takes the
    intersection of all of them, and its bits are the candidates: no line is joined with a plant.
    Lines that were not numbered yet are read from the clean order list, by their codes.
    """
    # bounded by the number of plants: a number of words, and a mask of each
    top = star.dim_plant.agg(F.max("plant_key")).first()[0] or 1
    words = -(-top // WORD)
    masks = star.bridge_plant_customer.agg(*[F.expr(_plant_bits(w)) for w in range(words)]).first()
    stock = _bitsets(star.bridge_plant_product, "product_key", words)
    listed = _bitsets(star.bridge_plant_customer, "customer_key", words)
    product_bits = [f"coalesce(_product_key_{w}, 0L)" for w in range(words)]
    if star.lines_unnumbered():
        # a product's keys in one row
        products = star.dim_product.join(stock, "product_key", "left").groupBy("product_id").agg(
            F.count(F.lit(1)).cast("int").alias("product_keys"),
            *[F.expr(f"bit_and({bits}) AS _product_key_{w}") for w, bits in enumerate(product_bits)])
        lines = shipment_lines(star.clean.order_list, star.dim_plant, products, star.dim_carrier, star.dim_port)
        listed = listed.join(star.dim_customer.select("customer_key", F.col("customer_id").alias("_code")), "customer_key")
        if star.bridge_plant_customer.select("customer_key").distinct().count() <= LISTED:
            listed = F.broadcast(listed)  # the lines would be shuffled for a few of the customers
        lines = lines.withColumnRenamed("order_date", "_day").join(listed, F.expr("customer = _code"), "left")
    else:
        lines = (star.fact_orders.select(*SHIPMENT_KEYS, "product_id", "customer_id", "unit_quantity", "weight",
                                         F.col("date_id").alias("_day"), F.lit(1).alias("product_keys"))
                 .join(stock, F.expr("product_id = product_key"), "left").join(listed, F.expr("customer_id = customer_key"), "left"))
    full = (1 << WORD) - 1
    both = [f"bit_and({product_bits[w]} & (coalesce(_customer_key_{w}, 0L) | {full & ~masks[w]}L)) AS _bits_{w}"
            for w in range(words)]
    needs = lines.groupBy(*SHIPMENT_KEYS).agg(
        F.sum("product_keys").alias("lines"), F.expr("sum(CAST(unit_quantity AS BIGINT) * product_keys) AS unit_quantity"),
        F.expr(f"CAST(sum(unit_quantity * weight * product_keys) AS {WEIGHT_TYPE}) AS total_weight"),
        F.min("_day").alias("first_day"), F.max("_day").alias("last_day"), *map(F.expr, both))
    plants = ", ".join(f"filter(sequence({w * WORD + 1}L, {min(top, (w + 1) * WORD)}L), "
                       f"k -> shiftright(_bits_{w}, CAST(k - {w * WORD + 1} AS INT)) & 1L = 1L)" for w in range(words))
    explode = "explode_outer" if every else "explode"
    asked = needs if every else needs.where(" OR ".join(f"_bits_{w} <> 0L" for w in range(words)))
    return asked.selectExpr(*SHIPMENT_KEYS, f"{explode}(concat({plants})) AS candidate_plant", "lines", "unit_quantity",
                            "total_weight", "first_day", "last_day")


def priced_options(star: Star, cfg: CostConfig, cheapest: bool = False, every: bool = False) -> DataFrame:
    """Every feasible (plant, origin port, carrier tariff) for every shipment, priced, with ``lines`` and days.

    ``cheapest``: of every (shipment, plant, origin port) the cheapest tariff alone, read off the
    lanes' lower envelopes; for callers that rank options by cost.
    ``every``: rows without a tariff stay, with NULL, so that every shipment is there.
    """
    how = "left" if every else "inner"
    ports = star.bridge_plant_port.select(F.col("plant_key").alias("candidate_plant"),
                                          F.col("port_key").alias("candidate_origin_port"))
    c = candidate_plants(star, every).join(ports, "candidate_plant", how)
    # a plant without a cost ranks its options by carrier, not by charge
    if cheapest and star.plants_priced():
        tariffs, levels = star.envelopes(cfg, guarded=True)
        band = ("from_weight", "to_weight")
    else:
        tariffs, levels, band = star.fact_freight_rates, tariff_levels(star.fact_freight_rates), BAND
    f = tariffs.select("freight_rate_id", "carrier_key", F.col("origin_port_key").alias("_o"),
                       F.col("destination_port_key").alias("_d"), F.col("service_level").alias("_s"),
                       *band, "rate", "minimum_cost")
    priced = lookup(c, f, levels, [("candidate_origin_port", "_o"), ("destination_port_id", "_d"), ("service_level", "_s")],
                    "total_weight", *band, row_keys=[*SHIPMENT_KEYS, "candidate_plant", "candidate_origin_port"] if every else None)
    plants = star.dim_plant.select(F.col("plant_key").alias("candidate_plant"), "cost_per_unit")
    transport = freight_charge_sql("total_weight", "rate", "minimum_cost", "carrier_key",
                                   cfg.zero_freight_carrier_key, guarded=True)
    return (priced.join(plants, "candidate_plant", how)
            .selectExpr(*SHIPMENT_KEYS, "candidate_plant", "candidate_origin_port",
                        "carrier_key AS candidate_carrier", "freight_rate_id", "lines", "first_day", "last_day", "unit_quantity",
                        "total_weight", f"{transport} AS transport_cost",
                        "unit_quantity * cost_per_unit AS warehouse_cost")
            .selectExpr("*", "transport_cost + warehouse_cost AS total_cost"))


def feasible_options(star: Star, cfg: CostConfig) -> DataFrame:
    return priced_options(star, cfg).drop("lines", "first_day", "last_day")


FEASIBLE_ORDER = [asc("total_cost"), asc("candidate_plant"), asc("candidate_origin_port"),
                  asc("candidate_carrier"), asc("freight_rate_id")]


def _cheapest(opts: DataFrame) -> DataFrame:
    return first_by(opts, SHIPMENT_KEYS, FEASIBLE_ORDER, [c for c in opts.columns if c not in SHIPMENT_KEYS])


def feasible_assignment(star: Star, cfg: CostConfig) -> DataFrame:
    """Cheapest feasible option per shipment (capacity not considered)."""
    return _cheapest(priced_options(star, cfg, cheapest=True).drop("lines", "first_day", "last_day"))


def utilization_shift(star: Star, cfg: CostConfig) -> DataFrame:
    """Order lines per plant before and after the feasible assignment, against capacity: the unit of
    the capacity questions, so "before" is their ``daily_orders``."""
    before = _lines_per_day(star).groupBy(F.col("plant_id").alias("plant_key")).agg(
        F.sum("lines").alias("historical_lines"))
    after = _cheapest(priced_options(star, cfg, cheapest=True).drop("first_day", "last_day")).groupBy(
        F.col("candidate_plant").alias("plant_key")).agg(F.sum("lines").alias("assigned_lines"))
    plants = star.dim_plant.select("plant_key", "plant_code", "daily_capacity")
    j = plants.join(before, "plant_key", "left").join(after, "plant_key", "left")
    h = F.coalesce("historical_lines", F.lit(0))
    a = F.coalesce("assigned_lines", F.lit(0))
    return j.select("plant_key", "plant_code", "daily_capacity", h.alias("historical_lines"),
                    a.alias("assigned_lines"),
                    _ratio(h, F.col("daily_capacity")).alias("historical_utilization"),
                    _ratio(a, F.col("daily_capacity")).alias("assigned_utilization"),
                    (a - h).alias("change_in_lines"))


# ---------------------------------------------------------------- capacity-limited assignment

OPTION = ["total_cost", "candidate_plant", "candidate_origin_port", "candidate_carrier", "freight_rate_id"]
SCOPE = ["_day", "candidate_plant"]
#: Cells per doubling of an amount, in the search for the last proposal that fits.
FINE = 256


def _shipment_options(star: Star, cfg: CostConfig, per_day: bool) -> DataFrame:
    """Every shipment once, with the best option at each of its plants in ``_options``, cheapest first, and the
    day whose capacity it takes (0: there is one capacity for all dates; NULL: it has no day of its own)."""
    keys, order = ", ".join(SHIPMENT_KEYS), order_sql(FEASIBLE_ORDER)
    rows = priced_options(star, cfg, cheapest=True, every=True).selectExpr(
        *SHIPMENT_KEYS, "unit_quantity", "lines", f"CASE WHEN first_day = last_day AND {KEYED} THEN first_day END AS _day" if per_day
        else "0 AS _day", *OPTION)
    found = rows.selectExpr(
        *SHIPMENT_KEYS, "unit_quantity", "lines", "_day",
        f"collect_list(CASE WHEN freight_rate_id IS NOT NULL THEN struct({', '.join(OPTION)}) END) OVER (PARTITION BY {keys} ORDER BY {order} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS _all",
        f"row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS _rn").where("_rn = 1")
    # a plant with several ports stands there once per port, the best one first
    return (found.withColumn("_plants", F.expr("array_distinct(transform(_all, o -> o.candidate_plant))"))
            .withColumn("_options", F.expr("CASE WHEN size(_plants) = size(_all) THEN _all ELSE "
                                           "transform(_plants, p -> filter(_all, o -> o.candidate_plant = p)[0]) END"))
            .drop("_all", "_plants", "_rn"))


#: A shipment whose keys are not all known is nobody's to find again: it takes room, but is not assigned.
KEYED = "(" + " AND ".join(f"{k} IS NOT NULL" for k in SHIPMENT_KEYS) + ")"


def _proposing(ships: DataFrame) -> DataFrame:
    """The shipments with their cheapest option at a plant with room for their lines (``_room`` by plant), the
    others that have room in ``_rest``, and ``_regret``: what the shipment loses at its next best plant (null:
    there is none)."""
    fits = ships.withColumn("_fits", F.expr("filter(_options, o -> lines <= get(_room, CAST(o.candidate_plant - 1 AS INT)))"))
    split = fits.selectExpr(*SHIPMENT_KEYS, "unit_quantity", "lines", "_day", "get(_fits, 0) AS _best", "slice(_fits, 2, size(_fits)) AS _rest")
    return split.selectExpr(*SHIPMENT_KEYS, "unit_quantity", "lines", "_day", *[f"_best.{c}" for c in OPTION], "_rest",
                            f"CASE WHEN {KEYED} THEN get(_rest, 0).total_cost - _best.total_cost END AS _regret")


def _rooms(capacity: DataFrame) -> DataFrame:
    """What is left of every day, as an array by plant key."""
    return capacity.groupBy("_day").agg(F.expr("transform(array_sort(collect_list(struct(candidate_plant, _left))), x -> x._left) AS _room"))


def _cell(amount: str) -> str:
    """A whole number that grows with ``amount``; near amounts share it."""
    return f"CAST(signum(CAST({amount} AS DOUBLE)) * floor(log2(1 + abs(CAST({amount} AS DOUBLE))) * {FINE}) AS BIGINT)"


# a plant takes proposals by regret (most first, none before all), cost and keys; cells and ranks grow with that
PROPOSAL_CELL = (f"CASE WHEN _regret IS NOT NULL THEN {1 << 31}L - {_cell('_regret')} "
                 f"WHEN total_cost IS NOT NULL THEN {_cell('total_cost')} ELSE {1 << 30}L END")
PROPOSAL_RANK = "struct({})".format(", ".join(
    f"{c} IS {'NOT ' if c == '_regret' else ''}NULL AS _{i}, {'-' if c == '_regret' else ''}{c} AS _v{i}"
    for i, c in enumerate(["_regret", "total_cost", *SHIPMENT_KEYS])))
ACCEPTED = "(_edge IS NULL OR _at < _edge OR (_at = _edge AND coalesce(_rank <= _last, false)))"


def _cuts(ships: DataFrame, totals: DataFrame) -> DataFrame:
    """Up to where each plant takes its proposals (``totals``: lines proposed, and ``_left``): all (``_edge``
    NULL), or those in cells before ``_edge`` and in it up to the rank ``_last``; with the lines ``_taken``.

    Lines are summed up by cell first, so that only the proposals of the one cell in which a plant fills up
    are put in order.
    """
    over = totals.where("_total > _left")
    asking = ships.select(*SCOPE, "lines", "_regret", "total_cost", *SHIPMENT_KEYS).withColumn("_at", F.expr(PROPOSAL_CELL))
    cells = asking.join(over, SCOPE).groupBy(*SCOPE, "_left", "_at").agg(F.sum("lines").alias("_lines"))
    up_to = cells.selectExpr("*", f"sum(_lines) OVER (PARTITION BY {', '.join(SCOPE)} ORDER BY _at) AS _up_to")
    # sums grow with the cell: the least of both is that of the first cell beyond
    edges = stored(up_to.where("_up_to > _left").groupBy(*SCOPE).agg(
        F.min("_at").alias("_edge"), F.min(F.expr("_up_to - _lines")).alias("_base")), "edges")
    edge = asking.join(edges, SCOPE).where("_at = _edge").drop("_at", "_edge")
    order = [F.col("_regret").desc_nulls_first(), *nulls_last("total_cost", *SHIPMENT_KEYS)]
    run = scalable_running_sum(edge, "_run", "lines", SCOPE, order).join(over.select(*SCOPE, "_left"), SCOPE)
    last = (run.where("_base + _run <= _left").withColumn("_rank", F.expr(PROPOSAL_RANK))
            .groupBy(*SCOPE).agg(F.max("_rank").alias("_last"), F.sum("lines").alias("_more")))
    return totals.join(edges, SCOPE, "left").join(last, SCOPE, "left").selectExpr(
        *SCOPE, "_edge", "_last", "CASE WHEN _edge IS NULL THEN _total ELSE _base + coalesce(_more, 0) END AS _taken")


def capacity_assignment(star: Star, cfg: CostConfig, per_day: bool = False) -> DataFrame:
    """Greedy, set-based assignment of shipments to feasible options under plant capacity.

    ``daily_capacity`` is the number of order lines a plant may take over the horizon (the reading
    and the unit of the capacity questions).  In a round every open shipment proposes its cheapest
    option at a plant that has room for its lines; each plant takes proposals in the order of
    regret (the loss at the next best plant, none first), then cost, as long as their running
    lines fit into what it has left.  The others ask again while the plant has room for them: the
    first proposal of a plant always fits, so every round fills plants up.  Rounds go on until no
    shipment has a plant to ask.  Shipments that end without a plant fit into no candidate plant
    and are returned with NULLs.  A heuristic: not claimed optimal.

    ``per_day=True`` gives every (plant, day) the full daily capacity.  A shipment whose lines have
    several dates has no day of its own and stays unassigned.

    A shipment is one row with its options in it, written when it proposes: once, and again with what is
    left of them whenever it was turned away.  Rounds shuffle sums and the proposals around the point where
    a plant fills up; no shipment is joined with its own rows.
    """
    # plants by key from 1, without a gap (bounded by the number of plants)
    keys = star.dim_plant.agg(F.expr("explode(sequence(1L, coalesce(max(plant_key), 1L))) AS candidate_plant"))
    plants = stored(keys.join(star.dim_plant.groupBy(F.col("plant_key").alias("candidate_plant")).agg(
        F.max("daily_capacity").cast("long").alias("_left")), "candidate_plant", "left"), "plants")
    options = _shipment_options(star, cfg, per_day)
    full = _rooms(plants.withColumn("_day", F.lit(0))).drop("_day")
    ships = stored(_proposing(options.crossJoin(F.broadcast(full)).withColumn(
        "_room", F.expr("CASE WHEN _day IS NOT NULL THEN _room END"))), "proposals")
    asked = ships.where("candidate_plant IS NOT NULL")
    capacity = stored(asked.select("_day").distinct().crossJoin(F.broadcast(plants)), "capacity")
    done, turn = [], 0
    while True:
        turn += 1
        totals = stored(ships.where("candidate_plant IS NOT NULL").groupBy(*SCOPE).agg(F.sum("lines").alias("_total"))
                        .join(capacity, SCOPE), "totals")
        plants_asked, over = totals.agg(F.count(F.lit(1)), F.count_if(F.col("_total") > F.col("_left"))).first()
        if not plants_asked:
            break
        cuts = stored(_cuts(ships, totals), "cuts") if over else totals.selectExpr(
            *SCOPE, "CAST(NULL AS BIGINT) AS _edge", "_total AS _taken").withColumn("_last", F.lit(None).cast(
                ships.select(F.expr(PROPOSAL_RANK)).schema[0].dataType))
        # a plant's room only shrinks: what does not fit now never will
        capacity = stored(capacity.join(cuts.select(*SCOPE, "_taken"), SCOPE, "left").select(
            *SCOPE, (F.col("_left") - F.coalesce("_taken", F.lit(0))).alias("_left")), "capacity")
        decided = (ships.withColumn("_at", F.expr(PROPOSAL_CELL)).withColumn("_rank", F.expr(PROPOSAL_RANK))
                   .join(cuts.drop("_taken"), SCOPE, "left").withColumn("_won", F.expr(f"{ACCEPTED} AND {KEYED}")))
        done.append(decided.where("_won OR candidate_plant IS NULL").withColumn("assignment_round", F.lit(turn)))
        turned_away = decided.where("NOT _won AND candidate_plant IS NOT NULL").withColumn(
            "_options", F.expr(f"concat(array(struct({', '.join(OPTION)})), _rest)"))
        ships = stored(_proposing(turned_away.join(_rooms(capacity), "_day", "left")), "proposals")
    done.append(ships.withColumn("assignment_round", F.lit(turn)))
    out = reduce(DataFrame.unionAll, [d.select(*SHIPMENT_KEYS, "unit_quantity", *OPTION, "assignment_round") for d in done])
    return out.select(*SHIPMENT_KEYS, "unit_quantity",
                      F.col("candidate_plant").alias("assigned_plant"),
                      F.col("candidate_origin_port").alias("assigned_origin_port"),
                      F.col("candidate_carrier").alias("assigned_carrier"), "freight_rate_id",
                      money(F.col("total_cost")).alias("total_cost"),
                      F.expr("CASE WHEN candidate_plant IS NOT NULL THEN CAST(assignment_round AS INT) END AS assignment_round"))

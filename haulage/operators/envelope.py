"""The cheapest tariff of every lane as a function of the weight: a lower envelope.

A tariff charges max(weight x rate, minimum) within its band: a flat piece and a line.  The
minimum over all tariffs of a lane is a sequence of such pieces with breakpoints where bands begin
and end and where two charges cross.  It is computed once per tariff table, in whole numbers
(weights in 1/10000, charges in 1/10^8), and a shipment's cheapest carrier is then one lookup by
weight instead of one row per carrier.  Equal charges go to the smaller carrier key, then the
smaller tariff id, as in the ranking of option rows.

Envelopes merge, so a lane with very many tariffs is computed in parts first.
"""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANE = ["origin_port_key", "destination_port_key", "service_level"]
#: Tariffs of a lane in one part.
PART = 4096
_SCHEMA = ("origin_port_key bigint, destination_port_key bigint, service_level string, from_weight decimal(12,4), "
           "to_weight decimal(12,4), carrier_key bigint, freight_rate_id bigint, rate decimal(12,4), minimum_cost decimal(12,4)")
_FIELDS = ["from_weight", "to_weight", "carrier_key", "freight_rate_id", "rate", "minimum_cost"]

# a piece: (from, to, slope, constant, (carrier, tariff), (rate, minimum) as given)
Piece = tuple[int, int, int, int, tuple[int, int], tuple]


def pieces(lo: int, hi: int, rate: int | None, minimum: int | None, key: tuple[int, int], free: bool, given: tuple) -> list[Piece]:
    """The charge of one tariff: the greater of a line through 0 and a constant, at most two pieces."""
    if lo > hi:
        return []
    least = (minimum or 0) * 10_000
    if free or rate is None:
        return [(lo, hi, 0, 0 if free else least, key, given)]
    if rate == 0:
        return [(lo, hi, 0, max(0, least), key, given)]
    line, flat = (rate, 0), (0, least)
    if rate > 0:  # the line is above from the first weight with weight x rate > least
        turn, before, after = least // rate + 1, flat, line
    else:  # and below from the first with weight x rate <= least
        turn, before, after = -(least // -rate), line, flat
    turn = min(max(turn, lo), hi + 1)
    return [(a, b, *f, key, given) for a, b, f in ((lo, turn - 1, before), (turn, hi, after)) if a <= b]


def _cheaper(a: Piece, b: Piece, lo: int, hi: int) -> list[Piece]:
    """Pieces of the minimum of two lines over [lo, hi]."""
    slope, constant, first = a[2] - b[2], b[3] - a[3], int(a[4] > b[4])
    cut = lambda p, x, y: [(x, y, *p[2:])] if x <= y else []
    # a wins where slope x weight <= constant, less one where b wins ties
    if slope == 0:
        return cut(a if constant - first >= 0 else b, lo, hi)
    if slope > 0:
        last = min(max((constant - first) // slope, lo - 1), hi)
        return cut(a, lo, last) + cut(b, last + 1, hi)
    begin = min(max(-((constant - first) // -slope), lo), hi + 1)
    return cut(b, lo, begin - 1) + cut(a, begin, hi)


def _joined(found: list[Piece]) -> list[Piece]:
    out: list[Piece] = []
    for p in found:
        if out and out[-1][1] + 1 == p[0] and out[-1][2:5] == p[2:5]:
            out[-1] = (out[-1][0], *p[1:])
        else:
            out.append(p)
    return out


def merge(left: list[Piece], right: list[Piece]) -> list[Piece]:
    """Pointwise minimum of two sequences of pieces, each sorted and free of overlaps."""
    out: list[Piece] = []
    i = j = 0
    at = None
    while i < len(left) or j < len(right):
        a, b = left[i] if i < len(left) else None, right[j] if j < len(right) else None
        begin = lambda p: p[0] if at is None else max(p[0], at)
        if a is None or b is None or a[1] < begin(b) or b[1] < begin(a):
            one = b if a is None or (b is not None and b[1] < begin(a)) else a
            out.append((begin(one), *one[1:]))
            at, i, j = one[1] + 1, i + (one is a), j + (one is not a)
            continue
        lo, hi = max(begin(a), begin(b)), min(a[1], b[1])
        for p in (a, b):
            if begin(p) < lo:
                out.append((begin(p), lo - 1, *p[2:]))
        out += _cheaper(a, b, lo, hi)
        at, i, j = hi + 1, i + (a[1] == hi), j + (b[1] == hi)
    return _joined(out)


def envelope(parts: list[list[Piece]]) -> list[Piece]:
    """Minimum of many sequences, merged two by two."""
    while len(parts) > 1:
        parts = [merge(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def _whole(value: Decimal | None) -> int | None:
    return None if value is None else int(value.scaleb(4))


def lane_envelopes(fact_freight_rates: DataFrame, zero_freight_carrier_key: int, guarded: bool) -> DataFrame:
    """(lane, from_weight, to_weight, carrier_key, freight_rate_id, rate, minimum_cost): for every weight with
    a tariff the cheapest one, with the tariff's own rate and minimum.  A tariff whose bounds or keys are
    NULL holds no weight; an empty table has no envelopes."""

    def row_pieces(table: pa.Table) -> list[list[Piece]]:
        rows = zip(*(table.column(c).to_pylist() for c in _FIELDS))
        return [pieces(_whole(lo), _whole(hi), _whole(rate), _whole(least), (carrier, tariff),
                       guarded and (carrier == zero_freight_carrier_key or rate is None), (rate, least))
                for lo, hi, carrier, tariff, rate, least in rows]

    def lowest(key: tuple, table: pa.Table) -> pa.Table:
        found = envelope(row_pieces(table))
        whole = pa.decimal128(12, 4)
        weight = lambda k: pa.array([Decimal(p[k]).scaleb(-4) for p in found], whole)
        columns = [weight(0), weight(1), pa.array([p[4][0] for p in found], pa.int64()), pa.array([p[4][1] for p in found], pa.int64()),
                   pa.array([p[5][0] for p in found], whole), pa.array([p[5][1] for p in found], whole)]
        lane = [pa.array([k.as_py()] * len(found), t) for k, t in zip(key, (pa.int64(), pa.int64(), pa.string()))]
        return pa.Table.from_arrays([*lane, *columns], names=[*LANE, *_FIELDS])

    tariffs = (fact_freight_rates.where("min_weight <= max_weight").dropna(subset=LANE)
               .selectExpr("CAST(origin_port_key AS BIGINT) AS origin_port_key", "CAST(destination_port_key AS BIGINT) AS destination_port_key",
                           "service_level", "min_weight AS from_weight", "max_weight AS to_weight", "CAST(carrier_key AS BIGINT) AS carrier_key",
                           "CAST(freight_rate_id AS BIGINT) AS freight_rate_id", "rate", "minimum_cost"))
    sizes = tariffs.groupBy(*LANE).agg(F.expr(f"CAST(ceil(count(1) / {PART}) AS INT) AS _parts"))
    parts = (tariffs.join(sizes, LANE).withColumn("_part", F.expr("pmod(xxhash64(freight_rate_id), _parts)"))
             .groupBy(*LANE, "_part").applyInArrow(lambda key, table: lowest(key[:3], table), _SCHEMA))
    # a piece of a part is a tariff with a shorter band: its charge is the same there
    return parts.groupBy(*LANE).applyInArrow(lowest, _SCHEMA)

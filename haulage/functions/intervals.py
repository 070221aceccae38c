"""Looking values up in bands by an equi-join: bands cut into dyadic cells.

A level is a power of two of whole units.  A band is listed under every cell of its level that it
meets (a few, since levels follow the bands' lengths), a value belongs to one cell per level, and
(lane, level, cell) is an ordinary join key: a lane with very many bands is many keys, in a hash
join as in a shuffle.  Cells only select candidates; the exact bounds are compared behind the join.

Most tables need one level.  A further level is opened where so many short bands lie within one
cell of the longest ones that they would be compared one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bands of a lane that may share a cell before shorter ones get a level of their own.
CROWD = 64
#: A level takes bands down to a 2^APART-th of its longest.
APART = 5


def _class(lo: str, hi: str) -> str:
    """Binary order of magnitude of a band's length in whole units (0: within one or two)."""
    return (f"CASE WHEN CAST({hi} AS BIGINT) > CAST({lo} AS BIGINT) "
            f"THEN CAST(floor(log2(CAST({hi} AS BIGINT) - CAST({lo} AS BIGINT))) AS INT) ELSE 0 END")


def levels_for(bands: DataFrame, lane: list[str], lo: str, hi: str) -> list[tuple[int, int]]:
    """[(least class, level)], longest bands first: a band goes to the first level whose least class it
    reaches.  A few small jobs over ``bands``; the driver sees two numbers of each."""
    left = bands.where(f"{lo} <= {hi}").selectExpr(*lane, f"{_class(lo, hi)} AS _class", f"CAST({lo} AS BIGINT) AS _lo")
    out: list[tuple[int, int]] = []
    while True:
        longest = left.agg(F.max("_class")).first()[0]
        if longest is None:
            return out or [(0, 0)]
        level = max(0, longest - 1)
        crowd = left.groupBy(*lane, F.expr(f"shiftright(_lo, {level})")).count().agg(F.max("count")).first()[0]
        least = level - APART + 1
        if crowd <= CROWD or least <= 0:
            return [*out, (0, level)]
        out.append((least, level))
        left = left.where(f"_class < {least}")


def in_cells(bands: DataFrame, levels: list[tuple[int, int]], lo: str, hi: str) -> DataFrame:
    """``bands`` with ``_level`` and ``_cell``, once for every cell that a band meets.  Bands without
    bounds, or with bounds the wrong way round, hold no value and go."""
    level = f"CASE {' '.join(f'WHEN {_class(lo, hi)} >= {least} THEN {at}' for least, at in levels)} END"
    return (bands.where(f"{lo} <= {hi}").selectExpr("*", f"{level} AS _level")
            .selectExpr("*", f"explode(sequence(shiftright(CAST({lo} AS BIGINT), _level), shiftright(CAST({hi} AS BIGINT), _level))) AS _cell"))


def cell_of(value: str, level: int) -> str:
    return f"shiftright(CAST({value} AS BIGINT), {level})"


def lookup(rows: DataFrame, bands: DataFrame, levels: list[tuple[int, int]], lane: list[tuple[str, str]],
           value: str, lo: str, hi: str, row_keys: list[str] | None = None) -> DataFrame:
    """``rows`` with every band of their lane that holds ``value`` (both bounds included); ``lane`` pairs
    the columns of rows and bands, whose names must differ.  With ``row_keys`` (a key of ``rows``), rows
    without any band stay with NULLs, as in a left join.

    With one level this is one equi-join.  With several, a row asks in each of them, and the rows that
    nobody answered are added from an anti-join by key.
    """
    cells = in_cells(bands, levels, lo, hi)
    if len(levels) == 1:
        asked, level = rows.selectExpr("*", f"{cell_of(value, levels[0][1])} AS _at"), "true"
    else:
        every = ", ".join(f"struct({at} AS _asked, {cell_of(value, at)} AS _at)" for _, at in levels)
        asked, level = rows.selectExpr("*", f"inline(array({every}))"), "_asked = _level"
    same = " AND ".join(f"{a} = {b}" for a, b in lane)
    on = F.expr(f"{same} AND {level} AND _at = _cell AND {value} BETWEEN {lo} AND {hi}")
    outer = row_keys is not None
    helpers = ["_at", "_cell", "_level", "_asked"]
    found = asked.join(cells, on, "left" if outer and len(levels) == 1 else "inner").drop(*helpers)
    if outer and len(levels) > 1:
        missing = [c for c in found.columns if c not in rows.columns]
        matched = found.select(*[F.col(k).alias(f"_m_{k}") for k in row_keys]).distinct()
        alone = rows.join(matched, F.expr(" AND ".join(f"{k} <=> _m_{k}" for k in row_keys)), "left_anti")
        found = found.unionByName(alone.selectExpr("*", *[f"CAST(NULL AS {dict(found.dtypes)[c]}) AS {c}" for c in missing]))
    return found

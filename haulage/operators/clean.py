"""Clean layer: staging -> clean.

Two rules, both the identity on already-clean input:
* code columns (plants, ports, carriers, customers, services) lose all white space at
  their ends and are upper-cased, so that the same code always joins to the same
  dimension row; a code that is then empty is NULL;
* rows whose every column is NULL are dropped (e.g. a trailing ``,`` CSV record).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.sources.schemas import CODE_COLUMNS
from haulage.sources.staging import Staging


def standardise_code(c):
    # between visible ASCII ends there is nothing to take off, which spares most codes the pattern
    visible = [F.ascii(end).between(33, 126) for end in (c, F.substring(c, -1, 1))]
    bare = F.when(visible[0] & visible[1], c).otherwise(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.upper(F.nullif(bare, F.lit("")))


def clean_table(name: str, df: DataFrame) -> DataFrame:
    codes = set(CODE_COLUMNS.get(name, ()))
    # asked of the columns as they come, the others first: a code is left if it is more than white space
    known = [F.col(c).isNotNull() for c in df.columns if c not in codes] + [F.col(c).rlike(r"\S") for c in df.columns if c in codes]
    return df.where(reduce(Column.__or__, known)).select(
        *[standardise_code(F.col(c)).alias(c) if c in codes else F.col(c) for c in df.columns])


def clean(staging: Staging) -> Staging:
    return staging.map(clean_table)

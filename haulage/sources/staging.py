"""The seven staging relations as one value, plus conformance to the declared schemas."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.sources import schemas


@dataclass(frozen=True)
class Staging:
    plant_port: DataFrame
    vmi_customers: DataFrame
    products_per_plant: DataFrame
    wh_capacities: DataFrame
    wh_costs: DataFrame
    freight_rates: DataFrame
    order_list: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def map(self, fn) -> "Staging":
        """Apply ``fn(name, df)`` to every table."""
        return Staging(**{n: fn(n, df) for n, df in self.tables().items()})


def conform(name: str, df: DataFrame) -> DataFrame:
    """Project ``df`` onto the declared schema of staging table ``name`` (by name)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name)
                       for f in schemas.STAGING[name].fields])

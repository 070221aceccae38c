"""haulage: a Spark-native freight-network cost and carrier-assignment engine.

Layers (each a set of composable DataFrame functions):

* ``sources``   - staging schemas, CSV ingest, the parquet test-data adapter, table sinks
* ``operators`` - clean layer, data quality, dimensions, bridges, facts, cost model
* ``functions`` - Column-level helpers (pricing, ordering, surrogate keys)
* ``plans``     - the star-schema build and the business questions built on it
* ``llm``       - training-data operators (optional)
"""

from haulage.config import CostConfig

__all__ = ["CostConfig"]
__version__ = "0.1.0"

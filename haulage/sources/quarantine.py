"""CSV ingest that sets bad records aside instead of stopping at the first one.

Records are read permissively as text, by position, and every field is cast to its declared type once.  The
outcome is written as one table, so the files are parsed a single time; the records whose fields are
all readable are the staging table, the others are the rejects, a row per fault:

* ``field_count``: the record has too few or too many fields.  Its fields are not judged further, since
  they may stand under the wrong columns;
* ``unreadable_value``: a field that is not blank has no value of its column's type.

A blank field is NULL and no fault; a record of blank fields is left to the clean layer.  Records that repeat
are all kept, on either side.  Empty files give two empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.session import scratch_path
from haulage.sources import schemas
from haulage.sources.csv import TABLE_FILES
from haulage.sources.staging import Staging

DAMAGED = "_damaged"
PROBLEM = "array<struct<rule: string, column_name: string, value: string>>"


@dataclass(frozen=True)
class Ingested:
    #: Records that are readable as a whole, in the declared schema.
    accepted: DataFrame
    #: (table_name, rule, column_name, value, source_file, record), a row per fault.
    rejects: DataFrame


def _typed(raw: Column, kind: T.DataType, date_format: str | None) -> Column:
    """The value of a text field, NULL if it has none of the type."""
    if isinstance(kind, T.StringType):
        return raw
    if isinstance(kind, T.DateType) and date_format:
        return F.try_to_timestamp(F.trim(raw), F.lit(date_format)).cast("date")
    return F.trim(raw).try_cast(kind)


def ingest(spark: SparkSession, path: str, table: str, date_format: str | None = None, header: bool = True) -> Ingested:
    """One staging table from the CSV file(s) at ``path``, bad records set aside.

    ``date_format`` is the pattern of the date columns if it is not yyyy-MM-dd; ``header``: whether every
    file begins with a line of names (which is skipped).
    """
    fields = schemas.STAGING[table].fields
    schema = T.StructType([*[T.StructField(f.name, T.StringType()) for f in fields], T.StructField(DAMAGED, T.StringType())])
    raw = (spark.read.option("header", header).option("enforceSchema", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", DAMAGED).option("encoding", "UTF-8").schema(schema).csv(path))
    values = {f.name: _typed(F.col(f.name), f.dataType, date_format) for f in fields}
    faults = [F.when((F.trim(f.name) != "") & values[f.name].isNull(),
                     F.struct(F.lit("unreadable_value").alias("rule"), F.lit(f.name).alias("column_name"), F.col(f.name).alias("value")))
              for f in fields if not isinstance(f.dataType, T.StringType)]
    count = F.array(F.struct(F.lit("field_count").alias("rule"), F.lit(None).cast("string").alias("column_name"),
                             F.lit(None).cast("string").alias("value")))
    problems = F.when(F.col(DAMAGED).isNotNull(), count).otherwise(
        F.array_compact(F.array(*faults)) if faults else F.array()).cast(PROBLEM)
    judged = raw.select(*[values[f.name].alias(f.name) for f in fields], problems.alias("_problems"),
                        F.col("_metadata.file_path").alias("_file"),
                        F.coalesce(DAMAGED, F.to_csv(F.struct(*[f.name for f in fields]))).alias("_record"))
    # the text of a good record is not kept
    judged = judged.withColumn("_record", F.when(F.size("_problems") > 0, F.col("_record")))
    where, made = scratch_path(spark, f"ingest-{table}"), judged.schema
    judged.write.parquet(where)
    judged = spark.read.schema(made).parquet(where)
    bad = judged.where(F.size("_problems") > 0).select(F.explode("_problems").alias("p"), "_file", "_record")
    return Ingested(
        accepted=judged.where(F.size("_problems") == 0).select(*[f.name for f in fields]),
        rejects=bad.select(F.lit(table).alias("table_name"), "p.rule", "p.column_name", "p.value",
                           F.col("_file").alias("source_file"), F.col("_record").alias("record")))


def ingest_folder(spark: SparkSession, folder: str, files: dict[str, str] | None = None,
                  date_format: str | None = None) -> tuple[Staging, DataFrame]:
    """All seven staging tables from one folder of CSV files, and the rejects of all of them."""
    names = {**TABLE_FILES, **(files or {})}
    parts = {t: ingest(spark, f"{folder.rstrip('/')}/{names[t]}", t, date_format) for t in schemas.STAGING}
    return (Staging(**{t: p.accepted for t, p in parts.items()}),
            reduce(DataFrame.unionByName, [p.rejects for p in parts.values()]))

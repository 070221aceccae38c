"""CSV ingest and export for the staging tables.

Source files carry their own header names ("Plant Code,Port", "WH,Cost/unit",
"Daily Capacity " with a trailing blank), a UTF-8 byte-order mark and CRLF line
ends.  Columns are therefore bound by position to the declared schema; the
header row is skipped, never trusted.  A record of empty fields (a trailing
``,`` line) reads as all-NULL and is removed by the clean layer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.sources import schemas
from haulage.sources.staging import Staging

# header names used by the source files (fixed values, in column order)
SOURCE_HEADERS = {
    "plant_port": ("Plant Code", "Port"),
    "vmi_customers": ("Plant Code", "Customers"),
    "wh_capacities": ("Plant ID", "Daily Capacity "),
    "wh_costs": ("WH", "Cost/unit"),
}

# default file (or folder) name of each staging table inside an input folder
TABLE_FILES = {t: f"{t}.csv" for t in schemas.STAGING}
MAPPING_TABLES = ("plant_port", "vmi_customers", "wh_capacities", "wh_costs")


def read_staging_csv(spark: SparkSession, path: str, table: str, date_format: str | None = None) -> DataFrame:
    """Read one staging table from CSV file(s) at ``path``, columns by position.

    ``date_format`` is the pattern of the date columns if it is not yyyy-MM-dd.
    """
    reader = spark.read.option("dateFormat", date_format) if date_format else spark.read
    return (reader
            .option("header", True)
            .option("enforceSchema", True)      # bind by position, ignore header names
            .option("mode", "FAILFAST")         # a malformed value is an error, not a NULL
            .option("encoding", "UTF-8")
            .schema(schemas.STAGING[table])
            .csv(path))


def write_staging_csv(df: DataFrame, path: str, table: str) -> None:
    """Write ``df`` (in staging column order) as headered CSV using the source header names."""
    names = SOURCE_HEADERS.get(table, tuple(f.name for f in schemas.STAGING[table].fields))
    out = df.select(*[df[f.name].alias(h) for f, h in zip(schemas.STAGING[table].fields, names)])
    out.write.mode("overwrite").option("header", True).csv(path)


def write_untidy_vmi(vmi: DataFrame, path: str, files: int = 8) -> None:
    """The VMI list as text files with what such exports bring along: byte-order mark, CRLF line ends,
    foreign headers, codes in lower case or padded with blanks and tabs, and blank records."""
    spark = vmi.sparkSession
    n = F.crc32(F.concat_ws(",", "plant_code", "customer_id"))
    pad = lambda c: (F.when(n % 4 == 0, F.lower(c)).when(n % 4 == 1, F.concat(F.lit("  "), c, F.lit("\t")))
                     .when(n % 4 == 2, F.concat(F.lit("\t"), F.lower(c), F.lit(" "))).otherwise(c))
    rows = vmi.select((n % files).cast("int").alias("file"), F.lit(1).alias("place"),
                      F.concat_ws(",", pad(F.col("plant_code")), pad(F.col("customer_id"))).alias("line"))
    fixed = [(0, "\ufeff" + ",".join(SOURCE_HEADERS["vmi_customers"])), (2, ","), (2, "  ,\t")]
    frame = spark.range(files).select(F.col("id").cast("int").alias("file"), F.explode(F.array(*[
        F.struct(F.lit(p).alias("place"), F.lit(t).alias("line")) for p, t in fixed])).alias("x")).select("file", "x.place", "x.line")
    (rows.unionByName(frame).repartitionById(files, F.col("file")).sortWithinPartitions("place")
     .select(F.concat("line", F.lit("\r")).alias("value")).write.text(path))


def read_csv_folder(spark: SparkSession, folder: str,
                    files: dict[str, str] | None = None) -> Staging:
    """All seven staging tables from one folder of CSV files (or folders of parts).

    ``files`` maps a staging table to its file name when it differs from
    ``<table>.csv``.
    """
    root = folder.rstrip("/")
    names = {**TABLE_FILES, **(files or {})}
    return Staging(**{t: read_staging_csv(spark, f"{root}/{names[t]}", t)
                      for t in schemas.STAGING})


def read_source_folder(spark: SparkSession, folder: str, others: Staging | None = None,
                       files: dict[str, str] | None = None) -> Staging:
    """The four mapping tables (plants, ports, VMI customers, capacities, costs) from a
    folder of CSV files; tariffs, orders and products per plant come from ``others``
    (empty when not given)."""
    names = {**TABLE_FILES, **(files or {})}
    tables = {t: read_staging_csv(spark, f"{folder.rstrip('/')}/{names[t]}", t)
              for t in MAPPING_TABLES}
    if others is None:
        empty = {t: spark.createDataFrame([], schemas.STAGING[t])
                 for t in ("products_per_plant", "freight_rates", "order_list")}
        return Staging(**tables, **empty)
    rest = {t: getattr(others, t) for t in ("products_per_plant", "freight_rates", "order_list")}
    return Staging(**tables, **rest)

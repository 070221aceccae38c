"""Session construction and the shared working folder.

On a cluster the operator sets ``spark.checkpoint.dir`` to a shared, durable
folder; every lineage cut (checkpoint, materialised star tables) goes there.
Only a ``local[...]`` session without that setting gets a private folder.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "haulage", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def app_id(spark: SparkSession) -> str:
    """Identifier of the running application (stable for the session's lifetime)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # sessions without a driver-side SparkContext
        return spark.conf.get("spark.app.id", "app")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of this session, set from ``spark.checkpoint.dir``.

    Falls back to a private temp folder only for local-mode sessions (tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="haulage-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder for one materialisation."""
    root = shared_dir(spark).rstrip("/")
    return f"{root}/{label}-{uuid.uuid4().hex[:12]}"


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITING: dict[str, tuple[int, str]] = {}
_WRITING_LOCK = threading.Lock()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Statements begun inside remove their shuffle files when they end, not when the driver happens to
    collect its garbage; the session's own setting comes back with the last of several threads."""
    app = app_id(spark)
    with _WRITING_LOCK:
        count, own = _WRITING.get(app) or (0, spark.conf.get(_FREE, "false"))
        _WRITING[app] = count + 1, own
        spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        with _WRITING_LOCK:
            count, own = _WRITING.pop(app)
            if count > 1:
                _WRITING[app] = count - 1, own
            else:
                spark.conf.set(_FREE, own)


def write(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as parquet and return the written table.

    Read back with the schema just written: no footer-inference job per table.
    """
    schema = df.schema
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a fresh folder of the session's shared folder and read back."""
    return write(df, scratch_path(df.sparkSession, label))

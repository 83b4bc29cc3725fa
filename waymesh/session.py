"""Session helpers: tables, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "waymesh", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine is tested with. On a cluster pass neither master nor partitions."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to: the session's, or, only in local mode where none is set, an own temporary one that goes with the process."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if have:
        return have
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="waymesh-ck-")
        atexit.register(shutil.rmtree, conf, ignore_errors=True)
    sc.setCheckpointDir(conf)
    return conf


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """A broadcast hint for df if it has at most max_rows rows (counted, stopping one row beyond), else df itself."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

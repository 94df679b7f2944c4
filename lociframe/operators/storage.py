"""Tables of iterative operators, kept in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one serves a local master only; a cluster has to name one that all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lociframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _removed_at_exit(spark: SparkSession, root: str) -> None:
    def remove() -> None:
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass

    atexit.register(remove)


def kept(df: DataFrame, name: str) -> str:
    """Writes df as the Parquet table `name` of a folder of its own in the shared one, and returns that folder. It goes when the driver's Python ends."""
    root = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex[:12]}"
    _removed_at_exit(df.sparkSession, root)
    df.write.parquet(f"{root}/{name}.parquet")
    return root


def writer(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """write(df, name): writes df as Parquet and reads it again, which cuts its lineage and outlives any executor. The tables go when the driver's Python ends."""
    root = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex[:12]}"

    _removed_at_exit(spark, root)

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    return write

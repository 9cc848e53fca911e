"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; a folder of this machine only where Spark runs in this
    process alone (tests). On a cluster no other folder is shared: without the setting it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='orebed-')}")
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df, computed once, written, and read from there. What follows plans from the table, whatever it took to make it, and
    a lost executor costs no more than what follows. The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/orebed-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(path: str) -> None:
    spark = SparkSession.getActiveSession()
    jvm = spark.sparkContext._jvm if spark is not None else None
    if jvm is None:  # the session has ended; the folder is scratch
        return
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except (Py4JError, OSError):  # the JVM has ended
        pass

"""Session helpers: tables, checkpoints and partition counts."""

import pickle
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the session names, else (local runs only) a temporary one."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at:
        return at
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="slotweave-checkpoint-")
    sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder, so that no later failure recomputes what led to them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def finished(spark: SparkSession, path: str) -> list[int]:
    """The numbered folders below path that were written to their end."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    return [int(n) for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def share(spark: SparkSession, value):
    """A broadcast of any object of this package (by value: workers need no copy of the package); open it with opened()."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared):
    return pickle.loads(shared.value)

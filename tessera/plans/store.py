"""Tables in the shared folder that ``spark.checkpoint.dir`` names: they cut lineage and outlive
lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint
    folder; a temporary one only in local mode, where the driver is the only executor."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        own = _OWN[context.applicationId] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return _OWN[context.applicationId]


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Deletes all that this application left in the shared folder, once results that read it are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back."""
    path = f"{own_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is made once per row.

    Spark copies the expression of a plain column into every filter and expression that uses it;
    a one-row generator stands in the way of that.
    """
    return df.withColumn(name, F.explode_outer(F.array(value)))

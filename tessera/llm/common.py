"""Plumbing shared by the training-data operators: tables, the shared folder, batch mapping."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import itertools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters outside blank and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OWN: dict[str, str] = {}
_C = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: what ``spark.checkpoint.dir`` names, or the
    checkpoint folder that the context was given.

    Only where neither is set, and the driver is the only executor (local tests), is a temporary folder made.
    """
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


def scratch(spark: SparkSession, what: str) -> str:
    """A new, unused path below the shared folder, in the folder of this application."""
    return f"{own_dir(spark)}/{what}-{uuid.uuid4().hex}"


def own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Deletes all tables, models and archives that this application left in the shared folder. To be
    called once nothing reads them any more: results are lazy, so that is after they are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: writes ``df`` to the shared folder as Parquet and reads it back.

    The files outlive any executor, so a lost one costs only its running tasks.
    """
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a DataFrame that ``stored`` returned, once nothing reads it again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: With it an execution deletes its shuffle files when it ends, not whenever the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within, no execution leaves shuffle files behind: for steps whose results are written. What reads
    them again all the same makes them again. Spark before 4.1 doesn't know the setting."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def posix(uri: str) -> str | None:
    """The plain path of a ``file:`` URI or of a path without scheme, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def put_file(uri: str, data: bytes | memoryview) -> None:
    """Writes one file into the shared folder from a worker: to another name, then renamed.

    A task that is run twice writes equal bytes twice; readers never see half a file.
    """
    path = posix(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, at)


def get_file(uri: str) -> str:
    """A path at which a worker can memory-map a file of the shared folder.

    A mounted folder is mapped in place. From an object store or HDFS the file is fetched once
    per executor into the folder that Spark keeps for the files of this application.
    """
    path = posix(uri)
    if path:
        return path
    from pyarrow import fs
    from pyspark import SparkFiles

    at = os.path.join(SparkFiles.getRootDirectory(), uri.replace("/", "_").replace(":", "_"))
    if not os.path.exists(at):
        store, where = fs.FileSystem.from_uri(uri)
        part = f"{at}.{uuid.uuid4().hex}"
        with store.open_input_stream(where) as src, open(part, "wb") as out:
            while chunk := src.read(1 << 22):
                out.write(chunk)
        os.replace(part, at)
    return at


#: Rows of an Arrow batch between the JVM and Python, where the session has Spark's own default. Ten
#: thousand documents would be held several times over on both sides.
BATCH_ROWS, SPARK_ROWS = "1000", "10000"


def small_batches(spark: SparkSession | None = None) -> None:
    """Bounds Arrow batches of texts; a session that sets its own bound keeps it."""
    conf = (spark or SparkSession.active()).conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == SPARK_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one record batch that yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from itertools.chain.from_iterable(map(fn, batches))
        tidy()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Bytes of text that a worker looks at together: batches may hold many times that.
SLICE_BYTES = 1 << 21


def slices(text: pa.Array) -> Iterator[slice]:
    """Ranges of rows of a few megabytes of text, or of one longer text."""
    at, held = 0, 0
    for i, n in enumerate(pc.binary_length(text).to_pylist()):
        held += n or 0
        if held >= SLICE_BYTES:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    if at < len(text):
        yield slice(at, len(text))


def map_slices(df: DataFrame, text: int, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` over a few megabytes at a time of the texts in column number ``text``."""

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        for s in slices(batch.column(text)):
            yield fn(batch.slice(s.start, s.stop - s.start))

    return map_batches(df, run, schema)


def in_slices(texts: pa.Array, fn: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """A function of a column of texts, applied to a few megabytes at a time."""
    parts = [fn(texts[s]) for s in slices(texts)]
    out = pa.concat_arrays(parts) if parts else fn(texts)
    del parts
    tidy()
    return out


def tidy() -> None:
    """Gives back what a worker no longer uses: workers live on, and hold what one task needed once."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_C, "malloc_trim", None):
        trim(0)


def lower_ascii(c: Column) -> Column:
    """Lower case for A to Z only."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACES), lambda w: w != "")


def fold_remainder(c: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n. A null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n

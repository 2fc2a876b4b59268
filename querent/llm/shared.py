"""Helpers shared by the corpus operators: cut lineage, fold case, stream groups, give memory back."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from py4j.java_gateway import JVMView
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a list of numbers up to which it is broadcast: some 30 MB.
SMALL = 1 << 20
#: Share of the driver's largest heap beyond which its garbage is collected, and how much of a heap may then stay free, in percent.
HEAP, SPARE = 0.5, 40
#: The driver's heap after the last of these collections, in bytes.
_after: dict[JVMView, int] = {}
#: bytes.translate table that lower-cases A-Z only.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset (a local session, as in tests) a temporary folder
    of this machine takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="querent-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def tidied(spark: SparkSession) -> None:
    """Has the driver's JVM collect garbage and give memory back, if its heap has outgrown HEAP.

    Hundreds of small jobs let a heap grow to its limit though little of it is
    in use, and a collection may leave up to 70 % of it free: this one leaves
    SPARE % at most, unless MaxHeapFreeRatio is set or the JVM has no such option.
    """
    jvm = spark._jvm
    runtime = jvm.Runtime.getRuntime()
    if runtime.totalMemory() <= max(HEAP * runtime.maxMemory(), 1.5 * _after.get(jvm, 0)):
        return
    with suppress(Py4JError, TypeError):
        kind = jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
        options = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(kind)
        if options.getVMOption("MaxHeapFreeRatio").getOrigin().toString() == "DEFAULT":
            options.setVMOption("MaxHeapFreeRatio", str(SPARE))
    jvm.System.gc()
    _after[jvm] = runtime.totalMemory()


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again.

    This cuts lineage: a lost executor costs the tasks it ran, never the
    stages before, and what was decided once (ids, positions) stays decided.
    The table is deleted when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/querent/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    tidied(spark)
    return out


def released(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more, and lets Spark drop the shuffles of finished jobs.

    Spark removes a shuffle once the driver's collector finds that nothing
    refers to it, which may be long after; large ones are worth asking for.
    """
    for df in tables:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def only(table: DataFrame, column: str, numbers: DataFrame) -> DataFrame:
    """The rows whose column is among ``numbers``, a written table of one column of distinct longs.

    It is broadcast if it has SMALL rows at most; a longer one is shuffled.
    """
    few = F.broadcast(numbers) if numbers.count() <= SMALL else numbers
    return table.join(few, table[column] == few[numbers.columns[0]], "left_semi")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, matched exactly, whatever else the table holds."""
    places = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[plain[f"c{p}"].alias(n) for p, n in zip(places, names, strict=True)])


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives memory back to the system when it ends: workers wait for later tasks, of any stage."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(AttributeError, OSError):  # the C library may have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return task


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column added, evaluated once a row.

    Adjacent projections are merged, and an expression that a later lambda
    mentions would then be evaluated once for each element. A generator of one
    element is a boundary that they aren't merged across.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


#: Bounds of an Arrow batch that holds whole texts, each after Spark's own default.
TEXT_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(1 << 20))}


def texts(df: DataFrame, *names: str) -> DataFrame:
    """As :func:`pick`, for Python stages over whole texts: their Arrow batches are kept small.

    A batch is buffered on both sides of the worker's pipe, so it is bounded by
    rows and by bytes. These are settings of the session, read when a plan is
    run; one that the session has set itself is kept.
    """
    conf = df.sparkSession.conf
    for key, (default, small) in TEXT_BATCH.items():
        if conf.get(key, None) == default:
            conf.set(key, small)
    return pick(df, *names)

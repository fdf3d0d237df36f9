"""Reading tables and cutting lineage, shared by every operator."""

from __future__ import annotations

import gc
import tempfile
import time

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Seconds between two sweeps of the driver, at least.
SWEEP_SECONDS = 10
_swept = 0.0


def sweep(sc: SparkContext) -> None:
    """Lets the driver collect its garbage, unless it did so just now.

    Spark deletes shuffle files, broadcasts and checkpoints of finished rounds only after the driver has collected what refers to them, by
    itself every half an hour; and the heap, which grows between collections, shrinks after one."""
    global _swept
    if time.monotonic() - _swept < SWEEP_SECONDS:
        return
    gc.collect()  # what Python still names, the JVM can't collect
    sc._jvm.System.gc()
    trim(sc)
    _swept = time.monotonic()


def trim(sc: SparkContext) -> bool:
    """Lets the driver's JVM return what its C allocator has freed but kept (compilers and buffers leave much); whether it could.

    Java 17.0.9 and later have this as the diagnostic command ``System.trim_native_heap``, on Linux."""
    jvm, array = sc._jvm, sc._gateway.new_array
    name_of = jvm.java.lang.Class.forName
    try:
        kinds = array(jvm.java.lang.Class, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = name_of(kind)
        # by way of the public interface: the server's own class isn't exported by its module
        invoke = name_of("javax.management.MBeanServer").getMethod("invoke", kinds)
        args = array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there.

    What earlier rounds left is swept from time to time. The folder is the one that the cluster names in ``spark.checkpoint.dir``.
    Only on one machine (a ``local`` master, as in tests) a folder is made where that is unset."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="mergeloom-"))
    done = df.checkpoint(eager=True)
    sweep(sc)
    return done


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session was told to hand rows to Python in Arrow batches of at most 4 MB.

    The default of 64 MB is held several times over, by the JVM and by Python, in every running task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return df

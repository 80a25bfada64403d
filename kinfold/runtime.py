"""Session helpers shared by all operators: table access and lineage cutting."""

from __future__ import annotations

import gc
import itertools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the executors' Python import this package, wherever the driver runs from: once
    per application, its source goes to them as a zip file."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="kinfold-code-")  # Spark serves it from the driver
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "kinfold"), "zip", os.path.dirname(here), os.path.basename(here)))


def prepare(spark: SparkSession) -> None:
    """Ship the package; switch off a planner setting that fails on unions of frames whose
    partition counts differ (they would claim a common partitioning); and let Spark delete
    checkpoints that nothing refers to, unless the application set that itself."""
    ship_package(spark)
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    conf = spark.sparkContext._jsc.sc().conf()
    if not conf.contains("spark.cleaner.referenceTracking.cleanCheckpoints"):
        conf.set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir`` (one Parquet file or a folder of parts)."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for written tables: the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master, as in tests, may fall back to a folder of its own; on a
    cluster a missing setting is an error, because a machine-local folder would be
    lost together with its executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.split("[")[0] == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kinfold-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return sc.getCheckpointDir()


class _Tables:
    """Written tables and the plans that read them, by their common file relation.

    Every frame derived from a table refers to the relation of its scan. When the driver's
    JVM has collected that, no plan can read the files any more and they are deleted.
    """

    def __init__(self) -> None:
        self.live: list[tuple[object, str]] = []

    def hold(self, spark: SparkSession, df: DataFrame, path: str) -> None:
        relation = df._jdf.queryExecution().analyzed().relation()
        self.live.append((spark._jvm.java.lang.ref.WeakReference(relation), path))

    def sweep(self, spark: SparkSession) -> None:
        gc.collect()
        spark._jvm.System.gc()
        kept = []
        for ref, path in self.live:
            if ref.get() is None:
                remove(spark, path)
            else:
                kept.append((ref, path))
        self.live = kept


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system Spark can reach."""
    at, fs = _at(spark, path)
    fs.delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    at, fs = _at(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, visible only when it is complete."""
    at, fs = _at(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.rename(part, at)


def read_small(spark: SparkSession, path: str) -> str:
    at, fs = _at(spark, path)
    source = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


_tables: dict[str, _Tables] = {}
_cuts = itertools.count(1)


def spread(df: DataFrame) -> DataFrame:
    """A table that was read, in at least one partition per core: for heavy work on rows that
    are few. A table of more splits than that is left as it is; split sizes decide."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder, once, and continue from the files.

    The files cut the lineage and outlive executors, like a checkpoint; but the plan runs
    once (an eager checkpoint runs its last stage twice), rows are compressed, later plans
    read only the columns they need, and the planner knows the true size. Files of
    tables that no plan refers to any more are deleted now and then.
    """
    spark = df.sparkSession
    prepare(spark)
    folder = ensure_checkpoint_dir(spark)
    path = f"{folder}/kinfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    done = spark.read.schema(df.schema).parquet(path)
    held = _tables.setdefault(spark.sparkContext.applicationId, _Tables())
    held.hold(spark, done, path)
    if next(_cuts) % 8 == 0:
        held.sweep(spark)
    return done


def mark(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``, for the small steps of loops: it plans faster than
    ``cut``, but runs the last stage of the plan twice and stores plain rows.

    The frame that Spark returns keeps its plan's partitioning claim, constraints and size
    estimate. Over the rounds of a loop the estimates are multiplied by each other until
    planning takes minutes, so the rows are taken as a plain source. Spark deletes the files
    when the driver has collected the frame, where ``cleanCheckpoints`` is on.
    """
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    spark = df.sparkSession
    prepare(spark)
    ensure_checkpoint_dir(spark)
    jdf = df.checkpoint(eager=True)._jdf
    if next(_cuts) % 8 == 0:
        _tables.setdefault(spark.sparkContext.applicationId, _Tables()).sweep(spark)
    return Classic(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)


def parallelism(spark: SparkSession) -> int:
    """Partition count for explicit repartitioning: at least twice the cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "8")), 2 * spark.sparkContext.defaultParallelism)

"""Session set-up, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SHARED: list[str] = []
_SHIPPED: set[str] = set()
_WORK_DIRS: set[str] = set()
_TABLES: dict = {}  # path -> weak reference to the file index of the plans that read it


def build_session(app: str = "lexitide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is designed for; every setting can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable by the Python workers, once an application, unless their path already has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SHIPPED.add(app)
    folder = tempfile.mkdtemp(prefix="lexitide-code-")  # the driver serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/lexitide", "zip", root, "lexitide"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session's ``spark.checkpoint.dir`` names it.

    Only a session that runs inside one machine's process (a ``local`` master) may do without: it gets a temporary folder. On a
    cluster every executor would write to a disk of its own there, so a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"master {master}: set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_SHARED:
        folder = tempfile.mkdtemp(prefix="lexitide-shared-")
        _LOCAL_SHARED.append(folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{_LOCAL_SHARED[0]}"


def work_dir(spark: SparkSession) -> str:
    """This application's own folder of the shared folder; it goes when the application's JVM ends."""
    path = f"{shared_dir(spark)}/lexitide/{spark.sparkContext.applicationId}"
    if path not in _WORK_DIRS:
        _WORK_DIRS.add(path)
        place, files = _hadoop(spark, path)
        files.mkdirs(place)
        files.deleteOnExit(place)
    return path


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def has_path(spark: SparkSession, path: str) -> bool:
    place, files = _hadoop(spark, path)
    return files.exists(place)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lineage cut that survives lost executors.

    The path is unique per call, so concurrent queries never see each other's tables. The table lasts as long as any plan of
    the JVM reads it (all plans made from the result share one file index, to which only a weak reference is kept), and is
    removed by a later call, by ``sweep`` or when the application ends.
    """
    spark = df.sparkSession
    sweep(spark)
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    index = read._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
    _TABLES[path] = spark.sparkContext._jvm.java.lang.ref.WeakReference(index)
    return read


def sweep(spark: SparkSession, collect: bool = False) -> int:
    """Removes written tables that no plan reads any more; with ``collect`` garbage is collected first. Gives the number left."""
    if collect:
        gc.collect()
        spark.sparkContext._jvm.java.lang.System.gc()
    for path, held in list(_TABLES.items()):
        if held.get() is None:
            place, files = _hadoop(spark, path)
            files.delete(place, True)
            del _TABLES[path]
    return len(_TABLES)


def parallelism(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's shuffle setting, but no fewer than its cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, where costly Python work follows on few files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

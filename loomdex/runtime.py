"""Session helpers: the shared folder for intermediate tables and table loading."""

from __future__ import annotations

import atexit
import os
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


#: Temporary folders of local applications, by application id.
_LOCAL: dict[str, str] = {}


def _configured(spark: SparkSession) -> str | None:
    return spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor reaches, as named by ``spark.checkpoint.dir``.

    Without that setting an application on a local master gets one temporary folder
    (tests and single-machine use); on a cluster it is an error, because a folder on one
    machine would be lost with it.
    """
    found = _configured(spark)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    name = spark.sparkContext.applicationId
    if name not in _LOCAL:
        _LOCAL[name] = "file://" + tempfile.mkdtemp(prefix="loomdex-")
    return _LOCAL[name]


#: Intermediate tables that were written, by application id.
_TABLES: dict[str, list[str]] = {}


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and return a scan of what was written.

    The table stays until ``clear`` or the end of the application, as results may be lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    name = spark.sparkContext.applicationId
    if name not in _TABLES:
        _TABLES[name] = []
        atexit.register(_clear_at_exit, spark)
    _TABLES[name].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Remove the intermediate tables of this application so far; results that still read them can't be used any more."""
    paths = _TABLES.get(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        removed += path.getFileSystem(conf).delete(path, True)
    return removed


def _clear_at_exit(spark: SparkSession) -> None:
    for folder in _LOCAL.values():
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)
    try:
        if spark.sparkContext._jsc is not None:
            clear(spark)
    except Exception:  # the session may have ended before
        pass


#: Applications whose executors have been given the package.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application.

    Spark serves the archive from the driver, so it need not be installed or on a path
    there. Every operator that runs Python calls this.
    """
    name = spark.sparkContext.applicationId
    if name in _SHIPPED:
        return
    package = pathlib.Path(__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="loomdex-ship-"), "loomdex.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions for an explicit repartition.

    Follows ``spark.sql.shuffle.partitions``, which a deployment sizes to its data.
    """
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that is long for each row.

    A scan of many files or large ones comes back as it is; only one that would leave
    cores idle is dealt out, which then moves little. A plan with a shuffle or join of its
    own also comes back as it is.
    """
    run = df._jdf.queryExecution()
    if run.executedPlan().nodeName().startswith("Adaptive"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if run.toRdd().getNumPartitions() >= cores else df.repartition(cores)

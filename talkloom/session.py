"""Session construction and shared-folder handling."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "talkloom", cpus: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g", extra: dict[str, str] | None = None) -> SparkSession:
    """A local session with the settings that tests and benchmarks use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return builder.config(map=extra or {}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where all of Spark runs in one process, and the setting is missing, a
    folder below the working directory's ``spark-warehouse`` is used; on a
    cluster a missing setting raises, as no local folder could do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + os.path.abspath(os.path.join("spark-warehouse", "shared"))
    return named.rstrip("/")


#: Folders that this process has written, by what reads them.
_written: dict[str, list[str]] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A folder in the shared one for files that tasks write themselves; it stays until :func:`discard` or :func:`clean_up`."""
    path = f"{shared_dir(spark)}/talkloom/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def store(uri: str):
    """(file system, path) of a URI as Spark writes it, for tasks that read and write files themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage as ``checkpoint()`` does, survives lost executors,
    and keeps the column types. The folder stays until :func:`discard` or
    :func:`clean_up`, as the result is read from it whenever it is used.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._talkloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(spark: SparkSession, written: DataFrame | str) -> None:
    """Delete a :func:`scratch` folder, or what :func:`materialise` wrote for a DataFrame, which can't be read any more."""
    path = written if isinstance(written, str) else written._talkloom_path
    _written[spark.sparkContext.applicationId].remove(path)
    _delete(spark, path)


def clean_up(spark: SparkSession) -> int:
    """Delete all that :func:`materialise` has written in this application; results that read it must have been used."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)

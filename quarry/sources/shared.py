"""Tables written between steps, in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN_DIR = "quarry.shared.dir"
_known: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder, else, where all runs on one machine, a new temporary
    folder, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}" if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quarry-tables"
        spark.conf.set(OWN_DIR, found)
    return found


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    """Remove a written folder, through the file system that Spark writes it with."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def is_written(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def state_of(spark: SparkSession, path: str) -> str:
    """Bytes and time of change of what lies at a path."""
    fs, at = _file_system(spark, path)
    return f"{fs.getContentSummary(at).getLength()}-{fs.getFileStatus(at).getModificationTime()}"


def application_dir(spark: SparkSession) -> str:
    """The shared folder's part that belongs to this application; it goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quarry-{spark.sparkContext.applicationId}"
    if path not in _known:
        _known.add(path)
        atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped context can't reach its file systems any more
        delete(spark, path)


def clean_up(spark: SparkSession) -> None:
    """Delete every table that this application wrote between steps; what was made from them must be written before."""
    delete(spark, application_dir(spark))


def write_out(df: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
    """Cut the lineage: write to the shared folder once and read back; also the path, to delete it after its last use."""
    path = path or f"{application_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame) -> DataFrame:
    return write_out(df)[0]

"""Tables in the folder that driver and executors share; gone when the driver ends."""

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[object, object]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is taken, but only in local mode: on a
    cluster such a folder would exist on one machine only, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="millrace-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


@atexit.register
def _remove_all() -> None:
    for conf, path in _MADE:
        with contextlib.suppress(Exception):  # the session may be gone at exit
            path.getFileSystem(conf).delete(path, True)


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    _MADE.append((sc._jsc.hadoopConfiguration(), sc._jvm.org.apache.hadoop.fs.Path(path)))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write and read back: it cuts lineage in storage that outlives executors, so
    a lost one costs a re-read and not a recomputation."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

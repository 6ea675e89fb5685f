"""Session helpers: table loading and intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from itertools import count

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
_NUMBER = count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables (a Parquet file or folder)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, in the one that ``spark.checkpoint.dir`` names.

    On a cluster it must be named. Only a local master, where driver and executors are one
    process, may leave it out (tests, a laptop); then it is a temporary folder.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _FOLDERS:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        local = sc.master == "local" or sc.master.startswith("local[")
        if not named and not local:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{named.rstrip('/')}/quire-{sc.applicationId}" if named else tempfile.mkdtemp(prefix="quire-")
        _FOLDERS[sc.applicationId] = folder
        atexit.register(_remove, sc._jvm, folder, not named)
    return _FOLDERS[sc.applicationId]


def _remove(jvm, folder: str, plain: bool) -> None:
    """Intermediate tables go with the application."""
    try:
        if plain:
            shutil.rmtree(folder, ignore_errors=True)
        else:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except Exception:  # the JVM may be gone already
        pass


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table into the shared folder and read it from there.

    The result survives the loss of executors, is not computed again by later branches, is read
    by columns, and its size in bytes is known to the planner, which alone decides by it which
    joins are broadcast.
    """
    path = f"{shared_folder(df.sparkSession)}/{next(_NUMBER)}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove the table behind a result of ``cut_lineage`` that nothing reads any more."""
    path = getattr(df, "_quire_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

"""Tables written between steps, in the shared folder that the session names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Folders that this process has written to, with the settings that reach them.
_OWN: dict[str, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only for a single-process local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + _LOCAL[0]


def own_folder(spark: SparkSession) -> str:
    """The folder of this application's tables in the shared folder; it goes when the driver's Python ends, or by :func:`clear`."""
    path = f"{shared_folder(spark).rstrip('/')}/millrace/{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN[path] = spark.sparkContext._jsc.hadoopConfiguration()
    return path


def delete(spark: SparkSession, path: str, conf=None) -> None:
    """Delete a folder and all in it, if there is one."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf or spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application wrote by :func:`cut`; what reads them fails from then on."""
    path = own_folder(spark)
    delete(spark, path)
    _OWN.pop(path, None)


@atexit.register
def _clear_all() -> None:
    for path, conf in _OWN.items():
        try:
            where = SparkContext._gateway.jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # noqa: BLE001  the JVM has gone first, and nothing can be done from here
            return


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    The written table replaces the lineage: a lost executor costs the tasks that read it, not the steps
    before it.  The schema is kept, so an empty table reads back as well.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column of ``df`` has."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        out.append(name)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a table that :func:`cut` returned and that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)

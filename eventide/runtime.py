"""Session helpers shared by operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; on a local master without it, one of our own that goes when Python ends."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="eventide-")
        atexit.register(shutil.rmtree, _own, True)
    return _own


_own: str | None = None


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new folder for files written and read again, under the shared folder."""
    return f"{_shared(spark)}/eventide-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session is gone; its owner clears the shared folder
        pass


def stage(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back, so that several readers each read only their columns.

    Later plans never run the work again, and a lost executor loses nothing.
    The folder goes when the driver's Python ends.
    """
    spark = df.sparkSession
    folder = scratch(spark)
    df.write.mode("overwrite").parquet(folder)
    atexit.register(_remove, spark, folder)
    staged = spark.read.schema(df.schema).parquet(folder)
    staged._stage_folder = folder
    return staged


def drop_stage(staged: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    _remove(staged.sparkSession, staged._stage_folder)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_eventide_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="eventide-ship-")
    atexit.register(shutil.rmtree, folder, True)
    target = Path(folder) / "eventide_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._eventide_shipped = True

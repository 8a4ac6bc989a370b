"""Session helpers: a tuned local session, table loading, the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, name: str = "lagweave", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir. Only a session whose tasks run in the driver's own process may go
    without one: executors of any other would write to their own disks what nobody else can read, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError(f"spark.checkpoint.dir names no folder that all executors of {sc.master} share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "lagweave-checkpoint"))


#: The folder of each table written by stored(), as long as its DataFrame lives.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, done: Iterable[DataFrame] = ()) -> DataFrame:
    """Cut the lineage with a table in the checkpoint folder, which survives the loss of executors. Unlike a checkpoint it is columnar and
    compressed, and the optimizer knows its size. It goes with discard(), or when the session's JVM ends.

    done: stored tables that nothing reads once this one is written; they are deleted.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _folder(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    discard(*done)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables written by stored(); other DataFrames are left alone."""
    for t in tables:
        if path := _FOLDERS.pop(t, None):
            fs, at = _folder(t.sparkSession, path)
            fs.delete(at, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers that could not import it: if it is neither on PYTHONPATH nor in the working folder, the driver serves it as an archive, once per application."""
    root, app = Path(__file__).resolve().parent.parent, spark.sparkContext.applicationId
    reachable = {os.path.realpath(p) for p in [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]}
    if app in _SHIPPED or str(root) in reachable:
        return
    archive = os.path.join(tempfile.mkdtemp(), "lagweave.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "lagweave").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)

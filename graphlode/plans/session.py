"""Session helpers shared by all operators: table access, checkpoint folder, input spreading."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the package to all Python workers, once a context, so that a cluster needs no installation."""
    sc = spark.sparkContext
    if getattr(sc, "_graphlode_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="graphlode-"), "graphlode.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._graphlode_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the schema comes from the Parquet footer, nothing is inferred."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; only where that is unset and all runs on one machine (tests) make one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphlode-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The files outlive any executor, so a lost executor never reruns what came before.
    """
    ship(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Spread the rows of an input that is read as fewer partitions than there are cores.

    Larger inputs are split by the scan already and come back unchanged, without a shuffle.
    """
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that are not yet in ``df`` (case-insensitively), one for each wanted name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it from there.

    Like ``cut``, but compressed and columnar, so later readers take only the columns they need, and
    the planner knows its size. The folder is removed by ``release`` or when the session ends.
    """
    spark = df.sparkSession
    ship(spark)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    fs, path = _file_system(spark, folder)
    fs.deleteOnExit(path)
    _STAGED.append((spark.sparkContext.applicationId, folder))
    return spark.read.schema(df.schema).parquet(folder)


_STAGED: list[tuple[str, str]] = []


def release(spark: SparkSession) -> None:
    """Remove all staged tables of the session: for use between queries, once results are written or collected."""
    kept = [x for x in _STAGED if x[0] != spark.sparkContext.applicationId]
    for application, folder in _STAGED:
        if application == spark.sparkContext.applicationId:
            remove(spark, folder)
    _STAGED[:] = kept


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    fs, path = _file_system(spark, folder)
    return fs.exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    fs, path = _file_system(spark, folder)
    fs.delete(path, True)


def swap(spark: SparkSession, new: str, target: str) -> None:
    """Put a written folder in the target's place. The old one waits beside it until the new one is there (see ``recover``)."""
    fs, to = _file_system(spark, target)
    _, source = _file_system(spark, new)
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to.getParent(), f"_old-{to.getName()}")  # readers pass over it
    fs.delete(old, True)
    fs.mkdirs(to.getParent())
    if fs.exists(to) and not fs.rename(to, old):
        raise OSError(f"cannot move {target}")
    if not fs.rename(source, to):
        raise OSError(f"cannot move {new}")
    fs.delete(old, True)


def recover(spark: SparkSession, target: str) -> None:
    """Bring back the old folder of a swap that was cut off before the new one was in place."""
    fs, to = _file_system(spark, target)
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to.getParent(), f"_old-{to.getName()}")  # readers pass over it
    if fs.exists(old):
        if fs.exists(to):
            fs.delete(old, True)
        else:
            fs.rename(old, to)

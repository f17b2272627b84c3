"""Session helpers: local test sessions and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "8g", name: str = "skyloom") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, whatever their machine and working folder are.

    Executors get a zip of it from the driver, once in an application; the
    driver's own planning workers find it on their path.
    """
    package = Path(__file__).resolve().parent
    root, sc = str(package.parent), spark.sparkContext
    if not any(x.startswith("skyloom-package-") for x in sc._python_includes):
        packed = f"{tempfile.mkdtemp()}/skyloom-package-{uuid.uuid4().hex}.zip"
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
            for f in sorted(package.rglob("*.py")):
                out.write(f, f.relative_to(package.parent))
        sc.addPyFile(packed)
    env = sc.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one where it is unset and all runs on this machine."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="skyloom-"))
        return sc._jsc.sc().getCheckpointDir().get()
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root


def _folder(spark: SparkSession, path: str):
    """A path's file system and path as Hadoop has them."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def shared_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A fresh path in a folder of its own below the shared folder, which goes when the application ends unless it is kept."""
    path = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    store, folder = _folder(spark, path)
    store.mkdirs(folder)
    if not keep:
        store.deleteOnExit(folder)
    return f"{path}/data"


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Delete what is staged inside when it ends: for steps whose result is written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for df in _scopes.pop():
            unstage(df)


def _written(df: DataFrame, label: str, **options: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    store, folder = _folder(spark, path)
    store.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def _noted(df: DataFrame) -> DataFrame:
    if _scopes:
        _scopes[-1].append(df)
    return df


def staged(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there.

    Whoever knows when it is no longer read calls unstage() or opens a
    scratch(); what is left goes when the application ends.
    """
    return _noted(_written(df, label, **options))


def settled(make: Callable[[], DataFrame], label: str, **options: str) -> DataFrame:
    """What ``make`` gives, staged, without what it has staged on its way."""
    with scratch():
        out = _written(make(), label, **options)
    return _noted(out)


def unstage(df: DataFrame) -> None:
    """Delete the files behind a staged frame that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        store, folder = _folder(df.sparkSession, path)
        store.delete(folder, True)

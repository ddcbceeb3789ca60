"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on. AQE splits skewed join partitions and sizes shuffles.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply ``SETTINGS`` to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for cut lineage and stream state: the cluster's checkpoint folder.

    Only a local session without one (a test) gets a folder of its own; the executors of a
    cluster would each write to their own disk there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="stackfall-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_RECORDED: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for recorded in _RECORDED:
        recorded.append(path)
    return path


@contextmanager
def scratch_of() -> Iterator[list[str]]:
    """The scratch paths that are handed out meanwhile, to be removed once they are not read any
    more."""
    paths: list[str] = []
    _RECORDED.append(paths)
    try:
        yield paths
    finally:
        _RECORDED.remove(paths)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "cut", *, clean: bool = False) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from there.

    Used where several operators read one expensive frame: the log is then parsed once, later
    reads are columnar and pruned, and a lost executor costs no recomputation of the parse.
    With ``clean`` the shuffle files of the write go with its end, not when the driver happens to
    collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    if clean:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean and before is None:
            spark.conf.unset(_CLEANUP)
        elif clean:
            spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote; nothing that reads them may be run any more."""
    for table in tables:
        remove(table.sparkSession, table.scratch)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str, *, written: bool = False) -> list[str]:
    """Names of the folders in ``path``, sorted; ``written`` leaves out tables not written to the end.
    A missing path has none."""
    place, files = _file_system(spark, path)
    if not files.exists(place):
        return []
    found = [entry.getPath() for entry in files.listStatus(place) if entry.isDirectory()]
    if written:
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = [folder for folder in found if files.exists(done(folder, "_SUCCESS"))]
    return sorted(folder.getName() for folder in found)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder that this session wrote, if it is there."""
    place, files = _file_system(spark, path)
    files.delete(place, True)

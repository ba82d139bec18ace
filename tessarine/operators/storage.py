"""Tables in the folder that all executors share: they cut lineages and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Lets go of the shuffle files of an execution when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: str | None = None
_scratch: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local one, if driver and executors are one process; on a
    cluster a local folder would lose data, so there it is an error."""
    global _own
    if there := spark.conf.get("spark.checkpoint.dir", None):
        return there.rstrip("/")
    master = spark.conf.get("spark.master", None) or ""
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="tessarine-")
        atexit.register(shutil.rmtree, _own, True)
    return f"file://{_own}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again.

    The shuffle files that made it go at once: nothing reads them any more. dropped() removes the table itself.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    back = spark.read.schema(df.schema).parquet(at)
    back._tessarine_at = at
    if _scratch:
        _scratch[-1].append(back)
    return back


@contextmanager
def scratch():
    """Tables written within are deleted at the end, but for those handed to the function that it yields."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    _scratch.append(made)
    try:
        yield keep
    finally:
        _scratch.remove(made)
        dropped(*[t for t in made if not any(t is k for k in kept)])


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written(), once nothing lazy reads them any more."""
    for df in tables:
        at = getattr(df, "_tessarine_at", None)
        if at:
            jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)

"""Session helpers: shared scratch tables and bounded driver reads."""

from __future__ import annotations

import atexit
import itertools
import shutil
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = uuid.uuid4().hex[:12]
_COUNTER = itertools.count()
_MARKED: set[str] = set()  # scratch folders that exist


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and all executors are in this process (tests,
    a laptop) a temporary folder of this machine is made and set as the checkpoint
    folder.  On a cluster without the setting it raises: executors can't share one
    machine's folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    local = tempfile.mkdtemp(prefix="mathquarry-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{local}")
    return f"file://{local}"


def scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/mathquarry-{_RUN}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, whatever its file system is; all of them go when the driver's JVM ends, or with ``cleanup``."""
    root = scratch_root(spark)
    if root not in _MARKED:
        where = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _MARKED.add(root)
    return f"{root}/{next(_COUNTER)}-{name}"


def cleanup(spark: SparkSession) -> None:
    """Deletes all scratch tables of this run now; results that read them must have been taken before."""
    _delete(spark, scratch_root(spark))
    _MARKED.discard(scratch_root(spark))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with a table every executor can read, so the loss of an
    executor costs no recomputation of what came before.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of ``materialize`` that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        _delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def distinct_records(df: DataFrame, *, keep_first: str | None = None) -> DataFrame:
    """Repeated rows of one record become one row.

    Rows count as the same record when all columns but ``loaded_at`` agree.
    With ``keep_first`` the smallest ``loaded_at`` is kept under that name,
    otherwise the column is dropped.
    """
    columns = [c for c in df.columns if c != "loaded_at"]
    if keep_first is None or "loaded_at" not in df.columns:
        return df.select(*columns).distinct()
    return df.groupBy(*columns).agg(F.min("loaded_at").alias(keep_first))


def bounded(df: DataFrame, key: str, most: int) -> DataFrame:
    """``df``, failing if a key has more than ``most`` rows, before any of its rows are gathered."""
    sizes = df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    large = sizes.agg(F.count("*").alias("_large"))
    fine = F.assert_true(F.col("_large") == 0, f"a value of {key} has more than {most} rows")
    return df.join(F.broadcast(large), how="cross").filter(fine.isNull()).drop("_large")  # one row of one number


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker does."""
    return sys.modules.setdefault("_mathquarry_worker", types.ModuleType("_mathquarry_worker")).__dict__

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import threading
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a table is staged: shuffle files go once it is written, not when the driver collects
#: garbage, and Python gets rows in batches that stay small where they hold whole texts.
STAGING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_lock, _staging, _before = threading.Lock(), [0], {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    A folder of this machine serves only a session that runs on this machine alone, as in
    tests; on a cluster the setting must be there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lacuna-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _switch(spark: SparkSession, on: bool) -> None:
    """The settings of STAGING hold while at least one table is being staged, by whatever thread."""
    with _lock:
        _staging[0] += 1 if on else -1
        if on and _staging[0] == 1:
            _before.update({k: spark.conf.get(k, None) for k in STAGING})
            for k, v in STAGING.items():
                spark.conf.set(k, v)
        elif not on and not _staging[0]:
            for k, v in _before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(df: DataFrame, name: str, share: int = 1) -> DataFrame:
    """df written once as Parquet in the shared folder and read back.

    Cuts the lineage: a lost executor costs no more than the tasks that it ran. share: the
    table is so many times smaller than those that set the number of partitions, and its
    rows are dealt to as many times fewer tasks that write it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _switch(spark, True)
    try:
        (df.repartition(max(6, partitions(spark) // share)) if share > 1 else df).write.parquet(path)
    finally:
        _switch(spark, False)
    where = _path(spark, path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)  # with the session's driver
    out = spark.read.schema(df.schema).parquet(path)
    out.lacuna_path = path
    return out


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that staged() made and nothing reads any more."""
    path = getattr(df, "lacuna_path", None)
    if path:
        where = _path(df.sparkSession, path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def pieces(df: DataFrame, text: str, size: int, least: int) -> int:
    """Into how many pieces of about `size` bytes the texts of df go, `least` at least: counted over all of them."""
    found = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, -(-found // size))


def spread(df: DataFrame) -> DataFrame:
    """df, a table as it is read, in as many partitions at least as tasks run at once: small tables lie in few splits."""
    want = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():  # dealt already
        return df
    return df.repartition(want) if df._jdf.queryExecution().toRdd().getNumPartitions() < want else df


def unused(df: DataFrame, name: str) -> str:
    """A name like the given one that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

"""Shared intermediate tables.

A table that several later steps read is kept. Where the cluster names a shared folder in
``spark.checkpoint.dir``, it is written there once and read back, which cuts the lineage,
survives lost executors, and gives later joins true file sizes to plan with. Without such
a folder it is persisted, with its lineage, so lost parts are computed again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that all executors share, if one is configured."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


class Kept:
    """What was kept for a result, so that it can be dropped with it."""

    def __init__(self) -> None:
        self._drops: list[Callable[[], object]] = []

    def add(self, drop: Callable[[], object]) -> None:
        self._drops.append(drop)

    def close(self) -> None:
        while self._drops:
            self._drops.pop()()


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _store(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str, kept: Kept | None = None) -> DataFrame:
    """Keep ``df`` and return the kept table. ``kept`` can drop it later."""
    spark, kept = df.sparkSession, kept or Kept()
    folder = shared_folder(spark)
    if folder is None:
        stored = df.persist()
        kept.add(stored.unpersist)
        return stored
    path = f"{folder}/tracewarden/{name}-{uuid.uuid4().hex}"
    kept.add(lambda: delete_folder(spark, path))
    return _store(df, path)


def materialize_by(df: DataFrame, name: str, key: str, kept: Kept | None = None) -> DataFrame:
    """Keep ``df`` dealt by ``key``, so that grouping or joining by it later moves nothing.

    In the shared folder it is a table in as many buckets as the session has shuffle partitions.
    """
    spark, kept = df.sparkSession, kept or Kept()
    folder, buckets = shared_folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, key)
    if folder is None:
        stored = dealt.persist()
        kept.add(stored.unpersist)
        return stored
    table = f"tracewarden_{name}_{uuid.uuid4().hex}"
    path = f"{folder}/tracewarden/{table}"
    kept.add(lambda: delete_folder(spark, path))
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    kept.add(lambda: spark.sql(f"DROP TABLE IF EXISTS {table}"))
    return spark.table(table)


def materialize_parts(
    spark: SparkSession, parts: Sequence[Callable[[], DataFrame]], name: str, kept: Kept | None = None
) -> DataFrame:
    """Keep tables of one schema and return them as one table.

    The parts are independent jobs and are submitted together, so the cluster works
    on all of them and every plan stays small. One plan holding them all would be
    optimised anew after each of its many stages.
    """
    folder, kept = shared_folder(spark), kept or Kept()
    if folder is None:

        def persist(make: Callable[[], DataFrame]) -> DataFrame:
            stored = make().persist()
            kept.add(stored.unpersist)
            stored.count()
            return stored

        with ThreadPoolExecutor(len(parts)) as pool:
            return reduce(DataFrame.unionByName, pool.map(persist, parts))
    root = f"{folder}/tracewarden/{name}-{uuid.uuid4().hex}"
    kept.add(lambda: delete_folder(spark, root))
    with ThreadPoolExecutor(len(parts)) as pool:
        stored = list(pool.map(lambda part: _store(part[1](), f"{root}/{part[0]}"), enumerate(parts)))
    return spark.read.schema(stored[0].schema).parquet(*[f"{root}/{i}" for i in range(len(parts))])

"""State of addresses between batches, in hash buckets.

A table is ``bucket=…/version=…`` folders of parquet. A batch writes the rows of the addresses it
changed, into their buckets, and reads these buckets alone. The newest rows of a key take
the place of all older ones. Every so many batches a bucket is folded into its newest rows,
each bucket at a batch of its own, so no batch folds the whole table.

Batch n writes version 2n + 1 and folds, before that, into version 2n. A fold appears by one rename
and older versions go after it, so a failure at any point leaves the same newest
rows, and a batch that runs again finds what was there before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BucketedState:
    """A state table under ``folder``. Rows of one ``keys`` are written together; a column ``ip`` decides the bucket."""

    spark: SparkSession
    folder: str
    keys: Sequence[str]
    buckets: int = 64
    fold_every: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("ip"), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows; there are as many as the table has at most."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        return at, at(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, buckets: Sequence[int], below: int | None = None) -> DataFrame | None:
        """The newest rows of every key in some buckets, as they were before batch ``below``; None if there are none.

        Only the folders of these buckets are listed and read.
        """
        at, files = self._files()
        paths = [f"{self.folder}/bucket={b}" for b in buckets]
        paths = [p for p in paths if files.exists(at(p))]
        if not paths:
            return None
        rows = self.spark.read.option("basePath", self.folder).parquet(*paths)
        if below is not None:
            rows = rows.where(F.col("version") <= 2 * below)
        newest = rows.groupBy(*self.keys).agg(F.max("version").alias("version"))
        return rows.join(newest, [*self.keys, "version"]).drop("version", "bucket")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """The new rows of every key that a batch changed; a second run overwrites the first."""
        self._put(rows, 2 * batch_id + 1, self.folder)

    def _put(self, rows: DataFrame, version: int, folder: str) -> None:
        (
            rows.withColumns({"bucket": self.bucket(), "version": F.lit(version)})
            .repartition("bucket")
            .sortWithinPartitions("bucket", "ip")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket", "version")
            .parquet(folder)
        )

    def due(self, batch_id: int) -> list[int]:
        """The buckets whose turn it is to be folded before a batch."""
        return [b for b in range(self.buckets) if batch_id and (batch_id + b) % self.fold_every == 0]

    def fold(self, batch_id: int, change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Fold the buckets that are due; ``change`` may bring their rows into a shorter form."""
        at, files = self._files()
        version = 2 * batch_id
        for bucket in self.due(batch_id):
            rows = self.read([bucket], below=batch_id)
            own = f"{self.folder}/bucket={bucket}"
            if rows is None or files.exists(at(f"{own}/version={version}")):
                continue
            self._put(change(rows), version, f"{self.folder}/_folded")
            files.rename(at(f"{self.folder}/_folded/bucket={bucket}/version={version}"), at(f"{own}/version={version}"))
            for entry in files.listStatus(at(own)):
                name = entry.getPath().getName()
                if name.startswith("version=") and int(name.partition("=")[2]) < version:
                    files.delete(entry.getPath(), True)

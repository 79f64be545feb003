"""An append log whose batches count once, whatever is run again.

Rows of a batch are files under ``batch=…/attempt=…``; a batch exists once its commit, one small row under
``_commits``, is written.  A writer that dies leaves files without a commit, which no reader sees; a batch that is sent
again finds its commit and writes nothing; of two writers that commit one batch at the same moment, readers keep the
attempt that sorts first.  So the log serves ``foreachBatch``, whose last batch may be replayed, and batch jobs alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

COMMITS = "batch string, attempt string, number long, folded array<string>, rows long"


class BatchLog:
    """The log under ``path``.  Readers see a column ``batch_id``, the name the batch was appended under."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _commits(self) -> DataFrame:
        folder = f"{self.path}/_commits"
        if not self._exists(folder):
            return self.spark.createDataFrame([], COMMITS)
        return self.spark.read.schema(COMMITS).parquet(folder)

    def _exists(self, folder: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _live(self) -> DataFrame:
        """One commit per batch, but for those that a later commit stands for."""
        commits = self._commits()
        first = commits.groupBy("batch").agg(F.min_by(F.struct("attempt", "number", "folded", "rows"), "attempt").alias("c")).select("batch", "c.*")
        gone = first.select(F.explode("folded").alias("batch")).distinct()
        return first.join(gone, "batch", "left_anti")

    def holds(self, batch_id) -> bool:
        """Whether the batch is in the log, by itself or folded into a later one; commits are never deleted."""
        return not self._commits().filter(F.col("batch") == str(batch_id)).isEmpty()

    def _commit(self, name: str, attempt: str, number: int | None, folded: list[str], rows: int) -> None:
        row = self.spark.createDataFrame([(name, attempt, number, folded, rows)], COMMITS)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/_commits")

    def append(self, df: DataFrame, batch_id, partition_by: Sequence[str] = ()) -> bool:
        """Add ``df`` as a batch; False, and nothing is written, where the log has it already."""
        if self.holds(batch_id):
            return False
        name, attempt = str(batch_id), f"a{uuid.uuid4().hex}"
        place = f"{self.path}/batch=b{name}/attempt={attempt}"
        writer = df.write.mode("error")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(place)
        number = int(name) if name.lstrip("-").isdigit() else None
        rows = self.spark.read.schema(df.schema).parquet(place).count()
        self._commit(name, attempt, number, [], rows)
        return True

    def read(self, batch_id=None, before: int | None = None) -> DataFrame:
        """Rows of all batches, of one, or of those numbered below ``before``; the column ``batch_id`` names theirs.

        An empty log has no schema to give, so reading it is an error; see :meth:`empty`.
        """
        wanted = self._live()
        if batch_id is not None:
            wanted = wanted.filter(F.col("batch") == str(batch_id))
        if before is not None:
            wanted = wanted.filter(F.col("number") < before)
        rows = self.spark.read.parquet(self.path)
        wanted = wanted.select(F.concat(F.lit("b"), "batch").alias("batch"), "attempt", F.col("batch").alias("batch_id"))
        return rows.join(wanted, ["batch", "attempt"]).drop("batch", "attempt")

    def empty(self) -> bool:
        return self._live().isEmpty()

    def numbers(self) -> DataFrame:
        """``batch_id, number, rows`` of every batch that readers see."""
        return self._live().select(F.col("batch").alias("batch_id"), "number", "rows")

    def fold(self, combine: Callable[[DataFrame], DataFrame]) -> int:
        """Replace all batches by one that holds ``combine`` of their rows; returns how many it stands for.

        The new batch takes the highest number and counts at the moment its commit is written, which also takes the
        others out of sight; a run that dies before that has changed nothing.  Their files stay for running readers
        until :meth:`vacuum`.
        """
        old = self._live().select("batch", "number").collect()
        if len(old) < 2:
            return 0
        top = max((r.number for r in old if r.number is not None), default=None)
        name, attempt = f"fold-{uuid.uuid4().hex}", f"a{uuid.uuid4().hex}"
        target = f"{self.path}/batch=b{name}/attempt={attempt}"
        rows = combine(self.read()).drop("batch_id")
        rows.write.parquet(target)
        self._commit(name, attempt, top, sorted(r.batch for r in old), self.spark.read.schema(rows.schema).parquet(target).count())
        return len(old)

    def vacuum(self) -> int:
        """Delete files that no reader can see any more: folded batches and attempts that did not count.  Run it when no
        reader that began before the last fold and no writer is active; returns the number of folders deleted."""
        live = {(f"batch=b{r.batch}", f"attempt={r.attempt}") for r in self._live().select("batch", "attempt").collect()}
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system, deleted = place.getFileSystem(self.spark._jsc.hadoopConfiguration()), 0
        for batch in system.listStatus(place):
            if not batch.getPath().getName().startswith("batch="):
                continue
            attempts = [a.getPath() for a in system.listStatus(batch.getPath())]
            for attempt in attempts:
                if (batch.getPath().getName(), attempt.getName()) not in live:
                    deleted += bool(system.delete(attempt, True))
            if not len(system.listStatus(batch.getPath())):
                system.delete(batch.getPath(), True)
        return deleted


def newest(rows: DataFrame, log: BatchLog, keys: Sequence[str]) -> DataFrame:
    """Of rows read from ``log``, those of each key's batch with the highest number; NULL is a key."""
    numbered = rows.join(log.numbers().select("batch_id", "number"), "batch_id")
    top = Window.partitionBy(*keys).orderBy(F.col("number").desc())
    return numbered.withColumn("_rank", F.rank().over(top)).filter("_rank = 1").drop("_rank", "number")

"""Task state of a stream that runs for ever: what has ended leaves it, and each batch rewrites a bounded part.

A :class:`RollingPhaseTable` deals tasks to buckets. Batch N writes its changes and rolls bucket N mod ``buckets``: the
bucket's last base and the changes since become its new base. So a bucket is rewritten once in ``buckets`` batches, one
in each batch, and a reader opens one base for each bucket and the changes of as many batches, however old the table is.

Time is that of the events: the clock of a batch is the newest change of all earlier ones. A task that ended more than
``keep`` before it leaves the state when its bucket is rolled; its row goes to the archive beside the table. From then on

* an event of a task the state does not know is late if it is not newer than clock - ``keep``: it is put aside, in the
  folder of late events, and changes nothing. A repeated event of an archived task does not start it again;
* a newer event of an archived task is one of a new run.

``states`` is the state of all tasks ever seen. There the first end of a task counts, as in one batch over all events.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetplan import schemas as S
from fleetplan.session import numbered_folders, path_exists, remove
from fleetplan.streaming.phases import TASK, PhaseTable

BUCKETS = 16
#: Before all batches.
NEVER = -(2**31)


class Rolled:
    """Folders of a table that is rolled bucket by bucket: changes by batch, and the last base of each bucket.

    A table has ``spark``, ``path``, ``schema`` (with ``batch``), ``buckets`` and ``KEY``, the columns that make its key.
    """

    KEY = TASK
    buckets = BUCKETS

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.KEY), F.lit(self.buckets)).cast("int")

    def _rolls(self, before: int | float) -> dict[int, int]:
        """The batch in which each bucket was rolled last."""
        taken = sorted(n for n in numbered_folders(self.spark, f"{self.path}-base", "roll") if n < before)
        return {n % self.buckets: n for n in taken}

    def _oldest(self, rolls: dict[int, int]) -> int:
        """Changes up to this batch are in the bases."""
        return min(rolls.values()) if len(rolls) == self.buckets else -1

    def _parts(self, before: int | float, rolled_before: int | float) -> tuple[dict[int, int], list[int]]:
        """The rolls and the batches that make the state: batches before one number on rolls before another."""
        rolls = self._rolls(rolled_before)
        return rolls, sorted(n for n in numbered_folders(self.spark, self.path, "batch") if self._oldest(rolls) < n < before)

    def folders(self, before_batch: int | None = None) -> list[str]:
        limit = float("inf") if before_batch is None else before_batch
        rolls, batches = self._parts(limit, limit)
        return [f"{self.path}-base/roll={n}" for n in sorted(rolls.values())] + [f"{self.path}/batch={n}" for n in batches]

    def log(self, before_batch: int | None = None) -> DataFrame:
        limit = float("inf") if before_batch is None else before_batch
        return self._rows(*self._parts(limit, limit))

    def _rows(self, rolls: dict[int, int], batches: list[int]) -> DataFrame:
        read = self.spark.read.schema(self.schema)
        rows = read.parquet(*[f"{self.path}/batch={n}" for n in batches]) if batches else self.spark.createDataFrame([], self.schema)
        if not rolls:
            return rows
        rolled = F.get(F.array(*[F.lit(rolls.get(b, NEVER)) for b in range(self.buckets)]), self._bucket())
        return rows.where(F.col("batch") > rolled).unionByName(read.parquet(*[f"{self.path}-base/roll={n}" for n in rolls.values()]))

    def _mine(self, batch: int) -> DataFrame:
        """The rows of the bucket that a batch rolls, its own among them. On earlier rolls alone: a batch that is run
        again finds its own roll, from which what has ended is gone."""
        return self._rows(*self._parts(batch + 1, batch)).where(self._bucket() == batch % self.buckets)

    def _prune(self, before: int) -> None:
        """Remove what no reader needs that began after batch ``before``, nor a batch from there on that is run again."""
        rolls = self._rolls(before)
        needed = set(rolls.values())
        for n in numbered_folders(self.spark, f"{self.path}-base", "roll"):
            if n < before and n not in needed:
                remove(self.spark, f"{self.path}-base/roll={n}")
        for n in numbered_folders(self.spark, self.path, "batch"):
            if n <= self._oldest(rolls):
                remove(self.spark, f"{self.path}/batch={n}")


class RollingPhaseTable(Rolled, PhaseTable):
    """Phases of the tasks that have not ended, or not long ago."""

    def __init__(self, spark, path: str, id_type: str = "bigint", keep: timedelta = timedelta(days=1), buckets: int = BUCKETS):
        super().__init__(spark, path, id_type)
        self.keep = keep
        self.buckets = buckets
        self._clock: tuple[int, object] | None = None

    def horizon(self, batch: int):
        """Changes up to this time are old for ``batch``; None before the first change."""
        if self._clock is None or self._clock[0] != batch:
            self._clock = (batch, self.log(batch).agg(F.max("changed_at")).first()[0])
        newest = self._clock[1]
        return None if newest is None else newest - self.keep

    def on_time(self, events: DataFrame, known: DataFrame, batch: int) -> DataFrame:
        """The events without late ones, which are put aside under the batch."""
        horizon = self.horizon(batch)
        if horizon is None:
            return events
        old = F.col("ts") <= F.lit(horizon)
        late = events.where(old).join(known.select(*TASK), TASK, "left_anti").select(events.columns)
        late.write.mode("overwrite").parquet(f"{self.path}-late/batch={batch}")
        return events.where(~old).unionByName(events.where(old).join(known.select(*TASK), TASK, "left_semi").select(events.columns))

    def write(self, changes: DataFrame, batch: int) -> None:
        rows = changes.select(*TASK, *self.BODY, F.lit(batch).cast("bigint").alias("batch"))
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        self._roll(batch)
        self._prune(batch - self.buckets)

    def _roll(self, batch: int) -> None:
        horizon = self.horizon(batch)
        last = F.max_by(F.struct(*self.BODY, "batch"), F.col("batch")).alias("l")
        state = self._mine(batch).groupBy(*TASK).agg(last).select(*TASK, "l.*")
        gone = F.lit(False) if horizon is None else F.col("phase").isin(S.SUCCEEDED, S.FAILED) & (F.col("changed_at") <= F.lit(horizon))
        # the archive first: a task is in both for a moment, but never in neither
        if horizon is not None:
            state.where(gone).write.mode("overwrite").parquet(f"{self.path}-ended/batch={batch}")
        state.where(~F.coalesce(gone, F.lit(False))).write.mode("overwrite").parquet(f"{self.path}-base/roll={batch}")

    def ended(self) -> DataFrame:
        """The archive: the first end of each task that has left the state."""
        folder = f"{self.path}-ended"
        if not path_exists(self.spark, folder):
            return self.spark.createDataFrame([], self.schema).drop("batch")
        first = F.min_by(F.struct(*self.BODY), F.col("batch")).alias("e")
        return self.spark.read.schema(self.schema).parquet(f"{folder}/batch=*").groupBy(*TASK).agg(first).select(*TASK, "e.*")

    def states(self) -> DataFrame:
        """Every task ever seen: wf_id, task_name, phase, changed_at."""
        old = self.ended().select(*TASK, F.struct(*self.BODY).alias("old"))
        new = self.current().select(*TASK, F.struct(*self.BODY).alias("new"))
        return new.join(old, TASK, "full").select(*TASK, F.coalesce("old", "new").alias("s")).select(*TASK, "s.*")

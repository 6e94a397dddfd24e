"""Change streams on Structured Streaming: idempotent apply, gap-free consumption, scope and lag."""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from ..operators import changes as ops
from ..sources import sinks


class Target:
    """A keyed table under a path whose versions are whole: version and batch are committed together by one small file.

    A batch that was committed is not applied again, so a stream that restarts gives the same table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str]):
        if not key:
            raise Refused("a target needs a key")
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def _commits(self) -> tuple[int, dict]:
        """(number of commits, the last one)."""
        n = 0
        while sinks.exists(self.spark, f"{self.path}/commit-{n + 1:08d}.json"):
            n += 1
        return n, json.loads(sinks.read_text(self.spark, f"{self.path}/commit-{n:08d}.json")) if n else {"batch": -1}

    def read(self) -> DataFrame:
        return self._table(self._commits()[1])

    def _table(self, commit: dict) -> DataFrame:
        if "version" not in commit:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{commit['version']}")

    def apply(self, changes: DataFrame, batch: int, transactions: bool = False) -> bool:
        """Applies a batch once; False if it had been.

        With transactions, only what a commit (op C) ends is applied; rows behind the last commit are kept beside the version and
        come before the next batch, so that the table never shows a part of a transaction that the batches split.
        """
        n, last = self._commits()
        if batch <= last["batch"]:
            return False
        commit = {"batch": batch, "version": f"v-{n + 1:08d}"}
        if transactions:
            if "pending" in last:
                changes = self.spark.read.schema(changes.schema).parquet(f"{self.path}/{last['pending']}").unionByName(changes)
            end = changes.filter("op = 'C'").agg(F.max("seq")).first()[0]
            done = F.lit(False) if end is None else F.col("seq") <= end
            commit["pending"] = f"pending-{n + 1:08d}"
            changes.filter(~done).write.mode("overwrite").parquet(f"{self.path}/{commit['pending']}", compression="zstd")
            changes = changes.filter(done & (F.col("op") != "C"))
        ops.apply(self._table(last), changes, self.key).write.mode("overwrite").parquet(f"{self.path}/{commit['version']}", compression="zstd")
        sinks.write_text(self.spark, f"{self.path}/commit-{n + 1:08d}.json", json.dumps(commit))
        return True


def start(changes: DataFrame, target: Target, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, transactions: bool = False, **trigger):
    """Applies a streaming table of changes batch by batch; with transactions, each becomes visible when its commit has come."""
    def one(batch: DataFrame, number: int) -> None:
        target.apply(transform(batch) if transform else batch, number, transactions)

    writer = changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


class Pace:
    """The size of the next batch, by the 95th percentile of the latest batches' seconds: a step more below the target, half above it."""

    def __init__(self, target: float, least: int = 100, most: int = 1_000_000, step: int = 1000, window: int = 50):
        if not 0 < least <= most or step < 1 or window < 1:
            raise Refused("no such pace")
        self.target, self.least, self.most, self.step, self.size = target, least, most, step, least
        self.seconds: deque[float] = deque(maxlen=window)

    def percentile(self, p: float = 0.95) -> float | None:
        """By nearest rank; None before the first batch."""
        known = sorted(self.seconds)
        return known[max(0, math.ceil(p * len(known)) - 1)] if known else None

    def observe(self, seconds: float) -> int:
        """Takes a batch's seconds (a negative time is a clock's jump and counts as none) and gives the next size."""
        self.seconds.append(max(0.0, seconds))
        if self.percentile() > self.target:
            self.size = max(self.least, self.size // 2)
            self.seconds.clear()  # times of larger batches say nothing about smaller ones
        else:
            self.size = min(self.most, self.size + self.step)
        return self.size


class Frontier:
    """Which numbers of a log may be consumed: the run without a hole behind the last one.

    A hole is passed over only when the caller proves that no open transaction can still fill it: every number up to `settled` is
    final.  State is one number and is returned to be kept with the data.
    """

    def __init__(self, last: int = 0):
        self.last = last

    def take(self, log: DataFrame, column: str = "id", settled: int | None = None) -> DataFrame:
        start = max(self.last, settled if settled is not None else self.last)
        end = ops.contiguous(log.filter(F.col(column) > start), start, column).first()["frontier"]
        ready = log.filter((F.col(column) > self.last) & (F.col(column) <= end))
        self.last = end
        return ready


class Lanes:
    """Commits that finish out of order: how far all before are done, and the last commit at or before that.

    The driver holds only what lies behind the frontier.
    """

    def __init__(self, start: int = 0):
        self.frontier, self.done, self.commits = start, set(), []

    def finish(self, seq: int, commit: bool = False) -> None:
        if seq <= self.frontier or seq in self.done:
            return
        self.done.add(seq)
        if commit:
            self.commits.append(seq)
        while self.frontier + 1 in self.done:
            self.frontier += 1
            self.done.discard(self.frontier)

    def checkpoint(self) -> int | None:
        past = [c for c in self.commits if c <= self.frontier]
        if past:
            self.commits = [c for c in self.commits if c >= max(past)]
        return max(past, default=None)


def lanes(changes: DataFrame, key: list[str], n: int, other_unique: bool = False) -> DataFrame:
    """changes with lane: by table and key, or by table alone where another unique column could tie keys together."""
    image = F.coalesce("after", "before")
    parts = [F.col("table")] if other_unique else [F.col("table"), *[image[k] for k in key]]
    return changes.withColumn("lane", F.pmod(F.xxhash64(*parts), F.lit(n)).cast("int"))


def handoff(snapshot: DataFrame, changes: DataFrame, position: int, key: list[str]) -> DataFrame:
    """The table after a snapshot taken at a position and the changes behind it."""
    return ops.apply(snapshot, changes.filter(F.col("seq") > position), key)

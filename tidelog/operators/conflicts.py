"""Optimistic concurrency: timestamps, conflicts and the index watermark."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Conflict, KVError


def conflicting(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Transactions (txn_id) that read a key which was written after they began.

    reads: txn_id, read_ts, user_key; writes: user_key, commit_ts. Writes are
    reduced to the last commit of a key first, so a hot key is one row there."""
    last = writes.groupBy("user_key").agg(F.max("commit_ts").alias("last_ts"))
    hit = reads.join(last, "user_key").where(F.col("last_ts") > F.col("read_ts"))
    return hit.select("txn_id").distinct()


def cleanup(commits: DataFrame, horizon: int) -> DataFrame:
    """Commits that an open transaction may still conflict with."""
    return commits.where(F.col("commit_ts") > horizon)


def done_until(marks: DataFrame) -> DataFrame:
    """The highest index all of whose begun predecessors are done, from rows (idx, begun, done)."""
    sums = marks.groupBy("idx").agg(F.sum("begun").alias("begun"), F.sum("done").alias("done"))
    lowest = F.broadcast(sums.where("begun > done").agg(F.min("idx").alias("open_idx")))
    return sums.join(lowest).where(F.col("open_idx").isNull() | (F.col("idx") < F.col("open_idx"))).agg(F.coalesce(F.max("idx"), F.lit(0)).cast("long").alias("done_until"))


class WaterMark:
    """The same on the driver, for the timestamps of one store."""

    def __init__(self):
        self._open: dict[int, int] = {}
        self._pending: set[int] = set()
        self._done = self._last = 0
        self._changed = threading.Condition()

    def begin(self, *indices: int) -> None:
        with self._changed:
            for i in indices:
                self._open[i] = self._open.get(i, 0) + 1
                self._pending.add(i)
                self._last = max(self._last, i)

    def done(self, *indices: int) -> None:
        with self._changed:
            for i in indices:
                if i < self._done:
                    raise KVError(f"index {i} lies below {self._done}, which is done")
                self._open[i] = self._open.get(i, 0) - 1
                self._pending.add(i)
            while self._pending and self._open.get(low := min(self._pending), 0) <= 0:
                self._pending.discard(low)
                self._open.pop(low, None)
                self._done = max(self._done, low)
            self._changed.notify_all()

    def done_until(self) -> int:
        return self._done

    def set_done_until(self, i: int) -> None:
        with self._changed:
            self._done = i
            self._changed.notify_all()

    def last_index(self) -> int:
        return self._last

    def wait_for(self, i: int, timeout: float | None = None) -> bool:
        with self._changed:
            return self._changed.wait_for(lambda: self._done >= i, timeout)


class Oracle:
    """Hands out read and commit timestamps and keeps what later commits are checked against."""

    def __init__(self, managed: bool = False, detect: bool = True, next_ts: int = 1):
        self.managed, self.detect, self.next_ts = managed, detect, next_ts
        self.discard_ts = self.last_cleanup = 0
        self.committed: dict[int, set[bytes]] = {}
        self.reads, self.commits = WaterMark(), WaterMark()
        self.reads.set_done_until(next_ts - 1)
        self.commits.set_done_until(next_ts - 1)
        self._lock = threading.RLock()

    def read_ts(self) -> int:
        """The last commit timestamp; waits until everything up to it is applied."""
        if self.managed:
            raise KVError("a managed store takes its read timestamps from the caller")
        with self._lock:
            ts = self.next_ts - 1
            self.reads.begin(ts)
        self.commits.wait_for(ts)
        return ts

    def has_conflict(self, read_ts: int, reads: set[bytes]) -> bool:
        return any(ts > read_ts and not reads.isdisjoint(keys) for ts, keys in self.committed.items())

    def commit_ts(self, read_ts: int, reads: set[bytes], writes: set[bytes], wanted: int = 0) -> int:
        """A timestamp for a commit, or Conflict."""
        with self._lock:
            if self.detect and self.has_conflict(read_ts, reads):
                raise Conflict("a key that was read has been written since")
            if self.managed:
                ts = wanted
                if ts < self.last_cleanup:
                    raise KVError(f"commit timestamp {ts} lies below {self.last_cleanup}, which is cleaned up")
            else:
                self.done_read(read_ts)
                self.clean()
                ts = self.next_ts
                self.next_ts += 1
                self.commits.begin(ts)
            if self.detect and writes:
                self.committed[ts] = self.committed.get(ts, set()) | writes
            return ts

    def forget(self, ts: int) -> None:
        """A commit that came to nothing leaves no keys behind."""
        with self._lock:
            self.committed.pop(ts, None)

    def done_commit(self, ts: int) -> None:
        if not self.managed:
            self.commits.done(ts)

    def done_read(self, ts: int) -> None:
        if not self.managed:
            self.reads.done(ts)

    def set_discard_ts(self, ts: int) -> None:
        with self._lock:
            self.discard_ts = ts
            self.clean()

    def discard_at_or_below(self) -> int:
        return self.discard_ts if self.managed else self.reads.done_until()

    def clean(self) -> None:
        with self._lock:
            horizon = self.discard_at_or_below()
            if horizon > self.last_cleanup:
                self.last_cleanup = horizon
                self.committed = {ts: k for ts, k in self.committed.items() if ts > horizon}

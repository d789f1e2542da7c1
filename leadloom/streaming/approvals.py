"""Approval of previewed batches as a stream: each is approved once, within its time to live, or expires.

State of a batch: when it was previewed last and when it was approved. A timer at the end of its time to live tells of
batches that nobody approved; the batch is remembered a while longer, so that a late approval is told why it comes to
nothing, and then forgotten, so state does not grow without end. Two senders that approve one batch meet in its state:
the first one gets it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, timedelta

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How long a preview may be approved, and how long an expired or approved batch is remembered after that.
TTL, REMEMBERED = timedelta(hours=24), timedelta(days=7)
VERDICTS = "batch string, event_id string, at timestamp, verdict string"
APPROVED, USED, EXPIRED, UNKNOWN, LAPSED = "approved", "already approved", "older than 24 h", "no such batch", "expired unapproved"

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BatchApproval(StatefulProcessor):
    """Verdicts of one batch's approvals, in the order of their times within a micro-batch."""

    def __init__(self, ttl: timedelta = TTL, remembered: timedelta = REMEMBERED):
        self.ttl, self.remembered = int(ttl.total_seconds() * 1_000_000), int(remembered.total_seconds() * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("batch", "created long, approved long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        held = self.state.get() if self.state.exists() else None
        created, approved = (held[0], held[1]) if held else (None, None)
        for r in sorted(rows, key=lambda r: (r.micros, r.kind == "approve", r.event_id)):
            if r.kind == "preview":
                # A new preview opens the batch anew; only its own end counts from now on.
                if created is not None:
                    self._forget_timers()
                created, approved = r.micros, None
                self.state.update((created, approved))
                self.handle.registerTimer(_millis(created + self.ttl))
                continue
            if created is None:
                verdict = UNKNOWN
            elif approved is not None:
                verdict = USED
            elif r.micros - created > self.ttl:
                verdict = EXPIRED
            else:
                verdict, approved = APPROVED, r.micros
                self.state.update((created, approved))
            yield Row(batch=key[0], event_id=r.event_id, at=r.at, verdict=verdict)

    def _forget_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        from datetime import datetime

        if not self.state.exists():
            return
        created, approved = self.state.get()[0], self.state.get()[1]
        end, now = created + self.ttl, expiredTimerInfo.getExpiryTimeInMs()
        if now >= _millis(end + self.remembered):
            self.state.clear()
            return
        self.handle.registerTimer(_millis(end + self.remembered))
        if approved is None:
            at = datetime.fromtimestamp(end // 1_000_000, UTC).replace(microsecond=end % 1_000_000)
            yield Row(batch=key[0], event_id=None, at=at, verdict=LAPSED)

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    """The first millisecond that is not before a time."""
    return -(-micros // 1000)


def approval_verdicts(events: DataFrame, delay: str = "1 hour", ttl: timedelta = TTL, remembered: timedelta = REMEMBERED) -> DataFrame:
    """(batch, event_id, at, verdict) of a stream of events (batch, event_id, kind, at).

    ``kind`` is preview or approve; other kinds, and rows without a batch or a time, are left out. Every approval gets a
    verdict: approved (once after each preview, within ``ttl``), already approved, older than 24 h, no such batch. A
    batch that the watermark finds unapproved at its end gets a row without an event. Events may come ``delay`` late.
    """
    # Timers and state of this kind are kept by this store.
    events.sparkSession.conf.set(_PROVIDER, _ROCKS)
    wanted = events.filter("batch is not null and at is not null and kind in ('preview', 'approve')").withWatermark("at", delay)
    rows = wanted.select("batch", "event_id", "kind", "at", F.unix_micros("at").alias("micros"))
    return rows.groupBy("batch").transformWithState(BatchApproval(ttl, remembered), VERDICTS, "Append", "eventTime")


def approvals_at_once(events: DataFrame, ttl: timedelta = TTL) -> DataFrame:
    """The verdicts of approvals over a whole table of events, by windows over each batch; lapsed batches are not told."""
    order = Window.partitionBy("batch").orderBy("at", F.col("kind") == "approve", "event_id")
    rows = events.filter("batch is not null and at is not null and kind in ('preview', 'approve')")
    rows = rows.withColumn("turn", F.count_if(F.col("kind") == "preview").over(order))
    turn = Window.partitionBy("batch", "turn")
    rows = rows.withColumn("created", F.max(F.when(F.col("kind") == "preview", F.col("at"))).over(turn))
    rows = rows.filter("kind = 'approve'").withColumn("first", F.row_number().over(turn.orderBy("at", "event_id")) == 1)
    rows = rows.withColumn("in_time", F.col("at") - F.col("created") <= F.lit(ttl))
    used = F.max(F.when(F.col("first"), F.col("in_time"))).over(turn)
    verdict = F.when(F.col("created").isNull(), UNKNOWN).when(F.col("first") & F.col("in_time"), APPROVED).when(used, USED).otherwise(EXPIRED)
    return rows.select("batch", "event_id", "at", verdict.alias("verdict"))

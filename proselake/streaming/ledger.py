"""The ledger of attempts as a stream: every key ends once, as accepted, rejected, or a dead letter.

An attempt that failed for other reasons than its result may be repeated: a key whose failures reach the limit, or that isn't
tried again in time, becomes a dead letter. Attempts wait in keyed state until the watermark has passed them, so that the order
in which they arrive within the delay doesn't matter; timers wake a key for its next attempt or at the end of its time. State
and timers are in the checkpoint: a stream that is killed and started again ends each key once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from proselake.streaming.state import key_of, named

ENDED = "key string, status string, failures int, ended timestamp"


class _Ledger(StatefulProcessor):
    def __init__(self, most_failures: int, retry_ms: int):
        self.most, self.retry = most_failures, retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, attempt long, outcome string")
        self.progress = handle.getValueState("progress", "failures int, last long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = [(int(r.at), int(r.attempt), r.outcome) for part in rows for r in part.itertuples() if isinstance(r.outcome, str)]
        ended = self.progress.exists() and self.progress.get()[2]
        got = [g for g in got if g[0] > timerValues.getCurrentWatermarkInMs()]
        if got and not ended:
            self.waiting.appendList(got)
            self.handle.registerTimer(min(g[0] for g in got))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, last, ended = self.progress.get() if self.progress.exists() else (0, -1, False)
        if ended:
            return
        mark, end = timerValues.getCurrentWatermarkInMs(), None
        waiting = sorted(set(self.waiting.get())) if self.waiting.exists() else []
        rest = [w for w in waiting if w[0] > mark]
        for at, _, outcome in (w for w in waiting if w[0] <= mark):
            if failures and at > last + self.retry:
                break
            if outcome != "error":
                end = (outcome, at)
                break
            failures, last = failures + 1, at
            if failures == self.most:
                end = ("exhausted", at)
                break
        if end is None and failures and mark > last + self.retry:
            end = ("expired", last + self.retry)
        self.progress.update((failures, last, end is not None))
        if end is not None:
            self.waiting.clear()
            yield pd.DataFrame({"key": [key[0]], "status": [end[0]], "failures": pd.array([failures], "int32"), "ended": pd.to_datetime([end[1]], unit="ms")})
            return
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(w[0] for w in rest))
        else:
            self.waiting.clear()
        if failures:
            self.handle.registerTimer(last + self.retry)

    def close(self) -> None:
        pass


def _millis(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def ledger_stream(attempts: DataFrame, most_failures: int = 3, retry: str = "2 days", delay: str = "1 day") -> DataFrame:
    """(key, status, failures, ended), a row when a key ends. attempts: key, attempt (a number, later ones larger), at, outcome.

    outcome is accepted, rejected or error. Attempts with a null key, time or outcome are left out but for the watermark that
    their time moves, and so are those that come after the watermark has passed them, repeats of an attempt, and whatever
    follows a key's end. Times count in milliseconds.
    """
    rows = attempts.withWatermark("at", delay).where("at IS NOT NULL")
    rows = rows.select(named("key").alias("key"), "attempt", F.when(F.col("key").isNotNull(), F.col("outcome")).alias("outcome"), F.col("at").alias("time"), F.unix_millis("at").alias("at"))
    ended = rows.groupBy("key").transformWithStateInPandas(_Ledger(most_failures, _millis(retry)), ENDED, "append", "EventTime")
    return ended.withColumn("key", key_of("key", attempts.schema["key"].dataType))


def ledger_batch(attempts: DataFrame, most_failures: int = 3, retry: str = "2 days") -> DataFrame:
    """The same rows from all attempts at once, once no more can come."""
    rows = attempts.where("key IS NOT NULL AND at IS NOT NULL AND outcome IS NOT NULL").dropDuplicates(["key", "attempt"]).withColumn("at", F.unix_millis("at"))
    w = Window.partitionBy("key").orderBy("at", "attempt", "outcome")
    error, due = F.col("outcome") == "error", F.col("at") + _millis(retry)
    rows = rows.withColumn("failures", F.sum(error.cast("int")).over(w).cast("int")).withColumn("next", F.lead("at").over(w)).withColumn("n", F.row_number().over(w))
    late = F.col("next").isNull() | (F.col("next") > due)
    end = F.when(~error, F.struct(F.col("outcome").alias("status"), F.col("at").alias("ended"))).when(F.col("failures") == most_failures, F.struct(F.lit("exhausted").alias("status"), F.col("at").alias("ended"))).when(late, F.struct(F.lit("expired").alias("status"), due.alias("ended")))
    first = rows.withColumn("end", end).where("end IS NOT NULL").groupBy("key").agg(F.min_by(F.struct("end", "failures"), "n").alias("f"))
    return first.select("key", "f.end.status", "f.failures", F.timestamp_millis("f.end.ended").alias("ended"))

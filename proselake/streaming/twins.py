"""Structured Streaming twins of batch operators; each gives the batch answer once all input has been seen."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from proselake.functions import text as T
from proselake.operators.dataset import is_single_line


def deduplicated(stream: DataFrame, text_col: str = "text", time_col: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Valid rows, one for each normalised key. With a time column, state older than the watermark is dropped."""
    rows = stream.where(is_single_line(text_col)).withColumn("key", T.dedup_key(text_col))
    if time_col is None:
        return rows.dropDuplicates(["key"])
    return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["key"])


def phrase_counts(stream: DataFrame, unit: str = "conv_id", turn: str = "turn", text_col: str = "text", n: int = 3, least: int = 2) -> DataFrame:
    """Running number of messages of a conversation that hold each n-word phrase."""
    s = stream.select(unit, turn, F.explode(T.sentences(text_col)).alias("s"))
    g = s.select(unit, turn, F.explode(T.ngrams(T.tokens("s"), n)).alias("g"))
    c = g.groupBy(unit, F.array_join("g", " ").alias("phrase")).agg(F.size(F.collect_set(turn)).alias("n_messages"))
    return c.where(F.col("n_messages") >= least)


def opener_windows(stream: DataFrame, time_col: str, text_col: str, wide: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """First words of sentences by event-time window; late rows within the watermark count."""
    s = stream.withWatermark(time_col, delay).select(time_col, F.explode(T.sentences(text_col)).alias("s"))
    return s.groupBy(F.window(time_col, wide), F.lower(F.element_at(F.split("s", r"\s+"), 1)).alias("opener")).agg(F.count(F.lit(1)).alias("n"))


def run_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], bool]) -> StreamingQuery:
    """Feed every micro-batch to `each` until it returns True; what was done is in the checkpoint and not done again."""
    state: dict[str, bool] = {}

    def step(batch: DataFrame, k: int) -> None:
        if not state.get("stop"):
            state["stop"] = bool(each(batch, k))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_resumable(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each row once, across restarts: the file sink's log and the checkpoint together leave no gaps and no repeats."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Aborted(Exception):
    """A stream that was stopped because partial input passes a bound already; carries the value that it is to return."""

    def __init__(self, value: float, batch: int):
        super().__init__(f"stopped in batch {batch} -> {value:+.3f}")
        self.value, self.batch = value, batch


class _Watch(StreamingQueryListener):
    """Adds up a query's observed metrics batch by batch and stops it once `bound` gives a value."""

    def __init__(self, metric: str, bound: Callable[[dict[str, float]], float | None], before: dict[str, float]):
        self.metric, self.bound, self.total, self.aborted, self.seen = metric, bound, before, None, set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = p.observedMetrics.get(self.metric)
        if row is None or self.aborted is not None or p.batchId in self.seen:  # a batch may be told twice
            return
        self.seen.add(p.batchId)
        for name, value in row.asDict().items():
            self.total[name] = self.total.get(name, 0) + (value or 0)
        value = self.bound(dict(self.total))
        if value is not None:
            self.aborted = Aborted(value, p.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_bounded(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], metrics: dict[str, Column], bound: Callable[[dict[str, float]], float | None], before: dict[str, float] | None = None) -> dict[str, float]:
    """Feed micro-batches to `each` while their observed metrics, summed so far, pass no bound; the sums if none is passed.

    The metrics are sums that Spark takes while a batch goes through, so nothing is read twice and no rows reach the driver.
    `bound` gets the sums after each batch: None goes on, a value ends the stream before its next batch and is raised in
    Aborted. `each` isn't called for later batches, and what they hold isn't marked as done in the checkpoint. before: the sums
    of an earlier run with this checkpoint.
    """
    spark, name = stream.sparkSession, f"observed_{uuid.uuid4().hex}"
    observed = stream.observe(name, *(c.alias(k) for k, c in metrics.items()))
    watch = _Watch(name, bound, dict(before or {}))

    def step(batch: DataFrame, k: int) -> None:
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
        if watch.aborted is not None:
            raise watch.aborted
        each(batch, k)

    spark.streams.addListener(watch)
    try:
        q = observed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except StreamingQueryException:
            if watch.aborted is None:
                raise
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(watch)
    if watch.aborted is not None:
        raise watch.aborted
    return watch.total

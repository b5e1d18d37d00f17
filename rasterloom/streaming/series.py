"""Series as streams: windowed statistics of events, running confusion counts and the exponential average, each with its state in the state store."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from rasterloom.operators.evaluation import COUNTS

#: Keyed state of more than one variable is kept by this provider alone.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed_statistics(events: DataFrame, at: str = "ts", by: str = "event_type", value: str = "value", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and greatest value of each key and time window; events later than the watermark are left out."""
    w = events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("top")).select(F.col("w.start").alias("start"), by, "n", "mean", "top")


def written(rows: DataFrame, out: str, every: str | None = None) -> StreamingQuery:
    """A stream's rows in the table ``out``/rows, each once; takes what there is, then ends, or looks for more ``every`` so long until it is stopped."""
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return rows.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(**trigger).start()


def with_state(rows: DataFrame, by: list[str], processor: StatefulProcessor, schema: StructType, time_mode: str = "None") -> DataFrame:
    """``processor`` for each key of a stream, with its state in the state store."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy(*by).transformWithStateInPandas(processor, schema, "Append", time_mode)


class Running(StatefulProcessor):
    """Sums of counts so far: a row a key and trigger that adds to it, with the number of rows in it."""

    def __init__(self, by: str, counts: list[str]):
        self.by, self.counts = by, counts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", ", ".join(f"{c} long" for c in [*self.counts, "trigger"]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = [int(x) for x in sum((d[self.counts].sum() for d in rows), pd.Series(0, self.counts))]
        old = self.sums.get() if self.sums.exists() else (0,) * (len(new) + 1)
        sums = tuple(int(a) + b for a, b in zip(old, [*new, 1], strict=True))
        self.sums.update(sums)
        yield pd.DataFrame([(*key, *sums)], columns=[self.by, *self.counts, "trigger"])


def running_counts(px: DataFrame, pred: Column, out: str, truth: str = "truth", by: str = "split") -> StreamingQuery:
    """Confusion counts of all pixels that have arrived, a row a key and trigger, in the table ``out``/rows; takes what there is, then ends.

    A task counts its own pixels before they are dealt by key, so a key's state gets a few rows from
    each task. The state is four counts a key; ``latest_counts`` reads the last of each.
    """
    kind = px.select(by).schema
    hit = [F.when(c, 1).otherwise(0).alias(n) for n, c in zip(COUNTS, _cases(pred, F.col(truth)), strict=True)]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby(by, dropna=False, as_index=False)[list(COUNTS)].sum()

    schema = StructType(kind.fields)
    for c in COUNTS:
        schema = schema.add(c, "long")
    few = px.select(by, *hit).mapInPandas(partial, schema)
    return written(with_state(few, [by], Running(by, list(COUNTS)), StructType(list(schema.fields)).add("trigger", "long")), out)


def _cases(pred: Column, truth: Column) -> list[Column]:
    return [{"tp": pred & truth, "fp": pred & ~truth, "fn": ~pred & truth, "tn": ~pred & ~truth}[c] for c in COUNTS]


def latest_counts(spark: SparkSession, out: str, by: str) -> DataFrame:
    """The counts of ``running_counts`` as they are now; ``by`` is the key's name and type."""
    rows = spark.read.schema(f"{by}, " + ", ".join(f"{c} long" for c in [*COUNTS, "trigger"])).parquet(f"{out}/rows")
    last = F.max_by(F.struct(*COUNTS), "trigger").alias("c")
    return rows.groupBy(by.split(" ")[0]).agg(last).select(by.split(" ")[0], "c.*")


class Average(StatefulProcessor):
    """The exponential average of a series whose steps run from 1; a step that comes early waits for those before it.

    After ``patience`` milliseconds without a missing step a timer lets the average go on from the next
    step there is. A step that comes when its place has passed is left out.
    """

    def __init__(self, names: list[str], order: str, value: str, beta: float, patience: int | None):
        self.names, self.order, self.value, self.beta, self.patience = names, order, value, beta, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "step long, average double")
        self.waiting = handle.getListState("waiting", "step long, value double")

    def _advance(self, key: tuple, heap: list, step: int, average: float, skip: bool = False) -> tuple[pd.DataFrame, int, float]:
        """What follows the last step without a gap (a first gap may be skipped)."""
        out = []
        while heap and (heap[0][0] <= step + 1 or skip):
            at, x = heapq.heappop(heap)
            if at > step:
                average = x if step == 0 else self.beta * average + (1 - self.beta) * x
                step, skip = at, False
                out.append((*key, step, average))
        return pd.DataFrame(out, columns=self.names), step, average

    def _leave(self, heap: list, step: int, average: float, timerValues: object) -> None:
        self.now.update((step, average))
        if heap:
            self.waiting.put([(int(a), float(b)) for a, b in heap])
            if self.patience is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        else:
            self.waiting.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        step, average = self.now.get() if self.now.exists() else (0, 0.0)
        heap = [(int(a), float(b)) for a, b in self.waiting.get()] if self.waiting.exists() else []
        heapq.heapify(heap)
        for batch in rows:
            for pair in sorted(zip(batch[self.order].tolist(), batch[self.value].tolist(), strict=True)):
                heapq.heappush(heap, pair)
            out, step, average = self._advance(key, heap, step, average)
            if len(out):
                yield out
        self._leave(heap, step, average, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        step, average = self.now.get()
        heap = [(int(a), float(b)) for a, b in self.waiting.get()] if self.waiting.exists() else []
        heapq.heapify(heap)
        out, step, average = self._advance(key, heap, step, average, skip=True)
        if len(out):
            yield out
        self._leave(heap, step, average, timerValues)


def running_average(rows: DataFrame, by: list[str], order: str, value: str, beta: float = 0.99, patience: int | None = None) -> DataFrame:
    """The exponential average of each series of a stream as its rows arrive, in any order: by, order, average.

    ``order`` runs from 1 without gaps. The state of a series is its last step and average, and the
    rows that came before their turn.
    """
    few = rows.select(*by, F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value))
    schema = StructType(few.select(*by, order).schema.fields).add("average", "double")
    return with_state(few, by, Average([*by, order, "average"], order, value, beta, patience), schema, "None" if patience is None else "ProcessingTime")


def streaming_average(rows: DataFrame, by: list[str], order: str, value: str, out: str, beta: float = 0.99, patience: int | None = None) -> StreamingQuery:
    """``running_average`` in the table ``out``/rows; takes what there is, then ends. With ``patience`` it goes on, as timers need later triggers, until it is stopped."""
    return written(running_average(rows, by, order, value, beta, patience), out, None if patience is None else "1 second")

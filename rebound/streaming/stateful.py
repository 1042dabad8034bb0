"""Stream operators on typed state with timers (S2, S6), and drift inside the stream.

``label_stream`` and ``dedup_stream`` keep their state in the state store's own
value and list variables, not in a row that is read and written whole: retries
that come before their decline are appended to a list that the store spills to
disk and are read back once, in order of arrival.  A timer at the end of each
horizon emits and clears the key, so state is bounded by the open keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rebound import config as C
from rebound.streaming.streams import as_event_time, sliding_bucket_counts

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Typed state needs the state store that keeps its data on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _ms(column: pd.Series) -> np.ndarray:
    return column.astype("datetime64[ms]").astype("int64").to_numpy()


class _Labels(StatefulProcessor):
    """A decline's time, its retries inside the horizon, and the retries that wait for a decline."""

    def __init__(self, horizon_ms: int):
        self.horizon = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.decline = handle.getValueState("decline", T.StructType().add("ms", T.LongType()))
        self.counted = handle.getValueState("counted", T.StructType().add("n", T.LongType()).add("ok", T.BooleanType()))
        self.waiting = handle.getListState("waiting", T.StructType().add("ms", T.LongType()).add("ok", T.BooleanType()))

    def _count(self, start: int, ms: np.ndarray, ok: np.ndarray) -> tuple[int, bool]:
        inside = (ms >= start) & (ms <= start + self.horizon)
        return int(inside.sum()), bool((inside & ok).any())

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = self.decline.get()[0] if self.decline.exists() else None
        n, ok = self.counted.get() if self.counted.exists() else (0, False)
        known, latest = start, None
        for pdf in rows:
            ms, is_decline = _ms(pdf["ts"]), (pdf["kind"] == "d").to_numpy()
            if is_decline.any():
                first = int(ms[is_decline].min())
                start = first if start is None else min(start, first)
            retry_ms, retry_ok = ms[~is_decline], (pdf["ok"] == True).to_numpy()[~is_decline]  # noqa: E712 - NULL is no success
            if known is not None:  # the decline came in an earlier batch
                more, won = self._count(start, retry_ms, retry_ok)
                n, ok = n + more, ok or won
            elif len(retry_ms):
                self.waiting.appendList([(int(t), bool(g)) for t, g in zip(retry_ms, retry_ok)])
                latest = max(int(retry_ms.max()), latest or 0)
        if start is None:
            if latest is not None:  # retries alone: kept until no decline could claim them
                self._timer(max([latest + self.horizon + 1, *self.handle.listTimers()]))
            return iter([])
        if known is None and self.waiting.exists():
            for t, good in self.waiting.get():
                more, won = self._count(start, np.array([t]), np.array([good]))
                n, ok = n + more, ok or won
            self.waiting.clear()
        self.decline.update((start,))
        self.counted.update((n, ok))
        self._timer(start + self.horizon + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.decline.exists():  # orphan retries go without a row
            n, ok = self.counted.get()
            yield pd.DataFrame({"transaction_id": [key[0]], "retries_within_horizon": [n], "recovered_within_horizon": [bool(ok)]})
        for state in (self.decline, self.counted, self.waiting):
            state.clear()

    def close(self) -> None:
        pass


def label_stream(declines: DataFrame, retries: DataFrame, horizon_hours: int = 720, id_col: str = "transaction_id",
                 link: str = "original_transaction_id", d_ts: str = "timestamp", r_ts: str = "retry_ts", status: str = "auth_status",
                 watermark: str = "1 day") -> DataFrame:
    """One label row per decline once its horizon has passed, whatever the order in which decline and retries arrive."""
    use_state_store(declines.sparkSession)
    id_type = declines.schema[id_col].dataType
    named = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    d = as_event_time(declines, d_ts).where(named(id_col)).select(
        F.col(id_col).alias("key"), F.col(d_ts).alias("ts"), F.lit("d").alias("kind"), F.lit(None).cast("boolean").alias("ok"))
    r = as_event_time(retries, r_ts).where(named(link)).select(
        F.col(link).cast(id_type).alias("key"), F.col(r_ts).alias("ts"), F.lit("r").alias("kind"), (F.col(status) == "APPROVED").alias("ok"))
    events = d.unionByName(r).where(F.col("ts").isNotNull()).withWatermark("ts", watermark)
    out = T.StructType([T.StructField("transaction_id", id_type), T.StructField("retries_within_horizon", T.LongType()),
                        T.StructField("recovered_within_horizon", T.BooleanType())])
    return events.groupBy("key").transformWithStateInPandas(_Labels(horizon_hours * 3_600_000), out, "append", "eventTime")


class _FirstKept(StatefulProcessor):
    """The time of the key's last kept event, until its horizon has passed."""

    def __init__(self, ts: str, id_col: str | None, columns: list[str], horizon_us: int):
        self.ts, self.id_col, self.columns, self.horizon = ts, id_col, columns, horizon_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType().add("us", T.LongType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        batch = pd.concat(list(rows), ignore_index=True)  # one key's rows of one micro-batch, to be put in order
        batch = batch.sort_values([self.ts, self.id_col] if self.id_col else [self.ts], kind="stable", ignore_index=True)
        us = batch[self.ts].astype("datetime64[us]").astype("int64").to_numpy()
        keep, i = [], 0
        while i < len(us):  # from one kept event straight to the next
            if last is not None and us[i] < last + self.horizon:
                i = int(us.searchsorted(last + self.horizon))
                continue
            keep.append(i)
            last = int(us[i])
        if keep:
            self.last.update((last,))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer((last + self.horizon) // 1000 + 1)
            yield batch.iloc[keep][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def dedup_stream(events: DataFrame, key: Sequence[str], ts: str, horizon_hours: int = 24, watermark: str = "1 hour",
                 id_col: str | None = None) -> DataFrame:
    """A kept event silences its key for the horizon, the first event at or after its end is kept again
    (``history.dedup_within`` for streams in event-time order)."""
    use_state_store(events.sparkSession)
    e = as_event_time(events, ts).where(F.col(ts).isNotNull()).withWatermark(ts, watermark)
    processor = _FirstKept(ts, id_col, e.columns, horizon_hours * 3_600_000_000)
    return e.groupBy(*key).transformWithStateInPandas(processor, e.schema, "append", "eventTime")


# ---------------------------------------------------------------- S5 / F7
def _psi(counts: Column, total: Column, shares: Sequence[float]) -> Column:
    """PSI of (bucket, n) structs against the baseline's shares; absent bins count 0."""
    def held(b: int) -> Column:
        return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + F.when(x["bucket"] == b, x["n"]).otherwise(0))

    out = F.lit(0.0)
    for b, share in enumerate(shares):
        n = held(b)
        ap, ep = F.greatest(n / total, F.lit(C.PSI_EPS)), max(float(share), C.PSI_EPS)
        out = out + (ap - F.lit(ep)) * F.log(ap / F.lit(ep))
    return out


def psi_stream(events: DataFrame, ts: str, value: str, edges: Sequence[float], shares: Sequence[float], length: str = "1 day",
               slide: str = "1 hour", watermark: str = "1 day", limit: float = C.PSI_ALERT_INVESTIGATE) -> DataFrame:
    """(window_start, window_end, rows, psi, alert) of every closed sliding window, in the stream itself.

    Two stateful aggregations in a chain: rows to counts per window and bin,
    then the counts of a window (one per bin) to its PSI.  Values outside the
    baseline's range count for no bin.
    """
    counts = sliding_bucket_counts(events, ts, value, edges, length, slide, watermark, keep_window=True).where(F.col("bucket").isNotNull())
    # a window's time is just before its end: one per slide, so a tumbling window of that length holds one sliding window
    g = counts.groupBy(F.window(F.window_time("w"), slide).alias("closed")).agg(
        F.first("w").alias("w"), F.sum("n").alias("rows"), F.collect_list(F.struct("bucket", "n")).alias("counts"))
    psi = _psi(F.col("counts"), F.col("rows"), shares)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "rows", psi.alias("psi"),
                    (psi > F.lit(limit)).alias("alert"))

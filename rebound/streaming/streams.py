"""Structured Streaming operators.

Each stream operator has a batch twin elsewhere in the library; the tests run
the stream with an ``availableNow`` trigger and compare with the twin.
Late data: rows behind the watermark are dropped by S2, S4, S5 and S6.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

DECLINE_EVENT_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("merchant_id", T.LongType()),
    T.StructField("merchant_vertical", T.StringType()),
    T.StructField("merchant_country", T.StringType()),
    T.StructField("processor_name", T.StringType()),
    T.StructField("amount_usd", T.DoubleType()),
    T.StructField("response_code", T.StringType()),
    T.StructField("is_soft_decline", T.BooleanType()),
])


# ---------------------------------------------------------------- I4
def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """I4: file-source stream with an explicit schema (no inference)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def read_kafka_declines(spark: SparkSession, servers: str, topic: str,
                        schema: T.StructType = DECLINE_EVENT_SCHEMA) -> DataFrame:
    """I4 on Kafka: JSON values parsed with ``from_json`` (needs the Kafka
    connector on the classpath; not available in the test image)."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).load())
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")


def as_event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need ``timestamp``, not ``timestamp_ntz``."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df


# ---------------------------------------------------------------- S1 / I5
def decision_payload(df: DataFrame, id_col: str = "transaction_id") -> DataFrame:
    """``{transaction_id, decision, confidence, value, explanation}`` as JSON."""
    expl = F.col("top_explanation_features") if "top_explanation_features" in df.columns else F.lit(None)
    return df.select(F.col(id_col).cast("string").alias("key"), F.to_json(F.struct(
        F.col(id_col).alias("transaction_id"), F.col("recommended_action").alias("decision"),
        F.col("confidence"), F.col("expected_value").alias("value"), expl.alias("explanation"))).alias("value"))


def score_stream(events: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stateless scoring of decline events: ``score`` is any batch
    DataFrame -> DataFrame decision function (stream-static joins only)."""
    return score(events)


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append",
                 available_now: bool = True, query_name: str | None = None) -> StreamingQuery:
    """Sink with a checkpoint in the shared folder (exactly-once file sink)."""
    w = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


# ---------------------------------------------------------------- S2
def dedup_stream(events: DataFrame, key: Sequence[str], ts: str, horizon: str = "24 hours") -> DataFrame:
    """First-wins dedup of a key within the horizon (state bounded by the watermark)."""
    return as_event_time(events, ts).withWatermark(ts, horizon).dropDuplicatesWithinWatermark(list(key))


# ---------------------------------------------------------------- S3
def validate_stream(events: DataFrame, broken_rules: Column, accepted_path: str, rejected_path: str,
                    checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """S3: rows with broken rules are written aside; the stream goes on.

    ``broken_rules`` is an ``array<string>`` column (empty when valid); each
    micro-batch is computed once and split by ``foreachBatch`` into one folder
    per epoch (``epoch=<id>``), which a retried batch replaces.
    """
    flagged = events.withColumn("broken_rules", broken_rules)

    def split(batch: DataFrame, epoch_id: int) -> None:
        ok = F.size("broken_rules") == 0
        held = batch.persist()
        try:
            held.where(ok).drop("broken_rules").write.mode("overwrite").parquet(f"{accepted_path}/epoch={epoch_id}")
            held.where(~ok).write.mode("overwrite").parquet(f"{rejected_path}/epoch={epoch_id}")
        finally:
            held.unpersist()

    w = flagged.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


# ---------------------------------------------------------------- S4
def monitor_counts(events: DataFrame, ts: str, counts: dict[str, Column], window: str = "1 minute",
                   watermark: str = "10 minutes") -> DataFrame:
    """Per-window monitoring counts (append mode emits closed windows, T25)."""
    e = as_event_time(events, ts).withWatermark(ts, watermark)
    return (e.groupBy(F.window(ts, window).alias("w"))
            .agg(F.count(F.lit(1)).alias("events"), *[F.count_if(c).alias(n) for n, c in counts.items()])
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events",
                    *counts))


# ---------------------------------------------------------------- S5 / F7
def sliding_bucket_counts(events: DataFrame, ts: str, value: str, edges: Sequence[float],
                          length: str = "1 day", slide: str = "1 hour", watermark: str = "1 day",
                          keep_window: bool = False) -> DataFrame:
    """Counts per (sliding window, baseline bin); PSI per window follows
    from these counts and the baseline shares (``rebound.operators.drift``).
    ``keep_window`` keeps the window itself (``w``) for a further aggregation."""
    arr = F.array(*[F.lit(float(x)) for x in edges])
    v = F.col(value)
    le = F.size(F.filter(arr, lambda x: x <= v))
    b = (F.when((v < F.lit(float(edges[0]))) | (v > F.lit(float(edges[-1]))), F.lit(None))
         .when(v == F.lit(float(edges[-1])), F.lit(len(edges) - 2)).otherwise(le - 1))
    e = as_event_time(events, ts).withWatermark(ts, watermark)
    return (e.where(v.isNotNull()).groupBy(F.window(ts, length, slide).alias("w"), b.alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(*(["w"] if keep_window else []), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "bucket", "n"))


# ---------------------------------------------------------------- S6
def close_retry_chains(declines: DataFrame, retries: DataFrame, horizon_hours: int = 720,
                       id_col: str = "transaction_id", link: str = "original_transaction_id",
                       d_ts: str = "timestamp", r_ts: str = "retry_ts", watermark: str = "1 day") -> DataFrame:
    """Watermarked left-outer stream-stream join of declines to their
    retries inside the horizon; a decline without a retry is emitted once the
    watermark passes its horizon."""
    d = as_event_time(declines, d_ts).withWatermark(d_ts, watermark).alias("d")
    r = as_event_time(retries, r_ts).withWatermark(r_ts, watermark).alias("r")
    cond = ((F.col(f"d.{id_col}") == F.col(f"r.{link}"))
            & (F.col(f"r.{r_ts}") >= F.col(f"d.{d_ts}"))
            & (F.col(f"r.{r_ts}") <= F.col(f"d.{d_ts}") + F.expr(f"INTERVAL {horizon_hours} HOURS")))
    return d.join(r, cond, "leftOuter")


# ---------------------------------------------------------------- S6 labels (stateful)
LABEL_STATE = "dts long, n long, ok boolean, pend_ts array<long>, pend_ok array<boolean>"


def label_stream(declines: DataFrame, retries: DataFrame, horizon_hours: int = 720,
                 id_col: str = "transaction_id", link: str = "original_transaction_id",
                 d_ts: str = "timestamp", r_ts: str = "retry_ts", status: str = "auth_status",
                 watermark: str = "1 day") -> DataFrame:
    """One label row per decline once its horizon has passed.

    Declines and retries are unioned on the decline key and folded by
    ``applyInPandasWithState``: the state holds the decline time, the number
    of retries inside [t, t + horizon] and whether one was approved.  An
    event-time timeout at t + horizon emits the label and drops the state, so
    state is bounded by the declines still open.  Retries that arrive before
    their decline wait in the state until it arrives.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    horizon_ms = horizon_hours * 3_600_000
    id_type = declines.schema[id_col].dataType
    label_schema = T.StructType([T.StructField("transaction_id", id_type),
                                 T.StructField("retries_within_horizon", T.LongType()),
                                 T.StructField("recovered_within_horizon", T.BooleanType())])
    named = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    d = as_event_time(declines, d_ts).where(named(id_col)).select(
        F.col(id_col).alias("key"), F.col(d_ts).alias("ts"), F.lit("d").alias("kind"),
        F.lit(None).cast("boolean").alias("ok"))
    # retries without a link belong to no decline: they must not gather in one state
    r = as_event_time(retries, r_ts).where(named(link)).select(
        F.col(link).cast(id_type).alias("key"), F.col(r_ts).alias("ts"), F.lit("r").alias("kind"),
        (F.col(status) == "APPROVED").alias("ok"))
    events = d.unionByName(r).withWatermark("ts", watermark)

    def fold(key, pdfs, state):
        if state.hasTimedOut:
            dts, n, ok, _, _ = state.get
            state.remove()
            if dts is not None:            # orphan retries (no decline) are dropped
                yield pd.DataFrame({"transaction_id": [key[0]], "retries_within_horizon": [n],
                                    "recovered_within_horizon": [bool(ok)]})
            return
        dts, n, ok, pend_ts, pend_ok = state.get if state.exists else (None, 0, False, [], [])
        pend_ts, pend_ok = list(pend_ts or []), list(pend_ok or [])
        for pdf in pdfs:
            ms = (pdf["ts"].astype("int64") // 1_000_000).tolist()
            for t, kind, good in zip(ms, pdf["kind"].tolist(), pdf["ok"].tolist()):
                if kind == "d":
                    dts = t if dts is None else min(dts, t)
                else:
                    pend_ts.append(t)
                    pend_ok.append(bool(good))
        if dts is not None:
            # fold waiting retries into the counters; outside the horizon they do not count
            for t, good in zip(pend_ts, pend_ok):
                if dts <= t <= dts + horizon_ms:
                    n += 1
                    ok = ok or good
            state.update((dts, n, ok, [], []))
            state.setTimeoutTimestamp(dts + horizon_ms + 1)
        else:
            state.update((None, n, ok, pend_ts, pend_ok))
            state.setTimeoutTimestamp(max(pend_ts) + horizon_ms + 1)

    return events.groupBy("key").applyInPandasWithState(
        fold, label_schema, LABEL_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def dedup_stream_sliding(events: DataFrame, key: Sequence[str], ts: str, horizon_hours: int = 24,
                         watermark: str = "1 hour", id_col: str | None = None) -> DataFrame:
    """S2, exact twin of ``history.dedup_within`` for streams in event-time
    order: a kept event silences its key for the horizon, [t, t + h), and the
    first event at or after its end is kept again.  The state per key is the
    time of the last kept event, expired when its horizon has passed.  Of
    events at one time in a batch the one of smallest ``id_col`` is kept."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    h_us = horizon_hours * 3_600_000_000
    e = as_event_time(events, ts).withWatermark(ts, watermark)
    cols = e.columns
    out_schema = e.schema

    def fold(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        (last,) = state.get if state.exists else (None,)
        batch = pd.concat(list(pdfs), ignore_index=True)
        batch = batch.sort_values([ts, id_col] if id_col else [ts], kind="stable", ignore_index=True)
        us = batch[ts].astype("datetime64[us]").astype("int64").to_numpy()
        keep, i = [], 0
        while i < len(us):  # from one kept event straight to the next
            if last is not None and us[i] < last + h_us:
                i = int(us.searchsorted(last + h_us))
                continue
            keep.append(i)
            last = int(us[i])
        state.update((last,))
        state.setTimeoutTimestamp(max((last + h_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if keep:
            yield batch.iloc[keep][cols]

    return e.groupBy(*key).applyInPandasWithState(fold, out_schema, "last long", "append",
                                                  GroupStateTimeout.EventTimeTimeout)

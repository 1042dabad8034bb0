"""Typed-state streams, drift in the stream and the upsert sink against batch twins, also over restarts and replays."""
import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rebound import config as C
from rebound.operators import drift, history
from rebound.plans import fixture as fx
from rebound.streaming import stateful as ST
from rebound.streaming import streams as S
from rebound.streaming import upsert as U

T0 = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)


@pytest.fixture(autouse=True)
def own_state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    yield
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _dir(name):
    return tempfile.mkdtemp(prefix=f"rebound-{name}-")


def add_file(spark, rows, schema, folder, n):
    """One file, the nth in order of time."""
    p = _dir("one")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(p)
    f = [x for x in os.listdir(p) if x.endswith(".parquet")][0]
    to = os.path.join(folder, f"part-{n:02d}.parquet")
    os.link(os.path.join(p, f), to)
    os.utime(to, (1_700_000_000 + n, 1_700_000_000 + n))


D_SCHEMA = "transaction_id long, timestamp timestamp"
R_SCHEMA = "original_transaction_id long, retry_ts timestamp, auth_status string"


def test_labels_over_a_restart_with_late_and_early_retries(spark):
    """Three runs from one checkpoint: retries before their decline, after it, outside the horizon, of nobody, and without a time."""
    d, r, out, ck = (_dir(f"lab-{x}") for x in "drok")
    runs = [([(1, T0)], [(2, T0 + 30 * H, "APPROVED"), (1, T0 + 2 * H, "DECLINED"), (9, T0 + H, "APPROVED"), (1, None, "APPROVED")]),
            ([(2, T0 + 26 * H), (3, T0 + 27 * H), (2, T0 + 26 * H)], [(1, T0 + 7 * H, "APPROVED"), (1, T0 + 3 * H, "APPROVED"), (3, T0 + 26 * H, "APPROVED"), (2, T0 + 800 * H, "APPROVED")]),
            ([(4, T0 + 2000 * H)], [(None, T0, "APPROVED"), (4, T0 + 2001 * H, "APPROVED")])]
    for n, (dec, ret) in enumerate(runs):
        add_file(spark, dec, D_SCHEMA, d, n)
        add_file(spark, ret, R_SCHEMA, r, n)
        ds, rs = S.read_stream(spark, d, spark.read.parquet(d).schema), S.read_stream(spark, r, spark.read.parquet(r).schema)
        S.write_stream(ST.label_stream(ds, rs), out, ck).awaitTermination()
    got = sorted(tuple(x) for x in spark.read.parquet(out).select("transaction_id", "retries_within_horizon", "recovered_within_horizon").collect())
    # decline 4 is still open; the retry of 3 came an hour before it; the one of 1 at 3 h is behind the watermark (30 h less a day)
    assert got == [(1, 2, True), (2, 1, True), (3, 0, False)]


def test_labels_on_the_fixture_equal_the_batch_twin(spark):
    import __spark_entry__ as E
    d, r, out, ck = (_dir(f"fix-{x}") for x in "drok")
    dec = fx.declines(spark, SF_SMALL).select("transaction_id", "timestamp").where("transaction_id % 4 = 0")
    ret = (fx.retries(spark, SF_SMALL).where("original_transaction_id % 4 = 0")
           .select("original_transaction_id", F.col("timestamp").alias("retry_ts"), "auth_status"))
    dec.write.mode("overwrite").parquet(d)
    ret.write.mode("overwrite").parquet(r)
    S.write_stream(ST.label_stream(S.read_stream(spark, d, spark.read.parquet(d).schema), S.read_stream(spark, r, spark.read.parquet(r).schema)), out, ck).awaitTermination()
    a = sorted(tuple(x) for x in spark.read.parquet(out).select("transaction_id", "retries_within_horizon", "recovered_within_horizon").collect())
    b = sorted(tuple(x) for x in E.queries()["horizon_labels"](spark, SF_SMALL).where("transaction_id % 4 = 0").collect())
    assert a == b and len(a) > 50


def test_dedup_over_a_restart_equals_the_batch_twin(spark):
    rng = random.Random(2)
    rows = sorted(((i, rng.choice("ab"), T0 + dt.timedelta(minutes=rng.randrange(9000))) for i in range(60)), key=lambda r: r[2])
    src, out, ck = (_dir(f"ded-{x}") for x in "sok")
    schema = "id long, k string, ts timestamp"
    for n in range(3):
        add_file(spark, rows[20 * n:20 * n + 20], schema, src, n)
        if n:  # the first run takes two files, the second one more from the same checkpoint
            stream = S.read_stream(spark, src, spark.read.parquet(src).schema, max_files_per_trigger=1)
            S.write_stream(ST.dedup_stream(stream, ["k"], "ts", id_col="id"), out, ck).awaitTermination()
    got = sorted(r["id"] for r in spark.read.parquet(out).collect())
    twin = sorted(r["id"] for r in history.dedup_within(spark.createDataFrame(rows, schema), ["k"], "ts", "id").collect())
    assert got == twin and 5 < len(got) < 30


def test_psi_in_the_stream_equals_the_batch_twin(spark):
    ev = fx.events(spark, SF_SMALL, ["ts", "value"])
    src, out, ck = (_dir(f"psi-{x}") for x in "sok")
    ev.repartition(3).write.mode("overwrite").parquet(src)
    edges, shares = [0.0, 5.0, 20.0, 100.0, 500.0], [0.1, 0.2, 0.3, 0.4]
    stream = S.read_stream(spark, src, spark.read.parquet(src).schema)
    S.write_stream(ST.psi_stream(stream, "ts", "value", edges, shares, "1 day", "6 hours", "1 hour"), out, ck).awaitTermination()
    wm = ev.agg(F.max("ts")).first()[0] - H
    counts = (S.sliding_bucket_counts(ev, "ts", "value", edges, "1 day", "6 hours", "1 hour").where((F.col("window_end") <= F.lit(wm)) & F.col("bucket").isNotNull()))
    want = {r["window_start"]: (r["rows"], r["psi"]) for r in drift.psi_from_window_counts(counts, dict(enumerate(shares)), 4).collect()}
    got = spark.read.parquet(out).collect()
    assert len(got) == len(want) > 0
    for r in got:
        rows, psi = want[r["window_start"]]
        assert r["rows"] == rows and abs(r["psi"] - psi) < 1e-12 and r["alert"] == (psi > C.PSI_ALERT_INVESTIGATE)
        assert r["window_end"] - r["window_start"] == dt.timedelta(days=1)


U_SCHEMA = "id long, region string, at long, decision string"


def table(spark, path, epoch=None):
    return sorted((tuple(r[c] for c in ("id", "region", "at", "decision")) for r in U.read_table(spark, path, epoch).collect()), key=repr)


def newest(*batches):
    kept = {}
    for rows in batches:
        for r in rows:
            if (r[0], r[1]) not in kept or r[2] >= kept[r[0], r[1]][2]:
                kept[r[0], r[1]] = r
    return sorted(kept.values(), key=repr)


def test_upsert_keeps_the_newest_and_replays_change_nothing(spark):
    path, key, order = _dir("ups"), ["id", "region"], ["at"]
    one = [(1, "a", 5, "retry"), (2, "a", 5, "retry"), (2, None, 1, "abandon"), (None, None, 1, "retry")]
    two = [(1, "a", 4, "older"), (2, "a", 6, "abandon"), (3, "b", 1, "retry"), (2, None, 1, "same time, later epoch")]
    with pytest.raises(FileNotFoundError):
        U.read_table(spark, path)
    merge = lambda rows, e: U.merge_epoch(spark.createDataFrame(rows, U_SCHEMA), e, path, key, order, 8)
    merge(one, 0)
    assert table(spark, path) == newest(one)
    merge(two, 1)
    assert table(spark, path) == newest(one, two)
    merge(two, 1)
    assert table(spark, path) == newest(one, two) and table(spark, path, 0) == newest(one)
    three = [(7, "z", 1, "retry")]
    merge(three, 2)
    assert table(spark, path) == newest(one, two, three)
    touched = [p for p in os.listdir(f"{path}/data/epoch=2") if p.startswith("bucket=")]
    assert len(touched) == 1  # only the partition of the one new key was written again
    merge([], 3)
    assert table(spark, path) == newest(one, two, three)
    U.expire(spark, path, 1)
    assert table(spark, path) == newest(one, two, three) and U.epochs(spark, path) == [3]


def test_an_epoch_that_failed_before_its_commit_is_not_seen(spark, monkeypatch):
    path, key, order = _dir("upf"), ["id", "region"], ["at"]
    one, two = [(1, "a", 5, "x")], [(1, "a", 6, "y"), (2, "a", 1, "z")]
    U.merge_epoch(spark.createDataFrame(one, U_SCHEMA), 0, path, key, order, 4)
    create = type(spark).createDataFrame
    df = create(spark, two, U_SCHEMA)

    def fail(self, *a, **k):
        raise RuntimeError("lost before the commit")

    monkeypatch.setattr(type(spark), "createDataFrame", fail)
    with pytest.raises(RuntimeError):
        U.merge_epoch(df, 1, path, key, order, 4)
    monkeypatch.setattr(type(spark), "createDataFrame", create)
    assert table(spark, path) == one
    U.merge_epoch(df, 1, path, key, order, 4)
    assert table(spark, path) == newest(one, two)


def test_upsert_stream_over_restarts(spark):
    src, path, ck = (_dir(f"upst-{x}") for x in "spk")
    rng, seen = random.Random(1), []
    for n in range(3):
        rows = [(rng.randrange(12), rng.choice(["a", "b", None]), 100 * n + i, f"d{n}-{i}") for i in range(30)]
        seen.append(rows)
        add_file(spark, rows, U_SCHEMA, src, n)
        stream = S.read_stream(spark, src, spark.read.parquet(src).schema)
        U.upsert_stream(stream, path, ck, ["id", "region"], ["at"], 8).awaitTermination()
        assert table(spark, path) == newest(*seen)

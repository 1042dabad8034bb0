"""Point-in-time history features and sliding-window reports (W5-W7, W6b, W10, S2 batch twin).

A window partitioned by the entity key alone would put a hot merchant (a
third of all rows) into one task.  Two layouts avoid that:

* cumulative history (W5, W6, W7): rows are first aggregated per
  (key, hour); a window over the key's *active hours* (bounded by the
  calendar) gives everything before the current hour, and a window
  partitioned by (key, hour) adds the earlier rows of the same hour;
* short look-backs (W10): rows copied into their own and the next bucket of
  the look-back's length, so a hot key is split by it (``lookback_counts``);
* long look-backs (W6b): C(t) - C(t - lookback) from the two-level cumulative
  sums, with a probe at t - lookback (``trailing_sums``);
* many keys at once (P18): the same, on rows stacked as (kind, key, instant)
  (``history_of_keys``);
* first-kept dedup (S2 twin): each time's successor at least a horizon later,
  then pointer doubling from the key's first time (``dedup_within``).

NULL keys are a key like others (joins are null-safe).  Rows without a time
have no history, are nobody's history, and are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebound.operators.joins import join_on
from rebound.session import materialize

DAY_SECONDS = 86400


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts))


def _day(ts: str, seconds: int = DAY_SECONDS) -> Column:
    """Time bucket index (``seconds`` wide, default one day)."""
    return F.floor(F.unix_seconds(F.col(ts)) / F.lit(seconds))


HOUR_SECONDS = 3600


# ---------------------------------------------------------------- W5
def sequence_features(df: DataFrame, key: str, ts: str, id_col: str, code: str | None = None,
                      bucket_seconds: int = HOUR_SECONDS) -> DataFrame:
    """Attempt number, minutes since the previous attempt, hours since the
    first attempt and whether the decline code changed, per key ordered by
    (ts, id).  Exact equivalent of a window over the whole key; a hot key is
    split into ``bucket_seconds`` buckets (the per-key window runs over its
    active buckets, the per-bucket window over one bucket's rows)."""
    d = df.withColumn("__day", _day(ts, bucket_seconds))
    prev_cols = [F.col(ts).alias("t"), F.col(id_col).alias("i")]
    if code:
        prev_cols.append(F.col(code).alias("c"))
    per_day = d.groupBy(key, "__day").agg(
        F.count(F.lit(1)).alias("__n"),
        F.min(F.struct(F.col(ts).alias("t"), F.col(id_col).alias("i"))).alias("__first"),
        F.max(F.struct(*prev_cols)).alias("__last"))
    wd = Window.partitionBy(key).orderBy("__day")
    days = per_day.select(
        key, "__day",
        F.coalesce(F.sum("__n").over(wd.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.lag("__last").over(wd).alias("__prev_day_last"),
        F.first("__first").over(wd.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("__key_first"))
    j = join_on(d, days, [key, "__day"])
    wi = Window.partitionBy(key, "__day").orderBy(F.col(ts), F.col(id_col))
    prev_ts = F.coalesce(F.lag(ts).over(wi), F.col("__prev_day_last.t"))
    out = j.withColumns({
        "attempt_number": F.col("__before") + F.row_number().over(wi),
        "minutes_since_last": (F.unix_micros(F.col(ts)) - F.unix_micros(prev_ts)) / F.lit(60_000_000.0),
        "hours_since_first": (F.unix_micros(F.col(ts)) - F.unix_micros(F.col("__key_first.t")))
        / F.lit(3_600_000_000.0),
    })
    if code:
        prev_code = F.when(F.lag(ts).over(wi).isNotNull(), F.lag(code).over(wi)).otherwise(
            F.col("__prev_day_last.c"))
        out = out.withColumn("decline_code_changed",
                             F.coalesce(prev_code != F.col(code), F.lit(False)))
    return out.drop("__day", "__before", "__prev_day_last", "__key_first")


# ---------------------------------------------------------------- W6 / W7
def history_before(events: DataFrame, key: str, ts: str, sums: dict[str, Column],
                   bucket_seconds: int = HOUR_SECONDS) -> DataFrame:
    """Per event: sums of ``sums`` over events of the same key with a strictly
    earlier timestamp (columns ``<name>_before``); two-level over
    ``bucket_seconds`` buckets, exact."""
    d = events.withColumn("__day", _day(ts, bucket_seconds)).withColumn("__us", _micros(ts))
    for n, e in sums.items():
        d = d.withColumn(f"__v_{n}", F.when(F.col("__us").isNotNull(), e))
    per_day = d.groupBy(key, "__day").agg(*[F.sum(f"__v_{n}").alias(f"__d_{n}") for n in sums])
    wd = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = per_day.select(key, "__day", *[F.coalesce(F.sum(f"__d_{n}").over(wd), F.lit(0)).alias(f"__o_{n}")
                                          for n in sums])
    wi = Window.partitionBy(key, "__day").orderBy("__us").rangeBetween(Window.unboundedPreceding, -1)
    j = join_on(d, days, [key, "__day"])
    known = F.col("__us").isNotNull()
    return j.select(*events.columns, *[F.when(known, F.col(f"__o_{n}") + F.coalesce(F.sum(f"__v_{n}").over(wi), F.lit(0)))
                                       .otherwise(F.lit(0)).alias(f"{n}_before") for n in sums])


def historical_rates(attempts: DataFrame, key: str, ts: str = "timestamp",
                     declined: Column | None = None, amount: str = "amount_usd") -> DataFrame:
    """W6 + W7: decline rate and mean amount of the key's strictly earlier
    attempts, and the amount's deviation from that mean (NULL without history)."""
    declined = declined if declined is not None else (F.col("auth_status") == "DECLINED")
    h = history_before(attempts, key, ts, {
        "n": F.lit(1).cast("bigint"),
        "declines": declined.cast("bigint"),
        # money is summed exactly (decimal), so the mean does not depend on
        # the summation order
        "amount_sum": F.col(amount).cast("decimal(18,4)"),
        "amount_n": F.col(amount).isNotNull().cast("bigint"),
    })
    mean = F.when(F.col("amount_n_before") > 0,
                  F.col("amount_sum_before").cast("double") / F.col("amount_n_before"))
    return h.select(*attempts.columns, F.col("n_before").alias("prior_attempts"),
                    F.when(F.col("n_before") > 0, F.col("declines_before") / F.col("n_before"))
                    .alias("prior_decline_rate"),
                    mean.alias("prior_mean_amount"), (F.col(amount) - mean).alias("amount_deviation"))


# ---------------------------------------------------------------- bounded look-back
def lookback_counts(events: DataFrame, key: Sequence[str], ts: str, lookback_us: int,
                    bucket_us: int | None = None, include_current: bool = True,
                    value: Column | None = None) -> DataFrame:
    """Count (or sum ``value``) of same-key rows in (t - lookback, t] (or
    [t - lookback, t) when ``include_current`` is False), per row.

    Rows are copied into their own and the next ``bucket_us`` bucket
    (bucket >= lookback) so a window partitioned by (key, bucket) sees the
    whole interval; only each row's own copy is evaluated.
    """
    key = list(key)
    bucket_us = bucket_us or lookback_us
    v = value if value is not None else F.lit(1)
    d = (events.withColumn("__us", _micros(ts)).withColumn("__val", v)
         .withColumn("__b", F.floor(F.col("__us") / F.lit(bucket_us))))
    copies = d.withColumn("__own", F.explode(F.array(F.lit(True), F.lit(False))))
    copies = copies.withColumn("__bucket", F.when(F.col("__own"), F.col("__b")).otherwise(F.col("__b") + 1))
    if include_current:
        frame = (-(lookback_us - 1), 0)
    else:
        frame = (-lookback_us, -1)
    w = Window.partitionBy(*key, "__bucket").orderBy("__us").rangeBetween(*frame)
    counted = copies.withColumn("lookback_value", F.when(F.col("__us").isNotNull(), F.sum("__val").over(w)))
    return counted.where("__own").drop("__us", "__val", "__b", "__own", "__bucket")


def trailing_sums(events: DataFrame, key: str, ts: str, lookbacks_us: Sequence[int], sums: dict[str, Column],
                  bucket_seconds: int = HOUR_SECONDS) -> DataFrame:
    """Per row and look-back L: sums over same-key rows with time in [t - L, t)
    (columns ``<name>_<nth look-back>``; 0 for rows without a time).

    The sums depend on (key, t) alone, so rows are first aggregated per key and
    instant.  S(x) = sum strictly before x is two-level (buckets, then instants
    of the bucket), read at t and at a probe placed at t - L; S(t) - S(t - L)
    is exact to the microsecond, and repeated ids or times cannot multiply rows.
    """
    us = _micros(ts)
    at = (events.where(F.col(ts).isNotNull()).groupBy(F.col(key).alias("__k"), us.alias("__us"))
          .agg(*[F.sum(e).alias(f"__s_{n}") for n, e in sums.items()]))
    probes = F.array(F.struct(F.lit(-1).alias("nth"), F.lit(0).cast("long").alias("back")),
                     *[F.struct(F.lit(i).alias("nth"), F.lit(x).cast("long").alias("back")) for i, x in enumerate(lookbacks_us)])
    u = at.withColumn("__p", F.explode(probes)).select(
        "__k", F.col("__us").alias("__t"), "__p.nth", (F.col("__us") - F.col("__p.back")).alias("__x"),
        *[F.when(F.col("__p.nth") < 0, F.col(f"__s_{n}")).alias(f"__v_{n}") for n in sums])
    u = u.withColumn("__b", F.floor(F.col("__x") / F.lit(bucket_seconds * 1_000_000)))
    per_b = u.groupBy("__k", "__b").agg(*[F.sum(f"__v_{n}").alias(f"__d_{n}") for n in sums])
    wb = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    off = per_b.select("__k", "__b", *[F.coalesce(F.sum(f"__d_{n}").over(wb), F.lit(0)).alias(f"__o_{n}") for n in sums])
    wi = Window.partitionBy("__k", "__b").orderBy("__x").rangeBetween(Window.unboundedPreceding, -1)
    c = join_on(u, off, ["__k", "__b"])
    before = c.select("__k", "__t", "nth", *[(F.col(f"__o_{n}") + F.coalesce(F.sum(f"__v_{n}").over(wi), F.lit(0))).alias(f"__c_{n}") for n in sums])
    pick = lambda n, i: F.sum(F.when(F.col("nth") == i, F.col(f"__c_{n}")))
    out = before.groupBy("__k", "__t").agg(*[(pick(n, -1) - pick(n, i)).alias(f"{n}_{i}") for n in sums for i in range(len(lookbacks_us))])
    names = [f"{n}_{i}" for n in sums for i in range(len(lookbacks_us))]
    d = events.withColumn("__k", F.col(key)).withColumn("__t", us)
    return join_on(d, out, ["__k", "__t"], "left").select(*events.columns, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])


def history_of_keys(events: DataFrame, asked: DataFrame, keys: dict[str, Sequence[str]], ts: str, sums: dict[str, Column],
                    lookbacks_us: Sequence[int] = (), bucket_seconds: int = HOUR_SECONDS) -> DataFrame:
    """Rows of ``asked`` with, for every key of ``keys`` (name -> columns), the
    sums over events of that key strictly before the row's time
    (``<key>_<sum>``) and over those in [t - L, t) for the nth look-back L
    (``<key>_<sum>_<n>``); 0 without events or without a time.

    One pass for all keys: events are stacked as (kind, key, instant) and summed
    first, so rows of one instant collapse before the shuffle.  The cumulative
    sum is two-level (active buckets of a key, then the instants of a bucket):
    no task holds more of a hot key than one bucket.  Answers depend on the
    keys and the instant alone, so each combination that ``asked`` holds is
    answered once and joined back; repeated rows cannot multiply each other.
    The stacked instants are read twice, so they are checkpointed.
    """
    columns = list(dict.fromkeys(c for cols in keys.values() for c in cols))
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.array(*[F.col(c).cast("string") for c in cols]).alias("key"))
                                for i, cols in enumerate(keys.values())]))
    stacked = events.where(F.col(ts).isNotNull()).select(*columns, _micros(ts).alias("__t"), *[e.alias(f"__s_{n}") for n, e in sums.items()])
    at = (stacked.withColumn("__k", kinds).groupBy("__k.kind", "__k.key", "__t")
          .agg(*[F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums]))
    probes = F.explode(F.array(*[F.struct(F.lit(i - 1).alias("nth"), F.lit(x).cast("long").alias("back")) for i, x in enumerate([0, *lookbacks_us])]))
    wanted = asked.where(F.col(ts).isNotNull()).select(*columns, _micros(ts).alias("__t")).distinct()
    ask = wanted.withColumn("__k", kinds).select("*", F.col("__k.kind"), F.col("__k.key"))
    moments = ask.select("kind", "key", "__t").distinct()
    asking = moments.withColumn("__p", probes).select("kind", "key", (F.col("__t") - F.col("__p.back")).alias("__x"), "__t", F.col("__p.nth"))
    u = at.select("kind", "key", F.col("__t").alias("__x"), *[F.col(f"__s_{n}") for n in sums]).unionByName(asking, allowMissingColumns=True)
    u = materialize(u.withColumn("__b", F.floor(F.col("__x") / F.lit(bucket_seconds * 1_000_000))))
    active = u.groupBy("kind", "key", "__b").agg(*[F.sum(f"__s_{n}").alias(f"__d_{n}") for n in sums])
    wb = Window.partitionBy("kind", "key").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    earlier = active.select("kind", "key", "__b", *[F.coalesce(F.sum(f"__d_{n}").over(wb), F.lit(0)).alias(f"__o_{n}") for n in sums])
    wi = Window.partitionBy("kind", "key", "__b").orderBy("__x").rangeBetween(Window.unboundedPreceding, -1)
    before = u.join(earlier, ["kind", "key", "__b"]).select(
        "kind", "key", "__t", "nth", *[(F.col(f"__o_{n}") + F.coalesce(F.sum(f"__s_{n}").over(wi), F.lit(0))).alias(f"__c_{n}") for n in sums])
    pick = lambda n, i: F.max(F.when(F.col("nth") == i, F.col(f"__c_{n}")))
    names = [n if i < 0 else f"{n}_{i}" for n in sums for i in range(-1, len(lookbacks_us))]
    values = [pick(n, -1) if i < 0 else pick(n, -1) - pick(n, i) for n in sums for i in range(-1, len(lookbacks_us))]
    answers = before.where(F.col("nth").isNotNull()).groupBy("kind", "key", "__t").agg(*[v.alias(f"__a_{c}") for v, c in zip(values, names)])
    spread = (ask.join(answers, ["kind", "key", "__t"]).groupBy(*columns, "__t")
              .agg(*[F.max(F.when(F.col("kind") == i, F.col(f"__a_{c}"))).alias(f"{k}_{c}") for i, k in enumerate(keys) for c in names]))
    out = join_on(asked.withColumn("__t", _micros(ts)), spread, [*columns, "__t"], "left")
    return out.select(*asked.columns, *[F.coalesce(F.col(f"{k}_{c}"), F.lit(0)).alias(f"{k}_{c}") for k in keys for c in names])


def rate_breaches(events: DataFrame, key: str, ts: str, limit: int, window_s: int = 60) -> DataFrame:
    """Requests per key in the trailing (t - 60 s, t]; breaches of the limit.
    A request without a time is counted and breaches nothing."""
    c = lookback_counts(events.select(key, ts), [key], ts, window_s * 1_000_000)
    return c.groupBy(key).agg(F.count(F.lit(1)).alias("requests"),
                              F.max("lookback_value").cast("bigint").alias("max_in_window"),
                              F.count_if(F.col("lookback_value") > limit).alias("breaches"))


def next_time(events: DataFrame, key: Sequence[str], ts: str, horizon_us: int,
              bucket_seconds: int = HOUR_SECONDS) -> DataFrame:
    """(key, __us, __next): every distinct time of a key with the key's first
    time at least ``horizon_us`` later (NULL if none), two-level like the rest."""
    key = list(key)
    at = events.where(F.col(ts).isNotNull()).select(*key, _micros(ts).alias("__us")).distinct()
    both = F.explode(F.array(F.struct(F.col("__us").alias("x"), F.lit(True).alias("real")),
                             F.struct((F.col("__us") + F.lit(horizon_us)).alias("x"), F.lit(False).alias("real"))))
    u = (at.withColumn("__e", both).withColumn("__x", F.col("__e.x"))
         .withColumn("__t", F.when(F.col("__e.real"), F.col("__x")))
         .withColumn("__b", F.floor(F.col("__x") / F.lit(bucket_seconds * 1_000_000))))
    per_b = u.groupBy(*key, "__b").agg(F.min("__t").alias("__m"))
    wb = Window.partitionBy(*key).orderBy("__b").rowsBetween(1, Window.unboundedFollowing)
    later = per_b.select(*key, "__b", F.min("__m").over(wb).alias("__later"))
    wi = Window.partitionBy(*key, "__b").orderBy("__x").rangeBetween(0, Window.unboundedFollowing)
    j = join_on(u, later, [*key, "__b"])
    j = j.withColumn("__next", F.coalesce(F.min("__t").over(wi), F.col("__later")))
    return j.where(~F.col("__e.real")).select(*key, "__us", "__next")


def dedup_within(events: DataFrame, key: Sequence[str], ts: str, id_col: str | None = None,
                 horizon_s: int = DAY_SECONDS) -> DataFrame:
    """S2 batch twin: a key's first event is kept and silences the key for the
    horizon; the first event at or after its end is kept again, and so on.

    Which time follows a kept one depends on that time alone (``next_time``),
    so the kept times are the orbit of the key's first time.  Pointer doubling
    finds them in log2(kept per key) rounds of joins; no key is folded in one
    task.  Of events at a kept time the one of smallest ``id_col`` stays.
    """
    key = list(key)
    jump = materialize(next_time(events, key, ts, horizon_s * 1_000_000))
    kept = jump.groupBy(*key).agg(F.min("__us").alias("__us"))
    while True:
        ahead = join_on(kept, jump, [*key, "__us"]).where(F.col("__next").isNotNull())
        kept = materialize(kept.unionByName(ahead.select(*key, F.col("__next").alias("__us"))).distinct())
        if ahead.isEmpty():
            break
        far = jump.select(*key, F.col("__us").alias("__via"), F.col("__next").alias("__far"))
        jump = materialize(join_on(jump.withColumnRenamed("__next", "__via"), far, [*key, "__via"], "left")
                           .select(*key, "__us", F.col("__far").alias("__next")))
    one = Window.partitionBy(*key, ts).orderBy(F.col(id_col) if id_col else F.lit(0))
    timed = events.where(F.col(ts).isNotNull()).withColumn("__us", _micros(ts))
    first = (join_on(timed, kept, [*key, "__us"]).withColumn("__n", F.row_number().over(one))
             .where("__n = 1").select(*events.columns))
    return first.unionByName(events.where(F.col(ts).isNull()))


def trailing_rate(attempts: DataFrame, key: str, ts: str, days: Sequence[int], declined: Column) -> DataFrame:
    """Decline rate of the key's attempts in [t - N days, t), to the
    microsecond, for each N in ``days`` (one pass for all)."""
    t = trailing_sums(attempts, key, ts, [n * DAY_SECONDS * 1_000_000 for n in days],
                      {"__n": F.lit(1).cast("bigint"), "__k": F.coalesce(declined.cast("bigint"), F.lit(0).cast("bigint"))})
    out = []
    for i, n in enumerate(days):
        count, k = F.col(f"__n_{i}"), F.col(f"__k_{i}")
        out += [count.alias(f"prior_{n}d_attempts"), F.when(count > 0, k / count).alias(f"prior_{n}d_decline_rate")]
    return t.select(*attempts.columns, *out)


# ---------------------------------------------------------------- P18
FEATURE_KEYS = {"provider": ["processor_name"], "country": ["merchant_country"], "code": ["response_code"],
                "code_country": ["response_code", "merchant_country"], "merchant": ["merchant_id"]}


def amount_bucket(amount: Column) -> Column:
    """Small, medium, large, very large; NULL without an amount."""
    return (F.when(amount < 50, "small").when(amount < 200, "medium").when(amount < 1000, "large")
            .when(amount.isNotNull(), "very_large"))


def _attempt_events(attempts: DataFrame, retries: DataFrame, ts: str, id_col: str, link: str, status: str) -> DataFrame:
    """Attempts and the retries of declined ones (under the keys of their original) as one event table."""
    declined = attempts.where(F.col(status) == "DECLINED")
    roles = ["merchant_id", "merchant_country", "processor_name", "response_code"]
    linked = retries.select(F.col(link).alias("__link"), F.col(ts), F.col(status)).join(
        declined.select(F.col(id_col).alias("__link"), *roles), "__link").drop("__link")
    return (attempts.select(*roles, ts, status, "amount_usd", F.lit(False).alias("is_retry"))
            .unionByName(linked.withColumn("is_retry", F.lit(True)), allowMissingColumns=True))


def feature_set(attempts: DataFrame, retries: DataFrame, ts: str = "timestamp", id_col: str = "transaction_id",
                link: str = "original_transaction_id", status: str = "auth_status") -> DataFrame:
    """The standard features of every declined original, each as known
    just before its time: provider, geography, amount, decline, time of day,
    merchant and sequence groups.

    A retry counts for the keys of its original from its own time on.  Attempts
    and retries form one event table, and ``history_of_keys`` answers all keys
    in one pass.
    """
    events = _attempt_events(attempts, retries, ts, id_col, link, status)
    retry, ok = F.col("is_retry"), F.col(status) == "APPROVED"
    one = lambda c: c.cast("bigint")
    sums = {"n": one(~retry), "ok": one(~retry & ok), "r": one(retry), "rok": one(retry & ok),
            "sum": F.when(~retry, F.col("amount_usd").cast("decimal(18,4)")), "cnt": one(~retry & F.col("amount_usd").isNotNull())}
    asked = materialize(sequence_features(attempts.where(F.col(status) == "DECLINED"), "merchant_id", ts, id_col, "response_code"))
    d = history_of_keys(events, asked, FEATURE_KEYS, ts, sums)
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    mean = F.when(F.col("merchant_cnt") > 0, F.col("merchant_sum").cast("double") / F.col("merchant_cnt"))
    hour, weekday = F.hour(ts), F.weekday(F.col(ts))
    soft = F.coalesce(F.col("is_soft_decline"), F.lit(False))
    return d.select(
        id_col, "processor_name", rate("provider_ok", "provider_n").alias("provider_approval_rate"),
        (F.lit(1.0) - rate("provider_ok", "provider_n")).alias("provider_decline_rate"), rate("provider_rok", "provider_r").alias("provider_retry_success_rate"),
        "merchant_country", rate("country_ok", "country_n").alias("country_approval_rate"), rate("country_rok", "country_r").alias("country_retry_success_rate"),
        "amount_usd", amount_bucket(F.col("amount_usd")).alias("amount_bucket"), (F.col("amount_usd") - mean).alias("amount_deviation"),
        "response_code", F.when(soft, "soft").otherwise("hard").alias("decline_category"), soft.alias("is_soft_decline"),
        rate("code_rok", "code_r").alias("code_retry_rate"), rate("code_country_rok", "code_country_r").alias("code_country_retry_rate"),
        hour.alias("event_hour"), weekday.alias("event_dayofweek"),
        (hour.between(9, 16) & (weekday < 5)).alias("is_business_hours"), "minutes_since_last",
        "merchant_vertical", rate("merchant_ok", "merchant_n").alias("merchant_approval_rate"),
        rate("merchant_rok", "merchant_r").alias("merchant_retry_success_rate"), mean.alias("merchant_mean_amount"),
        "attempt_number", "hours_since_first", "decline_code_changed")


def retry_success_history(attempts: DataFrame, retries: DataFrame, keys: dict[str, Sequence[str]], days: Sequence[int],
                          ts: str = "timestamp", id_col: str = "transaction_id", link: str = "original_transaction_id",
                          status: str = "auth_status") -> DataFrame:
    """For every declined original and key, the retries that ended in the
    N days before it, to the microsecond, and the share of them that succeeded
    (NULL without any), for each N in ``days``; all keys and days in one pass."""
    events = _attempt_events(attempts, retries, ts, id_col, link, status)
    retry = F.col("is_retry")
    sums = {"r": retry.cast("bigint"), "rok": (retry & (F.col(status) == "APPROVED")).cast("bigint")}
    asked = attempts.where(F.col(status) == "DECLINED")
    h = history_of_keys(events.where(retry), asked, keys, ts, sums, [n * DAY_SECONDS * 1_000_000 for n in days])
    out = []
    for k in keys:
        for i, n in enumerate(days):
            count, won = F.col(f"{k}_r_{i}"), F.col(f"{k}_rok_{i}")
            out += [count.alias(f"{k}_{n}d_retries"), F.when(count > 0, won / count).alias(f"{k}_{n}d_retry_success_rate")]
    return h.select(*asked.columns, *out)

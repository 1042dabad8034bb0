"""Retry chains -> one labelled row per original decline.

The whole reduction is one grouped aggregate on the link key followed by one
left join, with "first retry" and "first approved retry" expressed as ``min``
over a struct (lexicographic order, deterministic tie-break) instead of a
sort + drop-duplicates and two extra joins.  All aggregates are decomposable,
so a skewed link key is combined map-side before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rebound.functions.parse import strip_ws

APPROVED = "APPROVED"
DECLINED = "DECLINED"

SUMMARY_COLUMNS = ["retry_count", "max_retry_attempt_num", "any_approved", "first_retry_status",
                   "first_retry_attempt_num", "hours_to_first_retry", "recovery_attempt_num",
                   "hours_to_recovery"]

LABEL_COLUMNS = ["has_any_retry", "retry_count", "max_retry_attempt_num",
                 "target_recovered_by_retry", "target_first_retry_approved",
                 "first_retry_status", "first_retry_attempt_num", "hours_to_first_retry",
                 "recovery_attempt_num", "hours_to_recovery"]


def _valid_link(df: DataFrame, link: str):
    """Drop NULL and blank link keys (T2): orphans never form one hot group."""
    cond = F.col(link).isNotNull()
    if isinstance(df.schema[link].dataType, T.StringType):
        cond = cond & (strip_ws(F.col(link)) != "")
    return cond


def retry_partials(rows: DataFrame, group_keys: Sequence[str], order_cols: Sequence[str],
                   attempt_col: str = "retry_attempt_num", status_col: str = "auth_status") -> DataFrame:
    """Partial retry summary per ``group_keys`` (a refinement of the link key).

    ``order_cols`` is the tie-break order inside the group, first column is the
    attempt number.  Merge with :func:`merge_retry_partials`.
    """
    approved = F.col(status_col) == APPROVED
    key = [F.col(c).alias(f"k{i}") for i, c in enumerate(order_cols)]
    return (rows.groupBy(*group_keys)
            .agg(F.count(F.lit(1)).alias("cnt"),
                 F.max(attempt_col).alias("max_attempt"),
                 F.max(approved).alias("any_approved"),
                 F.min(F.struct(*key, F.col(status_col).alias("status"))).alias("first"),
                 F.min(F.when(approved, F.struct(*key))).alias("rec")))


def merge_retry_partials(partials: DataFrame, link: str, hours_col: str) -> DataFrame:
    """Final retry summary per link key from :func:`retry_partials` output.

    ``hours_col`` is constant inside each partial group and is inserted as the
    second sort key (after the attempt number), matching the row-level order
    (attempt, hours, tie-breaks).
    """
    first_fields = [f.name for f in partials.schema["first"].dataType.fields]
    order_fields = [n for n in first_fields if n != "status"]

    def with_hours(s: str, extra: list[str]):
        cols = [F.col(f"{s}.{order_fields[0]}").alias("a"), F.col(hours_col).alias("h")]
        cols += [F.col(f"{s}.{n}").alias(f"t{n}") for n in order_fields[1:]]
        cols += [F.col(f"{s}.{n}").alias(n) for n in extra]
        return F.struct(*cols)

    p = partials.where(_valid_link(partials, link))
    s = (p.groupBy(link)
         .agg(F.sum("cnt").alias("retry_count"),
              F.max("max_attempt").alias("max_retry_attempt_num"),
              F.max("any_approved").alias("any_approved"),
              F.min(with_hours("first", ["status"])).alias("__first"),
              F.min(F.when(F.col("rec").isNotNull(), with_hours("rec", []))).alias("__rec")))
    return s.select(link, "retry_count", "max_retry_attempt_num", "any_approved",
                    F.col("__first.status").alias("first_retry_status"),
                    F.col("__first.a").alias("first_retry_attempt_num"),
                    F.col("__first.h").alias("hours_to_first_retry"),
                    F.col("__rec.a").alias("recovery_attempt_num"),
                    F.col("__rec.h").alias("hours_to_recovery"))


def summarize_retries(retries: DataFrame, link: str = "original_transaction_id",
                      attempt_col: str = "retry_attempt_num", hours_col: str = "hours_since_original",
                      tiebreak: Sequence[str] = ("transaction_id",),
                      status_col: str = "auth_status") -> DataFrame:
    """G1-G3 on row-level retries: count, highest attempt, any approved, first
    retry and first approved retry, ordered by (attempt, hours, tie-breaks)."""
    rows = retries.where(_valid_link(retries, link))
    approved = F.col(status_col) == APPROVED
    key = [F.col(attempt_col).alias("a"), F.col(hours_col).alias("h"),
           *[F.col(c).alias(f"t{i}") for i, c in enumerate(tiebreak)]]
    s = (rows.groupBy(link)
         .agg(F.count(F.lit(1)).alias("retry_count"),
              F.max(attempt_col).alias("max_retry_attempt_num"),
              F.max(approved).alias("any_approved"),
              F.min(F.struct(*key, F.col(status_col).alias("status"))).alias("__first"),
              F.min(F.when(approved, F.struct(*key))).alias("__rec")))
    return s.select(link, "retry_count", "max_retry_attempt_num", "any_approved",
                    F.col("__first.status").alias("first_retry_status"),
                    F.col("__first.a").alias("first_retry_attempt_num"),
                    F.col("__first.h").alias("hours_to_first_retry"),
                    F.col("__rec.a").alias("recovery_attempt_num"),
                    F.col("__rec.h").alias("hours_to_recovery"))


def label_declines(declines: DataFrame, summary: DataFrame, id_col: str = "transaction_id",
                   link: str = "original_transaction_id") -> DataFrame:
    """Left join of declines to their retry summary, with labels.

    The summary has one row per link key, so the join never multiplies
    declines (T21) and its skew is bounded by the declines side.
    """
    s = summary.withColumnRenamed(link, "__link")
    j = declines.join(s, declines[id_col] == s["__link"], "left")
    labels = [
        F.col("__link").isNotNull().alias("has_any_retry"),
        F.coalesce(F.col("retry_count"), F.lit(0)).cast("bigint").alias("retry_count"),
        F.col("max_retry_attempt_num"),
        F.coalesce(F.col("any_approved"), F.lit(False)).alias("target_recovered_by_retry"),
        F.coalesce(F.col("first_retry_status") == APPROVED, F.lit(False)).alias("target_first_retry_approved"),
        "first_retry_status", "first_retry_attempt_num", "hours_to_first_retry",
        "recovery_attempt_num", "hours_to_recovery",
    ]
    return j.select(*[declines[c] for c in declines.columns], *labels)


def split_attempts(attempts: DataFrame, status_col: str = "auth_status",
                   retry_flag: str = "is_retry") -> tuple[DataFrame, DataFrame]:
    """Original declines and retries of one attempt table."""
    declines = attempts.where((F.col(status_col) == DECLINED) & ~F.col(retry_flag))
    retries = attempts.where(F.col(retry_flag))
    return declines, retries


def label_attempts(attempts: DataFrame, id_col: str = "transaction_id",
                   link: str = "original_transaction_id",
                   tiebreak: Sequence[str] = ("transaction_id",)) -> DataFrame:
    """A1 -> A2: the modeling table from one attempt table (originals + retries)."""
    declines, retries = split_attempts(attempts)
    keep = [c for c in declines.columns if c not in (link,)]
    summary = summarize_retries(retries, link=link, tiebreak=tiebreak)
    return label_declines(declines.select(*keep), summary, id_col=id_col, link=link)


def semi_flags(declines: DataFrame, retries: DataFrame, id_col: str = "transaction_id",
               link: str = "original_transaction_id", how: str = "left_semi") -> DataFrame:
    """J3 variants: declines with (``left_semi``) or without (``left_anti``) a retry."""
    r = retries.where(_valid_link(retries, link)).select(F.col(link).alias("__link"))
    return declines.join(r, declines[id_col] == r["__link"], how)


def lookup_keys(df: DataFrame, requests: DataFrame, key: str, request_key: str | None = None) -> DataFrame:
    """The rows of ``df`` whose key appears in a request table (a semi join;
    for a handful of literal keys use ``df.where(F.col(key).isin(...))``)."""
    rk = request_key or key
    r = requests.select(F.col(rk).alias("__rk")).distinct()
    return df.join(r, df[key] == r["__rk"], "left_semi")


def code_dimension(spark) -> DataFrame:
    """The response-code reference table built from the fixed code lists (a
    table of fixed size, so broadcasting it is bounded)."""
    from rebound import config as C
    rows = [(c, "hard", C.HARD_DECLINE_REASONS.get(c)) for c in C.HARD_DECLINE_CODES]
    rows += [(c, "soft", None) for c in C.SOFT_DECLINE_CODES]
    return spark.createDataFrame(rows, "code string, code_category string, code_reason string")


def enrich_codes(df: DataFrame, code_col: str = "response_code") -> DataFrame:
    """Decline enrichment by the code reference table (broadcast left join);
    codes outside the table are 'unknown'."""
    dim = F.broadcast(code_dimension(df.sparkSession))
    j = df.join(dim, strip_ws(F.col(code_col)) == F.col("code"), "left")
    return j.withColumn("code_category", F.coalesce(F.col("code_category"), F.lit("unknown"))).drop("code")


# ---------------------------------------------------------------- G2b value label
def value_label(modeling: DataFrame, margin: float, retry_cost: float, friction: float) -> DataFrame:
    """G2b, third label option: whether retrying a decline had positive business
    value, i.e. the recovered margin less what all its retries cost.  A
    decline that was never retried has value 0 and label false; a missing amount
    recovers nothing."""
    gain = F.when(F.col("target_recovered_by_retry"), F.coalesce(F.col("amount_usd").cast("double"), F.lit(0.0)) * F.lit(margin)).otherwise(F.lit(0.0))
    value = gain - F.col("retry_count") * F.lit(retry_cost + friction)
    return modeling.withColumn("retry_value_usd", value).withColumn("target_retry_had_value", F.col("retry_value_usd") > 0)

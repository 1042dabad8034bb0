"""Registered queries: chunking, retrieval, payload validation, text schema inference, long report."""

from __future__ import annotations

from pyspark.sql import functions as F

from rebound.operators import blocks as B
from rebound.operators import clean as CL
from rebound.operators import decide as D
from rebound.operators import retrieval as R
from rebound.plans import fixture as fx
from rebound.plans.catalog import register, round_doubles, sql_round
from rebound.plans.q_eval import EVAL_CTES, replay, test_with_scores
from rebound.plans.q_labels import modeling, policy_summary_sql
from rebound.plans.q_metrics import split_sql
from rebound.plans.sqlbase import with_ctes
from rebound.sources.tables import read_table

CHUNK, OVERLAP = 200, 50
_WS = r"[ \t\n\r\f\x0B]+"


@register("document_chunks", f"""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^{_WS}', ''), '{_WS}$', '') AS t FROM documents),
w AS (SELECT doc_id, string_split_regex(t, '{_WS}') AS w FROM t WHERE t <> ''),
c AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 1, 0) + 1, {CHUNK - OVERLAP})) AS word_start FROM w)
SELECT doc_id, CAST(word_start // {CHUNK - OVERLAP} AS INTEGER) AS chunk_index, CAST(word_start AS INTEGER) AS word_start,
       CAST(len(w[word_start + 1: word_start + {CHUNK}]) AS INTEGER) AS n_words,
       md5(array_to_string(w[word_start + 1: word_start + {CHUNK}], ' ')) AS chunk_md5
FROM c WHERE word_start = 0 OR word_start + {OVERLAP} < len(w)""", ops=("Q4",))
def q_document_chunks(spark, sf):
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    ch = R.chunk(docs, "doc_id", "text", CHUNK, OVERLAP)
    return ch.select("doc_id", "chunk_index", "word_start", "n_words", F.md5("chunk_text").alias("chunk_md5"))


K = 5


def _retrieval(spark, sf):
    emb = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    q = R.centroids(emb, "label", "embedding")
    return emb, R.top_k_cosine(emb, q, "vec_id", "embedding", "label", "query_vector", K)


_RET_CTES = f"""
WITH e AS (SELECT vec_id, label, embedding FROM embeddings),
ex AS (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS x FROM e),
cen AS (SELECT label AS query_id, list(x ORDER BY pos) AS qv
        FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM ex GROUP BY label, pos) AS a GROUP BY label),
sc AS (SELECT c.query_id, e.vec_id AS candidate_id, e.label AS candidate_label,
              list_sum(list_transform(list_zip(e.embedding, c.qv), lambda p: CAST(p[1] AS DOUBLE) * p[2]))
              / (sqrt(list_sum(list_transform(e.embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))))
                 * sqrt(list_sum(list_transform(c.qv, lambda v: v * v)))) AS score
       FROM e, cen AS c),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS r
                       FROM sc WHERE score IS NOT NULL) AS z WHERE r <= {K})
"""


@register("cosine_top_k", sql_round(["score"], _RET_CTES + "SELECT query_id, candidate_id, score FROM top"),
          ops=("Q5",))
def q_cosine_top_k(spark, sf):
    _, top = _retrieval(spark, sf)
    return round_doubles(top.select("query_id", "candidate_id", "score"))


@register("cosine_top_k_blocks", sql_round(["score"], _RET_CTES + "SELECT query_id, candidate_id, score FROM top"),
          ops=("Q5",))
def q_cosine_top_k_blocks(spark, sf):
    emb = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    top, _ = B.search(B.build(emb, "vec_id", "embedding"), R.centroids(emb, "label", "embedding"), "label", "query_vector", K)
    return round_doubles(top.select("query_id", "candidate_id", "score"))


@register("retrieval_hit_rate", sql_round(["hit_rate"], _RET_CTES + """
SELECT count(*) AS queries, avg(CASE WHEN hit THEN 1 ELSE 0 END) AS hit_rate FROM (
  SELECT query_id, bool_or(candidate_label = query_id) AS hit FROM top GROUP BY query_id) AS h"""), ops=("Q6",))
def q_retrieval_hit_rate(spark, sf):
    emb, top = _retrieval(spark, sf)
    expected = emb.select(F.col("label").alias("query_id"), F.col("vec_id").alias("candidate_id"))
    return round_doubles(R.hit_rate(top, expected))


@register("payload_validation", """
SELECT event_id, array_to_string(rules, ',') AS broken_rules, len(rules) = 0 AS accepted FROM (
  SELECT event_id, list_filter([
      CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL OR isnan(TRY_CAST(value AS DOUBLE))
                OR isinf(TRY_CAST(value AS DOUBLE)) OR TRY_CAST(value AS DOUBLE) <= 0 THEN 'amount' END,
      CASE WHEN event_type IS NULL OR trim(event_type) = '' THEN 'code' END,
      CASE WHEN json_keys(props) IS NULL THEN 'props_not_object' END,
      CASE WHEN len(list_filter(json_keys(props), lambda k: k NOT IN ('k'))) > 0 THEN 'unknown_fields' END,
      CASE WHEN json_extract_string(props, '$.k') IS NOT NULL
            AND (TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NULL
                 OR TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) < 0
                 OR TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 100) THEN 'k_range' END],
      lambda r: r IS NOT NULL) AS rules
  FROM events) AS v""", ops=("P15", "P16", "S3", "U3"))
def q_payload_validation(spark, sf):
    ev = fx.events(spark, sf, ["event_id", "event_type", "value", "props"])
    keys = F.json_object_keys("props")
    rules = CL.broken_rules({
        "amount": CL.amount_rule(F.col("value")),
        "code": F.col("event_type").isNull() | (F.trim("event_type") == ""),
        "props_not_object": keys.isNull(),
        "unknown_fields": F.coalesce(F.size(CL.unknown_fields(F.col("props"), ["k"])) > 0, F.lit(False)),
        "k_range": CL.range_rule(F.get_json_object("props", "$.k"), 0.0, 100.0),
    })
    return ev.select("event_id", F.array_join(rules, ",").alias("broken_rules"),
                     (F.size(rules) == 0).alias("accepted"))


TEXT_COLS = ["transaction_id", "timestamp", "merchant_vertical", "amount_usd", "response_code",
             "is_soft_decline", "has_any_retry", "retry_count", "target_recovered_by_retry", "first_retry_status",
             "hours_to_first_retry"]


@register("text_schema_inference", with_ctes(" UNION ALL ".join(f"""
SELECT '{c}' AS column_name,
       CASE WHEN count(v) > 0 AND count(*) FILTER (WHERE v IS NOT NULL AND lower(v) NOT IN ('true', 'false')) = 0
            THEN 'boolean'
            WHEN count(v) > 0 AND count(*) FILTER (WHERE v IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NULL) = 0
            THEN 'numeric' ELSE 'string' END AS inferred_type, count(v) AS non_null
FROM (SELECT CAST({'ts' if c == 'timestamp' else c} AS VARCHAR) AS v FROM modeling) AS t""" for c in TEXT_COLS)),
          ops=("P2", "P3", "I1", "A4"))
def q_text_schema_inference(spark, sf):
    m = modeling(spark, sf)
    as_text = m.select(*[F.col(c).cast("string").alias(c) for c in TEXT_COLS])
    return CL.infer_text_schema(as_text)


MEASURES = ["rows", "retry_count", "retry_rate", "recovered_count", "recovered_rate", "recovered_volume_usd",
            "gross_margin_recovered_usd", "wasted_retry_count", "wasted_retry_cost_usd", "friction_cost_usd",
            "realized_net_value_usd", "average_retry_probability"]


@register("policy_report", sql_round(["value"], split_sql(" UNION ALL ".join(
    f"SELECT 'policy_replay' AS report, policy AS section, '{m}' AS key, CAST({m} AS DOUBLE) AS value FROM ps"
    for m in MEASURES), EVAL_CTES + [("ps", policy_summary_sql("replay"))])), ops=("I6", "G11"))
def q_policy_report(spark, sf):
    ps = D.policy_summary(replay(test_with_scores(spark, sf)))
    return round_doubles(CL.report_table(ps, "policy_replay", "policy", MEASURES))


# Fixture binding for payload fields (events as scoring requests):
# latency_ms = value; amount_usd given for error/purchase events, amount for
# click events (so the backfill runs both ways); fx_rate = k / 50; fee = value / 100.
@register("payload_enrichment", sql_round(["latency_ms", "amount_usd", "amount", "fx_rate", "fee_bps"], """
SELECT event_id, latency_ms,
       CASE WHEN latency_ms IS NULL THEN NULL WHEN latency_ms < 250 THEN 'fast'
            WHEN latency_ms < 700 THEN 'medium' ELSE 'slow' END AS latency_bucket,
       coalesce(amount_usd, amount) AS amount_usd, coalesce(amount, amount_usd) AS amount,
       fx_rate, CASE WHEN fx_rate IS NOT NULL THEN abs(fx_rate - 1.0) > 1e-9 END AS fx_applied,
       CASE WHEN amount_usd > 0 AND fee IS NOT NULL THEN fee / amount_usd * 10000.0 END AS fee_bps,
       CASE WHEN lower(event_type) = 'true' THEN true WHEN lower(event_type) = 'false' THEN false
            ELSE length(event_type) > 0 END AS event_flag_lenient,
       CASE WHEN lower(trim(event_type)) IN ('true', '1', 'yes', 'y') THEN true
            WHEN lower(trim(event_type)) IN ('false', '0', 'no', 'n') THEN false END AS event_flag_strict,
       coalesce(TRY_CAST(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS INTEGER), 0) AS retry_attempt_num
FROM (SELECT event_id, event_type, props, CAST(value AS DOUBLE) AS latency_ms,
             CASE WHEN event_type IN ('error', 'purchase') THEN value END AS amount_usd,
             CASE WHEN event_type = 'click' THEN value END AS amount,
             TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50.0 AS fx_rate,
             value / 100.0 AS fee
      FROM events) AS e"""), ops=("P1", "P1b", "P4", "P6", "P7", "P8", "P9"))
def q_payload_enrichment(spark, sf):
    from rebound.functions import parse as P
    ev = fx.events(spark, sf, ["event_id", "event_type", "value", "props"])
    raw = ev.select("event_id", "event_type", "props", F.col("value").cast("double").alias("latency_ms"),
                    F.when(F.col("event_type").isin("error", "purchase"), F.col("value")).alias("amount_usd"),
                    F.when(F.col("event_type") == "click", F.col("value")).alias("amount"),
                    (F.get_json_object("props", "$.k").try_cast("double") / F.lit(50.0)).alias("fx_rate"),
                    (F.col("value") / F.lit(100.0)).alias("fee"))
    a_usd, a = P.backfill_amounts("amount_usd", "amount")
    out = raw.select("event_id", "latency_ms", P.latency_bucket("latency_ms").alias("latency_bucket"),
                     a_usd.alias("amount_usd"), a.alias("amount"), "fx_rate",
                     P.fx_applied(F.lit(None).cast("string"), "fx_rate").alias("fx_applied"),
                     P.fee_bps("fee", "amount_usd").alias("fee_bps"),
                     P.parse_bool_lenient("event_type").alias("event_flag_lenient"),
                     P.parse_bool_strict("event_type").alias("event_flag_strict"),
                     P.retry_number(F.get_json_object("props", "$.k")).alias("retry_attempt_num"))
    return round_doubles(out)

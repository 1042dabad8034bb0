"""Print the catalog of registered queries (markdown): name, operators, oracle, summary."""
from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rebound.plans.registry import load  # noqa: E402

SUMMARY = {'cascade_targets': 'provider with the best point-in-time recovery rate for this decline, own provider excluded',
    'cosine_top_k_blocks': 'the same neighbours through a block index that skips what cannot reach the k-th score',
    'sketch_profile': 'column statistics from merged daily sketches, with an exact audit of their error',
    'nightly_reconciliation': 'champion and challenger quality, PSI and deltas from merged daily state',
    'category_shift': 'category shares of the declines against a stored baseline, as table tests',
    'retry_success_history': 'W6b: retry success of merchant, provider and code x country in the 30 and 7 days before',
    'batch_score_summary': 'retry / skip / out-of-scope counts, EV of retries, hindsight recoveries',
    'best_f1_threshold': 'best-F1 threshold per split on the 46-point grid (first wins ties)',
    'best_net_value_threshold': 'threshold with the highest realised net value per split',
    'best_policy_by_segment': 'best replayed strategy per merchant vertical',
    'calibration_curve': '10 quantile buckets (duplicate edges dropped), mean prediction vs event rate',
    'calibration_error': 'expected calibration error of the rules and challenger scores',
    'category_vocabulary': 'distinct categories (MISSING for NULL) with counts on the train window',
    'challenger_scores': 'champion and challenger scores aligned by id with deltas',
    'champion_challenger_summary': 'means, mean |delta| and share of |delta| > 0.20',
    'cohort_fallback': "rules score where the model's segment AUC is below the rules'", 'column_profile': 'type family, rows, nulls, distinct, min/max and quartiles per decline column',
    'cosine_top_k': 'exact top-5 cosine neighbours of each label centroid',
    'decision_table': 'full retry decision per decline: scope, economics, EV, best delay, gate, confidence',
    'decline_enrichment': 'code category and reason from the code reference table',
    'declines_with_retry': 'declines that have at least one retry (semi join)',
    'declines_without_retry': 'declines without any retry (anti join)',
    'delay_curve': '10-point delay curve (success probability, EV) per in-scope decline',
    'document_chunks': '200-word chunks with 50-word overlap of every document (md5 per chunk)',
    'drift_metrics': 'PSI, KS statistic and p-value, JS divergence and alert per feature',
    'event_error_rates': "W6b over real times: a user's error rate in the 30 and 7 days before each event",
    'historical_feature_set': 'the standard point-in-time features of every decline',
    'metric_deltas': 'AUC, log loss, Brier, precision, recall, F1 of two scores and their differences',
    'value_labels': 'whether retrying had positive business value, per decline',
    'event_dedup': 'events kept by the 24 h first-wins dedup (batch twin of the stream)',
    'explained_top_rows': 'top 20 rows by explained score x top 5 contributions with phrases',
    'explanations': 'top-3 scorecard contributions per test decline with direction and phrase',
    'fairness_table': 'segment AUC / positive rate / F1 against the overall values',
    'feature_coverage': 'role and fill rate of every modeling-table column',
    'feature_matrix': 'typed feature matrix (booleans 0/1, MISSING categoricals) after guards',
    'feature_statistics': 'mean, exact median, distinct count, correlation with the label',
    'global_importance': 'mean |contribution| per scorecard feature',
    'historical_rates': 'prior decline rate, prior mean amount and deviation per attempt',
    'horizon_labels': 'retries and recovery within the 720 h horizon per decline',
    'label_rates': 'recovered, first-retry-recovered and retried counts and rates',
    'largest_disagreements': '12 declines with the largest champion/challenger disagreement',
    'merchant_week_mart': 'per merchant and week: attempts, approval / decline rate, top-3 codes',
    'model_importance': 'gain importance (trees) and top/bottom logistic weights',
    'model_quality': 'test AUC / log loss / Brier / F1 of rules, trees, logistic, calibrated trees',
    'modeling_table': 'one labelled row per original decline (retry-chain summary)',
    'monitor_per_minute': 'events, declines, approvals per minute (batch twin of the monitor stream)',
    'net_value_frontier': 'retries, recoveries, costs and realised net value at each grid threshold',
    'numeric_scaler': 'median, mean and population std of median-imputed numeric features',
    'overall_metrics': 'AUC, log loss, Brier, confusion, F1 over all declines',
    'payload_enrichment': 'latency bucket, amount backfill, fx flag, fee bps, boolean parses',
    'payload_validation': 'broken rules (amount, code, unknown JSON fields, ranges) per event',
    'policy_replay': '12 dollar measures for five retry strategies on the test window',
    'policy_report': 'policy replay as long (report, section, key, value) rows',
    'promotion_gate': 'net value lift, calibration error and z statistic of the challenger',
    'rate_breaches': 'max requests per trailing 60 s and breaches per key / address',
    'recovery_by_dimension': 'top-10 values per dimension with rows and recovery rate',
    'recovery_worklist': 'decisions ranked by action, EV and probability',
    'retrieval_hit_rate': 'share of label centroids with a same-label vector in their top 5',
    'rules_policy_summary': 'flagship: what the rules policy would have recovered (12 measures)',
    'scope_guard': 'first failing scope guard and hard-decline reason per decline',
    'segment_metrics': 'AUC, precision, recall, F1 for the top values of four segment columns',
    'sequence_features': 'attempt number, minutes since last, hours since first, code changed',
    'sliding_value_psi': 'PSI of event values per sliding 1-day window (1 h slide) vs the first week',
    'split_metrics': 'metric bundle per temporal split',
    'staged_events': 'typed, snake-cased events with invalid rows dropped',
    'table_tests': 'uniqueness, not-null, range, accepted-value and format tests',
    'target_encoding': 'smoothed target encoding per category (train window)',
    'temporal_split': '70/15/15 split by (timestamp NULLS LAST, id)',
    'text_schema_inference': 'boolean / numeric / string inference for all-text columns',
    'three_way_actions': 'retry / abandon / cascade by EV with failure-weighted value',
    'threshold_search': 'logistic regularisation grid scored by net value on expanding time folds',
    'threshold_sweep': 'confusion counts and F1 at each grid threshold per split',
    'timing_table': 'smoothed retry success by code, attempt and delay bucket',
    'top_category_buckets': 'top-12 country or OTHER per test decline',
    'traffic_split': 'deterministic 80/20 champion/challenger arm by md5 of the id',
    'trailing_decline_rates': '30-day and 7-day prior decline rates and their trend per attempt',
    'tree_explanations': 'top-3 path contributions of the boosted trees per test decline',
    'unseen_categories': 'share of test rows whose category is absent from the train vocabulary'}


def main() -> None:
    reg = load()
    print("# Registered queries\n")
    print("Every query reads the driver tables (whole tables) and is exposed by `__spark_entry__.queries()`.")
    print("`S` = checked against DuckDB SQL (`oracle_sql()`), `R` = rows-only.\n")
    print("| query | operators | oracle | module | summary |")
    print("| --- | --- | --- | --- | --- |")
    for name in sorted(reg):
        q = reg[name]
        summary = SUMMARY.get(name, "")
        mod = q.build.__module__.rsplit(".", 1)[-1]
        print(f"| `{name}` | {', '.join(q.ops)} | {'S' if q.sql else 'R'} | `{mod}` | {summary} |")


if __name__ == "__main__":
    main()

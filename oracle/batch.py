"""SQL for the batch-plane queries."""

from __future__ import annotations

from merchantscope import reference as ref
from merchantscope.plans import batch_queries as bq
from oracle.views import Z_FEATURES, burst_ctes, with_views

_TEXT = {
    "mcc_group", "top_category", "top_pattern", "risk_tier", "rule_names", "flag_reason",
    "family", "family_label", "subtype",
}
_DATES = {"first_txn_date", "last_txn_date"}
_INTS = {
    "txn_count", "approved_txn_count", "active_days", "n_issuer_countries", "n_issuer_bins",
    "n_acquirer_bins", "n_caids", "distinct_active_days", "n_sub_merchant_ids", "unique_cards",
    "max_txn_single_card", "active_months", "n_distinct_descriptors", "has_url_descriptor",
    "descriptor_changes", "split_burst_events", "split_txn_count", "declared_band_is_cheap",
    "rules_triggered", "flag_for_investigation", *ref.BATCH_RULES,
}


def col(c: str) -> str:
    if c in _TEXT:
        return c
    if c in _DATES:
        return f"strftime({c}, '%Y-%m-%d') AS {c}"
    if c in _INTS:
        return f"CAST({c} AS BIGINT) AS {c}"
    return f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}"


def cols(names: list[str]) -> str:
    return ", ".join(col(c) for c in names)


def features(names: list[str]) -> str:
    return with_views(f"SELECT merchant_id, {cols(names)} FROM features")


def scores(names: list[str]) -> str:
    return with_views(f"SELECT merchant_id, {cols(names)} FROM scores")


_AUDIT = """
SELECT merchant_id, txn_count_lookback, approved_count_lookback,
  round(sales_usd_lookback, 6) AS sales_usd_lookback, strftime(first_txn, '%Y-%m-%d') AS first_txn,
  strftime(last_txn, '%Y-%m-%d') AS last_txn,
  coalesce(date_diff('day', first_txn, last_txn) + 1, 0) AS active_days,
  coalesce(date_diff('day', last_txn, as_of), 999) AS days_since_last_txn,
  txn_count_lookback >= 95 AND approved_count_lookback > 0 AS passes_activity_filter,
  CASE WHEN txn_count_lookback < 95 THEN 'fewer than 95 transactions in trailing 12 months'
       WHEN approved_count_lookback = 0 THEN 'no approved transactions in lookback window'
       ELSE '' END AS exclusion_reason
FROM (SELECT merchant_id, count(*) FILTER (WHERE recent) AS txn_count_lookback,
        count(*) FILTER (WHERE recent AND approved_flag = 'Y') AS approved_count_lookback,
        coalesce(sum(settlement_amount_usd) FILTER (WHERE recent), 0) AS sales_usd_lookback,
        min(transaction_date) FILTER (WHERE recent) AS first_txn,
        max(transaction_date) FILTER (WHERE recent) AS last_txn, max(as_of) AS as_of
      FROM (SELECT *, (SELECT max(transaction_date) FROM tx) AS as_of,
              transaction_date > (SELECT max(transaction_date) FROM tx) - INTERVAL 12 MONTH AS recent
            FROM tx) GROUP BY merchant_id)
"""

_EVENT = burst_ctes(
    "evt",
    "("
    + " OR ".join(
        f"(abs(settlement_amount_usd) >= {c * ref.CEILING_LOWER_SHARE} "
        f"AND abs(settlement_amount_usd) < {c})"
        for c in ref.SPLIT_CEILINGS
    )
    + ")::INT",
)
_WIDE = {**_EVENT, "split": _EVENT["split"].replace("0.20", "0.6")}

_BURSTS = with_views(
    "SELECT merchant_id, CAST(burst_id AS BIGINT) AS burst_id, n, "
    "round(amt_mean, 6) AS amt_mean, round(amt_cv, 6) AS amt_cv, "
    "round(span_sec, 6) AS span_sec, round(near_share, 6) AS near_share FROM burst",
    _EVENT,
)

ORACLE = {
    "activity_audit": with_views(_AUDIT),
    "timeline_audit": with_views(_AUDIT),
    "volume_features": features(bq.VOLUME),
    "tenure_features": features(bq.TENURE),
    "channel_mix": features(bq.CHANNEL),
    "ticket_features": features(bq.TICKET_SHAPE),
    "timing_features": features(bq.TIMING),
    "auth_quality": features(bq.AUTH),
    "dispute_rates": features(bq.DISPUTE),
    "geo_concentration": features(bq.CONCENTRATION),
    "card_behaviour": features(bq.CARDS),
    "ticket_percentiles": with_views(
        "SELECT merchant_id, count(DISTINCT abs_amt) AS n_distinct_amounts, "
        "round(quantile_cont(abs_amt, 0.5) FILTER (approved = 1), 6) AS median_ticket_usd, "
        "round(quantile_cont(abs_amt, 0.95) FILTER (approved = 1), 6) AS p95_ticket_usd "
        "FROM fl GROUP BY merchant_id"
    ),
    "monthly_velocity": features(bq.VELOCITY),
    "descriptor_features": features(bq.DESCRIPTOR),
    "monthly_modal_descriptor": with_views(
        "SELECT merchant_id, month, merchant_descriptor AS descriptor FROM modal"
    ),
    "event_bursts": _BURSTS,
    "streamed_bursts": _BURSTS,
    "split_bursts": with_views(f"SELECT merchant_id, {cols(bq.SPLIT)} FROM split", _WIDE),
    "merchant_features": features(bq.WHOLE),
    "interchange_gap": features(bq.NORMS),
    "peer_zscores": with_views(
        "SELECT merchant_id, "
        + ", ".join(f"round(z_{c}, 6) + 0.0 AS z_{c}" for c in Z_FEATURES)
        + " FROM z"
    ),
    "category_scores": scores([*bq.CATEGORY_SCORES, "top_category", "top_category_score"]),
    "pattern_scores": scores([*bq.PATTERN_SCORES, "top_pattern", "top_pattern_score"]),
    "composite_score": scores(bq.COMPOSITE),
    "rules_and_flags": scores(bq.RULE_COLUMNS),
    "primary_family": scores(bq.FAMILY),
    "exposure_queue": with_views(
        "SELECT merchant_id, merchant_name, exposure_weighted_score, risk_tier, family "
        "FROM scores WHERE flag_for_investigation = 1"
    ),
}

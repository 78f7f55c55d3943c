"""Driver queries of the batch plane: activity, features, scores, rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantscope import reference as ref
from merchantscope.operators import activity, features as ft, peers, scoring as sc
from merchantscope.plans.workbench import Workbench, tidy
from merchantscope.session import run_folder, stage_table
from merchantscope.streaming import bursts as sb

M = "merchant_id"

# Result columns by query; the SQL side selects the same lists.
VOLUME = ["txn_count", "approved_txn_count", "sales_usd", "gross_sales_usd", "refund_usd"]
TENURE = ["first_txn_date", "last_txn_date", "active_days"]
CHANNEL = ["pct_cnp", "pct_ecom", "pct_moto", "pct_recurring", "pct_keyed", "pct_chip",
           "pct_token", "pct_3ds", "pct_quasi_cash", "pct_cross_border",
           "pct_acq_country_mismatch", "pct_offshore_acquirer"]
TICKET_SHAPE = ["avg_ticket_usd", "max_ticket_usd", "ticket_std_usd", "ticket_cv",
                "pct_round_amount", "pct_round_100", "pct_near_ceiling", "pct_ticket_gt_500",
                "pct_ticket_lt_20"]
TIMING = ["pct_night_txn", "pct_weekend_txn"]
AUTH = ["approval_rate", "decline_rate", "pct_decline_not_permitted",
        "pct_decline_suspected_fraud", "pct_decline_limit"]
DISPUTE = ["refund_rate_count", "refund_rate_amount", "reversal_rate", "chargeback_rate_bps",
           "fraud_rate_bps", "fraud_usd", "fraud_to_sales_bps", "cb_usd", "cb_to_sales_bps",
           "pct_cb_fraud_reason", "pct_cb_service_reason"]
CONCENTRATION = ["n_issuer_countries", "n_issuer_bins", "issuer_country_hhi",
                 "issuer_country_entropy", "top_issuer_country_share", "n_acquirer_bins",
                 "n_caids", "hour_entropy", "distinct_active_days", "n_sub_merchant_ids",
                 "decline_code_entropy"]
CARDS = ["unique_cards", "pct_cards_multi_use", "max_txn_single_card", "card_concentration_hhi"]
PERCENTILES = ["median_ticket_usd", "p95_ticket_usd"]
VELOCITY = ["active_months", "max_month_sales_usd", "median_month_sales_usd",
            "pct_sales_in_top_month", "max_mom_growth", "volume_spike_ratio"]
DESCRIPTOR = ["n_distinct_descriptors", "pct_generic_descriptor", "has_url_descriptor",
              "descriptor_name_jaccard", "descriptor_changes"]
SPLIT = ["split_burst_events", "split_txn_count", "mean_split_burst_size", "mean_split_gap_sec",
         "pct_split_near_ceiling"]
NORMS = ["mcc_group", "mcc_expected_avg_ticket", "mcc_expected_cnp_share",
         "mcc_expected_night_share", "ticket_vs_mcc_expected", "cnp_vs_mcc_expected",
         "night_vs_mcc_expected", "mcc_declared_interchange_bps", "effective_interchange_bps",
         "behaviour_expected_interchange_bps", "interchange_advantage_bps",
         "declared_band_is_cheap", "interchange_fee_usd"]
DERIVED = ["txn_per_active_day", "txn_per_card", "distinct_amount_ratio",
           "pct_txn_in_split_burst", "pct_txn_with_sub_merchant"]
CATEGORY_SCORES = [f"score_{c}" for c in ref.CATEGORY_WEIGHTS]
PATTERN_SCORES = [f"score_{p}" for p in ref.PATTERN_WEIGHTS]
TOPS = ["top_category", "top_category_score", "top_pattern", "top_pattern_score"]
COMPOSITE = ["integrity_composite_z", "integrity_risk_score", "integrity_percentile",
             "exposure_weighted_score", "risk_tier"]
RULE_COLUMNS = [*ref.BATCH_RULES, "rules_triggered", "rule_names", "flag_reason",
                "flag_for_investigation"]
FAMILY = ["family", "family_label", "subtype"]
WHOLE = [*VOLUME, *TENURE, *CHANNEL, *TICKET_SHAPE, *TIMING, *AUTH, *DISPUTE, *CONCENTRATION,
         *CARDS, *PERCENTILES, *VELOCITY, *DESCRIPTOR, *SPLIT, *NORMS, *DERIVED]


def activity_audit(b: Workbench, months: int = 12) -> DataFrame:
    return tidy(activity.activity_audit(b.tx, min_txn=95, lookback_months=months))


def timeline_audit(b: Workbench, months: int = 12) -> DataFrame:
    """The same audit of the fact laid out by month and day: the latest date comes from the folders."""
    laid_out = b.timeline
    return tidy(activity.activity_audit(laid_out.rows, 95, months, laid_out.latest))


def base(cols: list[str]):
    def run(b: Workbench) -> DataFrame:
        return tidy(ft.base_features(b.tx).select(M, *cols))

    return run


def dimensions(b: Workbench) -> DataFrame:
    return tidy(ft.per_merchant(b.tx, b.crowded, lambda t: ft.dimension_features(ft.dimension_counts(t))))


def cards(b: Workbench) -> DataFrame:
    rows = ft.per_merchant(b.tx, b.crowded, lambda t: ft.card_burst_features(ft.card_hour_counts(t)))
    return tidy(rows.select(M, *CARDS))


def percentiles(b: Workbench) -> DataFrame:
    amounts = stage_table(ft.per_merchant(b.tx, b.crowded, ft.amount_counts), "amount_counts")
    return tidy(ft.amount_features(amounts))


def velocity(b: Workbench) -> DataFrame:
    return tidy(ft.monthly_features(ft.month_descriptor_counts(b.tx)).select(M, *VELOCITY))


def descriptors(b: Workbench) -> DataFrame:
    months = stage_table(ft.month_descriptor_counts(b.tx), "month_descriptor_counts")
    return tidy(ft.descriptor_features(months, b.merchants))


def modal_descriptor(b: Workbench) -> DataFrame:
    return tidy(ft.monthly_modal_descriptor(ft.month_descriptor_counts(b.tx)))


def event_bursts(b: Workbench) -> DataFrame:
    """All bursts of the event table, with exact boundaries at one hour."""
    rows = ft.bursts(ft.card_hour_counts(b.fixture.events()))
    return tidy(rows.select(M, "burst_id", "n", "amt_mean", "amt_cv", "span_sec", "near_share"))


def streamed_bursts(b: Workbench) -> DataFrame:
    """The same bursts from a stream: the events arrive in three parts, in order of time."""
    events = b.fixture.events()
    events = events.withColumn("settlement_amount_usd", F.col("settlement_amount_usd").cast("double"))
    day = F.col("transaction_date")
    low, high = events.agg(F.min(day), F.max(day)).first()
    folder = f"{run_folder(b.spark)}/{uuid.uuid4().hex}"
    source, out, state = (f"{folder}/{x}" for x in ("events", "sessions", "state"))
    cuts = [low + (high - low) * k / 3 for k in (1, 2)]
    late = "30 days"
    for part in (day <= cuts[0], (day > cuts[0]) & (day <= cuts[1]), day > cuts[1]):
        events.filter(part).write.mode("append").parquet(source)
        sb.run_sessions(sb.read_events(b.spark, source, events.schema), out, state, late)
    sb.heartbeat(b.spark, events.schema, f"{high.year + 1}-12-31 00:00:00").write.mode("append").parquet(source)
    sb.run_sessions(sb.read_events(b.spark, source, events.schema), out, state, late)
    rows = sb.finished_bursts(b.spark, out, events.schema)
    return tidy(rows.select(M, "burst_id", "n", "amt_mean", "amt_cv", "span_sec", "near_share"))


def event_split_features(b: Workbench) -> DataFrame:
    """Split features of the event table; a wide CV cut keeps the set non-trivial."""
    rows = ft.bursts(ft.card_hour_counts(b.fixture.events()))
    return tidy(ft.burst_features(ft.split_bursts(rows, max_cv=0.6)).select(M, *SPLIT))


def whole_features(b: Workbench) -> DataFrame:
    return tidy(b.features.select(M, *WHOLE))


def category_norms(b: Workbench) -> DataFrame:
    return tidy(b.features.select(M, *NORMS))


def zscores(b: Workbench) -> DataFrame:
    z = peers.peer_zscores(b.features, sc.ScoreBook().features())
    return tidy(z.select(M, *[f"z_{c}" for c in sc.ScoreBook().features()]))


def scored(cols: list[str]):
    def run(b: Workbench) -> DataFrame:
        return tidy(b.scores.select(M, *cols))

    return run


def exposure_queue(b: Workbench) -> DataFrame:
    """Flagged merchants, most exposed first."""
    queue = b.scores.filter("flag_for_investigation = 1")
    return tidy(
        queue.select(M, "merchant_name", "exposure_weighted_score", "risk_tier", "family")
    ).orderBy(F.desc("exposure_weighted_score"), M)


QUERIES = {
    "activity_audit": activity_audit,
    "timeline_audit": timeline_audit,
    "volume_features": base(VOLUME),
    "tenure_features": base(TENURE),
    "channel_mix": base(CHANNEL),
    "ticket_features": base(TICKET_SHAPE),
    "timing_features": base(TIMING),
    "auth_quality": base(AUTH),
    "dispute_rates": base(DISPUTE),
    "geo_concentration": dimensions,
    "card_behaviour": cards,
    "ticket_percentiles": percentiles,
    "monthly_velocity": velocity,
    "descriptor_features": descriptors,
    "monthly_modal_descriptor": modal_descriptor,
    "event_bursts": event_bursts,
    "streamed_bursts": streamed_bursts,
    "split_bursts": event_split_features,
    "merchant_features": whole_features,
    "interchange_gap": category_norms,
    "peer_zscores": zscores,
    "category_scores": scored([*CATEGORY_SCORES, "top_category", "top_category_score"]),
    "pattern_scores": scored([*PATTERN_SCORES, "top_pattern", "top_pattern_score"]),
    "composite_score": scored(COMPOSITE),
    "rules_and_flags": scored(RULE_COLUMNS),
    "primary_family": scored(FAMILY),
    "exposure_queue": exposure_queue,
}

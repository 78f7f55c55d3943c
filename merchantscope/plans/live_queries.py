"""Driver queries of the live engine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantscope import live_reference as live
from merchantscope.functions import text
from merchantscope.operators import (
    cases as cs, entity_graph as eg, evaluation as ev, evidence as ed, explorer as ex, lanes,
    live_features as lf,
    live_rules as lr, mcc_model as mm, quality as ql, rule_rows as rr,
)
from merchantscope.plans.workbench import Workbench, tidy
from merchantscope.session import run_folder
from merchantscope.sources.state import KeyedState

M = "merchant_id"
FEATURES = [
    "txn_count", "total_volume", "avg_ticket", "std_ticket", "round_dollar_ratio",
    "card_not_present_ratio", "cross_border_ratio", "fallback_ratio", "manual_entry_ratio",
    "night_ratio", "weekend_ratio", "refund_rate", "reversal_rate", "dispute_rate",
    "not_recognized_dispute_rate", "refund_after_purchase_ratio", "cash_equivalent_ratio",
    "wallet_load_ratio", "threshold_proximity_ratio", "geo_dispersion",
]
DIVERSITY = ["descriptor_count", "descriptor_entropy", "category_diversity",
             "velocity_per_active_hour"]
CARDS = ["unique_card_ratio", "repeat_card_ratio", "rapid_repeat_ratio"]
TICKETS = ["median_ticket", "p95_ticket", "ticket_bimodality"]
GRAPH = ["shared_bank_account_count", "shared_ip_count", "shared_device_count",
         "submerchant_count", "known_bad_adjacency", "graph_score"]
COMPONENTS = ["rule_score", "supervised_score", "anomaly_score", "surcharge_score",
              "mcc_mismatch_score", "behavioral_change_score", "interchange_signal",
              "final_risk_score", "risk_tier"]


def base(b: Workbench) -> DataFrame:
    return tidy(lf.base_features(lf.approved(b.live_tx)).select(M, *FEATURES))


def diversity(b):
    return tidy(lf.diversity_features(lf.approved(b.live_tx)))


def rapid_repeats(b):
    return tidy(lf.card_features(lf.card_slices(lf.approved(b.live_tx))))


def event_rapid_repeats(b):
    """Same on the event table, whose users repeat within minutes."""
    ev_tx = b.fixture.events().select(
        M, F.col("card_token_id").alias("card_id"), F.col("transaction_datetime_utc").alias("event_ts")
    )
    return tidy(lf.card_features(lf.card_slices(ev_tx, 3600), 3600))


def tickets(b):
    return tidy(lf.ticket_features(lf.approved(b.live_tx)))


def change_point(b):
    return tidy(lf.change_point(lf.approved(b.live_tx)))


def rounded_features(b):
    cols = [*FEATURES, *DIVERSITY, *CARDS, *TICKETS, "change_point_score", "mcc_divergence"]
    return tidy(b.live_features.select(M, *cols), 4)


def text_similarity(b):
    return tidy(lf.profile_text_features(b.fixture.live_merchants()).select(
        M, "descriptor_name_similarity", "brand_mimic_score", "generic_token_ratio"))


def part_similarity(b):
    """Name against brand and type of every part: all text measures."""
    p = b.fixture.table("part")
    return tidy(p.select(
        "p_partkey",
        text.name_overlap(F.col("p_name"), F.concat_ws(" ", "p_brand", "p_name", "p_type")).alias(
            "token_jaccard"),
        text.edit_similarity(F.col("p_name"), F.col("p_type")).alias("edit_similarity"),
        text.trigram_similarity(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")).alias(
            "trigram_similarity"),
        text.generic_share(F.concat_ws(" ", "p_name", F.lit("ONLINE STORE")),
                           live.LIVE_GENERIC_TOKENS).alias("generic_share"),
    ))


def graph_metrics(b):
    return tidy(eg.graph_metrics(b.fixture.live_merchants(), b.fixture.known_bad()).select(M, *GRAPH))


def shared_parts(b):
    """Suppliers sharing parts: neighbour counts over the line items themselves."""
    members = b.fixture.table("lineitem").select(
        F.col("l_suppkey").alias(M), F.lit("bank").alias("kind"),
        F.col("l_partkey").cast("string").alias("entity_id")).distinct()
    return tidy(eg.neighbour_counts(members).select(M, "shared_bank_account_count"))


def neighbours(b):
    m = b.fixture.live_merchants()
    return tidy(eg.neighbours(eg.memberships(m), m))


def graph_edges(b):
    m = b.fixture.live_merchants()
    return tidy(eg.expand(m, m).groupBy("center", "type").agg(F.count("*").alias("edges")))


def graph_nodes(b):
    m = b.fixture.live_merchants()
    risks = b.live_records.select(M, F.col("final_risk_score").alias("risk"))
    nodes = eg.graph_nodes(eg.expand(m, m), b.fixture.known_bad(), risks)
    return tidy(nodes.groupBy("center").agg(
        F.count("*").alias("nodes"), F.count_if("known_bad").alias("known_bad"),
        F.count_if(F.col("type") == "merchant").alias("merchants")))


def graph_edge_rows(b):
    """Every edge of every merchant's bounded graph, with both ends."""
    m = b.fixture.live_merchants()
    return tidy(eg.expand(m, m))


def graph_node_rows(b):
    """Every node with its kind, risk and the known-bad mark."""
    m = b.fixture.live_merchants()
    risks = b.live_records.select(M, F.col("final_risk_score").alias("risk"))
    return tidy(eg.graph_nodes(eg.expand(m, m), b.fixture.known_bad(), risks))


def keywords(b):
    words = mm.matched_keywords(
        mm.merchant_texts(b.fixture.live_merchants(), b.live_tx), b.fixture.profiles())
    return tidy(words.select(M, F.array_join("matched_keywords", "|").alias("keywords")))


def mcc_prediction(b):
    c = F.col("mcc_candidates")
    return tidy(b.live_records.select(
        M, "declared_mcc", "predicted_mcc", "mcc_confidence", "mismatch_severity",
        "hierarchy_match", c[1]["mcc"].alias("second_mcc"),
        c[1]["probability"].alias("second_probability")))


def archetypes(b):
    return tidy(b.live_records.select(
        M, F.inline(F.transform("archetype_matches", lambda e: F.struct(
            e["archetype"].alias("archetype"), e["similarity"].alias("similarity"),
            e["attributions"][0]["share"].alias("top_share"))))))


def mcc_candidates(b):
    """All candidates of each merchant, the best first."""
    c = b.live_records.select(M, F.posexplode("mcc_candidates").alias("place", "c"))
    return tidy(c.select(M, (F.col("place") + 1).alias("place"), "c.mcc", "c.category", "c.probability"))


def archetype_attributions(b):
    """Match and share of every axis of every archetype, in the order shown."""
    each = b.live_records.select(M, F.explode("archetype_matches").alias("e"))
    axes = each.select(M, "e.archetype", "e.anchor_mcc", "e.similarity", F.posexplode("e.attributions").alias("place", "a"))
    return tidy(axes.select(M, "archetype", "anchor_mcc", "similarity", (F.col("place") + 1).alias("place"), "a.id", "a.match", "a.share"))


def rule_hits(b):
    return tidy(b.live_records.select(M, F.inline("rule_hits")).select(
        M, "rule_id", "typology", "severity", "score", "explanation"))


def rule_rows(b):
    """The default rules as rows of a table."""
    hits = rr.rule_hit_rows(b.live_features, rr.rules_frame(b.spark), [M])
    return tidy(hits.select(M, "rule_id", "typology", "severity", "score", "explanation"))


def category_rules(b):
    """A rule per category and state, made from the data: the category's busier merchants of other states."""
    f = b.live_features
    ranges = f.groupBy("declared_mcc").agg(F.min("txn_count").alias("low"), F.max("txn_count").alias("high"))
    made = f.select("declared_mcc", "state").distinct().join(ranges, "declared_mcc")

    def condition(feature, operator, number="NULL", texts="NULL"):
        return F.expr(f"named_struct('feature', '{feature}', 'operator', '{operator}', 'number', CAST({number} AS DOUBLE), "
                      f"'text', CAST(NULL AS STRING), 'texts', CAST({texts} AS ARRAY<STRING>))")

    rules = made.select(
        F.concat_ws("-", "declared_mcc", "state").alias("id"), F.lit("busy elsewhere").alias("name"), F.lit("MCC_ABUSE").alias("typology"),
        F.lit("LOW").alias("severity"), F.lit(5.0).alias("score"), F.lit("").alias("template"), F.lit(True).alias("enabled"),
        F.array(condition("declared_mcc", "in", texts="array(declared_mcc)"), condition("state", "not-in", texts="array(state)"),
                condition("txn_count", ">=", number="low + (high - low) DIV 2")).alias("conditions"))
    return tidy(rr.matches(f, rules, [M]))


def rule_overrides(b):
    """Two rules switched off: hits are recomputed from the stored features."""
    rules = lr.apply_overrides(live.DEFAULT_RULES, {"RULE-MCC-002": False, "RULE-GEN-001": False})
    base = b.live_features
    return tidy(lr.rule_hit_counts(lr.evaluate_rules(base, rules)))


def peer_population_z(b):
    return tidy(b.live_records.select(M, "peer_night_z", "peer_cnp_z", "peer_ticket_z"))


def ensemble(b):
    return tidy(b.live_records.select(M, *COMPONENTS))


def contributions(b):
    return tidy(b.live_records.select(M, F.inline("contributions")))


def typologies(b):
    t = F.col("typology_scores")
    return tidy(b.live_records.select(
        M, "primary_typology", *[F.element_at(t, F.lit(x)).alias(x.lower()) for x in live.TYPOLOGIES]))


def thresholds(b):
    return tidy(lanes.typology_thresholds(b.live_records))


def routing(b):
    routed = lanes.route(b.live_records, lanes.typology_thresholds(b.live_records))
    return tidy(routed.select(
        M, "lane", "queue_verb", F.array_join("active_typologies", "|").alias("active"),
        F.array_join("lanes_touched", "|").alias("touched")))


def totals(b):
    return tidy(lanes.portfolio_totals(b.live_records))


def typology_summary(b):
    return tidy(lanes.typology_summary(b.live_records))


def daily(b):
    return lanes.daily_volume(b.live_tx, *b.live_window)


def lane_rollup(b):
    return tidy(lanes.lane_summary(b.live_records, daily(b)))


def daily_trend(b):
    return tidy(lanes.daily_trend(daily(b), b.live_records, *b.live_window))


def geo(b):
    return tidy(lanes.geo_summary(b.live_records))


def histogram(b):
    return tidy(lanes.score_histogram(b.live_records))


def members(b):
    return tidy(cs.case_members(b.live_records).drop("trade_name"))


def cases(b):
    made = cs.acquirer_cases(cs.case_members(b.live_records), F.to_date(F.lit("2001-08-01")))
    return tidy(cs.sla_state(made, F.to_date(F.lit("2001-08-04"))))


def case_patches(b):
    made = cs.acquirer_cases(cs.case_members(b.live_records), F.to_date(F.lit("2001-08-01")))
    made = made.withColumn("notes", F.array(F.lit("opened")))
    patches = made.filter(F.col("merchant_count") % 2 == 0).select(
        "case_id", F.lit("triage").alias("status"), F.array(F.lit("checked")).alias("notes"))
    merged = cs.merge_patches(made, patches)
    return tidy(merged.select("case_id", "status", F.array_join("notes", "|").alias("notes")))


def engine_samples(b):
    """Events as transactions: full rows of the busiest users, 24 sampled of the others."""
    tx = b.fixture.events().select(
        M, F.col("event_id").alias("transaction_id"), F.col("transaction_datetime_utc").alias("event_ts"))
    records = tx.groupBy(M).agg(F.count("*").alias("final_risk_score"))
    return tidy(ex.engine_samples(tx, records).select(M, "transaction_id"))


def case_statuses(b):
    made = cs.acquirer_cases(cs.case_members(b.live_records), F.to_date(F.lit("2001-08-01")))
    return tidy(cs.status_counts(cs.filter_cases(made, "OPEN")))


def filed_cases(b):
    """Events as a filing log: the newest entry per user."""
    log = b.fixture.events().select(
        M, F.col("transaction_datetime_utc").alias("filed_at"), F.col("event_id").alias("filing_id"))
    return tidy(cs.file_cases(log))


def filed_state(b):
    """The filing log taken into a keyed state in three batches that do not follow time."""
    log = b.fixture.events().select(
        M, F.col("transaction_datetime_utc").alias("filed_at"), F.col("event_id").alias("filing_id"))
    state = KeyedState(b.spark, f"{run_folder(b.spark)}/{uuid.uuid4().hex}/filed", log.schema, (M,), ("filed_at", "filing_id"), slots=16)
    for batch in range(3):
        state.upsert(log.filter(F.pmod("filing_id", F.lit(3)) == batch))
    return tidy(state.rows())


def evidence(b):
    return tidy(ed.evidence_rows(b.live_records))


def confidence(b):
    return tidy(ed.confidence(b.live_records).select(M, "confidence", "confidence_label"))


def corroboration(b):
    return tidy(ed.corroboration(b.live_records))


def labelled(b):
    return b.live_records.join(b.fixture.live_labels(), M)


def live_curve(b):
    return tidy(ev.precision_curve(labelled(b), "final_risk_score", "abuse", "exposure"))


def live_class_precision(b):
    return tidy(ev.class_precision(labelled(b), "final_risk_score", "primary_typology",
                                   "true_typology", 28))


def contribution_importance(b):
    return tidy(ev.mean_contribution(b.live_records.withColumn("top", ed.top_contributions()),
                                     "top", "final_risk_score", 28))


def quality(b):
    tx = b.live_tx.withColumn(
        "card_id", F.when(F.col("card_id") % 100 == 7, F.lit("4000123412341234")).otherwise(
            F.format_string("C-%06d", F.col("card_id"))))
    return tidy(ql.transaction_checks(tx))


def share_quality(b):
    return tidy(ql.share_checks(b.features, ["pct_cnp", "refund_rate_count", "volume_spike_ratio"]))


def label_quality(b):
    labels = b.fixture.labels().withColumn(
        "typology", F.when(F.col("is_interchange_abuse"), "MCC_ABUSE").otherwise("CLEAN"))
    return tidy(ql.label_checks(labels, "is_integrity_violation", "typology"))


def row_quality(b):
    """The bounds a book of this kind is asked for: merchants, then transactions."""
    merchants = ql.row_bounds(b.live_records, 1_000, 5_000).withColumn("table", F.lit("merchants"))
    return tidy(merchants.unionByName(ql.row_bounds(b.live_tx, 1_000).withColumn("table", F.lit("transactions"))))


def enum_quality(b):
    return tidy(ql.enum_checks(b.live_tx, {
        "authorization_status": ["approved", "declined"], "entry_mode": ["manual", "chip", "contactless"],
        "dispute_reason": ["other"]}))


def missing(b):
    wanted = b.fixture.table("customer").select(F.col("c_custkey").alias(M))
    return tidy(ql.missing_ids(b.live_records, wanted, M))


QUERIES = {
    "live_base_features": base,
    "live_diversity": diversity,
    "live_card_behaviour": rapid_repeats,
    "rapid_repeats": event_rapid_repeats,
    "live_ticket_percentiles": tickets,
    "change_point": change_point,
    "live_features": rounded_features,
    "levenshtein_similarity": text_similarity,
    "token_jaccard": part_similarity,
    "graph_metrics": graph_metrics,
    "neighbor_counts": shared_parts,
    "graph_neighbours": neighbours,
    "graph_edges": graph_edges,
    "graph_nodes": graph_nodes,
    "graph_edge_rows": graph_edge_rows,
    "graph_node_rows": graph_node_rows,
    "keyword_matches": keywords,
    "mcc_prediction": mcc_prediction,
    "archetype_similarity": archetypes,
    "mcc_candidates": mcc_candidates,
    "archetype_attributions": archetype_attributions,
    "live_rule_hits": rule_hits,
    "rule_rows": rule_rows,
    "category_rules": category_rules,
    "rule_overrides": rule_overrides,
    "peer_population_z": peer_population_z,
    "ensemble_scores": ensemble,
    "feature_contributions": contributions,
    "typology_scores": typologies,
    "typology_thresholds": thresholds,
    "lane_routing": routing,
    "portfolio_totals": totals,
    "typology_summary": typology_summary,
    "lane_rollup": lane_rollup,
    "daily_trend": daily_trend,
    "geo_summary": geo,
    "score_histogram": histogram,
    "case_members": members,
    "case_rollup": cases,
    "case_patches": case_patches,
    "case_statuses": case_statuses,
    "engine_samples": engine_samples,
    "filed_cases": filed_cases,
    "filed_state": filed_state,
    "evidence_rows": evidence,
    "evidence_confidence": confidence,
    "corroboration": corroboration,
    "live_threshold_curve": live_curve,
    "live_class_precision": live_class_precision,
    "contribution_importance": contribution_importance,
    "quality_transactions": quality,
    "quality_shares": share_quality,
    "quality_missing_ids": missing,
    "quality_labels": label_quality,
    "quality_rows": row_quality,
    "quality_enums": enum_quality,
}

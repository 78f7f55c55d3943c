"""The live scoring run: transactions and profiles to routed risk records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from merchantscope import live_reference as live
from merchantscope.operators import (
    entity_graph as eg, lanes, live_features as lf, live_rules as lr, live_scoring as ls,
    mcc_model as mm, peers,
)
from merchantscope.session import stage_table

M = "merchant_id"
PEER_COLUMNS = {
    "night_ratio": "peer_night_z",
    "card_not_present_ratio": "peer_cnp_z",
    "avg_ticket": "peer_ticket_z",
}


def live_feature_table(
    tx: DataFrame, merchants: DataFrame, profiles: DataFrame, known_bad: DataFrame
) -> DataFrame:
    """Everything that reads the fact or the graph: one row per merchant."""
    features = lf.merchant_features(tx, merchants, profiles)
    graph = eg.graph_metrics(merchants, known_bad)
    words = mm.matched_keywords(mm.merchant_texts(merchants, tx), profiles)
    return features.join(graph, M, "left").join(words, M, "left")


def score_live(
    feature_table: DataFrame, profiles: DataFrame, rules: list[live.Rule] = live.DEFAULT_RULES
) -> DataFrame:
    """Peers, classifier, archetypes, rules, ensemble, typologies, contributions.

    Works on the stored feature table, so changed rules are re-scored without
    touching the transactions again.
    """
    out = peers.population_zscores(feature_table, PEER_COLUMNS, "declared_mcc")
    out = mm.predict_mcc(out, profiles)
    out = mm.archetype_matches(out)
    out = lr.evaluate_rules(out, rules)
    out = ls.typologies(ls.ensemble(out))
    return lanes.with_exposure(out.withColumn("contributions", ls.contributions()))


def run_live(
    tx: DataFrame, merchants: DataFrame, profiles: DataFrame, known_bad: DataFrame,
    rules: list[live.Rule] = live.DEFAULT_RULES,
) -> DataFrame:
    """Risk records with routing, from stored stages."""
    features = stage_table(live_feature_table(tx, merchants, profiles, known_bad), "live_features")
    records = stage_table(score_live(features, profiles, rules), "live_records")
    return lanes.route(records, lanes.typology_thresholds(records))

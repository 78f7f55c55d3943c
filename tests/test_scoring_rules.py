"""Boundaries of tiers, rules, families, flags and null handling."""

import pytest
from pyspark.sql import functions as F

from merchantscope import live_reference as live
from merchantscope import reference as ref
from merchantscope.functions import numeric as nm, text
from merchantscope.operators import live_rules as lr, live_scoring as ls, peers, scoring as sc

CALM = dict(
    pct_txn_in_split_burst=0.0, pct_near_ceiling=0.0, n_sub_merchant_ids=0, volume_spike_ratio=1.0,
    descriptor_changes=0, descriptor_name_jaccard=1.0, pct_quasi_cash=0.0, declared_mcc="5411",
    pct_night_txn=0.0, pct_round_amount=0.0, pct_cross_border=0.0, chargeback_rate_bps=0.0,
    refund_rate_count=0.0, pct_decline_not_permitted=0.0, pct_round_100=0.0, avg_ticket_usd=10.0,
    pct_ticket_gt_500=0.0, interchange_advantage_bps=0.0, declared_band_is_cheap=0,
    cnp_vs_mcc_expected=0.0, integrity_risk_score=10.0, pct_txn_with_sub_merchant=0.0,
    score_mcc_miscoding=50.0, score_descriptor=0.0, top_category="gambling",
)
CASES = [
    ("split_ticketing_rule", dict(pct_txn_in_split_burst=0.11, pct_near_ceiling=0.16), True),
    ("split_ticketing_rule", dict(pct_txn_in_split_burst=0.10, pct_near_ceiling=0.16), False),
    ("factoring_rule", dict(n_sub_merchant_ids=2, volume_spike_ratio=3.1), True),
    ("factoring_rule", dict(n_sub_merchant_ids=2, volume_spike_ratio=3.0), False),
    ("factoring_rule", dict(n_sub_merchant_ids=2, volume_spike_ratio=None), False),
    ("descriptor_churn_rule", dict(descriptor_changes=3, descriptor_name_jaccard=0.19), True),
    ("descriptor_churn_rule", dict(descriptor_changes=3, descriptor_name_jaccard=0.20), False),
    ("undeclared_quasi_cash_rule", dict(pct_quasi_cash=0.26), True),
    ("undeclared_quasi_cash_rule", dict(pct_quasi_cash=0.26, declared_mcc="6051"), False),
    ("undeclared_quasi_cash_rule", dict(pct_quasi_cash=0.26, declared_mcc=None), True),
    ("gambling_behaviour_rule",
     dict(pct_night_txn=0.36, pct_round_amount=0.31, pct_cross_border=0.31), True),
    ("gambling_behaviour_rule",
     dict(pct_night_txn=0.35, pct_round_amount=0.31, pct_cross_border=0.31), False),
    ("dispute_excursion_rule", dict(chargeback_rate_bps=101.0, refund_rate_count=0.06), True),
    ("dispute_excursion_rule", dict(chargeback_rate_bps=100.0, refund_rate_count=0.06), False),
    ("issuer_prohibition_rule", dict(pct_decline_not_permitted=0.051), True),
    ("issuer_prohibition_rule", dict(pct_decline_not_permitted=0.05), False),
    ("cash_disbursement_rule",
     dict(pct_round_100=0.41, avg_ticket_usd=401.0, pct_ticket_gt_500=0.31), True),
    ("cash_disbursement_rule",
     dict(pct_round_100=0.41, avg_ticket_usd=401.0, pct_ticket_gt_500=0.31, declared_mcc="6011"), False),
    ("interchange_abuse_rule", dict(interchange_advantage_bps=51.0, declared_band_is_cheap=1), True),
    ("interchange_abuse_rule", dict(interchange_advantage_bps=50.0, declared_band_is_cheap=1), False),
    ("interchange_abuse_rule", dict(interchange_advantage_bps=26.0, cnp_vs_mcc_expected=0.56), True),
    ("interchange_abuse_rule", dict(interchange_advantage_bps=None, cnp_vs_mcc_expected=0.56), False),
]
SCHEMA = ", ".join(
    f"{k} {'string' if isinstance(v, str) else 'int' if isinstance(v, int) else 'double'}"
    for k, v in CALM.items()
)


def test_rule_boundaries(spark):
    rows = [tuple({**CALM, **change}.values()) for _, change, _ in CASES]
    out = sc.apply_batch_rules(spark.createDataFrame(rows, SCHEMA)).toPandas()
    # Row order is kept: a local relation with row-local expressions only.
    for i, (rule, change, fires) in enumerate(CASES):
        assert out[rule][i] == int(fires), (rule, change)
        assert out.rule_names[i] == (rule if fires else "")
        assert out.flag_reason[i] == ("rule" if fires else "")


def test_rule_names_are_complete(spark):
    assert list(sc.batch_rules()) == ref.BATCH_RULES


@pytest.mark.parametrize("score,tier", [
    (60.0, "Low"), (60.1, "Monitor"), (75.0, "Monitor"), (75.1, "Elevated"), (85.0, "Elevated"),
    (85.1, "High"), (93.0, "High"), (93.1, "Critical"),
])
def test_batch_tiers_are_right_closed(spark, score, tier):
    assert spark.range(1).select(sc.batch_tier(F.lit(score))).first()[0] == tier


@pytest.mark.parametrize("score,tier", [(80.0, "critical"), (79.9, "high"), (62.0, "high"),
                                        (45.0, "elevated"), (28.0, "watch"), (27.9, "clear")])
def test_live_tiers_are_left_closed(spark, score, tier):
    assert spark.range(1).select(ls.live_tier(F.lit(score))).first()[0] == tier


@pytest.mark.parametrize("change,family", [
    (dict(interchange_abuse_rule=1, split_ticketing_rule=1), "mcc_abuse"),
    (dict(split_ticketing_rule=1, n_sub_merchant_ids=5), "split_ticketing"),
    (dict(pct_txn_with_sub_merchant=0.30), "factoring"),
    (dict(score_mcc_miscoding=44.9, score_descriptor=70.0), "descriptor"),
    (dict(score_mcc_miscoding=45.0, score_descriptor=70.0), "mcc_miscoding"),
    (dict(pct_quasi_cash=0.45), "cash"),
    (dict(cash_disbursement_rule=1), "cash"),
    (dict(), "mcc_miscoding"),
])
def test_family_cascade(spark, change, family):
    row = {**CALM, **{r: 0 for r in ref.BATCH_RULES}, **change}
    schema = SCHEMA + "".join(f", {r} int" for r in ref.BATCH_RULES)
    df = spark.createDataFrame([tuple(row.values())], schema)
    assert df.select(sc.primary_family()).first()[0] == family


def test_first_listed_model_wins_a_tie(spark):
    df = spark.createDataFrame([(5.0, 7.0, 7.0)], "score_a double, score_b double, score_c double")
    name, best = sc.top_model(["a", "b", "c"])
    assert df.select(name, best).first()[:] == ("b", 7.0)


def test_few_peers_fall_back_to_everyone(spark):
    rows = [("big", float(i)) for i in range(30)] + [("small", 100.0)]
    z = peers.peer_zscores(spark.createDataFrame(rows, "mcc_group string, x double"), ["x"]).toPandas()
    every = [v for _, v in rows]
    mean = sum(every) / len(every)
    sd = (sum((v - mean) ** 2 for v in every) / (len(every) - 1)) ** 0.5
    assert z[z.mcc_group == "small"].z_x.iloc[0] == pytest.approx(min(5, (100 - mean) / sd))


def test_no_spread_gives_zero(spark):
    df = spark.createDataFrame([("g", 0.3)] * 40, "mcc_group string, x double")
    assert {r.z_x for r in peers.peer_zscores(df, ["x"]).collect()} == {0.0}


def test_rounding_modes(spark):
    row = spark.range(1).select(
        nm.round_half_even(F.lit(0.25), 1), nm.round_half_up(F.lit(0.25), 1),
        nm.round_half_up(F.lit(-0.25), 1),
    ).first()
    assert row[:] == (0.2, 0.3, -0.2)


def test_finite_or(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("inf",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(nm.finite_or(F.col("s"), -1.0)).collect()] == [1.5, -1, -1, -1, -1]


def test_text_measures(spark):
    row = spark.range(1).select(
        text.name_overlap(F.lit("Acme Foods LLC"), F.lit("ACME*FOODS 12")),
        text.edit_similarity(F.lit("abcd"), F.lit(" ABXD ")),
        text.trigram_similarity(F.lit("ab"), F.lit("AB!")),
        text.generic_share(F.lit("global shop LLC"), live.LIVE_GENERIC_TOKENS),
        text.edit_similarity(F.lit(""), F.lit("")),
    ).first()
    assert row[0] == pytest.approx(2 / 3) and row[1] == 0.75 and row[2] == 1.0
    assert row[3] == pytest.approx(2 / 3) and row[4] == 1.0


def test_rules_as_data_round_trip(spark, tmp_path):
    (tmp_path / "rules.json").write_text(
        '{"id":"R1","name":"n","typology":"T","severity":"HIGH","score":5,"template":"{{nightPct}}% {{x}}",'
        '"conditions":[{"feature":"night_ratio","operator":">=","number":0.5},'
        '{"feature":"declared_mcc","operator":"not-in","texts":["7995"]}]}\n'
        '{"id":"R2","name":"n","typology":"T","severity":"LOW","score":1,"enabled":false,"conditions":[]}\n'
        '{"id":"R3","name":"n","typology":"T","severity":"LOW","score":1,'
        '"conditions":[{"feature":"unknown","operator":">","number":0}]}\n'
    )
    rules = lr.rules_from_json(spark, str(tmp_path / "rules.json"))
    needed = sorted({c for c in (
        "card_not_present_ratio night_ratio cash_equivalent_ratio wallet_load_ratio round_dollar_ratio "
        "refund_after_purchase_ratio threshold_proximity_ratio rapid_repeat_ratio cross_border_ratio "
        "fallback_ratio not_recognized_dispute_rate dispute_rate refund_rate descriptor_name_similarity "
        "descriptor_entropy brand_mimic_score mcc_divergence manual_entry_ratio descriptor_count "
        "shared_bank_account_count").split()})
    df = spark.createDataFrame([("5411",), ("7995",)], "declared_mcc string").select(
        "declared_mcc", *[F.lit(0.5).alias(c) for c in needed])
    hits = {r.declared_mcc: r.rule_hits for r in lr.evaluate_rules(df, rules).collect()}
    assert [h.rule_id for h in hits["5411"]] == ["R1"] and hits["7995"] == []
    assert hits["5411"][0].explanation == "50% {{x}}"

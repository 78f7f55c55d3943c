"""Hand-made records with expected values: case fines and actions, and every tell."""

from pyspark.sql import functions as F

from merchantscope.operators import anatomy as an
from merchantscope.operators import cases as cs

RECORD = (
    "acquirer_id string, merchant_id long, trade_name string, primary_typology string, risk_tier string, "
    "final_risk_score double, exposure double"
)


def test_case_fines_and_actions(spark):
    rows = [
        ("A", 1, "x", "FACTORING", "critical", 90.0, 100_000.0), ("A", 2, "y", "MCC_ABUSE", "high", 70.0, 50_000.0),
        ("A", 5, "w", "FACTORING", "high", 65.0, 0.0), ("B", 3, "z", "CASH_DISBURSEMENT", "high", 63.0, 1_000.0),
        ("B", 4, "v", "CLEAN", "clear", 3.0, 9_999.0),
    ]
    members = cs.case_members(spark.createDataFrame(rows, RECORD))
    assert {r.merchant_id: r.fine_usd for r in members.collect()} == {1: 37_000.0, 2: 13_000.0, 5: 10_000.0, 3: 10_060.0}
    made = {r.acquirer_id: r for r in cs.acquirer_cases(members, F.to_date(F.lit("2024-01-01"))).collect()}
    a, b = made["A"], made["B"]
    assert (a.typology, a.severity, a.queue, a.recommended_action) == ("FACTORING", "critical", "Laundering & Factoring", "escalate-network-integrity")
    assert (b.severity, b.queue, b.recommended_action, b.total_fine_usd) == ("high", "Cash Abuse", "heightened-monitoring", 10_060.0)


def test_all_eleven_tells(spark):
    plain = dict(
        settlement_amount_usd=123.0, local_hour=12, channel="POS", card_present_flag="Y", acquirer_country="US", issuer_country="US",
        merchant_acquirer_country_mismatch="N", approved_flag="Y", recurring_flag="N", split_group_id=None, sub_merchant_id=None,
    )
    cases = [
        ("night", "mcc_miscoding", dict(local_hour=3)), ("round", "cash", dict(settlement_amount_usd=300.0)),
        ("cnp", "descriptor", dict(card_present_flag="N")), ("offshore", "factoring", dict(acquirer_country="KY")),
        ("declined", "mcc_miscoding", dict(approved_flag="N")), ("recurring", "mcc_abuse", dict(recurring_flag="Y")),
        ("cpmismatch", "mcc_abuse", dict(channel="ECOM")), ("ceiling", "split_ticketing", dict(settlement_amount_usd=470.0)),
        ("burst", "split_ticketing", dict(split_group_id="G1")), ("submerchant", "factoring", dict(sub_merchant_id="S1")),
        ("big", "cash", dict(settlement_amount_usd=512.0)),
    ]
    names = list(plain)
    rows = [(tag, family, 500.0, *[{**plain, **change}[n] for n in names]) for tag, family, change in cases]
    rows += [(f"none:{family}", family, 500.0, *plain.values()) for family in ("mcc_miscoding", "mcc_abuse", "split_ticketing", "factoring", "cash")]
    kinds = {"settlement_amount_usd": "double", "local_hour": "int"}
    schema = "tag string, family string, ceiling double, " + ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    df = spark.createDataFrame(rows, schema)
    got = df.select("tag", an.row_tells(F.col("family"), F.col("ceiling"), F.lit("US")).alias("tells")).collect()
    assert {r.tag: r.tells for r in got} == {**{tag: [tag] for tag, _, _ in cases}, **{r[0]: [] for r in rows[len(cases):]}}

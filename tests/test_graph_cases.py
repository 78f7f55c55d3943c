"""Graph expansion, cases, patches, filing, surcharge and quality on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchantscope.operators import cases as cs, entity_graph as eg, quality as ql, surcharge as su

MERCHANT = (
    "merchant_id long, settlement_bank_account_id string, beneficial_owner_id string, "
    "ip_cluster_ids array<string>, device_ids array<string>"
)


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(300):
        bank = "HOT" if rng.random() < 0.35 else f"B{rng.integers(0, 120)}"
        ips = [f"I{x}" for x in rng.choice(60, rng.integers(0, 4), replace=False)]
        devices = [f"D{x}" for x in rng.choice(80, rng.integers(0, 3), replace=False)]
        rows.append((i, bank, f"O{i}", ips, devices))
    m = spark.createDataFrame(rows, MERCHANT)
    got = {}
    for r in eg.neighbours(eg.memberships(m), m).collect():
        got.setdefault(r.merchant_id, {})[r.neighbour_rank] = r.neighbour_id
    for i, bank, _, ips, devices in rows:
        seen = []
        chain = [("b", bank)] + [("i", x) for x in ips] + [("d", x) for x in devices]
        for kind, entity in chain:
            for j, bank2, _, ips2, devices2 in rows:
                theirs = {"b": [bank2], "i": ips2, "d": devices2}[kind]
                if j != i and entity in theirs and j not in seen:
                    seen.append(j)
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == seen[:8]


def test_a_neighbour_on_two_ips_counts_twice(spark):
    rows = [(1, "B1", "O1", ["I1", "I2"], []), (2, "B2", "O2", ["I1", "I2"], [])]
    out = eg.neighbour_counts(eg.memberships(spark.createDataFrame(rows, MERCHANT))).collect()
    assert {r.merchant_id: r.shared_ip_count for r in out} == {1: 2, 2: 2}


def test_patch_values_win_and_logs_grow(spark):
    cases = spark.createDataFrame(
        [("C1", "new", ["a"]), ("C2", "new", ["a"])], "case_id string, status string, notes array<string>")
    patches = spark.createDataFrame(
        [("C1", None, ["b"])], "case_id string, status string, notes array<string>")
    out = {r.case_id: r for r in cs.merge_patches(cases, patches).collect()}
    assert out["C1"].status == "new" and out["C1"].notes == ["a", "b"] and out["C2"].notes == ["a"]


def test_filing_keeps_the_newest_per_merchant(spark):
    log = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (2, 15, 3)],
                                "merchant_id long, filed_at long, filing_id long")
    state = cs.file_cases(log)
    assert sorted((r.merchant_id, r.filed_at) for r in state.collect()) == [(1, 20), (2, 15)]
    assert [r.merchant_id for r in cs.newest_cases(state, 1).collect()] == [1]


def test_case_totals_equal_member_sums(spark):
    rows = [("A", i, "x", t, tier, 60.0 + i, 1000.0 * i)
            for i, (t, tier) in enumerate([("FACTORING", "high"), ("FACTORING", "critical"),
                                           ("MCC_ABUSE", "high")])]
    records = spark.createDataFrame(rows, "acquirer_id string, merchant_id long, trade_name string, "
                                    "primary_typology string, risk_tier string, final_risk_score double, "
                                    "exposure double")
    members = cs.case_members(records)
    case = cs.acquirer_cases(members, F.to_date(F.lit("2024-01-01"))).first()
    assert case.total_fine_usd == members.agg(F.sum("fine_usd")).first()[0]
    assert (case.typology, case.severity, case.merchant_count) == ("FACTORING", "critical", 3)
    assert str(case.sla_due) == "2024-01-03"


@pytest.mark.parametrize("country,rate,disclosed,prepaid,status", [
    ("DE", 10.0, True, False, "SEVERE VIOLATION"), ("GB", 10.0, True, False, "SEVERE VIOLATION"),
    ("US", 300.0, True, False, "COMPLIANT"), ("US", 301.0, True, False, "POTENTIAL VIOLATION"),
    ("US", 100.0, True, True, "SEVERE VIOLATION"), ("ZZ", 900.0, True, False, "COMPLIANT"),
    ("ZZ", 900.0, False, False, "POTENTIAL VIOLATION"), ("US", 100.0, None, False, "INSUFFICIENT DATA"),
])
def test_surcharge_status(spark, country, rate, disclosed, prepaid, status):
    df = spark.createDataFrame(
        [(1, country, rate, 0.5, disclosed, prepaid, 100.0)],
        "merchant_id long, merchant_country string, surcharge_rate_bps double, pct_txn_surcharged double, "
        "surcharge_disclosed boolean, surcharges_debit_prepaid boolean, gross_sales_usd double")
    assert su.assess(df).first().status == status


def test_quality_counts(spark):
    tx = spark.createDataFrame([("C-000001", 5.0), ("4000123412341234", -1.0), (None, 1.0)],
                               "card_id string, amount double")
    assert ql.transaction_checks(tx).first()[:] == (3, 2, 1, 1)
    labels = spark.createDataFrame([(True, "X"), (True, "CLEAN"), (None, "X")], "abuse boolean, typology string")
    assert ql.label_checks(labels, "abuse", "typology").first()[:] == (1, 1)
    codes = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert ql.enum_checks(codes, {"c": ["a"]}).first().violations == 1
    assert ql.row_bounds(codes, 1, 2).first()[:] == (3, False)

"""Fixed values of the live engine: rules, archetypes, weights, lanes."""

from __future__ import annotations

from dataclasses import dataclass, field

# --------------------------------------------------------------------------
# features
# --------------------------------------------------------------------------
MONITORING_THRESHOLD = 500.0
RAPID_REPEAT_SECONDS = 300
KNOWN_BRANDS = [
    "WALMART SUPERCENTER", "AMAZON", "TARGET", "COSTCO WHOLESALE", "BEST BUY", "HOME DEPOT",
    "APPLE STORE", "NETFLIX", "UBER", "STARBUCKS",
]
LIVE_GENERIC_TOKENS = [
    "LLC", "INC", "GROUP", "SVCS", "SERVICES", "TRADING", "GLOBAL", "ONLINE", "STORE", "CO",
    "CORP", "HOLDINGS", "VARIES", "MULTI",
]
FALLBACK_PROFILE_MCC = "5999"
NOT_RECOGNISED = "merchant not recognized"

# --------------------------------------------------------------------------
# Nearest-profile classifier
# --------------------------------------------------------------------------
PROFILE_SIGMA = {"cnp": 0.18, "night": 0.16, "ticket": 0.7, "dispute": 0.03}
PROFILE_WEIGHT = {"cnp": 0.28, "night": 0.20, "ticket": 0.22, "dispute": 0.10, "cash": 0.20}
PROFILE_KEYWORD_BOOST = 0.6
PROFILE_TEMPERATURE = 0.16
CASH_PROFILE_MCCS = ["6051", "7995"]

# --------------------------------------------------------------------------
# ensemble
# --------------------------------------------------------------------------
ENSEMBLE_WEIGHTS = {
    "rule": 0.15, "supervised": 0.20, "anomaly": 0.15, "graph": 0.15, "surcharge": 0.15,
    "mcc_mismatch": 0.10, "behavioral_change": 0.10,
}
SEVERITY_BASE = {"critical": 90.0, "high": 72.0, "elevated": 55.0, "watch": 30.0, "clear": 6.0}
CARD_PRESENT_BANDS = ["5411", "5812", "5541", "5499", "5814"]
INTERCHANGE_OVERRIDE_AT = 45.0
CLEAN_BELOW = 28.0
EXPOSURE_FACTOR = 0.12
SECONDARY_TYPOLOGY_PERCENTILE = 0.9

TYPOLOGIES = [
    "MCC_MISCODING", "MCC_ABUSE", "SPLIT_TICKETING", "FACTORING", "CARD_SURCHARGE",
    "CASH_DISBURSEMENT",
]

# id, feature, weight, intensity (scale, cap) as min(1, value*scale) when capped,
# and whether a high value raises the score.
CONTRIBUTIONS = [
    ("F-001", "mcc_divergence", 26.0, 1 / 0.6, True, True),
    ("F-002", "card_not_present_ratio", 16.0, 1.0, False, True),
    ("F-003", "night_ratio", 15.0, 1 / 0.6, True, True),
    ("F-004", "cash_equivalent_ratio", 20.0, 1.5, True, True),
    ("F-005", "round_dollar_ratio", 14.0, 1.0, False, True),
    ("F-006", "refund_after_purchase_ratio", 14.0, 1.5, True, True),
    ("F-007", "threshold_proximity_ratio", 15.0, 1.5, True, True),
    ("F-008", "wallet_load_ratio", 15.0, 1.5, True, True),
    ("F-009", "descriptor_entropy", 13.0, 1 / 2.2, True, True),
    ("F-010", "brand_mimic_score", 16.0, 1.0, False, True),
    ("F-011", "not_recognized_dispute_rate", 14.0, 15.0, True, True),
    ("F-012", "cross_border_ratio", 10.0, 1.0, False, True),
    ("F-013", "shared_bank_account_count", 16.0, 1 / 4, True, True),
    ("F-014", "submerchant_count", 14.0, 1 / 8, True, True),
    ("F-015", "change_point_score", 12.0, 1.0, False, True),
    ("F-016", "avg_ticket", 6.0, 1 / 500, True, True),
    ("F-017", "repeat_card_ratio", 9.0, 1.0, False, True),
    ("F-018", "descriptor_name_similarity", 10.0, 1.0, False, False),
]

# Archetype -> anchor code, keywords, axes (id, feature, target, sigma, weight).
ARCHETYPES = {
    "adult": (
        "7273",
        ["dating", "match", "companions", "social", "adult", "cam", "escort"],
        [
            ("F-002", "card_not_present_ratio", 0.98, 0.12, 18.0),
            ("F-003", "night_ratio", 0.55, 0.18, 22.0),
            ("F-011", "not_recognized_dispute_rate", 0.05, 0.03, 20.0),
            ("D-DIS", "dispute_rate", 0.06, 0.035, 14.0),
            ("F-017", "repeat_card_ratio", 0.5, 0.25, 10.0),
        ],
    ),
    "gambling": (
        "7995",
        ["bet", "casino", "wager", "poker", "slots", "gaming", "stake", "odds"],
        [
            ("F-004", "cash_equivalent_ratio", 0.35, 0.2, 20.0),
            ("F-003", "night_ratio", 0.55, 0.18, 18.0),
            ("F-005", "round_dollar_ratio", 0.45, 0.22, 16.0),
            ("F-002", "card_not_present_ratio", 0.98, 0.12, 12.0),
            ("F-016", "avg_ticket", 260.0, 220.0, 12.0),
        ],
    ),
    "pharma": (
        "5967",
        ["rx", "pharma", "pill", "med", "supplement", "wellness", "membership", "trial", "nutra"],
        [
            ("F-006", "refund_after_purchase_ratio", 0.25, 0.15, 20.0),
            ("F-002", "card_not_present_ratio", 0.98, 0.12, 14.0),
            ("F-011", "not_recognized_dispute_rate", 0.05, 0.03, 18.0),
            ("F-012", "cross_border_ratio", 0.4, 0.25, 16.0),
            ("F-017", "repeat_card_ratio", 0.55, 0.22, 12.0),
        ],
    ),
    "crypto": (
        "6051",
        ["crypto", "coin", "wallet", "exchange", "topup", "load", "token", "btc", "usdt"],
        [
            ("F-004", "cash_equivalent_ratio", 0.5, 0.22, 22.0),
            ("F-008", "wallet_load_ratio", 0.4, 0.2, 20.0),
            ("F-002", "card_not_present_ratio", 1.0, 0.12, 12.0),
            ("F-016", "avg_ticket", 450.0, 350.0, 12.0),
            ("F-005", "round_dollar_ratio", 0.4, 0.22, 10.0),
        ],
    ),
}
ARCHETYPE_KEYWORD_STEP = 0.12
ARCHETYPE_KEYWORD_CAP = 0.35

# --------------------------------------------------------------------------
# Entity graph
# --------------------------------------------------------------------------
GRAPH_TERMS = [  # feature, weight, count cap
    ("shared_bank_account_count", 18.0, 3),
    ("shared_ip_count", 6.0, 4),
    ("shared_device_count", 6.0, 4),
    ("submerchant_count", 4.0, 10),
]
ADJACENCY_WEIGHT = 55.0
ADJACENCY_BY_KIND = {"bank": 1.0, "owner": 1.0, "ip": 0.85, "device": 0.85}

# --------------------------------------------------------------------------
# Response lanes and cases
# --------------------------------------------------------------------------
LANES = {
    "FINANCIAL_CRIME": (["FACTORING", "CASH_DISBURSEMENT"], "Deboard", "Investigate"),
    "CONTROLS": (["SPLIT_TICKETING", "MCC_ABUSE"], "Restrict", "Monitor"),
    "CONDUCT": (["MCC_MISCODING", "CARD_SURCHARGE"], "Suspend", "Remediate"),
}
QUEUE_BY_TYPOLOGY = {
    "MCC_MISCODING": "MCC Integrity", "MCC_ABUSE": "MCC Integrity",
    "FACTORING": "Laundering & Factoring", "CARD_SURCHARGE": "Surcharge Abuse",
    "CASH_DISBURSEMENT": "Cash Abuse",
}
QUEUE_OTHERWISE = "Escalations"
ACTION_CRITICAL = {
    "MCC_MISCODING": "correct-mcc", "MCC_ABUSE": "correct-mcc",
    "FACTORING": "escalate-network-integrity", "CASH_DISBURSEMENT": "suspend-txn-types",
    "CARD_SURCHARGE": "restrict-processing",
}
ACTION_CRITICAL_OTHERWISE = "enhanced-due-diligence"
ACTION_STANDARD = {
    "MCC_MISCODING": "request-info", "MCC_ABUSE": "request-info",
    "FACTORING": "review-facilitator", "CASH_DISBURSEMENT": "heightened-monitoring",
    "CARD_SURCHARGE": "merchant-outreach",
}
ACTION_STANDARD_OTHERWISE = "continue-monitoring"
FINE_RATE = {"critical": 0.12, "high": 0.06}
FINE_FLAT = {"critical": 25000.0, "high": 10000.0}
SLA_DAYS = {"critical": 2, "high": 5}
OPEN_STATUSES = ["new", "triage", "investigating", "escalated"]
CASE_STATUSES = ["new", "triage", "investigating", "escalated", "resolved", "closed"]


# --------------------------------------------------------------------------
# Rules as data
# --------------------------------------------------------------------------
@dataclass(frozen=True)
class Condition:
    feature: str
    operator: str  # > >= < <= == in not-in
    value: float | str | tuple


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    typology: str
    severity: str
    score: float
    conditions: tuple[Condition, ...]
    template: str = ""
    enabled: bool = field(default=True)


# Conditions, severities and scores of the default rules.
DEFAULT_RULES = [
    Rule("RULE-MCC-001", "Channel conflicts with the declared category", "MCC_MISCODING", "HIGH", 30.0,
         (Condition("card_not_present_ratio", ">", 0.9),
          Condition("declared_mcc", "in", ("5411", "5812", "5814", "5499", "5541")),
          Condition("night_ratio", ">", 0.4)),
         "Code {{declaredMcc}}: {{cardNotPresentPct}}% remote, {{nightPct}}% at night."),
    Rule("RULE-MCC-002", "Behaviour far from the declared profile", "MCC_MISCODING", "HIGH", 26.0,
         (Condition("mcc_divergence", ">", 0.45),),
         "Divergence {{mccDivergence}} from the profile of {{declaredMcc}}."),
    Rule("RULE-MCC-003", "Cash-like signals under a low-risk code", "MCC_MISCODING", "CRITICAL", 24.0,
         (Condition("cash_equivalent_ratio", ">", 0.2),
          Condition("declared_mcc", "in", ("5411", "5812", "5499", "5999"))),
         "{{cashEquivalentPct}}% cash-like transactions under {{declaredMcc}}."),
    Rule("RULE-SURCH-001", "Surcharge disputed as unauthorised", "CARD_SURCHARGE", "HIGH", 27.0,
         (Condition("not_recognized_dispute_rate", ">", 0.03),),
         "{{notRecognizedPct}}% disputed as not recognised."),
    Rule("RULE-SURCH-002", "Many fee chargebacks and reversals", "CARD_SURCHARGE", "MEDIUM", 18.0,
         (Condition("dispute_rate", ">", 0.04),),
         "{{disputePct}}% disputed, {{refundPct}}% refunded."),
    Rule("RULE-GEN-001", "Cross-border remote migration", "MCC_MISCODING", "MEDIUM", 16.0,
         (Condition("cross_border_ratio", ">", 0.4),
          Condition("card_not_present_ratio", ">", 0.7)),
         "{{crossBorderPct}}% cross-border and {{cardNotPresentPct}}% remote."),
]

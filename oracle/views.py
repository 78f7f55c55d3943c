"""Common table expressions: settlement views, merchant features, scores.

Written from the definitions of the features, not from the Spark code: plain
grouped SQL with count(distinct), quantile_cont and row-level windows.
"""

from __future__ import annotations

import math

from merchantscope import reference as ref
from starbook.fixtures import (
    BANDS_SQL, DUCKDB_TS_PLUS, EVENT_SQL, LABEL_SQL, MCC_SQL, MERCHANT_SQL, settlement_sql,
)


def _list(xs) -> str:
    return ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in xs)


def _near(x: str) -> str:
    return " OR ".join(
        f"({x} >= {c * ref.CEILING_LOWER_SHARE} AND {x} < {c})" for c in ref.SPLIT_CEILINGS
    )


VIEWS: dict[str, str] = {
    "tx": settlement_sql(DUCKDB_TS_PLUS),
    "dim": MERCHANT_SQL,
    "mcc_ref": MCC_SQL,
    "bands": BANDS_SQL,
    "lab": LABEL_SQL,
    "evt": EVENT_SQL,
}

VIEWS["fl"] = f"""
SELECT *, abs(settlement_amount_usd) AS abs_amt,
  (approved_flag = 'Y')::INT AS approved, (card_present_flag = 'N')::INT AS is_cnp,
  (channel = 'ECOMMERCE')::INT AS is_ecom, (channel = 'MOTO')::INT AS is_moto,
  (channel = 'RECURRING')::INT AS is_recur, (pos_entry_mode = '01')::INT AS is_keyed,
  (pos_entry_mode IN ('05','07','91'))::INT AS is_chip, (token_flag = 'Y')::INT AS is_token,
  (three_ds_flag = 'Y')::INT AS is_3ds, (transaction_type_code IN ('01','11'))::INT AS is_qc,
  (domestic_xborder_flag = 'CROSS_BORDER')::INT AS is_xb,
  (merchant_acquirer_country_mismatch = 'Y')::INT AS is_mis,
  (acquirer_country IN ({_list(ref.OFFSHORE_ACQUIRER_COUNTRIES)}))::INT AS is_off,
  (local_hour >= 22 OR local_hour <= 5)::INT AS is_night,
  (isodow(transaction_datetime_utc) >= 6)::INT AS is_weekend,
  (refund_flag = 'Y')::INT AS is_refund, (reversal_flag = 'Y')::INT AS is_rev,
  (chargeback_flag = 'Y')::INT AS is_cb, (fraud_flag = 'Y')::INT AS is_fraud,
  coalesce(chargeback_reason_code LIKE '10.%', false)::INT AS cb10,
  coalesce(chargeback_reason_code LIKE '13.%', false)::INT AS cb13,
  (auth_response_code IN ('57','62','93'))::INT AS d57, (auth_response_code = '59')::INT AS d59,
  (auth_response_code IN ('61','65'))::INT AS d61,
  (abs(settlement_amount_usd) > 0 AND abs(settlement_amount_usd) % 10 = 0)::INT AS r10,
  (abs(settlement_amount_usd) > 0 AND abs(settlement_amount_usd) % 100 = 0)::INT AS r100,
  ({_near('abs(settlement_amount_usd)')})::INT AS near,
  strftime(transaction_date, '%Y-%m') AS month
FROM tx
"""

VIEWS["base"] = """
SELECT merchant_id, count(*) AS txn_count, CAST(sum(approved) AS BIGINT) AS approved_txn_count,
  coalesce(sum(settlement_amount_usd) FILTER (approved = 1), 0) AS sales_usd,
  coalesce(sum(abs_amt) FILTER (approved = 1 AND is_refund = 0), 0) AS gross_sales_usd,
  coalesce(sum(abs_amt) FILTER (approved = 1 AND is_refund = 1), 0) AS refund_usd,
  coalesce(avg(abs_amt) FILTER (approved = 1), 0) AS avg_ticket_usd,
  coalesce(quantile_cont(abs_amt, 0.5) FILTER (approved = 1), 0) AS median_ticket_usd,
  coalesce(quantile_cont(abs_amt, 0.95) FILTER (approved = 1), 0) AS p95_ticket_usd,
  coalesce(max(abs_amt) FILTER (approved = 1), 0) AS max_ticket_usd,
  coalesce(stddev_samp(abs_amt) FILTER (approved = 1), 0) AS ticket_std_usd,
  min(transaction_date) AS first_txn_date, max(transaction_date) AS last_txn_date,
  count(DISTINCT transaction_date) AS distinct_active_days, count(DISTINCT month) AS active_months,
  avg(is_cnp) AS pct_cnp, avg(is_ecom) AS pct_ecom, avg(is_moto) AS pct_moto,
  avg(is_recur) AS pct_recurring, avg(is_keyed) AS pct_keyed, avg(is_chip) AS pct_chip,
  avg(is_token) AS pct_token, avg(is_3ds) AS pct_3ds, avg(is_qc) AS pct_quasi_cash,
  avg(is_xb) AS pct_cross_border, avg(is_mis) AS pct_acq_country_mismatch,
  avg(is_off) AS pct_offshore_acquirer, count(DISTINCT issuer_country) AS n_issuer_countries,
  count(DISTINCT issuer_bin) AS n_issuer_bins, count(DISTINCT acquirer_bin) AS n_acquirer_bins,
  count(DISTINCT card_acceptor_id) AS n_caids, avg(is_night) AS pct_night_txn,
  avg(is_weekend) AS pct_weekend_txn, avg(r10) AS pct_round_amount, avg(r100) AS pct_round_100,
  avg(near) AS pct_near_ceiling, avg((abs_amt > 500)::INT) AS pct_ticket_gt_500,
  avg((abs_amt < 20)::INT) AS pct_ticket_lt_20,
  count(DISTINCT abs_amt) / count(*) AS distinct_amount_ratio, avg(approved) AS approval_rate,
  avg(d57) AS pct_decline_not_permitted, avg(d59) AS pct_decline_suspected_fraud,
  avg(d61) AS pct_decline_limit, avg(is_refund) AS refund_rate_count, avg(is_rev) AS reversal_rate,
  avg(is_cb) * 10000 AS chargeback_rate_bps, avg(is_fraud) * 10000 AS fraud_rate_bps,
  sum(fraud_amount_usd) AS fraud_usd, sum(chargeback_amount_usd) AS cb_usd,
  avg(cb10) AS pct_cb_fraud_reason, avg(cb13) AS pct_cb_service_reason,
  count(DISTINCT card_token_id) AS unique_cards,
  count(DISTINCT sub_merchant_id) AS n_sub_merchant_ids,
  avg((sub_merchant_id IS NOT NULL)::INT) AS pct_txn_with_sub_merchant,
  coalesce(sum(interchange_fee_usd) FILTER (approved = 1), 0) AS interchange_fee_usd
FROM fl GROUP BY merchant_id
"""


def _entropy(name: str, source: str, key: str, where: str = "true") -> str:
    return f"""
SELECT merchant_id, -sum(p * ln(p)) AS {name}_entropy, sum(p * p) AS {name}_hhi, max(p) AS {name}_top
FROM (SELECT merchant_id, n / sum(n) OVER (PARTITION BY merchant_id) AS p
      FROM (SELECT merchant_id, {key}, count(*) AS n FROM {source}
            WHERE {key} IS NOT NULL AND {where} GROUP BY ALL)) GROUP BY merchant_id
"""


VIEWS["e_country"] = _entropy("country", "fl", "issuer_country")
VIEWS["e_hour"] = _entropy("hour", "fl", "local_hour")
VIEWS["e_decline"] = _entropy("decline", "fl", "auth_response_code", "approved = 0")
VIEWS["cards"] = """
SELECT merchant_id, avg((n > 1)::INT) AS pct_cards_multi_use, max(n) AS max_txn_single_card,
  sum((n / t) * (n / t)) AS card_concentration_hhi
FROM (SELECT merchant_id, n, sum(n) OVER (PARTITION BY merchant_id) AS t
      FROM (SELECT merchant_id, card_token_id, count(*) AS n FROM fl GROUP BY ALL))
GROUP BY merchant_id
"""
VIEWS["months"] = "SELECT merchant_id, month, sum(abs_amt) AS amt FROM fl GROUP BY ALL"
VIEWS["velocity"] = """
SELECT merchant_id, max(amt) AS max_month_sales_usd, quantile_cont(amt, 0.5) AS median_month_sales_usd,
  max(amt) / nullif(quantile_cont(amt, 0.5), 0) AS volume_spike_ratio,
  max(amt) / nullif(sum(amt), 0) AS pct_sales_in_top_month,
  coalesce(max((amt - prev) / greatest(prev, 1)), 0) AS max_mom_growth
FROM (SELECT *, lag(amt) OVER (PARTITION BY merchant_id ORDER BY month) AS prev FROM months)
GROUP BY merchant_id
"""


def burst_ctes(source: str, near: str) -> dict[str, str]:
    """Row-level sessionising: gap to the card's previous row, running burst number."""
    return {
        "gaps": f"""
SELECT *, {near} AS near_flag, abs(settlement_amount_usd) AS amt_abs,
  (epoch_us(transaction_datetime_utc) - lag(epoch_us(transaction_datetime_utc)) OVER (
    PARTITION BY merchant_id, card_token_id ORDER BY transaction_datetime_utc)) / 1e6 AS gap
FROM {source}""",
        "numbered": """
SELECT *, sum((gap IS NULL OR gap > 3600)::INT) OVER (PARTITION BY merchant_id, card_token_id
  ORDER BY transaction_datetime_utc, gap DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS burst_id FROM gaps""",
        "burst": """
SELECT merchant_id, card_token_id, burst_id, count(*) AS n, avg(amt_abs) AS amt_mean,
  stddev_samp(amt_abs) / nullif(avg(amt_abs), 0) AS amt_cv, coalesce(sum(gap), 0) AS span_sec,
  avg(near_flag) AS near_share FROM numbered GROUP BY ALL""",
        "split": """
SELECT merchant_id, count(*) AS split_burst_events, CAST(sum(n) AS BIGINT) AS split_txn_count,
  avg(n) AS mean_split_burst_size, avg(span_sec) / avg(n) AS mean_split_gap_sec,
  avg(near_share) AS pct_split_near_ceiling
FROM burst WHERE n >= 3 AND coalesce(amt_cv, 0) < 0.20 GROUP BY merchant_id""",
    }


VIEWS.update(burst_ctes("fl", "near"))

TOKENS = (
    "list_distinct(list_filter(regexp_split_to_array(upper({x}), '[^A-Z0-9]+'),"
    " lambda t: length(t) > 2))"
)
VIEWS["descr"] = f"""
SELECT d.merchant_id, d.merchant_descriptor, d.n, {TOKENS.format(x="d.merchant_descriptor")} AS dt,
  {TOKENS.format(x="m.merchant_name")} AS nt
FROM (SELECT merchant_id, merchant_descriptor, count(*) AS n FROM fl GROUP BY ALL) d
LEFT JOIN dim m USING (merchant_id)
"""
VIEWS["variety"] = f"""
SELECT merchant_id, count(*) AS n_distinct_descriptors,
  sum(n * (len(list_intersect(dt, [{_list(ref.DESCRIPTOR_GENERIC_TOKENS)}])) > 0)::INT) / sum(n)
    AS pct_generic_descriptor,
  max((contains(merchant_descriptor, 'WWW.') OR contains(merchant_descriptor, '.COM'))::INT)
    AS has_url_descriptor,
  max(CASE WHEN len(dt) = 0 OR len(nt) = 0 THEN 0.0 ELSE len(list_intersect(dt, nt))
      / len(list_distinct(list_concat(dt, nt))) END) AS descriptor_name_jaccard
FROM descr GROUP BY merchant_id
"""
VIEWS["modal"] = """
SELECT merchant_id, month, merchant_descriptor FROM (
  SELECT *, row_number() OVER (PARTITION BY merchant_id, month
    ORDER BY n DESC, merchant_descriptor) AS rn
  FROM (SELECT merchant_id, month, merchant_descriptor, count(*) AS n FROM fl GROUP BY ALL))
WHERE rn = 1
"""
VIEWS["churn"] = """
SELECT merchant_id, count(*) FILTER (prev <> merchant_descriptor) AS descriptor_changes
FROM (SELECT *, lag(merchant_descriptor) OVER (PARTITION BY merchant_id ORDER BY month) AS prev
      FROM modal) GROUP BY merchant_id
"""
VIEWS["features"] = """
SELECT *, cnp_bps AS behaviour_expected_interchange_bps,
  cnp_bps - effective_interchange_bps AS interchange_advantage_bps
FROM (
SELECT b.*, b.ticket_std_usd / nullif(b.avg_ticket_usd, 0) AS ticket_cv,
  date_diff('day', b.first_txn_date, b.last_txn_date) + 1 AS active_days,
  b.txn_count / b.distinct_active_days AS txn_per_active_day,
  country_hhi AS issuer_country_hhi, country_entropy AS issuer_country_entropy,
  country_top AS top_issuer_country_share, hour_entropy,
  coalesce(decline_entropy, 0) AS decline_code_entropy, 1 - b.approval_rate AS decline_rate,
  b.refund_usd / nullif(b.gross_sales_usd, 0) AS refund_rate_amount,
  b.fraud_usd / nullif(b.gross_sales_usd, 0) * 10000 AS fraud_to_sales_bps,
  b.cb_usd / nullif(b.gross_sales_usd, 0) * 10000 AS cb_to_sales_bps,
  b.txn_count / b.unique_cards AS txn_per_card, cards.* EXCLUDE (merchant_id),
  velocity.* EXCLUDE (merchant_id), coalesce(split_burst_events, 0) AS split_burst_events,
  coalesce(split_txn_count, 0) AS split_txn_count,
  coalesce(split_txn_count, 0) / b.txn_count AS pct_txn_in_split_burst,
  coalesce(mean_split_burst_size, 0) AS mean_split_burst_size,
  coalesce(mean_split_gap_sec, 0) AS mean_split_gap_sec,
  coalesce(pct_split_near_ceiling, 0) AS pct_split_near_ceiling,
  variety.* EXCLUDE (merchant_id), descriptor_changes, dim.* EXCLUDE (merchant_id, declared_mcc),
  lpad(dim.declared_mcc, 4, '0') AS declared_mcc, coalesce(mcc_ref.mcc_group, 'UNKNOWN') AS mcc_group,
  coalesce(expected_avg_ticket, 50) AS mcc_expected_avg_ticket,
  coalesce(expected_cnp_share, 0.3) AS mcc_expected_cnp_share,
  coalesce(expected_night_share, 0.12) AS mcc_expected_night_share,
  coalesce(band_bps, 195) AS mcc_declared_interchange_bps,
  b.avg_ticket_usd / coalesce(expected_avg_ticket, 50) AS ticket_vs_mcc_expected,
  b.pct_cnp - coalesce(expected_cnp_share, 0.3) AS cnp_vs_mcc_expected,
  b.pct_night_txn - coalesce(expected_night_share, 0.12) AS night_vs_mcc_expected,
  b.interchange_fee_usd / nullif(b.sales_usd, 0) * 10000 AS effective_interchange_bps,
  130 + 120 * greatest(0, least(1, b.pct_cnp)) AS cnp_bps,
  (coalesce(band_bps, 195) <= 160)::INT AS declared_band_is_cheap
FROM base b
LEFT JOIN e_country USING (merchant_id) LEFT JOIN e_hour USING (merchant_id)
LEFT JOIN e_decline USING (merchant_id) LEFT JOIN cards USING (merchant_id)
LEFT JOIN velocity USING (merchant_id) LEFT JOIN split USING (merchant_id)
LEFT JOIN variety USING (merchant_id) LEFT JOIN churn USING (merchant_id)
LEFT JOIN dim USING (merchant_id)
LEFT JOIN mcc_ref ON mcc_ref.mcc = lpad(dim.declared_mcc, 4, '0')
LEFT JOIN bands ON bands.mcc_group = mcc_ref.mcc_group)
"""

# ------------------------------------------------------------------- scores
_MODELS = {**ref.CATEGORY_WEIGHTS, **ref.PATTERN_WEIGHTS}
Z_FEATURES = sorted({f for w in [*_MODELS.values(), ref.COMPOSITE_WEIGHTS] for f in w})


def _z(c: str) -> str:
    v = f"CAST({c} AS DOUBLE)"
    grp = "(PARTITION BY mcc_group)"
    enough = f"count({c}) OVER {grp} >= {ref.MIN_PEERS}"
    mean = f"CASE WHEN {enough} THEN avg({v}) OVER {grp} ELSE avg({v}) OVER () END"
    sd = f"CASE WHEN {enough} THEN stddev_samp({v}) OVER {grp} ELSE stddev_samp({v}) OVER () END"
    return f"greatest(-5, least(5, coalesce(({v} - {mean}) / nullif({sd}, 0), 0))) AS z_{c}"


VIEWS["z"] = "SELECT *, " + ",\n".join(_z(c) for c in Z_FEATURES) + " FROM features"


def _weighted(w: dict[str, float]) -> str:
    total = " + ".join(f"({x}) * z_{f}" for f, x in w.items())
    return f"(({total}) / sqrt({sum(abs(x) for x in w.values())}))"


def _even(x: str, dp: int) -> str:
    return f"round_even({x} * {10**dp}, 0) / {10**dp}"


VIEWS["models"] = (
    "SELECT *, "
    + ",\n".join(
        _even(f"(100 / (1 + exp(-1.35 * {_weighted(w)})))", 1) + f" AS score_{m}"
        for m, w in _MODELS.items()
    )
    + f",\n{_even(_weighted(ref.COMPOSITE_WEIGHTS), 3)} AS integrity_composite_z,\n"
    + _even(f"(100 / (1 + exp(-1.55 * {_weighted(ref.COMPOSITE_WEIGHTS)})))", 1)
    + " AS integrity_risk_score FROM z"
)


def _argmax(names) -> str:
    best = "greatest(" + ", ".join(f"score_{n}" for n in names) + ")"
    whens = " ".join(f"WHEN score_{n} = {best} THEN '{n}'" for n in names)
    return f"CASE {whens} END"


_CAT, _PAT = list(ref.CATEGORY_WEIGHTS), list(ref.PATTERN_WEIGHTS)
RULES = {
    "split_ticketing_rule": "pct_txn_in_split_burst > 0.10 AND pct_near_ceiling > 0.15",
    "factoring_rule": "n_sub_merchant_ids >= 2 AND volume_spike_ratio > 3",
    "descriptor_churn_rule": "descriptor_changes >= 3 AND descriptor_name_jaccard < 0.20",
    "undeclared_quasi_cash_rule":
        f"pct_quasi_cash > 0.25 AND declared_mcc NOT IN ({_list(ref.CASH_LIKE_MCCS)})",
    "gambling_behaviour_rule":
        "pct_night_txn > 0.35 AND pct_round_amount > 0.30 AND pct_cross_border > 0.30",
    "dispute_excursion_rule": "chargeback_rate_bps > 100 AND refund_rate_count > 0.05",
    "issuer_prohibition_rule": "pct_decline_not_permitted > 0.05",
    "cash_disbursement_rule":
        "pct_round_100 > 0.40 AND avg_ticket_usd > 400 AND pct_ticket_gt_500 > 0.30 "
        f"AND declared_mcc NOT IN ({_list(ref.CASH_OUTLET_MCCS)})",
    "interchange_abuse_rule":
        "(interchange_advantage_bps > 50 AND declared_band_is_cheap = 1) "
        "OR (cnp_vs_mcc_expected > 0.55 AND interchange_advantage_bps > 25)",
}
VIEWS["ruled"] = (
    f"SELECT *, {_argmax(_CAT)} AS top_category, greatest({', '.join('score_' + n for n in _CAT)}) "
    f"AS top_category_score, {_argmax(_PAT)} AS top_pattern, "
    f"greatest({', '.join('score_' + n for n in _PAT)}) AS top_pattern_score, "
    + _even(
        "((rank() OVER (ORDER BY integrity_risk_score) + (count(*) OVER (PARTITION BY "
        "integrity_risk_score) - 1) / 2) / count(*) OVER () * 100)", 1)
    + " AS integrity_percentile, "
    + _even(
        "(integrity_risk_score * (0.7 + 0.3 * (ln(1 + greatest(gross_sales_usd, 0)) / "
        "max(ln(1 + greatest(gross_sales_usd, 0))) OVER ())))", 1)
    + " AS exposure_weighted_score, CASE WHEN integrity_risk_score > 93 THEN 'Critical' "
    "WHEN integrity_risk_score > 85 THEN 'High' WHEN integrity_risk_score > 75 THEN 'Elevated' "
    "WHEN integrity_risk_score > 60 THEN 'Monitor' ELSE 'Low' END AS risk_tier, "
    + ", ".join(f"CASE WHEN {cond} THEN 1 ELSE 0 END AS {name}" for name, cond in RULES.items())
    + " FROM models"
)
VIEWS["flagged0"] = (
    "SELECT *, "
    + " + ".join(RULES)
    + " AS rules_triggered, concat_ws('|', "
    + ", ".join(f"CASE WHEN {r} = 1 THEN '{r}' END" for r in RULES)
    + """) AS rule_names,
  CASE WHEN integrity_risk_score >= 85 THEN CASE WHEN """
    + " + ".join(RULES)
    + " > 0 THEN 'model + rule' ELSE 'model' END WHEN "
    + " + ".join(RULES)
    + " > 0 THEN 'rule' ELSE '' END AS flag_reason FROM ruled"
)


def _case(key: str, labels: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items())
    return f"CASE {key} {whens} ELSE '' END"


VIEWS["scores"] = f"""
SELECT *, {_case('family', ref.FAMILY_LABELS)} AS family_label,
  CASE WHEN family = 'mcc_miscoding' THEN {_case('top_category', ref.CATEGORY_LABELS)} ELSE '' END
    AS subtype
FROM (SELECT *, (flag_reason <> '')::INT AS flag_for_investigation,
  CASE WHEN flag_reason = '' THEN '' WHEN interchange_abuse_rule = 1 THEN 'mcc_abuse'
       WHEN split_ticketing_rule = 1 THEN 'split_ticketing'
       WHEN pct_txn_with_sub_merchant >= 0.30 OR n_sub_merchant_ids >= 2 THEN 'factoring'
       WHEN score_mcc_miscoding < 45 AND score_descriptor >= 70 THEN 'descriptor'
       WHEN pct_quasi_cash >= 0.45 OR cash_disbursement_rule = 1 THEN 'cash'
       ELSE 'mcc_miscoding' END AS family
  FROM flagged0)
"""


def assert_weights() -> None:
    """The printed weights are finite numbers (guards the generated SQL)."""
    assert all(math.isfinite(x) for w in _MODELS.values() for x in w.values())


def settle(sql: str) -> str:
    """Turn every ``round(x, 6)`` of a result into ``round(round(x, 9), 6)``.

    The inner step removes the noise of the summation order before a tie is rounded.
    """
    out, i = "", 0
    while (at := sql.find("round(", i)) >= 0:
        depth, end = 0, at + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if depth == 0:
                break
            end += 1
        inner = sql[at + 6 : end]
        if inner.endswith(", 6"):
            out += sql[i:at] + f"round(round({settle(inner[:-3])}, 9), 6)"
        else:
            out += sql[i:at] + f"round({settle(inner)})"
        i = end + 1
    return out + sql[i:]


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with exactly the views it needs, in dependency order."""
    import re

    pool, body = {**VIEWS, **(extra or {})}, settle(body)
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql):
            if name in pool and name not in needed:
                needed.add(name)
                visit(pool[name])

    visit(body)
    order: list[str] = []

    def place(name: str) -> None:
        for dep in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", pool[name]):
            if dep in needed and dep != name and dep not in order:
                place(dep)
        if name not in order:
            order.append(name)

    for name in [*pool]:
        if name in needed:
            place(name)
    if not order:
        return body.strip()
    # Views read more than once are evaluated once.
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({pool[n].strip()})" for n in order)
    return f"WITH {ctes}\n{body.strip()}"

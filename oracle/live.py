"""SQL for the live-engine queries."""

from __future__ import annotations

from merchantscope import live_reference as live
from merchantscope.operators.evidence import SUPPORTING
from merchantscope.plans.live_queries import (
    CARDS, COMPONENTS, DIVERSITY, FEATURES, GRAPH, TICKETS,
)
from starbook.fixtures import (
    KNOWN_BAD_SQL, LIVE_LABEL_SQL, LIVE_MERCHANT_SQL, LIVE_TX_SQL, PROFILE_SQL,
)
from oracle.views import TOKENS, _case, _list, with_views


def up(x: str, dp: int) -> str:
    return f"(floor(round(({x}) * CAST({10**dp} AS DOUBLE), 6) + 0.5) / {10**dp})"


def r6(cols: list[str], text: tuple[str, ...] = ()) -> str:
    return ", ".join(c if c in text else f"round({c}, 6) + 0.0 AS {c}" for c in cols)


V: dict[str, str] = {
    "ltx": LIVE_TX_SQL,
    "lm": LIVE_MERCHANT_SQL.format(arr="list_value"),
    "prof": PROFILE_SQL.format(arr="list_value"),
    "bad": KNOWN_BAD_SQL,
    "llab": LIVE_LABEL_SQL,
    "ok": "SELECT *, amount > 0 AND NOT refund AS buy FROM ltx WHERE authorization_status = 'approved'",
}
V["lbase"] = """
SELECT merchant_id, count(*) AS txn_count, coalesce(sum(amount) FILTER (WHERE buy), 0) AS total_volume,
  coalesce(avg(amount) FILTER (WHERE buy), 0) AS avg_ticket,
  coalesce(stddev_pop(amount) FILTER (WHERE buy), 0) AS std_ticket,
  count(*) FILTER (WHERE buy AND amount >= 5 AND amount % 10 = 0) / greatest(count(*) FILTER (WHERE buy), 1)
    AS round_dollar_ratio,
  avg(ecommerce::INT) AS card_not_present_ratio, avg(cross_border::INT) AS cross_border_ratio,
  avg((entry_mode = 'fallback')::INT) AS fallback_ratio,
  avg((entry_mode = 'manual')::INT) AS manual_entry_ratio,
  avg((hour(event_ts) >= 22 OR hour(event_ts) < 4)::INT) AS night_ratio,
  avg((isodow(event_ts) >= 6)::INT) AS weekend_ratio, avg(refund::INT) AS refund_rate,
  avg(reversal::INT) AS reversal_rate, avg(dispute::INT) AS dispute_rate,
  avg(coalesce(dispute AND dispute_reason = 'merchant not recognized', false)::INT)
    AS not_recognized_dispute_rate,
  count(*) FILTER (WHERE refund) / greatest(count(*) FILTER (WHERE buy), 1)
    AS refund_after_purchase_ratio,
  avg(cash_equivalent::INT) AS cash_equivalent_ratio, avg(wallet_load::INT) AS wallet_load_ratio,
  count(*) FILTER (WHERE buy AND amount >= 450 AND amount <= 500)
    / greatest(count(*) FILTER (WHERE buy), 1) AS threshold_proximity_ratio,
  coalesce(stddev_pop(latitude), 0) + coalesce(stddev_pop(longitude), 0) AS geo_dispersion
FROM ok GROUP BY merchant_id"""


def _entropy2(key: str, name: str) -> str:
    return f"""SELECT merchant_id, count(*) AS {name}_n, -sum(p * log2(p)) + 0.0 AS {name}_h FROM (
  SELECT merchant_id, n / sum(n) OVER (PARTITION BY merchant_id) AS p FROM (
    SELECT merchant_id, {key}, count(*) AS n FROM ok GROUP BY ALL)) GROUP BY merchant_id"""


V["ld"] = _entropy2("merchant_descriptor", "d")
V["ls"] = _entropy2("product_signal", "s")
V["ldiv"] = """
SELECT merchant_id, d_n AS descriptor_count, d_h AS descriptor_entropy, s_h AS category_diversity,
  v AS velocity_per_active_hour
FROM ld JOIN ls USING (merchant_id) JOIN (SELECT merchant_id,
  count(*) / count(DISTINCT date_trunc('hour', event_ts)) AS v FROM ok GROUP BY merchant_id) x
  USING (merchant_id)"""


def _cards(source: str, card: str, ts: str, seconds: int) -> str:
    return f"""SELECT merchant_id, count(*) / sum(n) AS unique_card_ratio,
  avg((n > 1)::INT) AS repeat_card_ratio, sum(rapid) / sum(n) AS rapid_repeat_ratio
FROM (SELECT merchant_id, c, count(*) AS n, count(*) FILTER (WHERE gap <= {seconds}) AS rapid
  FROM (SELECT merchant_id, {card} AS c, (epoch_us({ts}) - lag(epoch_us({ts})) OVER (
          PARTITION BY merchant_id, {card} ORDER BY {ts})) / 1e6 AS gap FROM {source})
  GROUP BY ALL) GROUP BY merchant_id"""


V["lcard"] = _cards("ok", "card_id", "event_ts", 300)
V["ltick"] = """
SELECT merchant_id, quantile_cont(amount, 0.5) AS median_ticket,
  max(amount) FILTER (WHERE rn = floor(0.95 * (n - 1))) AS p95_ticket,
  CASE WHEN quantile_cont(amount, 0.5) > 0 THEN least(1.0,
    (max(amount) FILTER (WHERE rn = floor(0.75 * (n - 1))) - max(amount) FILTER (WHERE rn = floor(0.25 * (n - 1))))
    / (quantile_cont(amount, 0.5) + 1)) ELSE 0.0 END AS ticket_bimodality
FROM (SELECT merchant_id, amount, row_number() OVER (PARTITION BY merchant_id ORDER BY amount) - 1 AS rn,
        count(*) OVER (PARTITION BY merchant_id) AS n FROM ok WHERE buy) GROUP BY merchant_id"""
V["lmid"] = """
SELECT merchant_id, event_ts AS mid FROM (SELECT merchant_id, event_ts,
  row_number() OVER (PARTITION BY merchant_id ORDER BY event_ts) - 1 AS rn,
  count(*) OVER (PARTITION BY merchant_id) AS n FROM ok) WHERE rn = floor(n / 2)"""
V["lcp"] = """
SELECT merchant_id, least(1, abs(c2 - c1) + abs(t2 - t1) / 300) AS change_point_score FROM (
  SELECT merchant_id, coalesce(avg(ecommerce::INT) FILTER (WHERE event_ts < mid), 0) AS c1,
    coalesce(avg(ecommerce::INT) FILTER (WHERE event_ts >= mid), 0) AS c2,
    coalesce(avg(amount) FILTER (WHERE event_ts < mid AND amount > 0), 0) AS t1,
    coalesce(avg(amount) FILTER (WHERE event_ts >= mid AND amount > 0), 0) AS t2
  FROM ok JOIN lmid USING (merchant_id) GROUP BY merchant_id)"""

_GRAMS = """list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3)))"""
_PAD = "concat(' ', trim(regexp_replace(regexp_replace(upper({x}), '[^A-Z0-9]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')"


def trigram(a: str, b: str) -> str:
    ga, gb = _GRAMS.format(x=_PAD.format(x=a)), _GRAMS.format(x=_PAD.format(x=b))
    return f"(len(list_intersect({ga}, {gb})) / len(list_distinct(list_concat({ga}, {gb}))))"


def edit(a: str, b: str) -> str:
    return (f"(1 - levenshtein(upper(trim({a})), upper(trim({b}))) "
            f"/ greatest(length(trim({a})), length(trim({b}))))")


def generic(x: str) -> str:
    toks = f"list_filter(regexp_split_to_array(upper({x}), '\\s+'), lambda t: t <> '')"
    return (f"(len(list_filter({toks}, lambda t: t IN ({_list(live.LIVE_GENERIC_TOKENS)}))) / len({toks}))")


_brand = "greatest(" + ", ".join(trigram("descriptor", f"'{b}'") for b in live.KNOWN_BRANDS) + ")"
V["ltext"] = f"""
SELECT merchant_id, {up(edit('descriptor', 'trade_name'), 4)} AS descriptor_name_similarity,
  {up(_brand, 4)} AS brand_mimic_score, {up(generic('descriptor'), 4)} AS generic_token_ratio FROM lm"""

_DP = {"total_volume": 2, "avg_ticket": 2, "median_ticket": 2, "std_ticket": 2, "p95_ticket": 2,
       "velocity_per_active_hour": 3}
_made = [*FEATURES, *DIVERSITY, *CARDS, *TICKETS, "change_point_score"]
V["lround"] = (
    "SELECT lm.merchant_id, lm.declared_mcc, "
    + ", ".join(
        f"coalesce({c}, 0) AS {c}" if c in ("txn_count", "descriptor_count")
        else f"coalesce({up(c, _DP.get(c, 4))}, 0) AS {c}"
        for c in _made
    )
    + " FROM lm LEFT JOIN lbase USING (merchant_id) LEFT JOIN ldiv USING (merchant_id) "
    "LEFT JOIN lcard USING (merchant_id) LEFT JOIN ltick USING (merchant_id) LEFT JOIN lcp USING (merchant_id)"
)
_EXP = "sqrt(greatest({lo}, 1) * greatest({hi}, {lo} + 1))".format(lo="p.ticket_lo", hi="p.ticket_hi")
V["lfeat"] = f"""
SELECT f.*, {up(f'''0.4 * abs(card_not_present_ratio - (1 - p.typical_card_present_ratio))
  + 0.3 * abs(night_ratio - p.typical_night_ratio)
  + 0.2 * least(1, abs(ln((avg_ticket + 1) / ({_EXP} + 1))) / 2)
  + 0.1 * least(1, abs(dispute_rate - p.typical_dispute_rate) / 0.05)''', 4)} AS mcc_divergence
FROM lround f JOIN prof p ON p.mcc = CASE WHEN f.declared_mcc IN (SELECT mcc FROM prof)
  THEN f.declared_mcc ELSE '5999' END"""

# ------------------------------------------------------------------- graph
V["mem"] = """
SELECT merchant_id, 'bank' AS kind, settlement_bank_account_id AS entity_id, 0 AS place FROM lm UNION ALL
SELECT merchant_id, 'owner', beneficial_owner_id, 0 FROM lm UNION ALL
SELECT merchant_id, 'ip', ip_cluster_ids[i], i - 1 FROM lm, range(1, 10) g(i) WHERE i <= len(ip_cluster_ids)
UNION ALL
SELECT merchant_id, 'device', device_ids[i], i - 1 FROM lm, range(1, 10) g(i) WHERE i <= len(device_ids)"""
V["msize"] = "SELECT kind, entity_id, count(*) AS size FROM mem GROUP BY ALL"
V["shares"] = """
SELECT merchant_id, CAST(coalesce(sum(size - 1) FILTER (WHERE kind = 'bank'), 0) AS BIGINT)
    AS shared_bank_account_count,
  CAST(coalesce(sum(size - 1) FILTER (WHERE kind = 'ip'), 0) AS BIGINT) AS shared_ip_count,
  CAST(coalesce(sum(size - 1) FILTER (WHERE kind = 'device'), 0) AS BIGINT) AS shared_device_count
FROM mem JOIN msize USING (kind, entity_id) GROUP BY merchant_id"""
V["adj"] = """
SELECT merchant_id, max(CASE WHEN kind IN ('bank', 'owner') THEN 1.0 ELSE 0.85 END) AS a
FROM mem JOIN bad USING (kind, entity_id) GROUP BY merchant_id"""
V["lgraph"] = f"""
SELECT *, {up('''least(100, 18 * least(shared_bank_account_count, 3) + 6 * least(shared_ip_count, 4)
  + 6 * least(shared_device_count, 4) + 4 * least(submerchant_count, 10) + 55 * known_bad_adjacency)''', 1)}
  AS graph_score
FROM (SELECT lm.merchant_id, shares.* EXCLUDE (merchant_id),
  CASE WHEN merchant_type = 'facilitator' THEN (SELECT count(*) FROM lm x
    WHERE x.payment_facilitator_id = lm.payment_facilitator_id) ELSE 0 END AS submerchant_count,
  coalesce(a, 0.0) AS known_bad_adjacency
  FROM lm JOIN shares USING (merchant_id) LEFT JOIN adj USING (merchant_id))"""
V["nb"] = """
SELECT merchant_id, neighbour_id, neighbour_rank FROM (SELECT *, row_number() OVER (
    PARTITION BY merchant_id ORDER BY kr, neighbour_id) AS neighbour_rank
  FROM (SELECT a.merchant_id, b.merchant_id AS neighbour_id,
      min(CASE a.kind WHEN 'bank' THEN 0 WHEN 'ip' THEN 1 ELSE 2 END * 1000 + a.place) AS kr
    FROM mem a JOIN mem b ON a.kind = b.kind AND a.entity_id = b.entity_id
      AND a.merchant_id <> b.merchant_id AND a.kind <> 'owner' GROUP BY a.merchant_id, b.merchant_id))
WHERE neighbour_rank <= 8"""
V["subs8"] = """
SELECT payment_facilitator_id, merchant_id AS sub_id FROM (SELECT payment_facilitator_id, merchant_id,
  row_number() OVER (PARTITION BY payment_facilitator_id ORDER BY merchant_id) AS rn FROM lm
  WHERE payment_facilitator_id IS NOT NULL) WHERE rn <= 8"""
V["edges"] = """
SELECT c AS center, c AS source, target, type FROM (
  SELECT CAST(merchant_id AS VARCHAR) AS c, settlement_bank_account_id AS target, 'settles-to' AS type FROM lm
  UNION ALL SELECT CAST(merchant_id AS VARCHAR), beneficial_owner_id, 'owned-by' FROM lm
  UNION ALL SELECT CAST(merchant_id AS VARCHAR), registered_address_id, 'uses-address' FROM lm
  UNION ALL SELECT CAST(merchant_id AS VARCHAR), website_domain, 'uses-domain' FROM lm
  UNION ALL SELECT CAST(merchant_id AS VARCHAR), acquirer_id, 'processes-through' FROM lm
  UNION ALL SELECT CAST(merchant_id AS VARCHAR), payment_facilitator_id, 'processes-through' FROM lm
    WHERE payment_facilitator_id IS NOT NULL
  UNION ALL SELECT CAST(merchant_id AS VARCHAR), 'DESC:' || descriptor, 'shares-descriptor' FROM lm
  UNION ALL SELECT CAST(merchant_id AS VARCHAR), 'DESC:' || unnest(alternate_descriptors),
    'shares-descriptor' FROM lm
  UNION ALL SELECT CAST(merchant_id AS VARCHAR), entity_id, 'uses-' || kind FROM mem
    WHERE kind IN ('ip', 'device') AND place < 4)
UNION ALL
SELECT CAST(nb.merchant_id AS VARCHAR), CAST(neighbour_id AS VARCHAR), a.entity_id,
  CASE a.kind WHEN 'bank' THEN 'settles-to' ELSE 'uses-' || a.kind END
FROM nb JOIN mem a ON a.merchant_id = nb.merchant_id AND a.kind <> 'owner'
  JOIN mem b ON b.merchant_id = neighbour_id AND b.kind = a.kind AND b.entity_id = a.entity_id
UNION ALL
SELECT CAST(merchant_id AS VARCHAR), lm.payment_facilitator_id, CAST(sub_id AS VARCHAR),
  'processes-through' FROM lm JOIN subs8 USING (payment_facilitator_id)
WHERE merchant_type = 'facilitator' AND sub_id <> merchant_id"""

# -------------------------------------------------------------- classifier
_fixed_words = sorted({k for _, words, _ in live.ARCHETYPES.values() for k in words})
V["texts"] = r"""
SELECT DISTINCT merchant_id, lower(product_signal) AS text FROM ltx UNION
SELECT merchant_id, lower(t) FROM (SELECT merchant_id, unnest(regexp_split_to_array(descriptor, '\s+')) AS t
  FROM lm UNION SELECT merchant_id, unnest(flatten(list_transform(alternate_descriptors,
    lambda d: regexp_split_to_array(d, '\s+')))) FROM lm)"""
V["vocab"] = (
    "SELECT DISTINCT k FROM (SELECT unnest(expected_keywords) AS k FROM prof UNION SELECT unnest(["
    + _list(_fixed_words) + "]))"
)
V["kw"] = "SELECT DISTINCT merchant_id, k FROM texts JOIN vocab ON contains(text, k)"
V["raws"] = f"""
SELECT f.merchant_id, f.declared_mcc, p.mcc, p.parent_category, p.risk_tier,
  (0.28 * exp(-pow(card_not_present_ratio - (1 - typical_card_present_ratio), 2) / (2 * 0.18 * 0.18))
  + 0.2 * exp(-pow(night_ratio - typical_night_ratio, 2) / (2 * 0.16 * 0.16))
  + 0.22 * exp(-pow(ln((avg_ticket + 1) / ({_EXP} + 1)), 2) / (2 * 0.7 * 0.7))
  + 0.1 * exp(-pow(dispute_rate - typical_dispute_rate, 2) / (2 * 0.03 * 0.03))
  + 0.2 * CASE WHEN p.mcc IN ('6051', '7995') THEN 0.5 + 0.5 * least(1, cash_equivalent_ratio * 2)
          ELSE 1 - least(1, cash_equivalent_ratio) END)
  * (1 + 0.6 * (SELECT count(*) FROM kw WHERE kw.merchant_id = f.merchant_id
        AND list_contains(p.expected_keywords, kw.k))) AS raw
FROM lfeat f CROSS JOIN prof p"""
V["ranked"] = """
SELECT *, exp((raw - max(raw) OVER w) / 0.16) / sum(e) OVER w AS prob,
  row_number() OVER (PARTITION BY merchant_id ORDER BY raw DESC, mcc) AS rn
FROM (SELECT *, exp((raw - max(raw) OVER (PARTITION BY merchant_id)) / 0.16) AS e FROM raws)
WINDOW w AS (PARTITION BY merchant_id)"""
V["pred"] = """
SELECT a.merchant_id, a.declared_mcc, a.mcc AS predicted_mcc, a.prob AS mcc_confidence,
  CASE WHEN a.mcc = a.declared_mcc THEN 'clear'
    WHEN coalesce(d.risk_tier, 'medium') IN ('low', 'medium') AND a.risk_tier IN ('high', 'prohibited-adjacent')
      THEN CASE WHEN a.prob > 0.75 THEN 'critical' ELSE 'high' END
    WHEN a.prob > 0.7 THEN 'elevated' ELSE 'watch' END AS mismatch_severity,
  coalesce(d.parent_category = a.parent_category, false) AS hierarchy_match,
  b.mcc AS second_mcc, b.prob AS second_probability
FROM ranked a JOIN ranked b ON b.merchant_id = a.merchant_id AND b.rn = 2
LEFT JOIN prof d ON d.mcc = a.declared_mcc WHERE a.rn = 1"""


def _z(c: str) -> str:
    w = "OVER (PARTITION BY declared_mcc)"
    return f"coalesce(CASE WHEN stddev_pop({c}) {w} > 1e-9 THEN round(({c} - avg({c}) {w}) / stddev_pop({c}) {w}, 3) END, 0.0)"


V["lz"] = f"""
SELECT merchant_id, {_z('night_ratio')} AS peer_night_z, {_z('card_not_present_ratio')} AS peer_cnp_z,
  {_z('avg_ticket')} AS peer_ticket_z FROM lfeat"""


def _cond(c: live.Condition) -> str:
    if c.operator == "in":
        return f"{c.feature} IN ({_list(c.value)})"
    return f"{c.feature} {c.operator} {c.value}"


def _whole_percent(c: str) -> str:
    return f"CAST(CAST(round({c} * 100) AS BIGINT) AS VARCHAR)"


#: What the placeholders of the default rules' templates show.
_SHOWN = {
    "declaredMcc": "declared_mcc",
    "mccDivergence": "printf('%.2f', round(mcc_divergence, 2))",
    "cardNotPresentPct": _whole_percent("card_not_present_ratio"),
    "nightPct": _whole_percent("night_ratio"),
    "cashEquivalentPct": _whole_percent("cash_equivalent_ratio"),
    "notRecognizedPct": _whole_percent("not_recognized_dispute_rate"),
    "disputePct": _whole_percent("dispute_rate"),
    "refundPct": _whole_percent("refund_rate"),
    "crossBorderPct": _whole_percent("cross_border_ratio"),
}


def _explanation(template: str) -> str:
    sql = f"'{template}'"
    for name, shown in _SHOWN.items():
        sql = f"replace({sql}, '{{{{{name}}}}}', {shown})"
    return sql


V["hits"] = " UNION ALL ".join(
    f"SELECT merchant_id, '{r.id}' AS rule_id, '{r.typology}' AS typology, '{r.severity}' AS severity, "
    f"CAST({r.score} AS DOUBLE) AS score, {_explanation(r.template)} AS explanation FROM lfeat WHERE " + " AND ".join(_cond(c) for c in r.conditions)
    for r in live.DEFAULT_RULES
)
V["hitsum"] = (
    "SELECT merchant_id, sum(score) AS total, "
    + ", ".join(f"coalesce(sum(score) FILTER (WHERE typology = '{t}'), 0) AS h_{t}" for t in live.TYPOLOGIES)
    + " FROM hits GROUP BY merchant_id"
)
V["all1"] = (
    "SELECT f.*, g.* EXCLUDE (merchant_id), p.* EXCLUDE (merchant_id, declared_mcc), z.* EXCLUDE (merchant_id), "
    "t.* EXCLUDE (merchant_id), coalesce(total, 0) AS hit_total, "
    + ", ".join(f"least(100, coalesce(h_{t}, 0)) AS h_{t}" for t in live.TYPOLOGIES)
    + """, lm.acquirer_id, lm.state,
  CASE WHEN f.declared_mcc IN ('5411', '5812', '5541', '5499', '5814') AND mcc_divergence <= 0.28
    AND least(1, (manual_entry_ratio + fallback_ratio) / 0.4) >= 0.5
    THEN least(100, 100 * (0.6 * least(1, (manual_entry_ratio + fallback_ratio) / 0.4)
      + 0.25 * least(1, cross_border_ratio / 0.3) + 0.15 * least(1, avg_ticket / 300))) ELSE 0 END
    AS interchange_signal
FROM lfeat f JOIN lgraph g USING (merchant_id) JOIN pred p USING (merchant_id) JOIN lz z USING (merchant_id)
JOIN ltext t USING (merchant_id) JOIN lm USING (merchant_id) LEFT JOIN hitsum USING (merchant_id)"""
)
V["all2"] = """
SELECT *, least(100, hit_total) AS c_rule,
  100 / (1 + exp(-(-3.2 + 2.6 * mcc_divergence + 1.8 * cash_equivalent_ratio
    + 1.4 * card_not_present_ratio * night_ratio * 3 + 1.2 * round_dollar_ratio
    + 1.1 * threshold_proximity_ratio + 0.9 * wallet_load_ratio
    + 0.7 * not_recognized_dispute_rate * 10))) AS c_supervised,
  least(100, 0.7 * 100 / (1 + exp(-0.9 * (abs(peer_night_z) + abs(peer_cnp_z) + abs(peer_ticket_z) - 2.5)))
    + 40 * mcc_divergence) AS c_anomaly,
  least(100, 100 * (0.5 * least(1, not_recognized_dispute_rate * 15) + 0.3 * least(1, dispute_rate * 12)
    + 0.2 * least(1, refund_rate * 6))) AS c_surcharge,
  least(100, 0.7 * CASE mismatch_severity WHEN 'critical' THEN 90 WHEN 'high' THEN 72 WHEN 'elevated' THEN 55
      WHEN 'watch' THEN 30 ELSE 6 END
    + CASE WHEN mismatch_severity = 'clear' THEN 0 ELSE 0.3 * mcc_confidence * 100 END
    + 10 * mcc_divergence) AS c_mismatch,
  least(100, 100 * change_point_score) AS c_change
FROM all1"""
_BASE = ("least(100, 0.15 * c_rule + 0.2 * c_supervised + 0.15 * c_anomaly + 0.15 * graph_score "
         "+ 0.15 * c_surcharge + 0.1 * c_mismatch + 0.1 * c_change)")
V["all3"] = f"""
SELECT *, CASE WHEN interchange_signal >= 45 THEN least(100, 0.3 * {_BASE} + 0.7 * interchange_signal)
  ELSE {_BASE} END AS fin FROM all2"""
_T = {
    "MCC_MISCODING": "0.5 * CASE WHEN mismatch_severity = 'clear' THEN 0 ELSE 100 END * mcc_confidence "
                     "+ 40 * mcc_divergence + 0.4 * h_MCC_MISCODING",
    "MCC_ABUSE": "interchange_signal + 0.4 * h_MCC_ABUSE",
    "SPLIT_TICKETING": "100 * (0.55 * threshold_proximity_ratio + 0.45 * least(1, rapid_repeat_ratio * 4)) "
                       "+ 0.5 * h_SPLIT_TICKETING",
    "FACTORING": "0.5 * graph_score + 100 * (0.3 * least(1, descriptor_entropy / 2.2) "
                 "+ 0.2 * least(1, category_diversity / 2)) + 0.5 * h_FACTORING",
    "CARD_SURCHARGE": "100 * (0.5 * least(1, not_recognized_dispute_rate * 15) "
                      "+ 0.3 * least(1, dispute_rate * 12)) + 0.5 * h_CARD_SURCHARGE",
    "CASH_DISBURSEMENT": "100 * (0.4 * round_dollar_ratio + 0.3 * least(1, wallet_load_ratio * 1.5) "
                         "+ 0.3 * least(1, refund_after_purchase_ratio * 1.5)) + 0.5 * h_CASH_DISBURSEMENT",
}
V["all4"] = (
    "SELECT *, " + ", ".join(f"{up(f'least(100, {x})', 1)} AS t_{t}" for t, x in _T.items())
    + f", {up('c_rule', 1)} AS rule_score, {up('c_supervised', 1)} AS supervised_score, "
    f"{up('c_anomaly', 1)} AS anomaly_score, {up('c_surcharge', 1)} AS surcharge_score, "
    f"{up('c_mismatch', 1)} AS mcc_mismatch_score, {up('c_change', 1)} AS behavioral_change_score, "
    f"{up('fin', 1)} AS final_risk_score, CASE WHEN fin >= 80 THEN 'critical' WHEN fin >= 62 THEN 'high' "
    "WHEN fin >= 45 THEN 'elevated' WHEN fin >= 28 THEN 'watch' ELSE 'clear' END AS risk_tier FROM all3"
)
_tmax = "greatest(" + ", ".join(f"t_{t}" for t in live.TYPOLOGIES) + ")"
V["records"] = (
    "SELECT *, CASE WHEN final_risk_score < 28 THEN 'CLEAN' "
    + " ".join(f"WHEN t_{t} = {_tmax} THEN '{t}'" for t in live.TYPOLOGIES)
    + f" END AS primary_typology, {up('total_volume * (final_risk_score / 100) * 0.12', 0)} AS exposure FROM all4"
)
V["gov"] = "SELECT * FROM records WHERE risk_tier IN ('high', 'critical')"
V["tlong"] = " UNION ALL ".join(
    f"SELECT merchant_id, {i} AS place, '{t}' AS typology, t_{t} AS score, primary_typology FROM records"
    for i, t in enumerate(live.TYPOLOGIES)
)
V["cuts"] = f"""
SELECT typology, {up('score', 1)} AS cut FROM (SELECT typology, score, row_number() OVER (
  PARTITION BY typology ORDER BY score) - 1 AS rn, count(*) OVER (PARTITION BY typology) AS n FROM tlong)
WHERE rn = floor((n - 1) * 0.9)"""
_LANE = {t: lane for lane, (members, _, _) in live.LANES.items() for t in members}
V["active"] = f"""
SELECT merchant_id, typology, score, place, {_case('typology', _LANE)} AS lane
FROM tlong JOIN cuts USING (typology)
WHERE primary_typology <> 'CLEAN' AND (typology = primary_typology OR score > cut)"""
_lane_place = "CASE lane " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(live.LANES)) + " END"
V["contribs"] = " UNION ALL ".join(
    f"SELECT merchant_id, final_risk_score, {i} AS place, '{fid}' AS id, CAST({f} AS DOUBLE) AS value, "
    + (
        f"{w} * " + (f"least(1, {f} * {s})" if capped else f"{f} * {s}")
        if raises else f"-{w} * {f}"
    )
    + " AS signed FROM records"
    for i, (fid, f, w, s, capped, raises) in enumerate(live.CONTRIBUTIONS)
)
V["contrib2"] = f"SELECT *, {up('signed', 2)} AS contribution FROM contribs"
V["contrib"] = """
SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY abs(contribution) DESC, place) AS rn
FROM contrib2 WHERE abs(contribution) >= 1"""
V["topc"] = "SELECT * FROM contrib WHERE rn <= 8"

O: dict[str, str] = {}


def q(sql: str, extra: dict[str, str] | None = None) -> str:
    return with_views(sql, {**V, **(extra or {})})


O["live_base_features"] = q(f"SELECT merchant_id, {r6(FEATURES, ('txn_count',))} FROM lbase")
O["live_diversity"] = q(f"SELECT merchant_id, {r6(DIVERSITY, ('descriptor_count',))} FROM ldiv")
O["live_card_behaviour"] = q(f"SELECT merchant_id, {r6(CARDS)} FROM lcard")
O["rapid_repeats"] = q(
    f"SELECT merchant_id, {r6(CARDS)} FROM (" + _cards("evt", "card_token_id", "transaction_datetime_utc", 3600) + ")"
)
O["live_ticket_percentiles"] = q(f"SELECT merchant_id, {r6(TICKETS)} FROM ltick")
O["change_point"] = q(f"SELECT merchant_id, {r6(['change_point_score'])} FROM lcp")
_cols = [*FEATURES, *DIVERSITY, *CARDS, *TICKETS, "change_point_score", "mcc_divergence"]
O["live_features"] = q(
    "SELECT merchant_id, "
    + ", ".join(c if c in ("txn_count", "descriptor_count") else f"round({c}, 4) + 0.0 AS {c}" for c in _cols)
    + " FROM lfeat"
)
O["levenshtein_similarity"] = q("SELECT * FROM ltext")
_a = TOKENS.format(x="p_name")
_b = TOKENS.format(x="concat_ws(' ', p_brand, p_name, p_type)")
O["token_jaccard"] = q(f"""
SELECT p_partkey, round(CASE WHEN len({_a}) = 0 OR len({_b}) = 0 THEN 0.0 ELSE len(list_intersect({_a}, {_b}))
    / len(list_distinct(list_concat({_a}, {_b}))) END, 6) AS token_jaccard,
  round({edit('p_name', 'p_type')}, 6) + 0.0 AS edit_similarity,
  round({trigram('p_name', "concat_ws(' ', p_type, p_name)")}, 6) AS trigram_similarity,
  round({generic("concat_ws(' ', p_name, 'ONLINE STORE')")}, 6) AS generic_share FROM part""")
_gi = ("shared_bank_account_count", "shared_ip_count", "shared_device_count", "submerchant_count")
O["graph_metrics"] = q(f"SELECT merchant_id, {r6(GRAPH, _gi)} FROM lgraph")
O["neighbor_counts"] = q("""
SELECT merchant_id, CAST(sum(size - 1) AS BIGINT) AS shared_bank_account_count
FROM (SELECT DISTINCT l_suppkey AS merchant_id, l_partkey FROM lineitem) m
JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS size FROM lineitem GROUP BY l_partkey) s USING (l_partkey)
GROUP BY merchant_id""")
O["graph_neighbours"] = q("SELECT * FROM nb")
O["graph_edges"] = q("SELECT center, type, count(*) AS edges FROM edges GROUP BY ALL")
O["graph_nodes"] = q("""
SELECT center, count(*) AS nodes, count(*) FILTER (WHERE b) AS known_bad, count(*) FILTER (WHERE m) AS merchants
FROM (SELECT center, node, node IN (SELECT entity_id FROM bad) AS b,
        node IN (SELECT CAST(merchant_id AS VARCHAR) FROM lm) AS m
      FROM (SELECT center, source AS node FROM edges UNION SELECT center, target FROM edges)) GROUP BY center""")
O["graph_edge_rows"] = q("SELECT center, source, target, type FROM edges")
O["graph_node_rows"] = q("""
SELECT center, node, CASE WHEN r.risk IS NOT NULL THEN 'merchant' ELSE k.kind END AS type,
  coalesce(r.risk, CASE WHEN bad_node THEN k.hot ELSE k.calm END) AS risk, bad_node AS known_bad
FROM (SELECT center, node, min(type) AS type, node IN (SELECT entity_id FROM bad) AS bad_node
      FROM (SELECT center, target AS node, type FROM edges UNION ALL SELECT center, source, NULL FROM edges) GROUP BY center, node) n
LEFT JOIN (SELECT CAST(merchant_id AS VARCHAR) AS node, final_risk_score AS risk FROM records) r USING (node)
LEFT JOIN (VALUES ('settles-to', 'bank', 20.0::DOUBLE, 95.0::DOUBLE), ('owned-by', 'owner', 25, 95), ('uses-address', 'address', 15, 15),
  ('uses-domain', 'domain', 20, 20), ('uses-ip', 'ip', 18, 92), ('uses-device', 'device', 18, 92),
  ('shares-descriptor', 'descriptor', 22, 22), ('processes-through', 'processor', 12, 12)) k(type, kind, calm, hot) USING (type)""")
O["keyword_matches"] = q("SELECT merchant_id, string_agg(k, '|' ORDER BY k) AS keywords FROM kw GROUP BY 1")
O["mcc_prediction"] = q("""
SELECT merchant_id, declared_mcc, predicted_mcc, round(mcc_confidence, 6) AS mcc_confidence,
  mismatch_severity, hierarchy_match, second_mcc, round(second_probability, 6) AS second_probability
FROM pred""")


def _arch(name: str) -> str:
    _, words, axes = live.ARCHETYPES[name]
    match = {
        axis: f"CASE WHEN {f} >= {t} THEN 1 ELSE exp(-pow({f} - {t}, 2) / (2 * {s} * {s})) END"
        for axis, f, t, s, _ in axes
    }
    total = " + ".join(f"{w} * {match[axis]}" for axis, _, _, _, w in axes)
    best = "greatest(" + ", ".join(f"{w} * {match[axis]}" for axis, _, _, _, w in axes) + ")"
    hits = (f"(SELECT count(*) FROM kw WHERE kw.merchant_id = lfeat.merchant_id AND k IN ({_list(words)}))")
    return (
        f"SELECT merchant_id, '{name}' AS archetype, round(100 * (s + (1 - s) * least(0.35, h * 0.12)), 1) "
        f"AS similarity, round(CASE WHEN t > 0 THEN b / t ELSE 0 END, 3) AS top_share FROM (SELECT merchant_id, "
        f"{total} AS t, {best} AS b, ({total}) / {sum(a[4] for a in axes)} AS s, {hits} AS h FROM lfeat)"
    )


O["archetype_similarity"] = q(" UNION ALL ".join(_arch(n) for n in live.ARCHETYPES))
O["mcc_candidates"] = q("""
SELECT merchant_id, rn AS place, r.mcc, p.category, round(prob, 6) AS probability FROM ranked r JOIN prof p USING (mcc) WHERE rn <= 3""")


def _axes(name: str) -> str:
    """One row per axis of an archetype: its match and its share of the weighted total."""
    anchor, words, axes = live.ARCHETYPES[name]
    rows = ", ".join(
        f"{{'axis': {i}, 'id': '{axis}', 'w': {w}::DOUBLE, 'm': CASE WHEN {f} >= {t} THEN 1.0::DOUBLE "
        f"ELSE exp(-pow({f} - {t}, 2) / (2 * {s} * {s})) END}}"
        for i, (axis, f, t, s, w) in enumerate(axes)
    )
    return (
        f"SELECT merchant_id, '{name}' AS archetype, '{anchor}' AS anchor_mcc, (SELECT count(*) FROM kw "
        f"WHERE kw.merchant_id = lfeat.merchant_id AND k IN ({_list(words)})) AS h, unnest([{rows}], recursive := true) FROM lfeat"
    )


O["archetype_attributions"] = q(
    "SELECT merchant_id, archetype, anchor_mcc, round(100 * (s + (1 - s) * least(0.35, h * 0.12)), 1) AS similarity, "
    "row_number() OVER (PARTITION BY merchant_id, archetype ORDER BY share DESC, axis) AS place, id, round(m, 3) AS match, share "
    "FROM (SELECT *, sum(w * m) OVER a / sum(w) OVER a AS s, "
    "round(CASE WHEN sum(w * m) OVER a > 0 THEN w * m / sum(w * m) OVER a ELSE 0 END, 3) AS share FROM ("
    + " UNION ALL ".join(_axes(n) for n in live.ARCHETYPES) + ") WINDOW a AS (PARTITION BY merchant_id, archetype))"
)
O["live_rule_hits"] = q("SELECT * FROM hits")
O["rule_rows"] = O["live_rule_hits"]
O["category_rules"] = q("""
SELECT f.merchant_id, r.declared_mcc || '-' || r.state AS rule_id FROM lfeat f JOIN (SELECT merchant_id, state FROM lm) lm USING (merchant_id) JOIN (
  SELECT b.declared_mcc, m.state, min(low) AS low, min(high) AS high FROM lfeat b JOIN (SELECT merchant_id, state FROM lm) m USING (merchant_id) JOIN (
    SELECT declared_mcc, min(txn_count) AS low, max(txn_count) AS high FROM lfeat GROUP BY 1) USING (declared_mcc) GROUP BY 1, 2) r
ON r.declared_mcc = f.declared_mcc AND r.state <> lm.state AND f.txn_count >= r.low + (r.high - r.low) // 2""")
O["rule_overrides"] = q(
    "SELECT v.rule_id, count(merchant_id) AS hits FROM (VALUES "
    + ", ".join(f"('{r.id}')" for r in live.DEFAULT_RULES)
    + ") v(rule_id) LEFT JOIN hits ON hits.rule_id = v.rule_id "
    "AND v.rule_id NOT IN ('RULE-MCC-002', 'RULE-GEN-001') GROUP BY 1"
)
O["peer_population_z"] = q("SELECT * FROM lz")
O["ensemble_scores"] = q(f"SELECT merchant_id, {r6(COMPONENTS, ('risk_tier',))} FROM records")
O["feature_contributions"] = q("""
SELECT merchant_id, id, round(value, 6) AS value, contribution, CASE WHEN abs(signed) < 1 THEN 'neutral'
  WHEN signed > 0 THEN 'raises' ELSE 'lowers' END AS direction FROM contrib""")
O["typology_scores"] = q(
    "SELECT merchant_id, primary_typology, "
    + ", ".join(f"t_{t} AS {t.lower()}" for t in live.TYPOLOGIES) + " FROM records"
)
O["typology_thresholds"] = q("SELECT * FROM cuts")
_verb = "CASE " + " ".join(
    f"WHEN lane = '{x}' THEN CASE WHEN risk_tier = 'critical' THEN '{c}' ELSE '{s}' END"
    for x, (_, c, s) in live.LANES.items()
) + " END"
O["lane_routing"] = q(f"""
SELECT merchant_id, lane, {_verb} AS queue_verb, coalesce(active, '') AS active, coalesce(touched, '') AS touched
FROM (SELECT merchant_id, risk_tier, nullif({_case('primary_typology', _LANE)}, '') AS lane FROM records)
LEFT JOIN (SELECT merchant_id, string_agg(typology, '|' ORDER BY score DESC, place) AS active FROM active
           GROUP BY 1) USING (merchant_id)
LEFT JOIN (SELECT merchant_id, string_agg(lane, '|' ORDER BY {_lane_place}) AS touched
           FROM (SELECT DISTINCT merchant_id, lane FROM active) GROUP BY 1) USING (merchant_id)""")
_G = "risk_tier IN ('high', 'critical')"
_W = "risk_tier IN ('elevated', 'watch')"
O["portfolio_totals"] = q(f"""
SELECT count(*) AS merchants_monitored, CAST(sum(txn_count) AS BIGINT) AS approved_transactions,
  {up('sum(total_volume)', 0)} AS total_volume,
  {', '.join(f"count(*) FILTER (WHERE risk_tier = '{t}') AS tier_{t}" for t in ['critical', 'high', 'elevated', 'watch', 'clear'])},
  coalesce(sum(exposure) FILTER (WHERE {_G}), 0.0) AS governed_exposure,
  coalesce(sum(exposure) FILTER (WHERE {_W}), 0.0) AS watch_exposure,
  coalesce(sum(exposure) FILTER (WHERE {_G} OR {_W}), 0.0) AS total_at_risk_exposure,
  {up(f"coalesce(sum(exposure) FILTER (WHERE {_G}), 0) / sum(exposure) FILTER (WHERE {_G} OR {_W})", 4)}
    AS governed_share,
  count(*) FILTER (WHERE {_W}) AS watch_merchants FROM records""")
O["typology_summary"] = q(
    "SELECT v.typology, count(merchant_id) AS alerts, coalesce(sum(exposure), 0.0) AS exposure, "
    "round(coalesce(avg(own) / 100, 0), 6) AS mean_confidence, "
    "first(merchant_id ORDER BY final_risk_score DESC, merchant_id) AS top_merchant_id FROM (VALUES "
    + ", ".join(f"('{t}')" for t in live.TYPOLOGIES)
    + ") v(typology) LEFT JOIN (SELECT *, CASE primary_typology "
    + " ".join(f"WHEN '{t}' THEN t_{t}" for t in live.TYPOLOGIES)
    + " END AS own FROM gov) g ON g.primary_typology = v.typology GROUP BY 1"
)
EXTRA_DAYS = {
    "span": """SELECT CAST(min(event_ts) AS DATE) AS d0,
      date_diff('day', CAST(min(event_ts) AS DATE), CAST(max(event_ts) AS DATE)) + 1 AS days FROM ltx""",
    "win": """SELECT ltx.*, date_diff('day', d0, CAST(event_ts AS DATE)) AS day,
      event_ts >= CAST(d0 AS TIMESTAMP) + to_hours(days * 12) AS late FROM ltx JOIN span ON true WHERE amount > 0""",
    "glane": f"SELECT *, nullif({_case('primary_typology', _LANE)}, '') AS lane FROM gov",
    "halves": """SELECT lane, coalesce(sum(amount) FILTER (WHERE NOT late), 0) AS a,
      coalesce(sum(amount) FILTER (WHERE late), 0) AS b
      FROM win JOIN glane USING (merchant_id) GROUP BY lane""",
}
O["lane_rollup"] = q(
    "SELECT v.lane, count(merchant_id) AS merchants, count(*) FILTER (WHERE risk_tier = 'critical') AS critical, "
    "coalesce(sum(exposure), 0.0) AS exposure, "
    f"coalesce(CASE WHEN any_value(a) > 0 THEN {up('(any_value(b) - any_value(a)) / any_value(a) * 100', 1)} END, 0.0)"
    " AS trend_pct FROM (VALUES " + ", ".join(f"('{x}')" for x in live.LANES)
    + ") v(lane) LEFT JOIN glane g ON g.lane = v.lane LEFT JOIN halves h ON h.lane = v.lane GROUP BY 1",
    EXTRA_DAYS,
)
O["daily_trend"] = q(f"""
SELECT d AS day, strftime(any_value(d0) + CAST(d AS INT), '%Y-%m-%d') AS date,
  {up('coalesce(sum(amount), 0)', 0)} AS volume,
  {up(f"coalesce(sum(amount) FILTER (WHERE {_G}), 0)", 0)} AS flagged_volume,
  {up("coalesce(sum(amount * final_risk_score) / sum(amount), 0)", 1)} AS risk_index
FROM (SELECT unnest(range(days)) AS d, d0 FROM span) s LEFT JOIN (SELECT win.*, final_risk_score, risk_tier FROM win
  JOIN records USING (merchant_id)) ON day = d GROUP BY d""", EXTRA_DAYS)
O["geo_summary"] = q(f"""
SELECT state, count(*) AS merchants, count(*) FILTER (WHERE {_G}) AS high_risk,
  {up('sum(total_volume)', 0)} AS volume FROM records GROUP BY state""")
O["score_histogram"] = q("""
SELECT b AS bucket, count(merchant_id) AS merchants FROM range(10) s(b)
LEFT JOIN records ON least(9, floor(final_risk_score / 10)) = b GROUP BY b""")
V["cmem"] = f"""
SELECT acquirer_id, merchant_id, primary_typology AS typology, risk_tier, final_risk_score AS model_score,
  exposure, {up("CASE risk_tier WHEN 'critical' THEN exposure * 0.12 + 25000 ELSE exposure * 0.06 + 10000 END", 0)}
    AS fine_usd FROM gov"""
O["case_members"] = q("SELECT * FROM cmem")
_act = (
    "CASE WHEN severity = 'critical' THEN coalesce(nullif("
    + _case("typology", live.ACTION_CRITICAL) + f", ''), '{live.ACTION_CRITICAL_OTHERWISE}') ELSE coalesce(nullif("
    + _case("typology", live.ACTION_STANDARD) + f", ''), '{live.ACTION_STANDARD_OTHERWISE}') END"
)
V["acase"] = f"""
SELECT *, {_act} AS recommended_action, coalesce(nullif({_case('typology', live.QUEUE_BY_TYPOLOGY)}, ''),
    '{live.QUEUE_OTHERWISE}') AS queue,
  DATE '2001-08-01' + CASE severity WHEN 'critical' THEN 2 ELSE 5 END AS due
FROM (SELECT c.*, d.typology, CASE WHEN critical_count > 0 THEN 'critical' ELSE 'high' END AS severity
  FROM (SELECT acquirer_id, count(*) AS merchant_count, count(*) FILTER (WHERE risk_tier = 'critical')
      AS critical_count, sum(exposure) AS total_exposure, sum(fine_usd) AS total_fine_usd,
      max(model_score) AS model_score,
      first(merchant_id ORDER BY model_score DESC, merchant_id) AS merchant_id FROM cmem GROUP BY 1) c
  JOIN (SELECT acquirer_id, first(typology ORDER BY n DESC, top DESC, typology) AS typology
        FROM (SELECT acquirer_id, typology, count(*) AS n, max(model_score) AS top FROM cmem GROUP BY ALL)
        GROUP BY 1) d USING (acquirer_id))"""
O["case_rollup"] = q("""
SELECT acquirer_id, merchant_count, critical_count, total_exposure, total_fine_usd, merchant_id, model_score,
  typology, 'CASE-' || acquirer_id AS case_id, severity, queue, recommended_action, 'new' AS status,
  '2001-08-01' AS opened, strftime(due, '%Y-%m-%d') AS sla_due,
  date_diff('day', DATE '2001-08-04', CAST(due AS DATE)) AS days_left,
  CASE WHEN due < DATE '2001-08-04' THEN CAST(-date_diff('day', DATE '2001-08-04', CAST(due AS DATE)) AS VARCHAR)
      || 'd overdue' WHEN due = DATE '2001-08-04' THEN 'due today'
    ELSE CAST(date_diff('day', DATE '2001-08-04', CAST(due AS DATE)) AS VARCHAR) || 'd left' END AS sla_state
FROM acase""")
O["case_patches"] = q("""
SELECT 'CASE-' || acquirer_id AS case_id, CASE WHEN merchant_count % 2 = 0 THEN 'triage' ELSE 'new' END AS status,
  CASE WHEN merchant_count % 2 = 0 THEN 'opened|checked' ELSE 'opened' END AS notes FROM acase""")
O["case_statuses"] = q(
    "SELECT s AS status, count(acquirer_id) AS cases FROM (VALUES "
    + ", ".join(f"('{s}')" for s in live.CASE_STATUSES)
    + ") v(s) LEFT JOIN acase ON s = 'new' GROUP BY 1"
)
O["engine_samples"] = q("""
SELECT merchant_id, transaction_id FROM (SELECT user_id AS merchant_id, event_id AS transaction_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rt,
    row_number() OVER (PARTITION BY user_id ORDER BY md5('20260724:' || CAST(event_id AS VARCHAR)), event_id) AS rh,
    user_id IN (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 60) AS best
  FROM events) WHERE CASE WHEN best THEN rt <= 400 ELSE rh <= 24 END""")
O["filed_cases"] = q("""
SELECT merchant_id, strftime(filed_at, '%Y-%m-%d %H:%M:%S.%f') AS filed_at, filing_id FROM (
  SELECT user_id AS merchant_id, ts AS filed_at, event_id AS filing_id, row_number() OVER (
    PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""")
O["filed_state"] = O["filed_cases"]
_open = " UNION ALL ".join(
    f"SELECT merchant_id, '{name}' AS section FROM topc WHERE id IN ({_list(openers)}) GROUP BY merchant_id"
    for name, (openers, _) in SUPPORTING.items()
)
_cite = ", ".join(f"('{name}', '{c}')" for name, (_, cites) in SUPPORTING.items() for c in cites)
V["sup"] = _open
V["mit"] = """
SELECT merchant_id, 'thin-history' AS section, NULL AS citation FROM records WHERE txn_count < 25 UNION ALL
SELECT merchant_id, 'low-disputes', NULL FROM records WHERE dispute_rate < 0.01 UNION ALL
SELECT merchant_id, 'legitimate-explanation', NULL FROM records
  WHERE primary_typology = 'CLEAN' OR declared_mcc = predicted_mcc UNION ALL
SELECT merchant_id, 'descriptor-matches-name', 'F-018' FROM records WHERE descriptor_name_similarity > 0.7"""
O["evidence_rows"] = q(f"""
SELECT s.merchant_id, 'supporting' AS side, s.section, c.cite AS citation
FROM sup s JOIN (VALUES {_cite}) c(section, cite) ON c.section = s.section
JOIN topc t ON t.merchant_id = s.merchant_id AND t.id = c.cite
UNION ALL SELECT r.merchant_id, 'supporting', 'composite-anomaly', t.id FROM records r
  LEFT JOIN topc t ON t.merchant_id = r.merchant_id AND t.rn <= 2
  WHERE r.merchant_id NOT IN (SELECT merchant_id FROM sup)
UNION ALL SELECT merchant_id, 'mitigating', section, citation FROM mit
UNION ALL SELECT merchant_id, 'mitigating', 'limited-contradiction', NULL FROM records
  WHERE merchant_id NOT IN (SELECT merchant_id FROM mit)""")
_conf = "least(0.97, 0.35 + final_risk_score / 140 + mcc_confidence * 0.25)"
O["evidence_confidence"] = q(f"""
SELECT merchant_id, {up(f'CASE WHEN txn_count < 25 THEN least({_conf}, 0.45) ELSE {_conf} END', 2)} AS confidence,
  CASE WHEN txn_count < 25 THEN 'Low (thin file)' WHEN {_conf} > 0.75 THEN 'High' WHEN {_conf} > 0.55
    THEN 'Moderate' ELSE 'Low' END AS confidence_label FROM records""")
O["corroboration"] = q("""
SELECT merchant_id, l AS graph_corroborates, hit_total > 0 AS rules_corroborate,
  card_not_present_ratio > 0.8 AS remote_flag, cash_equivalent_ratio > 0.1 AS quasi_cash_flag,
  round_dollar_ratio > 0.15 AS round_flag, abs(peer_night_z) > 2 AS night_z_flag,
  abs(peer_cnp_z) > 2 AS cnp_z_flag, mcc_divergence > 0.3 AS divergence_flag,
  CAST(2 + l::INT + (hit_total > 0)::INT AS BIGINT) AS corroborating_lanes
FROM (SELECT *, shared_bank_account_count + shared_ip_count + shared_device_count + submerchant_count > 0 AS l
      FROM records)""")
V["lrec"] = "SELECT * FROM records JOIN llab USING (merchant_id)"
V["lcurve"] = """
SELECT t AS threshold, count(merchant_id) AS alerts, count(*) FILTER (WHERE abuse) AS tp,
  coalesce(sum(exposure) FILTER (WHERE abuse), 0) AS captured_exposure,
  CASE WHEN count(merchant_id) > 0 THEN count(*) FILTER (WHERE abuse) / count(merchant_id) ELSE 0.0 END AS precision,
  count(*) FILTER (WHERE abuse) / greatest(1, (SELECT count(*) FROM lrec WHERE abuse)) AS recall
FROM (SELECT range * 2 AS t FROM range(51)) LEFT JOIN lrec ON final_risk_score >= t GROUP BY t"""
O["live_threshold_curve"] = q("""
SELECT threshold, alerts, tp, captured_exposure, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(2 * precision * recall / greatest(1e-9, precision + recall), 6) AS f1 FROM lcurve""")
O["live_class_precision"] = q("""
SELECT primary_typology AS class, count(*) AS alerts,
  round(avg((primary_typology = true_typology)::INT), 6) AS precision
FROM lrec WHERE final_risk_score >= 28 GROUP BY 1""")
O["contribution_importance"] = q("""
SELECT id, round(avg(abs(contribution)), 6) AS importance, count(*) AS n FROM topc
WHERE final_risk_score >= 28 GROUP BY id ORDER BY avg(abs(contribution)) DESC, id LIMIT 12""")
O["quality_transactions"] = q("""
SELECT count(*) AS "rows", count(*) FILTER (WHERE card_id % 100 = 7) AS bad_tokens,
  count(*) FILTER (WHERE card_id % 100 = 7) AS clear_pans, count(*) FILTER (WHERE amount < 0) AS negative_amounts
FROM ltx""")
O["quality_shares"] = q(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} < 0 OR {c} > 1) AS violations FROM features"
    for c in ["pct_cnp", "refund_rate_count", "volume_spike_ratio"]
))
O["quality_missing_ids"] = q("""
SELECT c_custkey AS merchant_id FROM customer WHERE c_custkey NOT IN (SELECT merchant_id FROM lm)""")
O["quality_labels"] = q("""
SELECT count(*) FILTER (WHERE is_integrity_violation IS NULL) AS missing_labels,
  count(*) FILTER (WHERE is_integrity_violation = NOT is_interchange_abuse) AS inconsistent_labels FROM lab""")
O["quality_rows"] = q("""
SELECT 'merchants' AS "table", count(*) AS "rows", count(*) BETWEEN 1000 AND 5000 AS within_bounds FROM lfeat
UNION ALL SELECT 'transactions', count(*), count(*) >= 1000 FROM ltx""")
O["quality_enums"] = q("""
SELECT 'authorization_status' AS "column", count(*) FILTER (WHERE authorization_status NOT IN ('approved', 'declined')) AS violations FROM ltx
UNION ALL SELECT 'entry_mode', count(*) FILTER (WHERE entry_mode NOT IN ('manual', 'chip', 'contactless')) FROM ltx
UNION ALL SELECT 'dispute_reason', count(*) FILTER (WHERE dispute_reason <> 'other') FROM ltx""")

ORACLE = O

"""SQL for the mart, explorer, evaluation and drill-down queries."""

from __future__ import annotations

from merchantscope import reference as ref
from merchantscope.plans.mart_queries import SIGNALS, SLICE_COLUMNS
from merchantscope.plans.mart_queries import REVENUE_BY_REGION
from merchantscope.sources.catalog import SAMPLE_QUERIES
from starbook.fixtures import RECORD_SQL, SURCHARGE_SQL
from oracle.views import Z_FEATURES, _case, _list, _z, with_views

R = "round({}, 6) + 0.0"


def q(sql: str, extra: dict[str, str] | None = None) -> str:
    return with_views(sql, {**EXTRA, **(extra or {})})


_TIERS = ref.TIER_ORDER
EXTRA: dict[str, str] = {
    "rec": RECORD_SQL,
    "sur": SURCHARGE_SQL,
    "flg": "SELECT * FROM scores WHERE flag_for_investigation = 1",
    "labs": "SELECT s.*, lab.* EXCLUDE (merchant_id) FROM scores s LEFT JOIN lab USING (merchant_id)",
    "merchants": """SELECT s.*, CASE WHEN is_interchange_abuse THEN 'interchange_abuse'
        WHEN is_integrity_violation THEN 'integrity_violation' ELSE 'clean' END AS label
        FROM scores s LEFT JOIN lab USING (merchant_id)""",
    "transactions": "SELECT tx.*, merchant_name FROM tx LEFT JOIN dim USING (merchant_id)",
    "spine100": "SELECT range * 2 AS t FROM range(51)",
    "spine4": "SELECT range * 4 AS t FROM range(26)",
}

ORACLE: dict[str, str] = {}
o = ORACLE

o["overview_headline"] = q("""
SELECT count(*) AS merchants_monitored, CAST(sum(txn_count) AS BIGINT) AS transactions_scored,
  round(sum(gross_sales_usd), 6) AS gross_sales_usd,
  count(*) FILTER (WHERE flag_for_investigation = 1) AS flagged_merchants,
  round(coalesce(sum(gross_sales_usd) FILTER (WHERE flag_for_investigation = 1), 0), 6)
    AS flagged_exposure_usd,
  round(coalesce(sum(gross_sales_usd) FILTER (WHERE flag_for_investigation = 1), 0)
    / sum(gross_sales_usd), 6) AS flagged_exposure_pct,
  count(*) FILTER (WHERE risk_tier = 'Critical') AS critical_merchants
FROM scores""")
o["overview_tiers"] = q(
    "SELECT CAST(i AS BIGINT) AS tier_rank, t AS risk_tier, count(merchant_id) AS merchants, "
    "round(coalesce(sum(gross_sales_usd), 0), 6) AS exposure FROM (VALUES "
    + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_TIERS))
    + ") AS v(i, t) LEFT JOIN scores ON risk_tier = t GROUP BY ALL"
)
o["family_pivot"] = q(
    "SELECT CAST(i AS BIGINT) AS family_rank, f AS family, count(merchant_id) AS alerts, "
    "round(coalesce(sum(gross_sales_usd), 0), 6) AS exposure, "
    + ", ".join(
        f"count(*) FILTER (WHERE risk_tier = '{t}') AS tier_{t.lower()}" for t in _TIERS
    )
    + ", "
    + ", ".join(
        "count(*) FILTER (WHERE top_category IN ("
        + _list([c for c, v in ref.CATEGORY_PRIORITY.items() if v == p])
        + f")) AS alerts_{p.lower()}"
        for p in ("P1", "P2", "P3")
    )
    + f", {_case('f', ref.FAMILY_LABELS)} AS label, f = 'mcc_abuse' AS separate_class FROM (VALUES "
    + ", ".join(f"({i}, '{f}')" for i, f in enumerate(ref.FAMILY_ORDER))
    + ") AS v(i, f) LEFT JOIN flg ON family = f GROUP BY ALL"
)
o["family_subtypes"] = q(
    "SELECT family, top_category AS category, count(*) AS alerts, "
    "round(sum(gross_sales_usd), 6) AS exposure, "
    f"{_case('top_category', ref.CATEGORY_LABELS)} AS label, "
    f"{_case('top_category', ref.CATEGORY_PRIORITY)} AS priority FROM flg GROUP BY family, top_category"
)
o["priority_queue"] = q("""
SELECT merchant_id, merchant_name, declared_mcc, mcc_group, integrity_risk_score, risk_tier, family,
  family_label, nullif(subtype, '') AS subtype, round(gross_sales_usd, 6) AS gross_sales_usd,
  exposure_weighted_score, rule_names, flag_reason, CAST(rules_triggered AS BIGINT) AS rules
FROM flg ORDER BY exposure_weighted_score DESC, merchant_id LIMIT 12""")
_ROLL = (
    "count(*) AS merchants, CAST(sum(txn_count) AS BIGINT) AS txns, "
    "round(sum(gross_sales_usd), 6) AS sales_usd, max(integrity_risk_score) AS max_score, "
    "round(avg(integrity_risk_score), 6) AS mean_score, "
    "CAST(sum(flag_for_investigation) AS BIGINT) AS flagged FROM scores"
)
o["dba_corp_grouping_sets"] = q(
    f"SELECT 'dba' AS level, CAST(dba_id AS BIGINT) AS entity_id, dba_name AS entity_name, {_ROLL} "
    "GROUP BY dba_id, dba_name UNION ALL SELECT 'corp', CAST(corp_id AS BIGINT), corp_name, "
    f"{_ROLL} GROUP BY corp_id, corp_name"
)
o["monthly_trend"] = q("""
SELECT strftime(transaction_date, '%Y-%m') AS month, round(sum(abs(settlement_amount_usd)), 6) AS volume,
  round(coalesce(sum(abs(settlement_amount_usd)) FILTER (WHERE flag_for_investigation = 1), 0), 6)
    AS flagged_volume
FROM tx JOIN scores USING (merchant_id)
WHERE tx.approved_flag = 'Y' AND tx.refund_flag <> 'Y' GROUP BY 1""")
o["scope_totals"] = q("""
SELECT count(*) FILTER (WHERE x) AS alerts,
  count(*) FILTER (WHERE x AND risk_tier = 'Critical') AS critical,
  round(coalesce(sum(gross_sales_usd) FILTER (WHERE x), 0), 6) AS exposure,
  round(coalesce(sum(gross_sales_usd) FILTER (WHERE x), 0) / sum(gross_sales_usd), 6) AS exposure_pct
FROM (SELECT *, family IN ('factoring', 'cash') AS x FROM scores)""")
o["rule_hits"] = q(
    " UNION ALL ".join(
        f"SELECT '{r}' AS rule, CAST(sum({r}) AS BIGINT) AS fired FROM scores" for r in ref.BATCH_RULES
    )
)
o["cohort_summary"] = q("""
SELECT family, top_category, count(*) AS merchants, round(sum(gross_sales_usd), 6) AS exposure,
  round(avg(integrity_risk_score), 6) AS mean_score,
  count(*) FILTER (WHERE risk_tier IN ('Critical', 'High')) AS acute,
  count(*) FILTER (WHERE flag_reason LIKE '%model%') AS model_flagged
FROM flg GROUP BY ALL""")
o["entity_search"] = q("""
SELECT merchant_id, merchant_name, integrity_risk_score FROM scores
WHERE lower(merchant_name) LIKE '%#00000000%' ORDER BY integrity_risk_score DESC, merchant_id LIMIT 20""")
o["indexed_entity_search"] = o["entity_search"]
o["indexed_part_search"] = """
WITH needles AS (
  SELECT unnest(string_split(p_type, ' ')) AS needle FROM part UNION SELECT substr(p_name, 1, 2) FROM part)
SELECT needle, p_partkey FROM needles JOIN part
ON contains(lower(p_name), lower(trim(needle))) OR contains(lower(p_type), lower(trim(needle))) WHERE trim(needle) <> ''"""


def _elevated() -> str:
    whens = []
    for family, models in ref.DETECTION_MODELS.items():
        for category, signals in models.items():
            hits = " + ".join(
                f"coalesce({s} >= {ref.SIGNAL_THRESHOLDS[s]}, false)::INT"
                for s in signals
                if not s.startswith("surcharge_") and s != "pct_txn_surcharged"
            )
            whens.append(
                f"WHEN family = '{family}' AND top_category = '{category}' THEN {hits or 0}"
            )
    return "CAST(CASE " + " ".join(whens) + " END AS BIGINT)"


EXTRA["elev"] = f"SELECT *, {_elevated()} AS elevated_signals FROM scores"
o["elevated_signals"] = q("SELECT merchant_id, family, top_category, elevated_signals FROM elev")
o["queue_view"] = q("""
SELECT merchant_id, family, top_category, elevated_signals, round(gross_sales_usd, 6) AS gross_sales_usd
FROM elev WHERE elevated_signals >= 1 AND merchant_id % 10 <> 0
  AND contains(lower(merchant_name), 'supplier')""")

# ----------------------------------------------------------------- explorer
o["merchant_view"] = q("""
SELECT merchant_id, merchant_name, corp_name, mcc_group, family, subtype, label, txn_count,
  integrity_risk_score FROM merchants""")
_VIEW_NUMBERS = [
    "gross_sales_usd", "avg_ticket_usd", "pct_cnp", "pct_recurring", "pct_quasi_cash", "pct_round_100", "pct_cross_border",
    "chargeback_rate_bps", "refund_rate_amount", "effective_interchange_bps", "interchange_advantage_bps",
    "pct_txn_with_sub_merchant", "integrity_risk_score", "integrity_percentile", "exposure_weighted_score",
]
o["merchant_view_rows"] = q(
    "SELECT merchant_id, merchant_name, corp_name, merchant_city, merchant_country, declared_mcc, mcc_group, txn_count, "
    "CAST(unique_cards AS BIGINT) AS unique_cards, CAST(n_distinct_descriptors AS BIGINT) AS n_distinct_descriptors, risk_tier, "
    "top_category, top_pattern, CAST(flag_for_investigation AS BIGINT) AS flag_for_investigation, rule_names, flag_reason, family, "
    "family_label, subtype, label, " + ", ".join(f"{R.format(c)} AS {c}" for c in _VIEW_NUMBERS) + " FROM merchants"
)
o["queue_rules"] = q("""
SELECT merchant_id, generate_subscripts(r, 1) - 1 AS place, unnest(r) AS rule FROM (
  SELECT merchant_id, list_filter(string_split(rule_names, '|'), lambda x: x <> '') AS r
  FROM flg ORDER BY exposure_weighted_score DESC, merchant_id LIMIT 12)""")
_TX_TIES = [
    "transaction_date", "local_hour", "merchant_descriptor", "sub_merchant_id",
    "settlement_amount_usd", "card_token_id", "issuer_country", "channel", "card_present_flag",
    "token_flag", "approved_flag", "interchange_fee_usd", "refund_flag", "chargeback_flag",
    "chargeback_amount_usd", "fraud_flag", "domestic_xborder_flag", "split_group_id",
]
_SLICE_OUT = ", ".join(
    {
        "transaction_datetime_utc": "strftime(transaction_datetime_utc, '%Y-%m-%d %H:%M:%S.%f')"
        " AS transaction_datetime_utc",
        "settlement_amount_usd": "round(settlement_amount_usd, 6) AS settlement_amount_usd",
    }.get(c, c)
    for c in SLICE_COLUMNS
)
for _view, _flagged, _clean, _sample in (("wanted", 400, 250, 150), ("wanted_small", 40, 25, 15)):
    EXTRA[_view] = f"""
SELECT merchant_id, {_flagged} AS cap FROM scores WHERE flag_for_investigation = 1 UNION ALL
SELECT merchant_id, {_clean} FROM (SELECT merchant_id FROM scores WHERE flag_for_investigation = 0
  ORDER BY md5('20260724:' || CAST(merchant_id AS VARCHAR)), merchant_id LIMIT {_sample})"""


def _latest(ties: list[str]) -> str:
    return (
        "row_number() OVER (PARTITION BY merchant_id ORDER BY transaction_datetime_utc DESC, "
        + ", ".join(f"{c} NULLS FIRST" for c in ties)
        + ")"
    )


for _name, _view in (("recent_rows_cap", "wanted"), ("recent_rows_small_cap", "wanted_small")):
    o[_name] = q(
        f"SELECT {_SLICE_OUT} FROM (SELECT tx.*, cap, {_latest(_TX_TIES)} AS rn "
        f"FROM tx JOIN {_view} USING (merchant_id)) WHERE rn <= cap"
    )
_SLICE_TEXT = [
    "merchant_id", "local_hour", "merchant_descriptor", "sub_merchant_id", "card_token_id", "issuer_country", "channel",
    "card_present_flag", "token_flag", "approved_flag", "refund_flag", "chargeback_flag", "fraud_flag", "domestic_xborder_flag",
    "split_group_id", "merchant_name",
]
_SLICE_NUMBERS = ["settlement_amount_usd", "interchange_fee_usd", "chargeback_amount_usd"]
o["slice_rows"] = q(
    f"SELECT {', '.join(_SLICE_TEXT)}, strftime(transaction_datetime_utc, '%Y-%m-%d %H:%M:%S.%f') AS transaction_datetime_utc, "
    "strftime(transaction_date, '%Y-%m-%d') AS transaction_date, "
    + ", ".join(f"{R.format(c)} AS {c}" for c in _SLICE_NUMBERS)
    + f" FROM (SELECT tx.*, cap, {_latest(_TX_TIES)} AS rn FROM tx JOIN wanted_small USING (merchant_id)) "
    "LEFT JOIN dim USING (merchant_id) WHERE rn <= cap"
)
EXTRA["picks"] = """
SELECT merchant_id, family FROM (SELECT *, row_number() OVER (PARTITION BY family
    ORDER BY exposure_weighted_score DESC, merchant_id) AS rn FROM flg) WHERE rn = 1 UNION ALL
SELECT merchant_id, '' FROM (SELECT merchant_id FROM scores WHERE flag_for_investigation = 0
  ORDER BY txn_count DESC, merchant_id LIMIT 2)"""
o["slice_preview"] = q(
    f"SELECT {_SLICE_OUT}, family FROM (SELECT tx.*, picks.family, "
    + _latest([*[c for c in SLICE_COLUMNS if c not in ("merchant_id", "transaction_datetime_utc")],
               "split_group_id"])
    + " AS rn FROM tx JOIN picks USING (merchant_id)) WHERE rn <= 14"
)
o["flagged_first"] = q("""
SELECT merchant_id, CAST(flag_for_investigation AS BIGINT) AS flag_for_investigation,
  integrity_risk_score FROM scores
ORDER BY flag_for_investigation DESC, integrity_risk_score DESC, merchant_id LIMIT 40""")
o["family_volume"] = q("""
SELECT family, count(*) AS txns, round(sum(settlement_amount_usd), 2) AS amount
FROM tx JOIN scores USING (merchant_id) GROUP BY family""")
o["run_metadata"] = q("""
SELECT 'merchants' AS "table", count(*) AS "rows" FROM dim
UNION ALL SELECT 'transactions', count(*) FROM tx""")
o["sql_by_cost"] = REVENUE_BY_REGION
o["catalog_statistics"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls FROM {t}"
    for t, columns in {
        "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
        "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
        "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
        "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    }.items() for c in columns.split()
)
for _name, _sql in SAMPLE_QUERIES.items():
    body = _sql.strip()
    body = body.replace("SELECT t.transaction_date,", "SELECT strftime(t.transaction_date, '%Y-%m-%d') AS transaction_date,")
    o[f"sql_{_name}"] = q(body)

# --------------------------------------------------------------- evaluation
o["confusion"] = q("""
SELECT 62.0 AS threshold, count(*) FILTER (WHERE p AND actual) AS tp,
  count(*) FILTER (WHERE p AND NOT actual) AS fp, count(*) FILTER (WHERE NOT p AND NOT actual) AS tn,
  count(*) FILTER (WHERE NOT p AND actual) AS fn,
  round(CASE WHEN count(*) FILTER (WHERE p) > 0 THEN count(*) FILTER (WHERE p AND actual)
    / count(*) FILTER (WHERE p) ELSE 0 END, 6) AS precision
FROM (SELECT *, score >= 62 AS p FROM rec)""")
o["threshold_curve"] = q("""
SELECT threshold, alerts, tp, round(captured_exposure, 6) AS captured_exposure,
  round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(2 * precision * recall / greatest(1e-9, precision + recall), 6) AS f1
FROM (SELECT t AS threshold, count(record_id) AS alerts, count(*) FILTER (WHERE actual) AS tp,
        coalesce(sum(exposure) FILTER (WHERE actual), 0) AS captured_exposure,
        CASE WHEN count(record_id) > 0 THEN count(*) FILTER (WHERE actual) / count(record_id)
          ELSE 0.0 END AS precision,
        count(*) FILTER (WHERE actual) / greatest(1, (SELECT count(*) FROM rec WHERE actual)) AS recall
      FROM spine100 LEFT JOIN rec ON score >= t GROUP BY t)""")
o["impact_sweep"] = q("""
SELECT t AS threshold, round(coalesce(sum(exposure), 0) / (SELECT sum(exposure) FROM rec), 6)
    AS captured_pct, count(record_id) AS alerts,
  round(count(record_id) / (SELECT count(*) FROM rec), 6) AS workload_pct
FROM spine4 LEFT JOIN rec ON score >= t GROUP BY t""")
o["impact_at"] = q("""
SELECT count(*) FILTER (WHERE score >= 40) AS alerts,
  round(sum(exposure) FILTER (WHERE score >= 40), 6) AS captured_exposure,
  round(coalesce(sum(exposure) FILTER (WHERE score < 40 AND actual), 0), 6) AS missed_exposure
FROM rec""")


def _auc(source: str, keys: str, score: str, actual: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return f"""
SELECT {head}CASE WHEN sum(a) > 0 AND sum(1 - a) > 0 THEN
  (sum(r * a) - sum(a) * (sum(a) + 1) / 2) / (sum(a) * sum(1 - a)) END AS auc,
  CAST(sum(a) AS BIGINT) AS positives, count(*) AS records
FROM (SELECT *, rank() OVER ({part} ORDER BY s)
        + (count(*) OVER (PARTITION BY {keys + ', ' if keys else ''}s) - 1) / 2 AS r
      FROM (SELECT {head}coalesce({score}, 0) AS s, coalesce({actual}, false)::INT AS a FROM {source}))
{'GROUP BY ' + keys if keys else ''}"""


o["rank_auc"] = q(f"SELECT grp, round(auc, 6) AS auc, positives, records FROM ({_auc('rec', 'grp', 'exposure', 'actual')})")
o["class_precision"] = q("""
SELECT predicted_class AS class, count(*) AS alerts,
  round(avg((predicted_class = actual_class)::INT), 6) AS precision
FROM rec WHERE score >= 30 GROUP BY predicted_class""")
o["false_positives"] = q("""
SELECT record_id, score FROM rec WHERE score >= 30 AND NOT actual
ORDER BY score DESC, record_id LIMIT 12""")


def _metrics(models: list[tuple[str, str, str, str | None]]) -> dict[str, str]:
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS model, coalesce({p}, false) AS p, coalesce({a}, false) AS a, "
        f"CAST({s or 'NULL'} AS DOUBLE) AS s FROM labs"
        for name, p, a, s in models
    )
    scored = _list([name for name, _, _, s in models if s])
    return {
        "long": rows,
        "long_scored": f"SELECT * FROM long WHERE model IN ({scored})",
        "aucs": _auc("long_scored", "model", "s", "a"),
        "conf": """SELECT model, count(*) FILTER (WHERE p AND a) AS tp,
            count(*) FILTER (WHERE p AND NOT a) AS fp, count(*) FILTER (WHERE NOT p AND a) AS fn,
            count(*) FILTER (WHERE a) AS support FROM long GROUP BY model""",
        "prf": "SELECT *, tp / greatest(1, tp + fp) AS pr, tp / greatest(1, tp + fn) AS re FROM conf",
    }


_METRICS_SQL = """
SELECT model, tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall,
  round(2 * pr * re / greatest(1e-9, pr + re), 6) AS f1, support, round(auc, 6) AS auc
FROM prf LEFT JOIN aucs USING (model)"""
_models: list[tuple[str, str, str, str | None]] = [
    ("descriptor", "score_descriptor >= 70", "descriptor_churn", "score_descriptor"),
    ("mcc_miscoding", "score_mcc_miscoding >= 70", "is_content_miscoded", "score_mcc_miscoding"),
]
for _f, _s in {"split_ticketing": "split_ticketing", "factoring": "factoring",
               "mcc_abuse": "mcc_abuse", "cash": "cash_disbursement"}.items():
    _models.append((_f, f"family = '{_f}'", f"true_family = '{_f}'", f"score_{_s}"))
_models.append(("composite", "flag_for_investigation = 1",
                "is_integrity_violation OR is_interchange_abuse", "integrity_risk_score"))
for _c in ref.CATEGORY_WEIGHTS:
    _models.append((f"category:{_c}", f"flag_for_investigation = 1 AND top_category = '{_c}'",
                    f"integrity_category = '{_c}'", None))
for _t in ("P1", "P2", "P3"):
    _cats = _list([c for c, v in ref.CATEGORY_PRIORITY.items() if v == _t])
    _models.append((f"priority:{_t}", f"flag_for_investigation = 1 AND top_category IN ({_cats})",
                    f"integrity_tier = '{_t}'", None))
o["registry_metrics"] = q(_METRICS_SQL, _metrics(_models))
o["queue_quality"] = q(
    _METRICS_SQL,
    _metrics([
        ("queue", "flag_for_investigation = 1", "is_integrity_violation OR is_interchange_abuse",
         "integrity_risk_score"),
        ("violation", "flag_for_investigation = 1", "is_integrity_violation", None),
        ("abuse", "flag_for_investigation = 1", "is_interchange_abuse", None),
    ]),
)
_books = {**ref.CATEGORY_WEIGHTS, **ref.PATTERN_WEIGHTS, "composite": ref.COMPOSITE_WEIGHTS}
EXTRA["zflag"] = (
    "SELECT z.* FROM z JOIN scores s USING (merchant_id) WHERE s.flag_for_investigation = 1"
)
o["feature_importance"] = q(
    "SELECT model, v.feature, weight, round(abs(weight) / sum(abs(weight)) OVER (PARTITION BY model)"
    " * 100, 6) AS importance, round(mean_z, 6) + 0.0 AS mean_z FROM (VALUES "
    + ", ".join(
        f"('{m}', '{f}', CAST({w} AS DOUBLE))" for m, ws in _books.items() for f, w in ws.items()
    )
    + ") AS v(model, feature, weight) JOIN ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, avg(z_{f}) AS mean_z FROM zflag" for f in Z_FEATURES)
    + ") mz USING (feature)"
)

# --------------------------------------------------------------- drill-down
_EXEMPLAR_ORDER = {
    "mcc_miscoding": "(txn_count >= 150) DESC, rules_triggered DESC, txn_count DESC, "
                     "exposure_weighted_score DESC",
    "mcc_abuse": "(txn_count >= 200) DESC, abs(interchange_advantage_bps) * gross_sales_usd DESC, "
                 "txn_count DESC",
    "split_ticketing": "pct_txn_in_split_burst DESC, split_burst_events DESC, txn_count DESC",
    "factoring": "n_sub_merchant_ids DESC, volume_spike_ratio DESC, txn_count DESC",
    "descriptor": "descriptor_changes DESC, txn_count DESC",
    "cash": "pct_round_100 DESC, pct_quasi_cash DESC, txn_count DESC",
}
o["exemplars"] = q(
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT family, merchant_id, txn_count, exposure_weighted_score FROM flg "
        f"WHERE family = '{f}' ORDER BY {order}, merchant_id LIMIT 1)"
        for f, order in _EXEMPLAR_ORDER.items()
    )
)
_TELLS = {
    "night": "local_hour <= 5 OR local_hour >= 23",
    "round": "amt > 0 AND amt % 100 = 0",
    "cnp": "card_present_flag = 'N'",
    "offshore": "merchant_acquirer_country_mismatch = 'Y' OR (acquirer_country <> merchant_country"
                " AND acquirer_country <> issuer_country)",
    "declined": "approved_flag <> 'Y'",
    "recurring": "channel = 'RECURRING'",
    "cpmismatch": "card_present_flag <> 'N' AND (channel LIKE '%ECOM%' OR channel LIKE '%MOTO%')",
    "ceiling": "ceiling > 0 AND amt >= ceiling * 0.85 AND amt < ceiling",
    "burst": "split_group_id IS NOT NULL",
    "submerchant": "sub_merchant_id IS NOT NULL",
    "big": "amt >= 500",
}
_tell = "concat_ws('|', " + ", ".join(
    f"CASE WHEN ({cond}) AND family IN ("
    + _list([f for f, tags in ref.FAMILY_TELLS.items() if tag in tags])
    + f") THEN '{tag}' END"
    for tag, cond in _TELLS.items()
) + ")"
EXTRA["sg"] = """
SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY size DESC, total DESC, split_group_id)
    AS place
FROM (SELECT merchant_id, split_group_id, count(*) AS size, sum(abs(settlement_amount_usd)) AS total,
        min(transaction_datetime_utc) AS started
      FROM tx WHERE split_group_id IS NOT NULL GROUP BY ALL)"""
EXTRA["ceil"] = (
    "SELECT merchant_id, p95, CASE "
    + " ".join(f"WHEN p95 < {c} THEN {c}" for c in ref.CEILING_STEPS)
    + " ELSE ceil(p95 / 1000) * 1000 END AS ceiling FROM (SELECT tx.merchant_id, "
    "quantile_cont(abs(settlement_amount_usd), 0.95) AS p95 FROM tx JOIN sg USING (merchant_id, "
    "split_group_id) WHERE place <= 6 GROUP BY tx.merchant_id)"
)
EXTRA["told"] = (
    f"SELECT *, {_tell} AS tells FROM (SELECT tx.*, abs(settlement_amount_usd) AS amt, f.family, "
    "f.merchant_country, CASE WHEN channel = 'RECURRING' THEN 'Y' END AS recurring_flag, "
    "ceiling FROM tx JOIN flg f USING (merchant_id) LEFT JOIN ceil USING (merchant_id))"
)
# The order of ties follows the columns of the tagged table.
_ALL = [
    "local_hour", "settlement_amount_usd", "channel", "card_present_flag", "issuer_country",
    "acquirer_country", "approved_flag", "auth_response_code", "merchant_descriptor",
]
_ORDER = "transaction_datetime_utc DESC, " + ", ".join(f"{c} NULLS FIRST" for c in _ALL)
o["evidence_sample"] = q(f"""
SELECT merchant_id, family,
  strftime(transaction_datetime_utc, '%Y-%m-%d %H:%M:%S.%f') AS transaction_datetime_utc,
  round(settlement_amount_usd, 6) AS settlement_amount_usd, tells <> '' AS telling, tells
FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY {_ORDER}, tells <> '') AS rn2
  FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id, tells <> '' ORDER BY {_ORDER}) AS rn
        FROM told) WHERE rn <= CASE WHEN tells <> '' THEN 9 ELSE 3 END) WHERE rn2 <= 12""")
_cats = list(ref.CATEGORY_WEIGHTS)
EXTRA["cat_long"] = " UNION ALL ".join(
    f"SELECT merchant_id, {i} AS place, '{c}' AS category, score_{c} AS score FROM scores"
    for i, c in enumerate(_cats)
)
o["category_fingerprint"] = q("""
SELECT merchant_id, string_agg(category, '|' ORDER BY rn) AS categories, max(score) AS top_score,
  count(*) FILTER (WHERE score >= 90) AS lit
FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY score DESC, place) AS rn
      FROM cat_long) WHERE rn <= 6 GROUP BY merchant_id""")
o["fingerprint_rows"] = q("""
SELECT merchant_id, rn AS place, category, round(score, 6) AS score FROM (SELECT *, row_number() OVER (
  PARTITION BY merchant_id ORDER BY score DESC, place) AS rn FROM cat_long) WHERE rn <= 6""")
o["interchange_signature"] = q(
    "SELECT merchant_id, "
    + ", ".join(
        f"{R.format(c)} AS {c}"
        for c in ["mcc_declared_interchange_bps", "behaviour_expected_interchange_bps",
                  "effective_interchange_bps", "interchange_advantage_bps", "cnp_vs_mcc_expected",
                  "gross_sales_usd"]
    )
    + ", round(abs(interchange_advantage_bps) / 10000 * gross_sales_usd, 6) AS leaked_fees_usd FROM scores"
)
o["split_groups"] = q("""
SELECT merchant_id, split_group_id, size, round(total, 6) AS total,
  strftime(started, '%Y-%m-%d %H:%M:%S.%f') AS started, place FROM sg WHERE place <= 6""")
o["split_ceilings"] = q("SELECT merchant_id, round(p95, 6) AS p95, ceiling FROM ceil")
o["sub_merchants"] = q("""
SELECT merchant_id, sub_merchant_id, descriptor, txns, round(volume, 6) AS volume, place FROM (
  SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY volume DESC, sub_merchant_id) AS place
  FROM (SELECT merchant_id, sub_merchant_id, CAST(sum(n) AS BIGINT) AS txns, sum(amt) AS volume,
          first(merchant_descriptor ORDER BY n DESC, merchant_descriptor) AS descriptor
        FROM (SELECT merchant_id, sub_merchant_id, merchant_descriptor, count(*) AS n,
                sum(abs(settlement_amount_usd)) AS amt
              FROM tx WHERE sub_merchant_id IS NOT NULL GROUP BY ALL) GROUP BY ALL)) WHERE place <= 8""")
o["recent_months"] = q("""
SELECT merchant_id, month, round(volume, 6) AS volume FROM (
  SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY month DESC) AS rn
  FROM (SELECT merchant_id, strftime(transaction_datetime_utc, '%Y-%m') AS month,
          sum(abs(settlement_amount_usd)) AS volume FROM tx GROUP BY ALL)) WHERE rn <= 12""")
o["descriptor_timeline"] = q("""
SELECT merchant_id, merchant_descriptor,
  strftime(first_seen, '%Y-%m-%d %H:%M:%S.%f') AS first_seen, txns, place,
  round(txns / total, 6) AS share
FROM (SELECT *, sum(txns) OVER (PARTITION BY merchant_id) AS total, row_number() OVER (
        PARTITION BY merchant_id ORDER BY first_seen, merchant_descriptor) AS place
      FROM (SELECT merchant_id, merchant_descriptor, min(transaction_datetime_utc) AS first_seen,
              count(*) AS txns FROM tx GROUP BY ALL)) WHERE place <= 8""")
_edges = [*ref.CASH_HISTOGRAM_EDGES, 1e300]
o["amount_histogram"] = q(
    " UNION ALL ".join(
        f"SELECT merchant_id, CAST({i} AS BIGINT) AS bucket, CAST({_edges[i]} AS DOUBLE) AS lower, "
        f"count(*) FILTER (WHERE abs(settlement_amount_usd) >= {_edges[i]} AND "
        f"abs(settlement_amount_usd) < {_edges[i + 1]}) AS n FROM tx GROUP BY merchant_id"
        for i in range(len(_edges) - 1)
    )
)
o["round_comb"] = q("""
SELECT merchant_id, CAST(v AS BIGINT) AS amount, count(*) AS n
FROM tx JOIN (SELECT DISTINCT round(abs(settlement_amount_usd) / 100) * 100 AS v FROM tx) g
  ON abs(abs(settlement_amount_usd) - v) < 0.01 WHERE v >= 100 GROUP BY ALL""")


def _dev() -> str:
    rows = []
    for family, specs in ref.FAMILY_DEVIATIONS.items():
        for f, e in specs:
            rows.append(
                f"SELECT merchant_id, family, '{f}' AS feature, coalesce({f}, 0) AS value, z_{f} AS z, "
                f"{e or 'NULL'} AS expected, CASE WHEN count(*) OVER g >= 5 THEN "
                f"quantile_cont({f}, 0.5) OVER g END AS med, flag_for_investigation AS hit "
                f"FROM devz WINDOW g AS (PARTITION BY mcc_group)"
            )
            rows[-1] = f"SELECT * FROM ({rows[-1]}) WHERE hit = 1 AND family = '{family}'"
    return " UNION ALL ".join(rows)


_shown = sorted({f for specs in ref.FAMILY_DEVIATIONS.values() for f, _ in specs})
EXTRA["devz"] = (
    "SELECT scores.*, "
    + ", ".join(_z(f) for f in _shown if f not in Z_FEATURES)
    + " FROM scores"
)
EXTRA["devs"] = _dev()
o["deviations"] = q("""
SELECT merchant_id, family, feature, round(value, 6) + 0.0 AS value, round(z, 6) + 0.0 AS z,
  round(b, 6) + 0.0 AS baseline,
  CASE WHEN expected IS NOT NULL THEN 'expected' WHEN med IS NOT NULL THEN 'peer median' END
    AS baseline_kind,
  round(CASE WHEN abs(b) > 1e-9 THEN value / b END, 6) + 0.0 AS multiple, abs(z) >= 1.5 AS hot
FROM (SELECT *, coalesce(expected, med) AS b FROM devs)""")
_root = f"sqrt({sum(abs(w) for w in ref.COMPOSITE_WEIGHTS.values())})"
EXTRA["contrib"] = " UNION ALL ".join(
    f"SELECT merchant_id, '{f}' AS feature, z_{f} AS z, CAST({w} AS DOUBLE) AS weight, "
    f"z_{f} * ({w} / {_root}) AS contribution FROM zflag"
    for f, w in ref.COMPOSITE_WEIGHTS.items()
)
o["composite_drivers"] = q("""
SELECT merchant_id, rn AS place, feature, round(z, 6) AS z, weight,
  round(contribution, 6) AS contribution,
  round(contribution / sum(contribution) OVER (PARTITION BY merchant_id) * 100, 6) AS share
FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY contribution DESC, feature DESC)
        AS rn FROM contrib WHERE contribution > 0) WHERE rn <= 6""")
o["composite_reconstruction"] = q(
    "SELECT merchant_id, round_even((("
    + " + ".join(f"z_{f} * ({w})" for f, w in ref.COMPOSITE_WEIGHTS.items())
    + f") / {_root}) * 1000, 0) / 1000 AS integrity_composite_z, round(("
    + " + ".join(f"z_{f} * ({w})" for f, w in ref.COMPOSITE_WEIGHTS.items())
    + f") / {_root}, 3) + 0.0 AS reconstructed_z FROM z"
)
o["rule_checks"] = q(
    " UNION ALL ".join(
        f"SELECT merchant_id, family, CASE flag_reason WHEN 'model + rule' THEN 'both' "
        f"WHEN 'rule' THEN 'rule' ELSE 'model' END AS routed_by, '{rule}' AS rule, "
        f"'{f}' AS feature, round(coalesce({f}, 0), 6) + 0.0 AS actual, '{op}' AS op, "
        f"CAST({thr} AS DOUBLE) AS threshold, coalesce({f}, 0) {op} {thr} AS pass "
        f"FROM flg WHERE family = '{family}'"
        for family, (rule, specs) in ref.FAMILY_RULE_CHECKS.items()
        for f, op, thr in specs
    )
)

# ---------------------------------------------------------------- detection
EXTRA["kinds"] = """
SELECT mcc_group, CASE WHEN count(*) FILTER (WHERE label = 'clean') >= 8 THEN 'clean'
  WHEN count(*) >= 8 THEN 'group' ELSE 'everyone' END AS kind FROM merchants GROUP BY mcc_group"""
EXTRA["sigs"] = " UNION ALL ".join(
    f"SELECT merchant_id, mcc_group, label, '{s}' AS signal, CAST({s} AS DOUBLE) AS value, "
    f"{ref.SIGNAL_THRESHOLDS[s] * ref.PEER_SIGMA_FLOOR} AS floor_sd FROM merchants"
    for s in SIGNALS
)
EXTRA["standing"] = """
SELECT a.merchant_id, a.signal, any_value(a.value) AS value, any_value(k.kind) AS peer_kind,
  count(*) AS peers, avg(p.value) AS peer_mean,
  greatest(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(p.value) END, any_value(a.floor_sd)) AS peer_sd,
  avg((p.value <= a.value)::INT) AS percentile
FROM sigs a JOIN kinds k USING (mcc_group) JOIN sigs p ON p.signal = a.signal
  AND (k.kind = 'everyone' OR p.mcc_group = a.mcc_group) AND (k.kind <> 'clean' OR p.label = 'clean')
GROUP BY a.merchant_id, a.signal"""
o["peer_standing"] = q("""
SELECT merchant_id, signal, round(value, 6) AS value, peer_kind, peers, round(peer_mean, 6) AS peer_mean,
  round(peer_sd, 6) AS peer_sd, round((value - peer_mean) / peer_sd, 6) + 0.0 AS z,
  round(peer_mean + 3 * peer_sd, 6) AS ceiling, round(percentile, 6) AS percentile FROM standing""")
o["peer_histogram"] = q("""
SELECT mcc_group, signal, CAST(least(47, greatest(0, floor(value / hi * 48))) AS BIGINT) AS bin,
  count(*) AS n
FROM (SELECT *, CASE WHEN max(value) OVER w * 1.06 > 0 THEN max(value) OVER w * 1.06 ELSE 1 END AS hi
      FROM sigs WINDOW w AS (PARTITION BY mcc_group, signal)) GROUP BY ALL""")

# ---------------------------------------------------------------- surcharge
_EU = _list(ref.SURCHARGE_BAN_EU)
EXTRA["asd"] = f"""
SELECT *, CASE WHEN NOT known THEN '' WHEN regime = 'ban' THEN 'Regional ban'
    WHEN surcharges_debit_prepaid THEN 'Prohibited debit/prepaid' WHEN over_cap THEN 'Over-cap'
    WHEN NOT surcharge_disclosed THEN 'Undisclosed' ELSE '' END AS violation
FROM (SELECT *, surcharge_disclosed IS NOT NULL AS known, surcharge_rate_bps / 100 AS surcharge_pct,
  CASE WHEN merchant_country IN ({_EU}, 'GB') THEN 'ban' WHEN merchant_country IN ('US', 'CA', 'IN')
    THEN 'capped' ELSE 'cost-of-acceptance' END AS regime,
  CASE WHEN merchant_country IN ({_EU}) THEN 'European Union' WHEN merchant_country = 'ZZ' THEN 'ZZ'
    ELSE {_case('merchant_country', ref.SURCHARGE_REGIONS)} END AS region,
  coalesce(surcharge_rate_bps / 100 > CASE merchant_country WHEN 'US' THEN 3.0 WHEN 'CA' THEN 2.4
    WHEN 'AU' THEN 1.5 WHEN 'IN' THEN 1.0 END, false) AS over_cap FROM sur)"""
EXTRA["asv"] = """
SELECT *, CASE WHEN NOT known THEN 'INSUFFICIENT DATA' WHEN violation IN ('Regional ban',
  'Prohibited debit/prepaid') THEN 'SEVERE VIOLATION' WHEN violation <> '' THEN 'POTENTIAL VIOLATION'
  ELSE 'COMPLIANT' END AS status, floor(round(gross_sales_usd * pct_txn_surcharged, 6) + 0.5) AS vol FROM asd"""
o["surcharge_assessment"] = q("""
SELECT merchant_id, region, regime, surcharge_pct, over_cap, violation, status,
  CASE WHEN NOT known THEN '' WHEN violation = 'Regional ban' THEN 'cease-surcharge notice|third-party audit transaction|brand-rules referral'
    WHEN violation = 'Prohibited debit/prepaid' THEN 'freeze debit and prepaid surcharges|debit test purchase|warning letter, 30 days to cure'
    WHEN violation = 'Over-cap' THEN 'fee-cap breach notice|request cost-of-acceptance evidence|monitor fee chargebacks'
    WHEN violation = 'Undisclosed' THEN 'require point-of-sale disclosure|test the checkout|warning letter, re-audit in 60 days'
    ELSE 'no action|keep in monitoring' END AS steps FROM asv""")
o["compliance_matrix"] = q("""
SELECT merchant_id, 'jurisdiction' AS "check", merchant_country AS detected,
  CASE WHEN regime = 'ban' THEN 'fail' ELSE 'info' END AS outcome FROM asv WHERE known UNION ALL
SELECT merchant_id, 'product type', CASE WHEN surcharges_debit_prepaid THEN 'debit/prepaid surcharged' ELSE 'debit/prepaid exempt' END,
  CASE WHEN surcharges_debit_prepaid THEN 'fail' ELSE 'pass' END FROM asv WHERE known UNION ALL
SELECT merchant_id, 'surcharge rate', printf('%.1f%%', surcharge_pct),
  CASE WHEN regime = 'ban' OR over_cap THEN 'fail' ELSE 'pass' END FROM asv WHERE known UNION ALL
SELECT merchant_id, 'disclosure', CASE WHEN surcharge_disclosed THEN 'disclosed' ELSE 'not disclosed' END,
  CASE WHEN surcharge_disclosed THEN 'pass' ELSE 'fail' END FROM asv WHERE known""")
EXTRA["vio"] = """
SELECT * FROM asv WHERE violation <> '' AND surcharge_rate_bps > 0 AND pct_txn_surcharged > 0"""
_SUM = (
    "count(*) AS merchants, count(*) FILTER (WHERE status = 'SEVERE VIOLATION') AS severe, "
    "coalesce(sum(vol), 0.0) AS violation_volume FROM vio"
)
o["surcharge_portfolio"] = q(
    f"SELECT 'acquirer' AS lens, CAST(acquirer_id AS VARCHAR) AS entry, {_SUM} GROUP BY acquirer_id "
    f"UNION ALL SELECT 'violation', violation, {_SUM} GROUP BY violation "
    f"UNION ALL SELECT 'region', region, {_SUM} GROUP BY region UNION ALL SELECT 'total', NULL, {_SUM}"
)
o["surcharge_totals"] = q("""
SELECT count(*) AS surcharging, count(*) FILTER (WHERE violation <> '') AS violating,
  count(*) FILTER (WHERE status = 'SEVERE VIOLATION') AS severe,
  count(*) FILTER (WHERE status = 'POTENTIAL VIOLATION') AS potential,
  coalesce(sum(vol) FILTER (WHERE violation <> ''), 0.0) AS violation_volume,
  count(*) FILTER (WHERE violation <> '') * 5000.0::DOUBLE AS assessment_low,
  count(*) FILTER (WHERE violation <> '') * 10000.0::DOUBLE AS assessment_high
FROM asv WHERE surcharge_rate_bps > 0 AND pct_txn_surcharged > 0""")
EXTRA["det"] = """
SELECT 'composite' AS detector, coalesce(flag_for_investigation = 1, false) AS p,
  coalesce(is_integrity_violation, false) OR coalesce(is_interchange_abuse, false) AS a, gross_sales_usd AS e FROM labs UNION ALL
SELECT 'surcharge', true, status = 'SEVERE VIOLATION', gross_sales_usd FROM vio"""
EXTRA["drow"] = """
SELECT detector, count(*) FILTER (p) AS alerts, coalesce(count(*) FILTER (p AND a) / nullif(count(*) FILTER (p), 0), 0) AS precision,
  coalesce(sum(e) FILTER (p AND a), 0) AS captured_exposure FROM det GROUP BY detector"""
o["detector_metrics"] = q("""
SELECT detector, alerts, round(precision, 6) AS precision, round(captured_exposure, 6) AS captured_exposure FROM drow""")
o["detector_rollup"] = q("""
SELECT round(avg(precision), 6) AS mean_precision, CAST(sum(alerts) AS BIGINT) AS alert_volume,
  round(sum(captured_exposure), 6) AS captured_exposure FROM drow""")
o["surcharge_signals"] = q("""
SELECT merchant_id, 'surcharge' AS family, top_category, CAST(CASE top_category
  WHEN 'surcharge_over_cap' THEN coalesce(rate >= 300, false)::INT + coalesce(share >= 0.5, false)::INT
    + coalesce(chargeback_rate_bps >= 50, false)::INT
  WHEN 'surcharge_prohibited' THEN coalesce(share >= 0.5, false)::INT + coalesce(chargeback_rate_bps >= 50, false)::INT
    + coalesce(refund_rate_amount >= 0.08, false)::INT
  ELSE coalesce(rate >= 300, false)::INT + coalesce(chargeback_rate_bps >= 50, false)::INT
    + coalesce(refund_rate_amount >= 0.08, false)::INT END AS BIGINT) AS elevated_signals
FROM (SELECT scores.*, vio.surcharge_rate_bps AS rate, vio.pct_txn_surcharged AS share, CASE violation
        WHEN 'Over-cap' THEN 'surcharge_over_cap' WHEN 'Undisclosed' THEN 'surcharge_undisclosed' ELSE 'surcharge_prohibited' END
        AS top_category FROM (SELECT * EXCLUDE (top_category) FROM scores) scores JOIN vio USING (merchant_id))""")
o["cohort"] = q("""
SELECT merchant_id, merchant_name, family, top_category, risk_tier, round(integrity_risk_score, 6) AS integrity_risk_score,
  round(gross_sales_usd, 6) AS gross_sales_usd, CAST(flag_for_investigation AS BIGINT) AS flag_for_investigation
FROM scores WHERE family = 'cash' AND top_category = 'crypto_cash'""")

"""SQL for the expressible part of the model queries."""

from __future__ import annotations

from merchantscope import reference as ref
from merchantscope.plans.ml_queries import GIVEN_INTERCEPT, GIVEN_WEIGHTS
from starbook.fixtures import RECORD_SQL
from oracle.live import V
from oracle.views import with_views

_F = ref.INTEGRITY_FEATURES
X = {
    **V,
    "cl": "SELECT s.*, NOT (is_integrity_violation OR is_interchange_abuse) AS is_clean "
          "FROM scores s JOIN lab USING (merchant_id)",
    "cg": "SELECT mcc_group, count(*) FILTER (WHERE is_clean) AS n, "
          + ", ".join(
              f"avg(coalesce({f}, 0)) FILTER (WHERE is_clean) AS m_{f}, "
              f"stddev_pop(coalesce({f}, 0)) FILTER (WHERE is_clean) AS s_{f}" for f in _F
          )
          + " FROM cl GROUP BY mcc_group",
    "ca": "SELECT "
          + ", ".join(
              f"avg(coalesce({f}, 0)) FILTER (WHERE is_clean) AS gm_{f}, "
              f"stddev_pop(coalesce({f}, 0)) FILTER (WHERE is_clean) AS gs_{f}, "
              f"avg(coalesce({f}, 0)) FILTER (WHERE NOT is_clean) AS a_{f}" for f in _F
          )
          + " FROM cl",
}


def _raw_z(f: str) -> str:
    sd = f"CASE WHEN n >= 8 THEN s_{f} ELSE gs_{f} END"
    return (
        f"greatest(-4, least(8, CASE WHEN a_{f} < gm_{f} THEN -1 ELSE 1 END * (coalesce({f}, 0) - "
        f"CASE WHEN n >= 8 THEN m_{f} ELSE gm_{f} END) / CASE WHEN {sd} > 1e-9 THEN {sd} ELSE 1 END))"
    )


def _z(f: str) -> str:
    return f"round({_raw_z(f)}, 6) + 0.0 AS z_{f}"


_SEED = 20260724
X["zz"] = (
    "SELECT cl.*, " + ", ".join(f"{_raw_z(f)} AS y_{f}" for f in _F) + " FROM cl JOIN cg USING (mcc_group) CROSS JOIN ca"
)
X["scored"] = (
    "SELECT *, family IN (" + ", ".join(f"'{f}'" for f in ref.MODEL_ROUTED_FAMILIES) + ") AS routed, 1 / (1 + exp(-("
    + f"{GIVEN_INTERCEPT} + " + " + ".join(f"y_{f} * {w}" for f, w in zip(_F, GIVEN_WEIGHTS)) + "))) AS p FROM zz"
)
X["blend"] = "SELECT *, CASE WHEN routed THEN round_even(100 * p, 1) ELSE integrity_risk_score END AS ms FROM scored"
X["push"] = " UNION ALL ".join(
    f"SELECT merchant_id, '{f}' AS feature, y_{f} AS z, {w}::DOUBLE AS coef, y_{f} * {w} AS contribution FROM scored WHERE routed"
    for f, w in zip(_F, GIVEN_WEIGHTS)
)
X["rec"] = RECORD_SQL
X["held"] = """SELECT coalesce(score, 0) AS s, actual::INT AS a FROM rec WHERE record_id % 3 <> 0"""


ORACLE = {
    "offline_features": with_views(
        """
SELECT merchant_id, count(*) AS txn_count, round(avg(amount), 6) AS avg_ticket,
  round(coalesce(stddev_samp(amount), 0), 6) AS std_ticket,
  round(avg(cash_equivalent::INT), 6) AS cash_share, round(avg((NOT ecommerce)::INT), 6) AS card_present_share,
  round(avg(refund::INT), 6) AS refund_rate,
  round(avg((amount >= 450 AND amount < 500)::INT), 6) AS threshold_proximity FROM ltx GROUP BY merchant_id""",
        X,
    ),
    "clean_baseline_z": with_views(
        "SELECT merchant_id, " + ", ".join(_z(f) for f in _F) + " FROM cl JOIN cg USING (mcc_group) CROSS JOIN ca",
        X,
    ),
    "percentile_rank": with_views(
        """
SELECT merchant_id, round(pct, 6) AS pct, row_number() OVER (ORDER BY pct, merchant_id) - 1 AS position,
  count(*) OVER () AS position_total
FROM (SELECT merchant_id, (rank() OVER (ORDER BY gross_sales_usd)
        + (count(*) OVER (PARTITION BY gross_sales_usd) - 1) / 2) / count(*) OVER () AS pct FROM features)""",
        X,
    ),
    "integrity_rescored": with_views(
        """
SELECT merchant_id, round(ms, 6) AS model_score,
  round(coalesce(round_even((row_number() OVER (ORDER BY ms, merchant_id) - 1) * 100.0 / nullif(count(*) OVER () - 1, 0), 1), 0), 6)
    AS model_percentile,
  CASE WHEN ms >= 90 THEN 'Critical' WHEN ms >= 80 THEN 'High' WHEN ms >= 65 THEN 'Elevated' WHEN ms >= 45 THEN 'Monitor'
    ELSE 'Low' END AS model_tier,
  round(round_even(ms * log10(greatest(gross_sales_usd, 10)), 1), 6) AS model_exposure_score,
  CAST(ms >= 65 AS BIGINT) AS model_flag FROM blend""",
        X,
    ),
    "integrity_drivers": with_views(
        """
SELECT merchant_id, feature, round(z, 4) AS z, round(coef, 4) AS coef, round(contribution, 4) AS contribution,
  round(contribution / upward, 4) AS share
FROM (SELECT *, sum(greatest(contribution, 0)) OVER (PARTITION BY merchant_id) AS upward,
        row_number() OVER (PARTITION BY merchant_id ORDER BY contribution DESC, feature DESC) AS rn FROM push)
WHERE rn <= 6 AND contribution > 0.02""",
        X,
    ),
    "integrity_optimality": "SELECT term, 0.0::DOUBLE AS gradient FROM (VALUES ('intercept'), "
    + ", ".join(f"('{f}')" for f in _F) + ") v(term)",
    "stratified_split": with_views(
        f"""
SELECT merchant_id, behavior_mcc, place <= CASE WHEN n > 1 THEN greatest(1, least(n - 1, floor(n * 0.75 + 0.5))) ELSE n END AS is_train
FROM (SELECT *, count(*) OVER (PARTITION BY behavior_mcc) AS n, row_number() OVER (
        PARTITION BY behavior_mcc ORDER BY md5('{_SEED}:' || merchant_id), merchant_id) AS place
      FROM (SELECT DISTINCT merchant_id, '700' || (merchant_id % 8) AS behavior_mcc FROM ltx JOIN lab USING (merchant_id)))""",
        X,
    ),
    "head_metrics": with_views(
        """
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / greatest(1e-9, tp / (tp + fp) + tp / (tp + fn)), 6) AS f1, tp + fn AS support,
  round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc
FROM (SELECT count(*) FILTER (s >= 62 AND a = 1) AS tp, count(*) FILTER (s >= 62 AND a = 0) AS fp,
        count(*) FILTER (s < 62 AND a = 1) AS fn FROM held),
  (SELECT avg(CASE WHEN x.s > y.s THEN 1.0 WHEN x.s = y.s THEN 0.5 ELSE 0 END) AS roc_auc FROM held x, held y WHERE x.a = 1 AND y.a = 0),
  (SELECT sum(a * found / alerts) / max(pos) AS pr_auc FROM (SELECT a, sum(a) OVER (ORDER BY s DESC) AS found,
     count(*) OVER (ORDER BY s DESC) AS alerts, sum(a) OVER () AS pos FROM held))""",
        X,
    ),
}

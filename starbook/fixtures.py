"""Adapter: the driver's star schema seen as settlement data.

Suppliers stand for merchants, nations for DBAs, regions for corporations and peer
groups, customers for cards, line items for transactions. Columns the star schema
lacks (entry mode, response code, clock time, ...) are derived row by row from
columns it has. ``SETTLEMENT_SQL`` and friends are plain SQL so that another engine
can build the same views; ``{ts_plus}`` is the one dialect-specific expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "labels")

SPARK_TS_PLUS = "timestampadd(SECOND, {seconds}, {start})"
DUCKDB_TS_PLUS = "({start} + to_seconds({seconds}))"

# Suppliers take one of eight roles (key modulo 8), so that every family occurs:
# 1 cash, 2 descriptor churn, 3 split tickets, 4 cheap interchange, 5 factoring,
# 6 miscoding; 0 and 7 stay ordinary.
_START = "CASE WHEN l.l_suppkey % 8 = 3 THEN date_trunc('month', o.o_orderdate) ELSE o.o_orderdate END"
_HOUR = (
    "CASE WHEN l.l_suppkey % 8 = 3 THEN 12 WHEN l.l_suppkey % 8 = 6 "
    "THEN (o.o_orderkey * 5 + l.l_suppkey) % 8 ELSE 8 + (o.o_orderkey * 5 + l.l_suppkey) % 15 END"
)
_SECONDS = f"CAST(({_HOUR}) * 3600 + l.l_linenumber * 600 + (l.l_partkey % 10) * 7 AS INT)"

SETTLEMENT_SQL = """
SELECT merchant_id, transaction_datetime_utc, transaction_date, local_hour,
       CASE WHEN refund_flag = 'Y' THEN -amt ELSE amt END AS settlement_amount_usd,
       CASE WHEN fraud_flag = 'Y' THEN amt ELSE CAST(0 AS DOUBLE) END AS fraud_amount_usd,
       CASE WHEN chargeback_flag = 'Y' THEN amt ELSE CAST(0 AS DOUBLE) END AS chargeback_amount_usd,
       amt * fee_rate AS interchange_fee_usd, card_token_id, issuer_bin, issuer_country,
       acquirer_bin, acquirer_country, card_acceptor_id, merchant_descriptor, sub_merchant_id,
       split_group_id, channel, domestic_xborder_flag, pos_entry_mode, transaction_type_code,
       auth_response_code, chargeback_reason_code, approved_flag, card_present_flag, token_flag,
       refund_flag, reversal_flag, chargeback_flag, fraud_flag, three_ds_flag,
       merchant_acquirer_country_mismatch
FROM (
  SELECT l.l_suppkey AS merchant_id,
         {ts_plus} AS transaction_datetime_utc,
         CAST(o.o_orderdate AS DATE) AS transaction_date,
         CAST({hour} AS INT) AS local_hour,
         CASE WHEN l.l_suppkey % 8 = 3
              THEN CAST(470 AS DOUBLE) + CAST(floor(l.l_extendedprice) AS DOUBLE) % CAST(25 AS DOUBLE)
              WHEN l.l_suppkey % 8 = 1 AND l.l_linenumber <= 5
              THEN CAST(floor(l.l_extendedprice / 20000) AS DOUBLE) * CAST(100 AS DOUBLE)
                   + CAST(400 AS DOUBLE)
              WHEN l.l_suppkey % 8 = 6 AND l.l_linenumber <= 4
              THEN CAST(floor(l.l_extendedprice / 1000) AS DOUBLE) * CAST(10 AS DOUBLE)
              WHEN l.l_suppkey % 8 = 5 AND CAST(o.o_orderdate AS DATE) >= DATE '1999-06-01'
                   AND CAST(o.o_orderdate AS DATE) < DATE '1999-07-01'
              THEN CAST(floor(l.l_extendedprice) AS DOUBLE) / CAST(10 AS DOUBLE)
              WHEN l.l_linenumber = 2
              THEN CAST(floor(l.l_extendedprice / 10000) AS DOUBLE) * CAST(100 AS DOUBLE)
              ELSE CAST(floor(l.l_extendedprice + 0.5) AS DOUBLE) / CAST(100 AS DOUBLE)
              END AS amt,
         CASE WHEN l.l_suppkey % 8 = 4 THEN l.l_tax / CAST(10 AS DOUBLE)
              ELSE CAST(0.019 AS DOUBLE) + l.l_tax / CAST(20 AS DOUBLE) END AS fee_rate,
         CASE WHEN l.l_suppkey % 8 = 3 THEN o.o_custkey % 5 ELSE o.o_custkey END AS card_token_id,
         o.o_custkey % 50 AS issuer_bin,
         cn.n_name AS issuer_country,
         p.p_brand AS acquirer_bin,
         CASE WHEN l.l_suppkey % 8 >= 5 AND p.p_size % 7 = 0 THEN 'MT'
              WHEN l.l_suppkey % 8 >= 5 AND p.p_size % 7 = 1 THEN 'PA' ELSE 'US'
              END AS acquirer_country,
         l.l_suppkey * 10 + l.l_linenumber % 3 AS card_acceptor_id,
         CASE WHEN l.l_suppkey % 8 = 2 OR (l.l_suppkey % 8 = 5 AND p.p_size <= 20)
              THEN CASE WHEN p.p_size % 13 = 0 THEN concat('WWW.', upper(p.p_brand))
                        ELSE upper(p.p_name) END
              WHEN p.p_size % 11 = 0 THEN concat('SUPPLIER ', upper(p.p_type), ' ONLINE')
              ELSE concat('SUPPLIER ', CAST(l.l_suppkey AS STRING)) END AS merchant_descriptor,
         CASE WHEN l.l_suppkey % 8 = 5 AND p.p_size <= 20 THEN p.p_type END AS sub_merchant_id,
         CASE WHEN l.l_suppkey % 8 = 3 AND l.l_quantity >= 20
              THEN concat(CAST(l.l_suppkey AS STRING), '-', CAST(o.o_custkey % 40 AS STRING))
              END AS split_group_id,
         CASE WHEN l.l_suppkey % 8 = 4 AND p.p_size <= 30 THEN 'RECURRING'
              ELSE CASE o.o_orderpriority WHEN '1-URGENT' THEN 'ECOMMERCE' WHEN '2-HIGH'
                   THEN 'RECURRING' WHEN '3-MEDIUM' THEN 'MOTO' ELSE 'POS' END END AS channel,
         CASE WHEN l.l_suppkey % 8 <> 6 AND c.c_nationkey % 4 <> l.l_suppkey % 4 THEN 'DOMESTIC'
              ELSE 'CROSS_BORDER' END AS domestic_xborder_flag,
         CASE l.l_partkey % 5 WHEN 0 THEN '01' WHEN 1 THEN '05' WHEN 2 THEN '07' WHEN 3 THEN '91'
                              ELSE '81' END AS pos_entry_mode,
         CASE WHEN l.l_suppkey % 8 = 1 AND p.p_size <= 30 THEN '11'
              WHEN p.p_size = 3 THEN '01' ELSE '00' END AS transaction_type_code,
         CASE WHEN o.o_orderstatus <> 'P' THEN '00' WHEN l.l_suppkey % 8 <> 6 THEN '51'
              ELSE CASE l.l_linenumber WHEN 1 THEN '05' WHEN 2 THEN '57' WHEN 3 THEN '59'
                                       WHEN 4 THEN '61' ELSE '62' END END AS auth_response_code,
         CASE WHEN l.l_returnflag = 'A' AND l.l_linenumber = 1 AND l.l_suppkey % 8 IN (2, 4, 6)
              THEN CASE WHEN l.l_linestatus = 'F' THEN '10.4' ELSE '13.1' END
              END AS chargeback_reason_code,
         CASE WHEN o.o_orderstatus = 'P' THEN 'N' ELSE 'Y' END AS approved_flag,
         CASE WHEN l.l_suppkey % 8 IN (4, 6)
              THEN CASE WHEN o.o_orderpriority = '5-LOW' AND p.p_size > 30 THEN 'Y' ELSE 'N' END
              WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'N' ELSE 'Y'
              END AS card_present_flag,
         CASE WHEN l.l_discount > 0.05 THEN 'Y' ELSE 'N' END AS token_flag,
         CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' AND l.l_linenumber <> 4
              THEN 'Y' ELSE 'N' END AS refund_flag,
         CASE WHEN l.l_returnflag = 'N' AND l.l_linenumber = 7 THEN 'Y' ELSE 'N'
              END AS reversal_flag,
         CASE WHEN l.l_returnflag = 'A' AND l.l_linenumber = 1 AND l.l_suppkey % 8 IN (2, 4, 6)
              THEN 'Y' ELSE 'N' END AS chargeback_flag,
         CASE WHEN l.l_returnflag = 'A' AND l.l_linenumber = 2 THEN 'Y' ELSE 'N' END AS fraud_flag,
         CASE WHEN l.l_discount < 0.02 THEN 'Y' ELSE 'N' END AS three_ds_flag,
         CASE WHEN l.l_suppkey % 8 >= 5 AND p.p_size % 7 <= 1 THEN 'Y' ELSE 'N'
              END AS merchant_acquirer_country_mismatch
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
) AS derived
"""

MERCHANT_SQL = """
SELECT s.s_suppkey AS merchant_id, s.s_name AS merchant_name, s.s_nationkey AS dba_id,
       n.n_name AS dba_name, n.n_regionkey AS corp_id, r.r_name AS corp_name,
       n.n_name AS merchant_country, concat(n.n_name, ' CITY') AS merchant_city,
       CASE WHEN s.s_suppkey % 10 = 0 THEN '6051'
            ELSE CAST(5000 + s.s_nationkey AS STRING) END AS declared_mcc
FROM supplier s
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""

#: Category reference derived from nations (one code each) plus one cash code.
MCC_SQL = """
SELECT CAST(5000 + n.n_nationkey AS STRING) AS mcc, n.n_name AS mcc_description,
       r.r_name AS mcc_group, CAST(200 + 10 * n.n_nationkey AS DOUBLE) AS expected_avg_ticket,
       CAST(30 + n.n_nationkey AS DOUBLE) / CAST(100 AS DOUBLE) AS expected_cnp_share,
       CAST(10 + n.n_nationkey AS DOUBLE) / CAST(100 AS DOUBLE) AS expected_night_share, 'low' AS risk_class
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
UNION ALL
SELECT '6051', 'QUASI CASH', max(r_name), CAST(300 AS DOUBLE), CAST(0.8 AS DOUBLE), CAST(0.3 AS DOUBLE), 'high' FROM region
"""

BANDS_SQL = """
SELECT r_name AS mcc_group, CAST(120 + 20 * r_regionkey AS DOUBLE) AS band_bps FROM region
"""

LABEL_SQL = """
SELECT s_suppkey AS merchant_id, s_acctbal < 1000 AS is_integrity_violation,
       s_acctbal > 9000 AS is_interchange_abuse,
       CASE s_suppkey % 5 WHEN 0 THEN 'mcc_abuse' WHEN 1 THEN 'factoring' WHEN 2 THEN 'cash'
                          WHEN 3 THEN 'split_ticketing' END AS true_family,
       s_suppkey % 7 = 0 AS descriptor_churn, s_suppkey % 3 = 0 AS is_content_miscoded,
       CASE s_suppkey % 4 WHEN 0 THEN 'gambling' WHEN 1 THEN 'pharma' WHEN 2 THEN 'crypto_cash'
                          END AS integrity_category,
       CASE s_suppkey % 4 WHEN 0 THEN 'P1' WHEN 1 THEN 'P1' WHEN 2 THEN 'P2' END AS integrity_tier
FROM supplier
"""

#: Labelled documents as scored records: two classes, a 0..100 score and a weight.
RECORD_SQL = """
SELECT d.doc_id AS record_id, d.lang AS grp, d.source AS predicted_class,
       CASE WHEN l.toxic = 1 THEN d.source ELSE d.lang END AS actual_class,
       CAST(d.n_chars % 1001 AS DOUBLE) / CAST(10 AS DOUBLE) AS score,
       CAST(d.n_chars AS DOUBLE) AS exposure, l.quality = 1 AS actual
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

#: Surcharge inputs per merchant; every eleventh merchant lacks the disclosure.
SURCHARGE_SQL = """
SELECT s.s_suppkey AS merchant_id, s.s_nationkey AS acquirer_id,
       CASE s.s_nationkey % 9 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'AU' WHEN 3 THEN 'IN'
            WHEN 4 THEN 'GB' WHEN 5 THEN 'DE' WHEN 6 THEN 'PA' WHEN 7 THEN 'ZZ' ELSE 'FR' END
            AS merchant_country,
       CAST(s.s_suppkey % 5 AS DOUBLE) * CAST(100 AS DOUBLE) AS surcharge_rate_bps,
       CAST(s.s_suppkey % 4 AS DOUBLE) / CAST(4 AS DOUBLE) AS pct_txn_surcharged,
       CASE WHEN s.s_suppkey % 11 <> 10 THEN s.s_suppkey % 3 <> 0 END AS surcharge_disclosed,
       s.s_suppkey % 6 = 1 AS surcharges_debit_prepaid,
       abs(s.s_acctbal) * CAST(100 AS DOUBLE) AS gross_sales_usd
FROM supplier s
"""

#: The live engine's transaction, seen on the settlement view.
LIVE_TX_SQL = """
SELECT merchant_id, card_token_id AS card_id, transaction_datetime_utc AS event_ts,
       settlement_amount_usd AS amount, merchant_descriptor,
       CASE WHEN approved_flag = 'Y' THEN 'approved' ELSE 'declined' END AS authorization_status,
       CASE pos_entry_mode WHEN '01' THEN 'manual' WHEN '05' THEN 'chip' WHEN '07' THEN 'contactless'
                           WHEN '91' THEN 'fallback' ELSE 'swipe' END AS entry_mode,
       card_present_flag = 'N' AS ecommerce, domestic_xborder_flag = 'CROSS_BORDER' AS cross_border,
       refund_flag = 'Y' AS refund, reversal_flag = 'Y' AS reversal,
       chargeback_flag = 'Y' OR fraud_flag = 'Y' AS dispute,
       CASE WHEN chargeback_reason_code LIKE '10.%' THEN 'merchant not recognized'
            WHEN chargeback_flag = 'Y' THEN 'other' END AS dispute_reason,
       transaction_type_code IN ('01', '11') AS cash_equivalent,
       transaction_type_code = '11' AND token_flag = 'Y' AS wallet_load,
       CASE WHEN sub_merchant_id IS NULL THEN lower(merchant_descriptor) ELSE lower(sub_merchant_id)
            END AS product_signal,
       CAST(issuer_bin AS DOUBLE) AS latitude, CAST(card_token_id % 180 AS DOUBLE) AS longitude
FROM tx
"""

#: ``{arr}`` is the dialect's array constructor.
LIVE_MERCHANT_SQL = """
SELECT s.s_suppkey AS merchant_id, s.s_name AS trade_name, s.s_name AS legal_name,
       CASE s.s_suppkey % 5 WHEN 0 THEN concat('SUPPLIER ', CAST(s.s_suppkey AS STRING))
            WHEN 1 THEN 'AMAZON STORE' WHEN 2 THEN 'GLOBAL TRADING LLC' WHEN 3 THEN s.s_name
            ELSE 'UBER EATS GROUP' END AS descriptor,
       CASE s.s_suppkey % 6 WHEN 0 THEN '5411' WHEN 1 THEN '5812' WHEN 2 THEN '5999' WHEN 3 THEN '6051'
            WHEN 4 THEN '5001' ELSE '9999' END AS declared_mcc,
       CASE WHEN s.s_suppkey % 20 = 4 THEN 'facilitator' ELSE 'direct' END AS merchant_type,
       CASE WHEN s.s_suppkey % 4 = 0 THEN concat('PF', CAST(s.s_suppkey % 12 AS STRING)) END
            AS payment_facilitator_id,
       concat('A', CAST(s.s_nationkey % 6 AS STRING)) AS acquirer_id, n.n_name AS state,
       concat('site', CAST(s.s_suppkey % 70 AS STRING), '.example') AS website_domain,
       concat('ADDR', CAST(s.s_nationkey AS STRING)) AS registered_address_id,
       concat('B', CAST(s.s_suppkey % 40 AS STRING)) AS settlement_bank_account_id,
       concat('O', CAST(s.s_suppkey % 60 AS STRING)) AS beneficial_owner_id,
       {arr}('RED WIDGET', upper(n.n_name)) AS alternate_descriptors,
       {arr}(concat('D', CAST(s.s_suppkey % 13 AS STRING)), concat('D', CAST(100 + s.s_suppkey % 29 AS STRING)))
            AS device_ids,
       {arr}(concat('IP', CAST(s.s_suppkey % 17 AS STRING))) AS ip_cluster_ids
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
"""

#: Category profiles derived from nations: five known codes and synthetic ones.
PROFILE_SQL = """
SELECT CASE n_nationkey WHEN 0 THEN '5411' WHEN 1 THEN '5812' WHEN 2 THEN '5999' WHEN 3 THEN '6051'
            WHEN 4 THEN '7995' ELSE CAST(5000 + n_nationkey AS STRING) END AS mcc,
       n_name AS category, concat('PARENT', CAST(n_regionkey AS STRING)) AS parent_category,
       CASE n_nationkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high'
            ELSE 'prohibited-adjacent' END AS risk_tier,
       CAST(n_nationkey % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS typical_card_present_ratio,
       CAST(n_nationkey % 7 AS DOUBLE) / CAST(10 AS DOUBLE) AS typical_night_ratio,
       CAST(5 + n_nationkey AS DOUBLE) AS ticket_lo, CAST(100 + 50 * n_nationkey AS DOUBLE) AS ticket_hi,
       CAST(n_nationkey % 5 AS DOUBLE) / CAST(100 AS DOUBLE) AS typical_dispute_rate,
       CASE n_nationkey % 3 WHEN 0 THEN {arr}('gear', 'ring') WHEN 1 THEN {arr}('widget', 'bolt')
            ELSE {arr}('promo', 'online', 'wheel') END AS expected_keywords
FROM nation
"""

KNOWN_BAD_SQL = """
SELECT concat('B', CAST(r_regionkey * 7 AS STRING)) AS entity_id, 'bank' AS kind FROM region
UNION ALL SELECT concat('IP', CAST(r_regionkey + 1 AS STRING)), 'ip' FROM region
UNION ALL SELECT concat('O', CAST(r_regionkey * 9 AS STRING)), 'owner' FROM region
UNION ALL SELECT concat('D', CAST(r_regionkey AS STRING)), 'device' FROM region
"""

#: Labels of the live engine, for evaluation only.
LIVE_LABEL_SQL = """
SELECT s_suppkey AS merchant_id, s_acctbal < 2000 AS abuse,
       CASE WHEN s_acctbal < 1000 THEN 'MCC_MISCODING' WHEN s_acctbal < 2000 THEN 'FACTORING'
            ELSE 'CLEAN' END AS true_typology
FROM supplier
"""

EVENT_SQL = """
SELECT event_id, user_id AS merchant_id, user_id AS card_token_id, ts AS transaction_datetime_utc,
       CAST(ts AS DATE) AS transaction_date, CAST(hour(ts) AS INT) AS local_hour,
       value AS settlement_amount_usd, event_type AS merchant_descriptor
FROM events
"""


def settlement_sql(ts_plus: str) -> str:
    return SETTLEMENT_SQL.format(
        ts_plus=ts_plus.format(seconds=_SECONDS, start=_START), hour=_HOUR
    )


class StarFixture:
    """Lazy views over one driver folder; nothing is read before an action."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _sql(self, query: str, *tables: str) -> DataFrame:
        frames = {t: self.table(t) for t in tables}
        return self.spark.sql(_named(query, tables), **frames)

    def settlement(self) -> DataFrame:
        return self._sql(
            settlement_sql(SPARK_TS_PLUS), "lineitem", "orders", "customer", "nation", "part"
        )

    def merchants(self) -> DataFrame:
        return self._sql(MERCHANT_SQL, "supplier", "nation", "region")

    def mcc_reference(self) -> DataFrame:
        return self._sql(MCC_SQL, "nation", "region")

    def bands(self) -> DataFrame:
        return self._sql(BANDS_SQL, "region")

    def labels(self) -> DataFrame:
        return self._sql(LABEL_SQL, "supplier")

    def records(self) -> DataFrame:
        return self._sql(RECORD_SQL, "documents", "labels")

    def surcharging(self) -> DataFrame:
        return self._sql(SURCHARGE_SQL, "supplier")

    def live_merchants(self) -> DataFrame:
        return self._sql(LIVE_MERCHANT_SQL.format(arr="array"), "supplier", "nation")

    def profiles(self) -> DataFrame:
        return self._sql(PROFILE_SQL.format(arr="array"), "nation")

    def known_bad(self) -> DataFrame:
        return self._sql(KNOWN_BAD_SQL, "region")

    def live_transactions(self, tx: DataFrame) -> DataFrame:
        """The settlement rows in the form of the live engine."""
        return self.spark.sql(LIVE_TX_SQL.replace("FROM tx", "FROM {tx}"), tx=tx)

    def live_labels(self) -> DataFrame:
        return self._sql(LIVE_LABEL_SQL, "supplier")

    def events(self) -> DataFrame:
        return self._sql(EVENT_SQL, "events")


def _named(query: str, tables: tuple[str, ...]) -> str:
    """Turn ``FROM t`` / ``JOIN t`` into DataFrame parameters of ``spark.sql``."""
    for t in tables:
        query = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", query)
    return query

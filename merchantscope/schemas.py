"""Explicit schemas. Every code column is a string: "01" must never become 1."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(kind: T.DataType, names: str) -> list[T.StructField]:
    return [T.StructField(n, kind, True) for n in names.split()]


#: One cleared transaction, the columns the batch features and slices read.
SETTLEMENT = T.StructType(
    _fields(T.StringType(), "transaction_id merchant_id")
    + _fields(T.TimestampNTZType(), "transaction_datetime_utc")
    + _fields(T.DateType(), "transaction_date")
    + _fields(T.IntegerType(), "local_hour")
    + _fields(
        T.DoubleType(),
        "settlement_amount_usd fraud_amount_usd chargeback_amount_usd "
        "interchange_fee_usd cashback_amount",
    )
    + _fields(
        T.StringType(),
        "card_token_id issuer_bin issuer_country acquirer_bin acquirer_country "
        "card_acceptor_id merchant_descriptor sub_merchant_id split_group_id "
        "channel domestic_xborder_flag wallet_provider pos_entry_mode "
        "transaction_type_code auth_response_code chargeback_reason_code "
        "approved_flag card_present_flag token_flag refund_flag reversal_flag "
        "chargeback_flag fraud_flag three_ds_flag recurring_flag moto_flag "
        "merchant_acquirer_country_mismatch",
    )
)

MERCHANT_DIM = T.StructType(
    _fields(
        T.StringType(),
        "merchant_id merchant_name dba_id corp_id declared_mcc merchant_country "
        "merchant_city",
    )
)
DBA_DIM = T.StructType(_fields(T.StringType(), "dba_id dba_name"))
CORP_DIM = T.StructType(_fields(T.StringType(), "corp_id corp_name corp_country"))
ACCEPTANCE_DIM = T.StructType(
    _fields(T.StringType(), "merchant_id acquirer_bin card_acceptor_id")
)
LABELS = T.StructType(
    _fields(T.StringType(), "merchant_id archetype integrity_category")
    + _fields(T.BooleanType(), "is_integrity_violation is_interchange_abuse")
)

#: Reference row of one merchant category code.
MCC_REFERENCE = T.StructType(
    _fields(T.StringType(), "mcc mcc_description mcc_group")
    + _fields(
        T.DoubleType(),
        "expected_avg_ticket expected_cnp_share expected_night_share",
    )
    + _fields(T.StringType(), "risk_class")
)
INTERCHANGE_BANDS = T.StructType(
    _fields(T.StringType(), "mcc_group") + _fields(T.DoubleType(), "band_bps")
)

#: One transaction of the live engine.
LIVE_TRANSACTION = T.StructType(
    _fields(
        T.StringType(),
        "transaction_id merchant_id card_id customer_id currency declared_mcc "
        "merchant_descriptor authorization_status entry_mode card_country "
        "merchant_country device_id ip_address terminal_id authorization_code "
        "original_transaction_id dispute_reason product_signal "
        "transaction_cluster_id",
    )
    + _fields(T.TimestampNTZType(), "event_ts")
    + _fields(T.DoubleType(), "amount latitude longitude")
    + _fields(
        T.BooleanType(),
        "card_present ecommerce recurring cross_border refund reversal dispute "
        "cash_equivalent wallet_load",
    )
)

#: One merchant of the live engine.
LIVE_MERCHANT = T.StructType(
    _fields(
        T.StringType(),
        "merchant_id legal_name trade_name descriptor declared_mcc "
        "business_category merchant_type payment_facilitator_id acquirer_id "
        "parent_merchant_id country state city website_domain "
        "registered_address_id settlement_bank_account_id beneficial_owner_id",
    )
    + _fields(
        T.ArrayType(T.StringType()),
        "alternate_descriptors device_ids ip_cluster_ids",
    )
)
KNOWN_BAD = T.StructType(_fields(T.StringType(), "entity_id kind"))

#: Behavioural profile of one category for the nearest-profile classifier.
MCC_PROFILE = T.StructType(
    _fields(T.StringType(), "mcc category parent_category risk_tier")
    + _fields(
        T.DoubleType(),
        "typical_card_present_ratio typical_night_ratio ticket_lo ticket_hi "
        "typical_dispute_rate",
    )
    + [T.StructField("expected_keywords", T.ArrayType(T.StringType()), True)]
)

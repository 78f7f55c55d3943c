"""Batch merchant features from the settlement fact.

The fact is read in five column-pruned passes, each ending in a map-side combined
aggregation, so that one merchant holding a third of all rows still spreads over
all tasks:

* ``base_features``        one row per merchant: sums, shares, extremes
* ``dimension_counts``     (merchant, dimension, value) for low-cardinality dimensions
* ``card_hour_counts``     (merchant, card, hour slice): card use and split bursts
* ``amount_counts``        (merchant, amount): distinct amounts and exact percentiles
* ``month_descriptor_counts`` (merchant, month, descriptor): velocity and descriptors

The finer the key and the more tasks, the less a map side combines. ``per_merchant``
therefore exchanges the rows of ordinary merchants once, pruned, by merchant, after
which nothing of theirs moves again; only crowded merchants take the spread form.
``ticket_flow`` and ``month_flow`` are passes 4 and 5 for ordinary merchants: counts,
ranks and months in one go over those rows, nothing stored in between.

Joining the fact to the merchant dimension or to the activity gate is not needed:
both happen on the merchant grain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantscope import reference as ref
from merchantscope.functions import text
from merchantscope.functions.numeric import any_within, entropy_from_sums, flag, share
from merchantscope.operators.ordering import exact_percentiles, small_key_percentiles
from merchantscope.operators.ranking import PIECE, WHOLE
from merchantscope.session import stage_table

M = "merchant_id"
#: Rows of a merchant beyond which they are not brought together in one task.
CROWD_ROWS = 500_000


# ------------------------------------------------------------------ row flags
def row_flags() -> dict[str, Column]:
    """0/1 indicators of one transaction (NULL codes count as 0)."""
    c = F.col
    amount = F.abs(c("settlement_amount_usd"))
    reason = c("chargeback_reason_code")
    return {
        "approved": flag(c("approved_flag") == "Y"),
        "is_cnp": flag(c("card_present_flag") == "N"),
        "is_ecom": flag(c("channel") == "ECOMMERCE"),
        "is_moto": flag(c("channel") == "MOTO"),
        "is_recurring": flag(c("channel") == "RECURRING"),
        "is_keyed": flag(c("pos_entry_mode").isin(ref.KEYED_ENTRY_MODES)),
        "is_chip": flag(c("pos_entry_mode").isin(ref.CHIP_ENTRY_MODES)),
        "is_token": flag(c("token_flag") == "Y"),
        "is_3ds": flag(c("three_ds_flag") == "Y"),
        "is_quasi_cash": flag(c("transaction_type_code").isin(ref.QUASI_CASH_TYPES)),
        "is_cross_border": flag(c("domestic_xborder_flag") == "CROSS_BORDER"),
        "is_acq_mismatch": flag(c("merchant_acquirer_country_mismatch") == "Y"),
        "is_offshore": flag(c("acquirer_country").isin(ref.OFFSHORE_ACQUIRER_COUNTRIES)),
        "is_night": flag(c("local_hour").isin(ref.NIGHT_HOURS)),
        "is_weekend": flag(F.weekday("transaction_datetime_utc") >= 5),
        "is_refund": flag(c("refund_flag") == "Y"),
        "is_reversal": flag(c("reversal_flag") == "Y"),
        "is_chargeback": flag(c("chargeback_flag") == "Y"),
        "is_fraud": flag(c("fraud_flag") == "Y"),
        "is_cb_fraud_reason": flag(reason.startswith("10.")),
        "is_cb_service_reason": flag(reason.startswith("13.")),
        "is_decl_not_permitted": flag(c("auth_response_code").isin(ref.DECLINE_NOT_PERMITTED)),
        "is_decl_fraud": flag(c("auth_response_code").isin(ref.DECLINE_SUSPECTED_FRAUD)),
        "is_decl_limit": flag(c("auth_response_code").isin(ref.DECLINE_LIMIT)),
        "abs_amt": amount,
        "is_round_10": flag((amount % 10 == 0) & (amount > 0)),
        "is_round_100": flag((amount % 100 == 0) & (amount > 0)),
        "is_near_ceiling": flag(any_within(amount, ref.SPLIT_CEILINGS, ref.CEILING_LOWER_SHARE)),
        "month": F.date_format("transaction_date", "yyyy-MM"),
    }


def with_flags(tx: DataFrame, *names: str) -> DataFrame:
    """Add the named row flags (all of them when none is named)."""
    flags = row_flags()
    return tx.withColumns({n: flags[n] for n in (names or flags)})


# ------------------------------------------------- ordinary and crowded merchants
def crowded_merchants(tx: DataFrame, limit: int = CROWD_ROWS) -> DataFrame | None:
    """Merchants of more than ``limit`` rows (and the missing id); None if there are none.

    At most one per ``limit`` rows of the fact, hence small beside it.
    """
    sizes = tx.groupBy(M).agg(F.count("*").alias("n"))
    found = stage_table(sizes.filter((F.col("n") > limit) | F.col(M).isNull()).select(M), "crowded_merchants")
    return None if found.isEmpty() else found


def per_merchant(
    tx: DataFrame,
    crowded: DataFrame | None,
    make: Callable[..., DataFrame],
    spread: Callable[[DataFrame], DataFrame] | None = None,
    laid: DataFrame | None = None,
) -> DataFrame:
    """``make`` of the fact, whose result is grouped by merchant or finer.

    Rows of ordinary merchants meet in one task per merchant first, so that groupings
    and windows below the merchant need no exchange of their own. Those of ``crowded``
    merchants stay where they are and are combined on the map side, by ``spread`` where
    ``make`` would order a merchant in one task. ``laid`` is the fact as it lies in buckets by
    merchant and piece (``sources.buckets``), if it is stored that way: then nothing is
    exchanged, and ``make`` is asked to group by both.
    """
    if laid is not None:
        whole = F.col(PIECE) == WHOLE
        ordinary = make(laid.filter(whole), (M, PIECE)).drop(PIECE)
        return ordinary if crowded is None else ordinary.unionByName((spread or make)(laid.filter(~whole).drop(PIECE)))
    if crowded is None:
        return make(tx.repartition(M))
    same = tx[M].eqNullSafe(crowded[M])
    ordinary = tx.join(F.broadcast(crowded), same, "left_anti").repartition(M)
    return make(ordinary).unionByName((spread or make)(tx.join(F.broadcast(crowded), same, "left_semi")))


# ------------------------------------------------------------- pass 1: base
_SHARES = {
    "pct_cnp": "is_cnp",
    "pct_ecom": "is_ecom",
    "pct_moto": "is_moto",
    "pct_recurring": "is_recurring",
    "pct_keyed": "is_keyed",
    "pct_chip": "is_chip",
    "pct_token": "is_token",
    "pct_3ds": "is_3ds",
    "pct_quasi_cash": "is_quasi_cash",
    "pct_cross_border": "is_cross_border",
    "pct_acq_country_mismatch": "is_acq_mismatch",
    "pct_offshore_acquirer": "is_offshore",
    "pct_night_txn": "is_night",
    "pct_weekend_txn": "is_weekend",
    "pct_round_amount": "is_round_10",
    "pct_round_100": "is_round_100",
    "pct_near_ceiling": "is_near_ceiling",
    "approval_rate": "approved",
    "pct_decline_not_permitted": "is_decl_not_permitted",
    "pct_decline_suspected_fraud": "is_decl_fraud",
    "pct_decline_limit": "is_decl_limit",
    "refund_rate_count": "is_refund",
    "reversal_rate": "is_reversal",
    "pct_cb_fraud_reason": "is_cb_fraud_reason",
    "pct_cb_service_reason": "is_cb_service_reason",
}


def base_features(tx: DataFrame) -> DataFrame:
    """Everything one grouped pass can give: no distinct counts, no percentiles."""
    t = with_flags(tx)
    ok = F.col("approved") == 1
    refund = F.col("is_refund") == 1

    def sum_if(cond: Column, col: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0.0))

    def mean(flagged: str) -> Column:
        # Flags are never missing: all share one row count, where avg() exchanges one each.
        return F.sum(flagged) / F.count("*")

    approved_amount = F.when(ok, F.col("abs_amt"))
    gross = sum_if(ok & ~refund, "abs_amt")
    aggs = t.groupBy(M).agg(
        F.count("*").alias("txn_count"),
        F.sum("approved").alias("approved_txn_count"),
        sum_if(ok, "settlement_amount_usd").alias("sales_usd"),
        gross.alias("gross_sales_usd"),
        sum_if(ok & refund, "abs_amt").alias("refund_usd"),
        F.coalesce(F.avg(approved_amount), F.lit(0.0)).alias("avg_ticket_usd"),
        F.coalesce(F.max(approved_amount), F.lit(0.0)).alias("max_ticket_usd"),
        F.coalesce(F.stddev_samp(approved_amount), F.lit(0.0)).alias("ticket_std_usd"),
        F.min("transaction_date").alias("first_txn_date"),
        F.max("transaction_date").alias("last_txn_date"),
        *[mean(src).alias(name) for name, src in _SHARES.items()],
        share(F.col("abs_amt") > 500).alias("pct_ticket_gt_500"),
        share(F.col("abs_amt") < 20).alias("pct_ticket_lt_20"),
        (mean("is_chargeback") * 10000).alias("chargeback_rate_bps"),
        (mean("is_fraud") * 10000).alias("fraud_rate_bps"),
        F.coalesce(F.sum("fraud_amount_usd"), F.lit(0.0)).alias("fraud_usd"),
        F.coalesce(F.sum("chargeback_amount_usd"), F.lit(0.0)).alias("cb_usd"),
        sum_if(ok, "interchange_fee_usd").alias("interchange_fee_usd"),
        share(text.valid_string(F.col("sub_merchant_id"))).alias("pct_txn_with_sub_merchant"),
    )
    return aggs.withColumns(
        {
            "ticket_cv": F.try_divide("ticket_std_usd", "avg_ticket_usd"),
            "active_days": F.datediff("last_txn_date", "first_txn_date") + 1,
            "decline_rate": 1 - F.col("approval_rate"),
            "refund_rate_amount": F.try_divide("refund_usd", "gross_sales_usd"),
            "fraud_to_sales_bps": F.try_divide("fraud_usd", "gross_sales_usd") * 10000,
            "cb_to_sales_bps": F.try_divide("cb_usd", "gross_sales_usd") * 10000,
        }
    )


# ------------------------------------------- pass 2: low-cardinality dimensions
_DIMENSIONS = {
    "issuer_country": F.col,
    "issuer_bin": F.col,
    "acquirer_bin": F.col,
    "card_acceptor_id": F.col,
    "local_hour": F.col,
    "transaction_date": F.col,
    "sub_merchant_id": lambda c: F.when(text.valid_string(F.col(c)), F.col(c)),
    "decline_code": lambda c: F.when(
        F.col("approved_flag").isNull() | (F.col("approved_flag") != "Y"),
        F.col("auth_response_code"),
    ),
}


def dimension_counts(tx: DataFrame, by: tuple[str, ...] = (M,)) -> DataFrame:
    """(merchant, dim, value) -> n, every dimension out of a single scan.

    Generated rows, unlike unpivoted ones, keep the partitioning by merchant.
    """
    named = [
        F.struct(F.lit(d).alias("dim"), make(d).cast("string").alias("val"))
        for d, make in _DIMENSIONS.items()
    ]
    return (
        tx.select(*by, F.inline(F.array(*named)))
        .filter(F.col("val").isNotNull())
        .groupBy(*by, "dim", "val")
        .agg(F.count("*").alias("n"))
    )


def dimension_features(counts: DataFrame, by: tuple[str, ...] = (M,)) -> DataFrame:
    """Distinct counts, concentration and entropy out of the dimension counts."""

    def of(dim: str, x: Column) -> Column:
        return F.when(F.col("dim") == dim, x)

    n = F.col("n").cast("double")

    def distinct(dim: str) -> Column:
        return F.count(of(dim, n))

    def total(dim: str) -> Column:
        return F.sum(of(dim, n))

    def entropy(dim: str) -> Column:
        return F.coalesce(
            entropy_from_sums(total(dim), F.sum(of(dim, n * F.ln(n))), distinct(dim)), F.lit(0.0)
        )

    country = total("issuer_country")
    return counts.groupBy(*by).agg(
        distinct("issuer_country").alias("n_issuer_countries"),
        distinct("issuer_bin").alias("n_issuer_bins"),
        (F.sum(of("issuer_country", n * n)) / (country * country)).alias("issuer_country_hhi"),
        entropy("issuer_country").alias("issuer_country_entropy"),
        (F.max(of("issuer_country", n)) / country).alias("top_issuer_country_share"),
        distinct("acquirer_bin").alias("n_acquirer_bins"),
        distinct("card_acceptor_id").alias("n_caids"),
        entropy("local_hour").alias("hour_entropy"),
        distinct("transaction_date").alias("distinct_active_days"),
        distinct("sub_merchant_id").alias("n_sub_merchant_ids"),
        entropy("decline_code").alias("decline_code_entropy"),
    )


# --------------------------------------------------- pass 3: cards and bursts
def card_hour_counts(
    tx: DataFrame, gap_seconds: int = ref.BURST_GAP_SECONDS, by: tuple[str, ...] = (M,)
) -> DataFrame:
    """Mergeable moments per (merchant, card, slice of one burst gap).

    Rows inside one slice are less than ``gap_seconds`` apart, hence always in the
    same burst. That makes sessionising a grouped pass: only slices, not rows, are
    ordered afterwards, at most one per gap length and card, even for a card or
    merchant that holds a third of the fact.
    """
    t = with_flags(tx, "abs_amt", "is_near_ceiling").withColumn(
        "us", F.unix_micros(F.col("transaction_datetime_utc").cast("timestamp"))
    )
    return (
        t.withColumn("slice", F.floor(F.col("us") / F.lit(gap_seconds * 1_000_000)))
        .groupBy(*by, "card_token_id", "slice")
        .agg(
            F.count("*").alias("n"),
            F.sum("abs_amt").alias("amt"),
            F.sum(F.col("abs_amt") * F.col("abs_amt")).alias("amt_sq"),
            F.sum("is_near_ceiling").alias("near"),
            F.min("us").alias("first_us"),
            F.max("us").alias("last_us"),
        )
    )


def bursts(
    slices: DataFrame, gap_seconds: int = ref.BURST_GAP_SECONDS, by: tuple[str, ...] = (M,)
) -> DataFrame:
    """One row per burst: a run of a card's transactions with gaps <= gap_seconds.

    ``span_sec`` sums all gaps of the burst's rows *including* the idle time before
    its first row (0 for the card's first burst); ``inner_span_sec`` leaves it out.
    """
    by_card = Window.partitionBy(*by, "card_token_id").orderBy("slice")
    gap = (F.col("first_us") - F.lag("last_us").over(by_card)) / F.lit(1_000_000.0)
    marked = (
        slices.filter(F.col("card_token_id").isNotNull())
        .withColumn("gap", gap)
        .withColumn("starts", flag(F.col("gap").isNull() | (F.col("gap") > gap_seconds)))
        .withColumn("burst_id", F.sum("starts").over(by_card))
    )
    within = (F.col("last_us") - F.col("first_us")) / F.lit(1_000_000.0)
    n = F.sum("n")
    mean = F.sum("amt") / n
    variance = F.greatest(F.sum("amt_sq") - n * mean * mean, F.lit(0.0)) / (n - 1)
    return marked.groupBy(*by, "card_token_id", "burst_id").agg(
        n.alias("n"),
        mean.alias("amt_mean"),
        F.when(n > 1, F.try_divide(F.sqrt(F.when(n > 1, variance)), mean)).alias("amt_cv"),
        (F.sum(within) + F.coalesce(F.sum("gap"), F.lit(0.0))).alias("span_sec"),
        (
            F.sum(within)
            + F.coalesce(F.sum(F.when(F.col("starts") == 0, F.col("gap"))), F.lit(0.0))
        ).alias("inner_span_sec"),
        (F.sum("near") / n).alias("near_share"),
    )


def split_bursts(
    burst_rows: DataFrame, min_size: int = ref.BURST_MIN_SIZE, max_cv: float = ref.BURST_MAX_CV
) -> DataFrame:
    """Bursts that look like one purchase cut into several similar ones."""
    return burst_rows.filter(
        (F.col("n") >= min_size) & (F.coalesce("amt_cv", F.lit(0.0)) < max_cv)
    )


def burst_features(split: DataFrame) -> DataFrame:
    return split.groupBy(M).agg(
        F.count("*").alias("split_burst_events"),
        F.sum("n").alias("split_txn_count"),
        F.avg("n").alias("mean_split_burst_size"),
        (F.avg("span_sec") / F.avg("n")).alias("mean_split_gap_sec"),
        (F.avg("inner_span_sec") / F.avg("n")).alias("mean_split_inner_gap_sec"),
        F.avg("near_share").alias("pct_split_near_ceiling"),
    )


def card_burst_features(slices: DataFrame, by: tuple[str, ...] = (M,)) -> DataFrame:
    """Card use and split features in one flow over the slices.

    Bursts are folded into their card and cards into their merchant; window and
    both first groupings share the partitioning by (merchant, card).
    """
    rows = bursts(slices, by=by)
    split = (F.col("n") >= ref.BURST_MIN_SIZE) & (
        F.coalesce("amt_cv", F.lit(0.0)) < ref.BURST_MAX_CV
    )

    def sum_if(col: str) -> Column:
        return F.coalesce(F.sum(F.when(split, F.col(col))), F.lit(0)).cast("double")

    per_card = rows.groupBy(*by, "card_token_id").agg(
        F.sum("n").cast("double").alias("n"),
        F.count_if(split).alias("events"),
        *[sum_if(c).alias(f"_{c}") for c in ("n", "span_sec", "inner_span_sec", "near_share")],
    )
    total, events, split_n = F.sum("n"), F.sum("events"), F.sum("_n")
    zero = F.lit(0.0)
    return per_card.groupBy(*by).agg(
        F.count("*").alias("unique_cards"),
        share(F.col("n") > 1).alias("pct_cards_multi_use"),
        F.max("n").cast("long").alias("max_txn_single_card"),
        (F.sum(F.col("n") * F.col("n")) / (total * total)).alias("card_concentration_hhi"),
        events.alias("split_burst_events"),
        split_n.cast("long").alias("split_txn_count"),
        F.coalesce(F.try_divide(split_n, events), zero).alias("mean_split_burst_size"),
        F.coalesce(F.try_divide(F.sum("_span_sec"), split_n), zero).alias("mean_split_gap_sec"),
        F.coalesce(F.try_divide(F.sum("_inner_span_sec"), split_n), zero).alias(
            "mean_split_inner_gap_sec"
        ),
        F.coalesce(F.try_divide(F.sum("_near_share"), events), zero).alias(
            "pct_split_near_ceiling"
        ),
    )


# ------------------------------------------------------------ pass 4: amounts
def amount_counts(tx: DataFrame, by: tuple[str, ...] = (M,)) -> DataFrame:
    """(merchant, absolute amount) -> rows and approved rows."""
    return (
        with_flags(tx, "abs_amt", "approved")
        .groupBy(*by, "abs_amt")
        .agg(F.count("*").alias("n"), F.sum("approved").alias("n_approved"))
    )


def amount_features(counts: DataFrame) -> DataFrame:
    """Distinct amounts, and exact median and p95 of approved tickets.

    Reads ``counts`` several times: hand in a stored table.
    """
    known = counts.filter(F.col("abs_amt").isNotNull())
    distinct = known.groupBy(M).agg(F.count("*").alias("n_distinct_amounts"))
    quantiles = exact_percentiles(
        known, [M], "abs_amt", {"median_ticket_usd": 0.5, "p95_ticket_usd": 0.95}, n="n_approved"
    )
    return distinct.join(quantiles, M, "left").na.fill(0.0, ["median_ticket_usd", "p95_ticket_usd"])


def ticket_flow(tx: DataFrame, by: tuple[str, ...] = (M,)) -> DataFrame:
    """``amount_features`` of the fact for merchants that fit one task."""
    return small_key_percentiles(
        amount_counts(tx, by).filter(F.col("abs_amt").isNotNull()), [*by], "abs_amt",
        {"median_ticket_usd": 0.5, "p95_ticket_usd": 0.95}, n="n_approved", distinct="n_distinct_amounts",
    ).na.fill(0.0, ["median_ticket_usd", "p95_ticket_usd"])


# ------------------------------------------- pass 5: months and descriptors
def month_descriptor_counts(tx: DataFrame) -> DataFrame:
    """(merchant, month, descriptor) -> rows and absolute volume."""
    return (
        with_flags(tx, "abs_amt", "month")
        .groupBy(M, "month", F.coalesce("merchant_descriptor", F.lit("")).alias("descriptor"))
        .agg(F.count("*").alias("n"), F.sum("abs_amt").alias("amt"))
    )


def monthly_features(counts: DataFrame) -> DataFrame:
    """Volume by month: peak, median, spike, growth over the months present."""
    monthly = counts.groupBy(M, "month").agg(F.sum("amt").alias("amt"))
    previous = F.lag("amt").over(Window.partitionBy(M).orderBy("month"))
    growth = (F.col("amt") - F.col("prev")) / F.greatest(F.col("prev"), F.lit(1.0))
    return (
        monthly.withColumn("prev", previous)
        .groupBy(M)
        .agg(
            F.count("*").alias("active_months"),
            F.max("amt").alias("max_month_sales_usd"),
            F.median("amt").alias("median_month_sales_usd"),
            F.try_divide(F.max("amt"), F.sum("amt")).alias("pct_sales_in_top_month"),
            F.coalesce(F.max(growth), F.lit(0.0)).alias("max_mom_growth"),
        )
        .withColumn(
            "volume_spike_ratio", F.try_divide("max_month_sales_usd", "median_month_sales_usd")
        )
    )


def monthly_modal_descriptor(counts: DataFrame) -> DataFrame:
    """Most frequent descriptor of each month; the smallest wins a tie."""
    return (
        counts.groupBy(M, "month")
        .agg(F.min(F.struct((-F.col("n")).alias("rank"), "descriptor")).alias("top"))
        .select(M, "month", F.col("top.descriptor").alias("descriptor"))
    )


def descriptor_features(
    counts: DataFrame, merchants: DataFrame, generic: list[str] = ref.DESCRIPTOR_GENERIC_TOKENS
) -> DataFrame:
    """Descriptor variety, generic wording, churn and closeness to the name."""
    per_descriptor = counts.groupBy(M, "descriptor").agg(F.sum("n").alias("n"))
    named = per_descriptor.join(merchants.select(M, "merchant_name"), M, "left")
    variety = named.groupBy(M).agg(
        F.count("*").alias("n_distinct_descriptors"),
        (
            F.sum(F.when(text.has_generic_token(F.col("descriptor"), generic), F.col("n")).otherwise(0))
            / F.sum("n")
        ).alias("pct_generic_descriptor"),
        F.max(flag(text.looks_like_url(F.col("descriptor")))).alias("has_url_descriptor"),
        F.max(text.name_overlap(F.col("merchant_name"), F.col("descriptor"))).alias(
            "descriptor_name_jaccard"
        ),
    )
    modal = monthly_modal_descriptor(counts)
    before = F.lag("descriptor").over(Window.partitionBy(M).orderBy("month"))
    churn = (
        modal.withColumn("before", before)
        .groupBy(M)
        .agg(F.count_if(F.col("before") != F.col("descriptor")).alias("descriptor_changes"))
    )
    return variety.join(churn, M)


def month_flow(
    tx: DataFrame, merchants: DataFrame, generic: list[str] = ref.DESCRIPTOR_GENERIC_TOKENS
) -> DataFrame:
    """``monthly_features`` and ``descriptor_features`` for merchants that fit one task.

    Every window holds the merchant, so all follow one exchange. A month is told by its
    modal row, a descriptor by its first one.
    """
    by_month = Window.partitionBy(M, "month")
    by_descriptor = Window.partitionBy(M, "descriptor")
    rows = (
        month_descriptor_counts(tx)
        .withColumn("modal", F.row_number().over(by_month.orderBy(F.desc("n"), "descriptor")) == 1)
        .withColumn("month_amt", F.sum("amt").over(by_month))
        .withColumn("first", F.row_number().over(by_descriptor.orderBy("month")) == 1)
        .withColumn("uses", F.sum("n").over(by_descriptor))
    )
    # Modal rows come first, in the order of their months.
    months = Window.partitionBy(M).orderBy(F.desc("modal"), "month")
    rows = rows.withColumn("prev", F.lag("month_amt").over(months)).withColumn(
        "before", F.lag("descriptor").over(months)
    )
    # Months count once for a merchant that is listed repeatedly.
    copy = F.row_number().over(Window.partitionBy(M).orderBy("merchant_name"))
    names = merchants.select(M, "merchant_name").withColumn("copy", copy)
    named = rows.join(names, M, "left")
    month = F.col("modal") & (F.coalesce("copy", F.lit(1)) == 1)
    amt, first, text_of = F.when(month, F.col("month_amt")), F.col("first"), F.col("descriptor")
    growth = F.when(month, (F.col("month_amt") - F.col("prev")) / F.greatest(F.col("prev"), F.lit(1.0)))
    return named.groupBy(M).agg(
        F.count_if(month).alias("active_months"),
        F.max(amt).alias("max_month_sales_usd"),
        F.median(amt).alias("median_month_sales_usd"),
        F.try_divide(F.max(amt), F.sum(amt)).alias("pct_sales_in_top_month"),
        F.coalesce(F.max(growth), F.lit(0.0)).alias("max_mom_growth"),
        F.count_if(first).alias("n_distinct_descriptors"),
        (
            F.sum(F.when(first & text.has_generic_token(text_of, generic), F.col("uses")).otherwise(0))
            / F.sum(F.when(first, F.col("uses")))
        ).alias("pct_generic_descriptor"),
        F.max(F.when(first, flag(text.looks_like_url(text_of)))).alias("has_url_descriptor"),
        F.max(F.when(first, text.name_overlap(F.col("merchant_name"), text_of))).alias("descriptor_name_jaccard"),
        F.count_if(month & (F.col("before") != text_of)).alias("descriptor_changes"),
    ).withColumn("volume_spike_ratio", F.try_divide("max_month_sales_usd", "median_month_sales_usd"))


def month_spread(tx: DataFrame, merchants: DataFrame) -> DataFrame:
    """The columns of ``month_flow`` for merchants of any size; the counts are stored, as several passes read them."""
    months = stage_table(month_descriptor_counts(tx), "month_descriptor_counts")
    return monthly_features(months).join(descriptor_features(months, merchants), M)


# ------------------------------------------------------------- category norms
def with_category_norms(
    features: DataFrame, mcc_reference: DataFrame, bands: DataFrame
) -> DataFrame:
    """Expected behaviour and interchange band of the declared category.

    Both lookups are small files or literals; Spark broadcasts them by their known
    size and shuffles them otherwise.
    """
    norms = mcc_reference.select(
        F.col("mcc").alias("declared_mcc"),
        "mcc_group",
        F.col("expected_avg_ticket").alias("mcc_expected_avg_ticket"),
        F.col("expected_cnp_share").alias("mcc_expected_cnp_share"),
        F.col("expected_night_share").alias("mcc_expected_night_share"),
    )
    known = features.join(norms, "declared_mcc", "left").na.fill(
        {
            "mcc_group": ref.UNKNOWN_MCC_GROUP,
            "mcc_expected_avg_ticket": ref.UNKNOWN_MCC_TICKET,
            "mcc_expected_cnp_share": ref.UNKNOWN_MCC_CNP_SHARE,
            "mcc_expected_night_share": ref.UNKNOWN_MCC_NIGHT_SHARE,
        }
    )
    banded = known.join(
        bands.select("mcc_group", F.col("band_bps").alias("mcc_declared_interchange_bps")),
        "mcc_group",
        "left",
    ).na.fill(ref.INTERCHANGE_BPS_DEFAULT, ["mcc_declared_interchange_bps"])
    cnp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("pct_cnp")))
    return banded.withColumns(
        {
            "ticket_vs_mcc_expected": F.try_divide("avg_ticket_usd", "mcc_expected_avg_ticket"),
            "cnp_vs_mcc_expected": F.col("pct_cnp") - F.col("mcc_expected_cnp_share"),
            "night_vs_mcc_expected": F.col("pct_night_txn") - F.col("mcc_expected_night_share"),
            "effective_interchange_bps": F.try_divide("interchange_fee_usd", "sales_usd") * 10000,
            "behaviour_expected_interchange_bps": cnp * ref.BEHAVIOUR_CNP_BPS
            + ref.BEHAVIOUR_BASE_BPS,
            "declared_band_is_cheap": flag(
                F.col("mcc_declared_interchange_bps") <= ref.CHEAP_BAND_MAX_BPS
            ),
        }
    ).withColumn(
        "interchange_advantage_bps",
        F.col("behaviour_expected_interchange_bps") - F.col("effective_interchange_bps"),
    )


def interchange_bands(spark, bands: dict[str, float] | None = None) -> DataFrame:
    rows = [(g, float(b)) for g, b in (bands or ref.INTERCHANGE_BPS_BY_GROUP).items()]
    return spark.createDataFrame(rows, "mcc_group string, band_bps double")


# ------------------------------------------------------------------ assembly
def merchant_features(
    tx: DataFrame,
    merchants: DataFrame,
    mcc_reference: DataFrame,
    bands: DataFrame,
    crowd: int = CROWD_ROWS,
    laid: DataFrame | None = None,
) -> DataFrame:
    """The full feature row per merchant. ``crowd`` and ``laid`` only route (see ``per_merchant``).

    Tickets and months, whose crowded merchants take jobs of their own, are stored per
    merchant first. The other parts are hash-partitioned by merchant already, so
    assembling them adds no exchange of its own.
    """
    crowded = crowded_merchants(tx, crowd)
    tickets = per_merchant(
        tx, crowded, ticket_flow, lambda t: amount_features(stage_table(amount_counts(t), "amount_counts")), laid
    )
    months = per_merchant(tx, crowded, lambda t: month_flow(t, merchants), lambda t: month_spread(t, merchants))
    parts = [
        per_merchant(tx, crowded, lambda t, by=(M,): dimension_features(dimension_counts(t, by), by), laid=laid),
        per_merchant(tx, crowded, lambda t, by=(M,): card_burst_features(card_hour_counts(t, by=by), by), laid=laid),
        stage_table(tickets, "ticket_features"),
        stage_table(months, "month_features"),
    ]
    wide = base_features(tx)
    for part in parts:
        wide = wide.join(part, M, "left")
    zero_if_absent = [
        "split_burst_events", "split_txn_count", "mean_split_burst_size", "mean_split_gap_sec",
        "mean_split_inner_gap_sec", "pct_split_near_ceiling", "n_issuer_countries",
        "n_issuer_bins", "n_acquirer_bins", "n_caids", "n_sub_merchant_ids", "hour_entropy",
        "decline_code_entropy", "unique_cards", "distinct_active_days", "n_distinct_amounts",
    ]
    wide = wide.na.fill(0, zero_if_absent).withColumns(
        {
            "txn_per_active_day": F.try_divide("txn_count", "distinct_active_days"),
            "txn_per_card": F.try_divide("txn_count", "unique_cards"),
            "distinct_amount_ratio": F.col("n_distinct_amounts") / F.col("txn_count"),
            "pct_txn_in_split_burst": F.col("split_txn_count") / F.col("txn_count"),
        }
    )
    described = wide.join(
        merchants.select(
            M, "dba_id", "corp_id", "merchant_name", "declared_mcc", "merchant_country",
            "merchant_city",
        ),
        M,
        "left",
    ).withColumn("declared_mcc", F.lpad(F.col("declared_mcc").cast("string"), 4, "0"))
    return with_category_norms(described, mcc_reference, bands)

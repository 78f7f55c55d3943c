"""Card-surcharge compliance by jurisdiction, and the portfolio lens on it.

Rate, share of surcharged transactions, disclosure and whether debit or prepaid
cards are surcharged are inputs. Where one is missing the merchant is reported as
INSUFFICIENT DATA instead of being given a made-up value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantscope import reference as ref
from merchantscope.functions.numeric import round_half_up
from merchantscope.operators.scoring import label_of

M = "merchant_id"
REQUIRED = [
    "merchant_country", "surcharge_rate_bps", "pct_txn_surcharged", "surcharge_disclosed",
    "surcharges_debit_prepaid",
]
SEVERE, POTENTIAL = "SEVERE VIOLATION", "POTENTIAL VIOLATION"

NEXT_STEPS = {
    "Regional ban": ["cease-surcharge notice", "third-party audit transaction", "brand-rules referral"],
    "Prohibited debit/prepaid": ["freeze debit and prepaid surcharges", "debit test purchase",
                                 "warning letter, 30 days to cure"],
    "Over-cap": ["fee-cap breach notice", "request cost-of-acceptance evidence",
                 "monitor fee chargebacks"],
    "Undisclosed": ["require point-of-sale disclosure", "test the checkout",
                    "warning letter, re-audit in 60 days"],
    "": ["no action", "keep in monitoring"],
}


def regimes(spark: SparkSession) -> DataFrame:
    """Known jurisdictions: regime (ban, capped, cost-of-acceptance), cap and region."""
    rows = [(c, "ban", None, "European Union") for c in ref.SURCHARGE_BAN_EU]
    rows += [(c, "ban", None, ref.SURCHARGE_REGIONS[c]) for c in ref.SURCHARGE_BAN_OTHER]
    for c, cap in ref.SURCHARGE_CAPS_PCT.items():
        kind = "cost-of-acceptance" if c in ref.SURCHARGE_COST_OF_ACCEPTANCE else "capped"
        rows.append((c, kind, cap, ref.SURCHARGE_REGIONS[c]))
    listed = {r[0] for r in rows}
    rows += [
        (c, "cost-of-acceptance", None, region)
        for c, region in ref.SURCHARGE_REGIONS.items()
        if c not in listed
    ]
    return spark.createDataFrame(
        rows, "merchant_country string, regime string, cap_pct double, region string"
    )


def assess(merchants: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Status, violation and next steps of each merchant."""
    rules = rules if rules is not None else regimes(merchants.sparkSession)
    known = F.lit(True)
    for c in REQUIRED:
        known = known & F.col(c).isNotNull()
    rate = F.col("surcharge_rate_bps") / 100.0
    banned = F.col("regime") == "ban"
    prohibited = F.col("surcharges_debit_prepaid")
    over = F.coalesce(rate > F.col("cap_pct"), F.lit(False))
    hidden = ~F.col("surcharge_disclosed")
    violation = (
        F.when(~known, F.lit(""))
        .when(banned, F.lit("Regional ban"))
        .when(prohibited, F.lit("Prohibited debit/prepaid"))
        .when(over, F.lit("Over-cap"))
        .when(hidden, F.lit("Undisclosed"))
        .otherwise(F.lit(""))
    )
    steps = F.lit(None).cast("array<string>")
    for name, items in NEXT_STEPS.items():
        steps = F.when(
            F.col("violation") == name, F.array(*[F.lit(i) for i in items])
        ).otherwise(steps)
    return (
        merchants.join(rules, "merchant_country", "left")
        .withColumn("regime", F.coalesce("regime", F.lit("cost-of-acceptance")))
        .withColumn("region", F.coalesce("region", "merchant_country"))
        .withColumn("surcharge_pct", rate)
        .withColumn("over_cap", over)
        .withColumn("violation", violation)
        .withColumn(
            "status",
            F.when(~known, F.lit("INSUFFICIENT DATA"))
            .when(F.col("violation").isin("Regional ban", "Prohibited debit/prepaid"), F.lit(SEVERE))
            .when(F.col("violation") != "", F.lit(POTENTIAL))
            .otherwise(F.lit("COMPLIANT")),
        )
        .withColumn("next_steps", F.when(known, steps))
    )


def compliance_matrix(assessed: DataFrame) -> DataFrame:
    """Four checks per merchant: jurisdiction, product type, rate, disclosure."""
    banned = F.col("regime") == "ban"

    def row(check: str, detected: Column, outcome: Column) -> Column:
        return F.struct(
            F.lit(check).alias("check"), detected.alias("detected"), outcome.alias("outcome")
        )

    def fail_if(cond: Column, other: str = "pass") -> Column:
        return F.when(cond, F.lit("fail")).otherwise(F.lit(other))

    checks = F.array(
        row("jurisdiction", F.col("merchant_country"), fail_if(banned, "info")),
        row(
            "product type",
            F.when(F.col("surcharges_debit_prepaid"), F.lit("debit/prepaid surcharged")).otherwise(
                F.lit("debit/prepaid exempt")
            ),
            fail_if(F.col("surcharges_debit_prepaid")),
        ),
        row(
            "surcharge rate",
            F.format_string("%.1f%%", F.col("surcharge_pct")),
            fail_if(banned | F.col("over_cap")),
        ),
        row(
            "disclosure",
            F.when(F.col("surcharge_disclosed"), F.lit("disclosed")).otherwise(F.lit("not disclosed")),
            fail_if(~F.col("surcharge_disclosed")),
        ),
    )
    return assessed.filter(F.col("status") != "INSUFFICIENT DATA").select(M, F.inline(checks))


def violations(assessed: DataFrame) -> DataFrame:
    """Surcharging merchants in violation with their violation volume."""
    return (
        assessed.filter((F.col("surcharge_rate_bps") > 0) & (F.col("pct_txn_surcharged") > 0))
        .filter(F.col("violation") != "")
        .withColumn(
            "violation_volume",
            round_half_up(F.col("gross_sales_usd") * F.col("pct_txn_surcharged"), 0),
        )
        .withColumn(
            "severity",
            label_of(
                F.col("status"), {SEVERE: "SEVERE", POTENTIAL: "POTENTIAL"}
            ),
        )
    )


def portfolio(violating: DataFrame) -> DataFrame:
    """Rollups by acquirer, violation and region in one pass, and the total.

    ``lens`` names the rollup, ``entry`` its member.
    """
    dims = ["acquirer_id", "violation", "region"]
    gid = F.grouping_id(*dims)
    return (
        violating.select(*dims, M, "severity", "violation_volume")
        .groupingSets([[d] for d in dims] + [[]], *dims)
        .agg(
            gid.alias("_g"),
            F.count(M).alias("merchants"),
            F.count_if(F.col("severity") == "SEVERE").alias("severe"),
            F.coalesce(F.sum("violation_volume"), F.lit(0.0)).alias("violation_volume"),
        )
        .select(
            F.when(F.col("_g") == 3, F.lit("acquirer"))
            .when(F.col("_g") == 5, F.lit("violation"))
            .when(F.col("_g") == 6, F.lit("region"))
            .otherwise(F.lit("total"))
            .alias("lens"),
            F.coalesce(F.col("acquirer_id").cast("string"), "violation", "region").alias("entry"),
            "merchants", "severe", "violation_volume",
        )
    )


def portfolio_totals(
    assessed: DataFrame, band_low: float = 5000.0, band_high: float = 10000.0
) -> DataFrame:
    """Headline: surcharging, violating, severe, volume and the assessment band."""
    hit = F.col("violation") != ""
    severe = F.col("status") == SEVERE
    volume = round_half_up(F.col("gross_sales_usd") * F.col("pct_txn_surcharged"), 0)
    surcharging = assessed.filter(
        (F.col("surcharge_rate_bps") > 0) & (F.col("pct_txn_surcharged") > 0)
    )
    return surcharging.agg(
        F.count("*").alias("surcharging"),
        F.count_if(hit).alias("violating"),
        F.count_if(severe).alias("severe"),
        F.count_if(hit & ~severe).alias("potential"),
        F.coalesce(F.sum(F.when(hit, volume)), F.lit(0.0)).alias("violation_volume"),
        (F.count_if(hit) * band_low).alias("assessment_low"),
        (F.count_if(hit) * band_high).alias("assessment_high"),
    )

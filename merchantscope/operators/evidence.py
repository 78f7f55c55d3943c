"""Evidence tables: supporting and mitigating statements, lane corroboration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantscope.functions.numeric import round_half_up

M = "merchant_id"
THIN_FILE = 25

# Section -> contributions that open it, contributions it may cite.
SUPPORTING = {
    "category-divergence": (["F-001"], ["F-001", "F-002", "F-003"]),
    "cash-extraction": (["F-004", "F-005"], ["F-004", "F-005", "F-006"]),
    "threshold-avoidance": (["F-007"], ["F-007"]),
    "descriptor-deception": (["F-010", "F-011"], ["F-010", "F-011", "F-018"]),
    "shared-infrastructure": (["F-013", "F-014"], ["F-013", "F-014"]),
}


def top_contributions(k: int = 8) -> Column:
    return F.slice("contributions", 1, k)


def confidence(records: DataFrame) -> DataFrame:
    """Confidence of the finding; a thin file caps it."""
    thin = F.col("txn_count") < THIN_FILE
    base = F.least(
        F.lit(0.97), 0.35 + F.col("final_risk_score") / 140 + F.col("mcc_confidence") * 0.25
    )
    value = F.when(thin, F.least(base, F.lit(0.45))).otherwise(base)
    return records.withColumn("confidence", round_half_up(value, 2)).withColumn(
        "confidence_label",
        F.when(thin, F.lit("Low (thin file)"))
        .when(value > 0.75, F.lit("High"))
        .when(value > 0.55, F.lit("Moderate"))
        .otherwise(F.lit("Low")),
    )


def evidence_rows(records: DataFrame) -> DataFrame:
    """One row per merchant, section and citation (NULL citation where none).

    Sections open on the merchant's top contributions; a merchant without any gets
    its two strongest contributions, one without mitigating facts says so.
    """
    ids = F.transform(top_contributions(), lambda c: c["id"])

    def section(name: str, side: str, cites: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), F.lit(name).alias("section"), cites.alias("cites"))

    none = F.array().cast("array<string>")
    opened = []
    for name, (openers, cites) in SUPPORTING.items():
        found = F.arrays_overlap(ids, F.array(*[F.lit(x) for x in openers]))
        cited = F.array_intersect(F.array(*[F.lit(x) for x in cites]), ids)
        opened.append(F.when(found, section(name, "supporting", cited)))
    fit = F.col("descriptor_name_similarity") > 0.7
    explained = (F.col("primary_typology") == "CLEAN") | (
        F.col("declared_mcc") == F.col("predicted_mcc")
    )
    against = [
        F.when(F.col("txn_count") < THIN_FILE, section("thin-history", "mitigating", none)),
        F.when(F.col("dispute_rate") < 0.01, section("low-disputes", "mitigating", none)),
        F.when(explained, section("legitimate-explanation", "mitigating", none)),
        F.when(
            fit,
            section("descriptor-matches-name", "mitigating", F.array(F.lit("F-018"))),
        ),
    ]
    supporting = F.array_compact(F.array(*opened))
    mitigating = F.array_compact(F.array(*against))
    strongest = F.array(section("composite-anomaly", "supporting", F.slice(ids, 1, 2)))
    limited = F.array(section("limited-contradiction", "mitigating", none))
    everything = F.concat(
        F.when(F.size(supporting) > 0, supporting).otherwise(strongest),
        F.when(F.size(mitigating) > 0, mitigating).otherwise(limited),
    )
    return records.select(M, F.inline(everything)).select(
        M, "side", "section", F.explode_outer("cites").alias("citation")
    )


def corroboration(records: DataFrame) -> DataFrame:
    """Verdict of each internal lane and the number that corroborate.

    Lanes: transactions and peers always speak; the graph does when entities are
    shared, the rules when one fired. Outside sources are not part of it.
    """
    linked = (
        F.col("shared_bank_account_count") + F.col("shared_ip_count")
        + F.col("shared_device_count") + F.col("submerchant_count")
    ) > 0
    fired = F.size("rule_hits") > 0
    c = F.col
    flags = {
        "remote_flag": c("card_not_present_ratio") > 0.8,
        "quasi_cash_flag": c("cash_equivalent_ratio") > 0.1,
        "round_flag": c("round_dollar_ratio") > 0.15,
        "night_z_flag": F.abs("peer_night_z") > 2,
        "cnp_z_flag": F.abs("peer_cnp_z") > 2,
        "divergence_flag": c("mcc_divergence") > 0.3,
    }
    return records.select(
        M,
        linked.alias("graph_corroborates"),
        fired.alias("rules_corroborate"),
        *[x.alias(n) for n, x in flags.items()],
        (F.lit(2) + linked.cast("int") + fired.cast("int")).alias("corroborating_lanes"),
    )

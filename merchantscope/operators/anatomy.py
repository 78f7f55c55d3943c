"""Drill-down of flagged merchants: exemplars, telling rows, signatures, deviations.

The reference point is one exemplar per family, but every operator works on any
number of merchants at once: one scan of the fact serves all of them, and results
come as rows, so that nothing grows with the size of a single merchant.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantscope import reference as ref
from merchantscope.functions.numeric import finite_or, nice_ceiling
from merchantscope.functions.text import valid_string
from merchantscope.operators.ordering import exact_percentiles, value_counts
from merchantscope.operators.ranking import best_per_group, join_in_pieces, top_per_key
from merchantscope.session import stage_table

M = "merchant_id"


# --------------------------------------------------------------- exemplars
def exemplars(scores: DataFrame, aligned: Column | None = None) -> DataFrame:
    """One flagged merchant per family, by the family's own priorities.

    ``aligned`` (optional, from labels) marks rows whose category is confirmed.
    Priorities that fall back when no row meets them are just leading sort keys.
    """
    c, fam = F.col, F.col("family")
    confirmed = F.coalesce(aligned, F.lit(False)) if aligned is not None else F.lit(False)
    p1 = c("top_category").isin([k for k, v in ref.CATEGORY_PRIORITY.items() if v == "P1"])
    zero = F.lit(0.0)
    leak = F.abs("interchange_advantage_bps") * c("gross_sales_usd")

    def by_family(**keys: Column) -> Column:
        out = F.lit(None)
        for name, key in keys.items():
            out = F.when(fam == name, key.cast("double")).otherwise(out)
        return F.coalesce(out.cast("double"), zero)

    busy = {"mcc_miscoding": (c("txn_count") >= 150).cast("int"),
            "mcc_abuse": (c("txn_count") >= 200).cast("int")}
    order = [
        by_family(**busy),
        by_family(mcc_miscoding=F.when(confirmed & p1, 2).when(confirmed, 1).otherwise(0)),
        by_family(
            mcc_miscoding=c("rules_triggered"), mcc_abuse=leak,
            split_ticketing=c("pct_txn_in_split_burst"), factoring=c("n_sub_merchant_ids"),
            descriptor=c("descriptor_changes"), cash=c("pct_round_100"),
        ),
        by_family(
            mcc_miscoding=c("txn_count"), mcc_abuse=c("txn_count"),
            split_ticketing=c("split_burst_events"), factoring=c("volume_spike_ratio"),
            descriptor=c("txn_count"), cash=c("pct_quasi_cash"),
        ),
        by_family(
            mcc_miscoding=c("exposure_weighted_score"), split_ticketing=c("txn_count"),
            factoring=c("txn_count"), cash=c("txn_count"),
        ),
    ]
    flagged = scores.filter("flag_for_investigation = 1")
    return best_per_group(flagged, "family", [*[-k for k in order], F.col(M)])


# ------------------------------------------------------------ telling rows
def row_tells(family: Column, ceiling: Column, declared_country: Column) -> Column:
    """Reasons a transaction is telling, limited to those its family looks for."""
    c = F.col
    amount = F.abs(finite_or(c("settlement_amount_usd")))
    hour = finite_or(c("local_hour"))
    absent = F.upper(F.coalesce("card_present_flag", F.lit(""))).startswith("N")
    remote = F.upper(F.coalesce("channel", F.lit(""))).rlike("ECOM|MOTO")

    def yes(col: str) -> Column:
        return F.upper(F.coalesce(c(col), F.lit(""))).startswith("Y")

    third_country = (
        valid_string(c("acquirer_country"))
        & ~c("acquirer_country").eqNullSafe(declared_country)
        & ~c("acquirer_country").eqNullSafe(c("issuer_country"))
    )
    tests = {
        "night": (hour <= 5) | (hour >= 23),
        "round": (amount > 0) & (amount % 100 == 0),
        "cnp": absent,
        "offshore": yes("merchant_acquirer_country_mismatch") | third_country,
        "declined": ~yes("approved_flag"),
        "recurring": yes("recurring_flag"),
        "cpmismatch": ~absent & remote,
        "ceiling": (ceiling > 0)
        & (amount >= ceiling * ref.CEILING_LOWER_SHARE)
        & (amount < ceiling),
        "burst": valid_string(c("split_group_id")),
        "submerchant": valid_string(c("sub_merchant_id")),
        "big": amount >= 500,
    }
    found = F.array_compact(F.array(*[F.when(t, F.lit(tag)) for tag, t in tests.items()]))
    wanted = F.lit(None).cast("array<string>")
    for name, tags in ref.FAMILY_TELLS.items():
        wanted = F.when(family == name, F.array(*[F.lit(t) for t in tags])).otherwise(wanted)
    return F.array_intersect(found, F.coalesce(wanted, F.array().cast("array<string>")))


#: Columns an evidence row shows.
EVIDENCE_COLUMNS = [
    M, "family", "transaction_datetime_utc", "local_hour", "settlement_amount_usd", "channel",
    "card_present_flag", "issuer_country", "acquirer_country", "approved_flag",
    "auth_response_code", "merchant_descriptor",
]


def tagged_rows(tx: DataFrame, merchants: DataFrame, ceilings: DataFrame | None = None) -> DataFrame:
    """Transactions of the given merchants (family, merchant_country) with their tells."""
    who = merchants.select(M, "family", F.col("merchant_country").alias("_declared_country"))
    if ceilings is not None:
        who = who.join(ceilings.select(M, "ceiling"), M, "left")
    else:
        who = who.withColumn("ceiling", F.lit(None).cast("double"))
    spread = [c for c in EVIDENCE_COLUMNS if c not in ("family", "transaction_datetime_utc")]
    return (
        join_in_pieces(tx, who, [M], spread)
        .withColumn("tells", row_tells(F.col("family"), F.col("ceiling"), F.col("_declared_country")))
        .select(*EVIDENCE_COLUMNS, "tells", "_piece")
    )


def evidence_sample(tagged: DataFrame, k: int = 12, clean: int = 3) -> DataFrame:
    """Last k-3 telling rows and last 3 clean rows of each merchant, k in all."""
    own = (M, "family", "transaction_datetime_utc", "tells", "_piece")
    ties = [c for c in tagged.columns if c not in own]
    order = [F.desc("transaction_datetime_utc"), *[F.asc_nulls_first(c) for c in ties]]
    marked = tagged.withColumn("telling", F.size("tells") > 0)
    kept = top_per_key(
        marked, [M, "telling"], order, max(k - clean, clean), [M, *ties],
        cap=F.when(F.col("telling"), k - clean).otherwise(clean),
    )
    return top_per_key(kept, [M], [*order, F.asc("telling")], k, [M, *ties])


# -------------------------------------------------------------- signatures
def fingerprint(scores: DataFrame, k: int = 6, lit_at: float = 90.0) -> DataFrame:
    """Top category scores of each merchant and how many of them are lit."""
    entries = F.array(
        *[
            F.struct(F.col(f"score_{c}").alias("score"), F.lit(-i).alias("place"),
                     F.lit(c).alias("category"))
            for i, c in enumerate(ref.CATEGORY_WEIGHTS)
        ]
    )
    top = F.slice(F.sort_array(entries, asc=False), 1, k)
    return scores.select(
        M,
        F.transform(top, lambda e: e["category"]).alias("categories"),
        F.transform(top, lambda e: e["score"]).alias("scores"),
        F.size(F.filter(top, lambda e: e["score"] >= lit_at)).alias("lit"),
    )


def interchange_signature(scores: DataFrame) -> DataFrame:
    advantage = finite_or(F.col("interchange_advantage_bps"))
    return scores.select(
        M, "mcc_declared_interchange_bps", "behaviour_expected_interchange_bps",
        "effective_interchange_bps", "interchange_advantage_bps", "cnp_vs_mcc_expected",
        "gross_sales_usd",
        (F.abs(advantage) / 10000.0 * finite_or(F.col("gross_sales_usd"))).alias("leaked_fees_usd"),
    )


def split_groups(tx: DataFrame, k: int = 6) -> DataFrame:
    """The k largest split groups of each merchant."""
    groups = (
        tx.filter(valid_string(F.col("split_group_id")))
        .groupBy(M, "split_group_id")
        .agg(
            F.count("*").alias("size"),
            F.sum(F.abs("settlement_amount_usd")).alias("total"),
            F.min("transaction_datetime_utc").alias("started"),
        )
    )
    order = [F.desc("size"), F.desc("total"), F.asc("split_group_id")]
    return top_per_key(groups, [M], order, k, ["split_group_id"], rank_col="place")


def split_group_amounts(tx: DataFrame, groups: DataFrame) -> DataFrame:
    """Amounts inside the chosen split groups as (group, amount, count) rows."""
    chosen = groups.select(M, "split_group_id", "place")
    return (
        tx.filter(valid_string(F.col("split_group_id")))
        .join(chosen, [M, "split_group_id"])
        .groupBy(M, "place", "split_group_id", F.abs("settlement_amount_usd").alias("amount"))
        .agg(F.count("*").alias("n"))
    )


def split_ceilings(amounts: DataFrame) -> DataFrame:
    """Likely authorisation ceiling: the first round step above the 95th percentile."""
    counts = stage_table(
        amounts.groupBy(M, "amount").agg(F.sum("n").alias("n")), "split_amount_counts"
    )
    p95 = exact_percentiles(counts, [M], "amount", {"p95": 0.95})
    beyond = F.ceil(F.col("p95") / 1000) * 1000.0
    return p95.select(
        M,
        "p95",
        F.when(F.col("p95") >= ref.CEILING_STEPS[-1], beyond)
        .otherwise(nice_ceiling(F.col("p95"), ref.CEILING_STEPS))
        .alias("ceiling"),
    )


def sub_merchants(tx: DataFrame, k: int = 8) -> DataFrame:
    """Largest sub-merchants by volume with their most frequent descriptor."""
    by_descriptor = (
        tx.filter(valid_string(F.col("sub_merchant_id")))
        .groupBy(M, "sub_merchant_id", "merchant_descriptor")
        .agg(F.count("*").alias("n"), F.sum(F.abs("settlement_amount_usd")).alias("amt"))
    )
    subs = by_descriptor.groupBy(M, "sub_merchant_id").agg(
        F.min(
            F.when(
                valid_string(F.col("merchant_descriptor")),
                F.struct((-F.col("n")).alias("rank"), "merchant_descriptor"),
            )
        ).alias("_top"),
        F.sum("n").alias("txns"),
        F.sum("amt").alias("volume"),
    )
    named = subs.select(
        M, "sub_merchant_id",
        F.coalesce("_top.merchant_descriptor", F.lit("—")).alias("descriptor"), "txns", "volume",
    )
    order = [F.desc("volume"), F.asc("sub_merchant_id")]
    return top_per_key(named, [M], order, k, ["sub_merchant_id"], rank_col="place")


def recent_months(tx: DataFrame, k: int = 12) -> DataFrame:
    """Absolute volume of the last k months present."""
    monthly = tx.groupBy(M, F.date_format("transaction_datetime_utc", "yyyy-MM").alias("month")).agg(
        F.sum(F.abs("settlement_amount_usd")).alias("volume")
    )
    return top_per_key(monthly, [M], [F.desc("month")], k, ["month"])


def descriptor_timeline(tx: DataFrame, k: int = 8) -> DataFrame:
    """Descriptors in order of first use, with their share of the merchant's rows."""
    seen = stage_table(
        tx.filter(valid_string(F.col("merchant_descriptor")))
        .groupBy(M, "merchant_descriptor")
        .agg(F.min("transaction_datetime_utc").alias("first_seen"), F.count("*").alias("txns")),
        "descriptors_seen",
    )
    totals = seen.groupBy(M).agg(F.sum("txns").alias("_total"))
    order = [F.asc("first_seen"), F.asc("merchant_descriptor")]
    first = top_per_key(seen, [M], order, k, ["merchant_descriptor"], rank_col="place")
    return (
        first.join(totals, M)
        .withColumn("share", F.col("txns") / F.col("_total"))
        .drop("_total")
    )


def cash_histogram(tx: DataFrame, edges: list[float] = ref.CASH_HISTOGRAM_EDGES) -> DataFrame:
    """Absolute amounts by fixed edges, empty buckets included."""
    amount = F.abs("settlement_amount_usd")
    bounds = list(zip(edges, [*edges[1:], math.inf]))
    counts = tx.groupBy(M).agg(
        *[F.count_if((amount >= lo) & (amount < hi)).alias(f"b{i}") for i, (lo, hi) in enumerate(bounds)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("bucket"), F.lit(lo).alias("lower"), F.col(f"b{i}").alias("n"))
            for i, (lo, _) in enumerate(bounds)
        ]
    )
    return counts.select(M, F.inline(rows))


def round_comb(tx: DataFrame, top: int | None = None) -> DataFrame:
    """Transactions at exact multiples of 100, by amount (a chart may stop at ``top``)."""
    amount = F.abs("settlement_amount_usd")
    nearest = F.rint(amount / 100) * 100
    return (
        tx.filter((F.abs(amount - nearest) < 0.01) & (nearest >= 100))
        .filter(F.lit(True) if top is None else nearest <= top)
        .groupBy(M, nearest.cast("long").alias("amount"))
        .agg(F.count("*").alias("n"))
    )


# -------------------------------------------------------------- deviations
def deviations(scores_z: DataFrame, hot: float = 1.5, min_peers: int = 5) -> DataFrame:
    """Per flagged merchant and family feature: value, z, baseline and multiple.

    The baseline is what the declared category expects, else the exact median of
    the peer group. Medians come from value counts, never from one group in a task.
    """
    features = sorted({f for specs in ref.FAMILY_DEVIATIONS.values() for f, _ in specs})
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]
    )
    long = scores_z.select("mcc_group", F.inline(pairs))
    peers = long.groupBy("mcc_group", "feature").agg(F.count("*").alias("_peers"))
    medians = exact_percentiles(
        value_counts(long, ["mcc_group", "feature"], "v"), ["mcc_group", "feature"], "v",
        {"_median": 0.5},
    )
    baselines = peers.join(medians, ["mcc_group", "feature"], "left")

    wanted = F.array().cast("array<struct<feature:string,value:double,z:double,expected:double>>")
    for family, specs in ref.FAMILY_DEVIATIONS.items():
        items = F.array(
            *[
                F.struct(
                    F.lit(f).alias("feature"),
                    finite_or(F.col(f)).alias("value"),
                    finite_or(F.col(f"z_{f}")).alias("z"),
                    (F.col(e).cast("double") if e else F.lit(None).cast("double")).alias("expected"),
                )
                for f, e in specs
            ]
        )
        wanted = F.when(F.col("family") == family, items).otherwise(wanted)
    rows = scores_z.filter("flag_for_investigation = 1").select(
        M, "family", "mcc_group", F.inline(wanted)
    )
    median = F.when(F.col("_peers") >= min_peers, F.col("_median"))
    baseline = F.coalesce("expected", median)
    return (
        rows.join(baselines, ["mcc_group", "feature"], "left")
        .withColumn("baseline", baseline)
        .withColumn(
            "baseline_kind",
            F.when(F.col("expected").isNotNull(), F.lit("expected")).when(
                median.isNotNull(), F.lit("peer median")
            ),
        )
        .withColumn(
            "multiple",
            F.when(F.abs("baseline") > 1e-9, F.col("value") / F.col("baseline")),
        )
        .withColumn("hot", F.abs("z") >= hot)
        .select(M, "family", "feature", "value", "z", "baseline", "baseline_kind", "multiple", "hot")
    )


def composite_drivers(
    scores_z: DataFrame, weights: dict[str, float] = ref.COMPOSITE_WEIGHTS, k: int = 6
) -> DataFrame:
    """Positive contributions to the composite of each flagged merchant, top k."""
    root = math.sqrt(sum(abs(w) for w in weights.values()))
    parts = F.array(
        *[
            F.struct(
                (F.col(f"z_{f}") * F.lit(w / root)).alias("contribution"),
                F.lit(f).alias("feature"),
                F.col(f"z_{f}").alias("z"),
                F.lit(float(w)).alias("weight"),
            )
            for f, w in weights.items()
        ]
    )
    positive = F.filter(parts, lambda p: p["contribution"] > 0)
    top = F.slice(F.sort_array(positive, asc=False), 1, k)
    total = F.aggregate(top, F.lit(0.0), lambda acc, p: acc + p["contribution"])
    flagged = scores_z.filter("flag_for_investigation = 1")
    rows = flagged.select(
        M,
        total.alias("_total"),
        F.posexplode(top).alias("_i", "_p"),
    )
    return rows.select(
        M,
        (F.col("_i") + 1).alias("place"),
        "_p.feature",
        "_p.z",
        "_p.weight",
        "_p.contribution",
        (F.col("_p.contribution") / F.col("_total") * 100).alias("share"),
    )


def composite_reconstruction(
    scores_z: DataFrame, weights: dict[str, float] = ref.COMPOSITE_WEIGHTS
) -> DataFrame:
    """The composite z rebuilt as the plain sum of all contributions."""
    root = math.sqrt(sum(abs(w) for w in weights.values()))
    total = sum((F.col(f"z_{f}") * F.lit(w / root) for f, w in weights.items()), F.lit(0.0))
    return scores_z.select(M, "integrity_composite_z", total.alias("reconstructed_z"))


def rule_checks(scores: DataFrame) -> DataFrame:
    """Clause by clause: actual value, threshold and outcome of the family's rule."""
    ops = {
        ">": lambda a, t: a > t, ">=": lambda a, t: a >= t,
        "<": lambda a, t: a < t, "<=": lambda a, t: a <= t,
    }
    clauses = F.array().cast(
        "array<struct<rule:string,feature:string,actual:double,op:string,threshold:double,pass:boolean>>"
    )
    for family, (rule, specs) in ref.FAMILY_RULE_CHECKS.items():
        items = []
        for feature, op, threshold in specs:
            actual = finite_or(F.col(feature))
            items.append(
                F.struct(
                    F.lit(rule).alias("rule"),
                    F.lit(feature).alias("feature"),
                    actual.alias("actual"),
                    F.lit(op).alias("op"),
                    F.lit(threshold).alias("threshold"),
                    ops[op](actual, F.lit(threshold)).alias("pass"),
                )
            )
        clauses = F.when(F.col("family") == family, F.array(*items)).otherwise(clauses)
    routed = (
        F.when(F.col("flag_reason") == "model + rule", F.lit("both"))
        .when(F.col("flag_reason") == "rule", F.lit("rule"))
        .otherwise(F.lit("model"))
    )
    return scores.filter("flag_for_investigation = 1").select(
        M, "family", routed.alias("routed_by"), F.inline(clauses)
    )

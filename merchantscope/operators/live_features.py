"""Features of the live engine, per merchant over approved transactions.

Same construction as the batch features: one base pass plus pre-aggregates on
(merchant, dimension), (merchant, card, slice), (merchant, amount) and
(merchant, hour), each map-side combined. The finer the key, the less that combines:
the rows of ordinary merchants are exchanged once instead, for all of these
(``merchant_flow``), and only crowded merchants take the pre-aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantscope import live_reference as live
from merchantscope.functions import text
from merchantscope.functions.numeric import entropy_from_sums, flag, ratio0, round_half_up
from merchantscope.operators.features import CROWD_ROWS, crowded_merchants, per_merchant
from merchantscope.operators.ordering import exact_percentiles
from merchantscope.session import stage_table

M = "merchant_id"


def approved(tx: DataFrame) -> DataFrame:
    return tx.filter(F.col("authorization_status") == "approved")


def _purchase() -> Column:
    return ~F.coalesce("refund", F.lit(False)) & (F.col("amount") > 0)


def is_night(ts: Column) -> Column:
    return (F.hour(ts) >= 22) | (F.hour(ts) < 4)


def base_features(ok: DataFrame, within: list[Column] | None = None) -> DataFrame:
    """Counts, sums and ratios of approved rows per merchant (and per ``within``, e.g. a time window)."""
    buy = _purchase()
    bought = F.when(buy, F.col("amount"))
    n = F.count("*").cast("double")
    purchases = F.greatest(F.count_if(buy), F.lit(1)).cast("double")

    def ratio(cond: Column) -> Column:
        return F.sum(flag(cond)) / n

    low = live.MONITORING_THRESHOLD * 0.9
    near = buy & F.col("amount").between(low, live.MONITORING_THRESHOLD)
    rounded = buy & (F.col("amount") >= 5) & (F.col("amount") % 10 == 0)
    return ok.groupBy(M, *(within or [])).agg(
        F.count("*").alias("txn_count"),
        F.count_if(buy).alias("purchase_count"),
        F.coalesce(F.sum(bought), F.lit(0.0)).alias("total_volume"),
        F.coalesce(F.avg(bought), F.lit(0.0)).alias("avg_ticket"),
        F.coalesce(F.stddev_pop(bought), F.lit(0.0)).alias("std_ticket"),
        (F.sum(flag(rounded)) / purchases).alias("round_dollar_ratio"),
        ratio(F.col("ecommerce")).alias("card_not_present_ratio"),
        ratio(F.col("cross_border")).alias("cross_border_ratio"),
        ratio(F.col("entry_mode") == "fallback").alias("fallback_ratio"),
        ratio(F.col("entry_mode") == "manual").alias("manual_entry_ratio"),
        ratio(is_night(F.col("event_ts"))).alias("night_ratio"),
        ratio(F.weekday("event_ts") >= 5).alias("weekend_ratio"),
        ratio(F.col("refund")).alias("refund_rate"),
        ratio(F.col("reversal")).alias("reversal_rate"),
        ratio(F.col("dispute")).alias("dispute_rate"),
        ratio(F.col("dispute") & (F.col("dispute_reason") == live.NOT_RECOGNISED)).alias(
            "not_recognized_dispute_rate"
        ),
        (F.sum(flag(F.col("refund"))) / purchases).alias("refund_after_purchase_ratio"),
        ratio(F.col("cash_equivalent")).alias("cash_equivalent_ratio"),
        ratio(F.col("wallet_load")).alias("wallet_load_ratio"),
        (F.sum(flag(near)) / purchases).alias("threshold_proximity_ratio"),
        (
            F.coalesce(F.stddev_pop("latitude"), F.lit(0.0))
            + F.coalesce(F.stddev_pop("longitude"), F.lit(0.0))
        ).alias("geo_dispersion"),
    )


def diversity_features(ok: DataFrame) -> DataFrame:
    """Descriptor and product-signal entropy (base 2), and volume per active hour."""
    named = ok.select(
        M,
        F.col("merchant_descriptor").alias("descriptor"),
        F.col("product_signal").alias("signal"),
        F.date_trunc("hour", "event_ts").cast("string").alias("hour"),
    )
    counts = (
        named.unpivot([M], ["descriptor", "signal", "hour"], "dim", "val")
        .groupBy(M, "dim", "val")
        .agg(F.count("*").cast("double").alias("n"))
    )

    def of(dim: str, x: Column) -> Column:
        return F.when(F.col("dim") == dim, x)

    n = F.col("n")

    def entropy(dim: str) -> Column:
        return entropy_from_sums(
            F.sum(of(dim, n)), F.sum(of(dim, n * F.ln(n))), F.count(of(dim, n)), base=2.0
        )

    return counts.groupBy(M).agg(
        F.count(of("descriptor", n)).alias("descriptor_count"),
        entropy("descriptor").alias("descriptor_entropy"),
        entropy("signal").alias("category_diversity"),
        (F.sum(of("hour", n)) / F.count(of("hour", n))).alias("velocity_per_active_hour"),
    )


def card_slices(ok: DataFrame, seconds: int = live.RAPID_REPEAT_SECONDS) -> DataFrame:
    """(merchant, card, slice of ``seconds``): rows and first and last instant."""
    us = F.unix_micros(F.col("event_ts").cast("timestamp"))
    return (
        ok.withColumn("us", us)
        .groupBy(M, "card_id", F.floor(F.col("us") / (seconds * 1_000_000)).alias("slice"))
        .agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    )


def card_features(slices: DataFrame, seconds: int = live.RAPID_REPEAT_SECONDS) -> DataFrame:
    """Unique and repeated cards, and repeats on a card within ``seconds``.

    Rows of one slice follow each other within the limit, so each but the first is
    a rapid repeat; between slices the neighbouring instants decide.
    """
    before = F.lag("last_us").over(Window.partitionBy(M, "card_id").orderBy("slice"))
    near = (F.col("first_us") - F.col("before")) <= seconds * 1_000_000
    per_card = (
        slices.withColumn("before", before)
        .groupBy(M, "card_id")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") - 1 + flag(near)).alias("rapid"),
        )
    )
    total = F.sum("n").cast("double")
    return per_card.groupBy(M).agg(
        (F.count("*") / total).alias("unique_card_ratio"),
        (F.count_if(F.col("n") > 1) / F.count("*")).alias("repeat_card_ratio"),
        (F.sum("rapid") / total).alias("rapid_repeat_ratio"),
    )


def ticket_features(ok: DataFrame) -> DataFrame:
    """Median, p95 and quartile spread of purchase amounts."""
    counts = stage_table(
        ok.filter(_purchase()).groupBy(M, "amount").agg(F.count("*").alias("n")), "ticket_counts"
    )
    q = exact_percentiles(
        counts, [M], "amount", {"median_ticket": 0.5},
        floor={"p95_ticket": 0.95, "_q1": 0.25, "_q3": 0.75},
    )
    return _with_bimodality(q)


def _with_bimodality(quantiles: DataFrame) -> DataFrame:
    spread = (F.col("_q3") - F.col("_q1")) / (F.col("median_ticket") + 1)
    return quantiles.withColumn(
        "ticket_bimodality",
        F.when(F.col("median_ticket") > 0, F.least(F.lit(1.0), spread)).otherwise(F.lit(0.0)),
    ).drop("_q1", "_q3")


def change_point(ok: DataFrame) -> DataFrame:
    """Shift of channel and ticket between the halves split at the median instant.

    Hours are summed up per merchant first; the median row lies in one of them, and
    only that hour's rows are looked at again, by instant. So the fact is never dealt
    out by merchant, and what is stored has one row per merchant and hour.
    """
    us = F.unix_micros(F.col("event_ts").cast("timestamp"))
    positive = F.col("amount") > 0
    rows = ok.select(M, us.alias("us"), F.floor(us / F.lit(3_600_000_000)).alias("hour"), "amount", "ecommerce")
    sums = {
        "n": F.count("*"),
        "remote": F.sum(flag(F.col("ecommerce"))),
        "amt": F.coalesce(F.sum(F.when(positive, F.col("amount"))), F.lit(0.0)),
        "paid": F.count_if(positive),
    }
    measures = [a.alias(c) for c, a in sums.items()]
    hours = stage_table(rows.groupBy(M, "hour").agg(*measures), "merchant_hours")
    whole = Window.partitionBy(M)

    def before(order: str) -> list[Column]:
        upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_{order}") for c in sums]

    split = hours.select(M, "hour", "n", *before("hour"), *[F.sum(c).over(whole).alias(f"{c}_all") for c in sums])
    middle = F.floor(F.col("n_all") / 2) - F.col("n_hour")  # place of the median row in its hour
    split = split.filter((middle >= 0) & (middle < F.col("n"))).withColumn("middle", middle).drop("n")
    near = rows.join(split.select(M, "hour"), [M, "hour"]).groupBy(M, "us").agg(*measures)
    instants = near.select(M, "n", *before("us")).join(split, M)
    at = instants.filter((F.col("middle") >= F.col("n_us")) & (F.col("middle") < F.col("n_us") + F.col("n")))
    early = {c: (F.col(f"{c}_hour") + F.col(f"{c}_us")).cast("double") for c in sums}
    late = {c: F.col(f"{c}_all").cast("double") - early[c] for c in sums}

    def shift(num: str, den: str) -> Column:
        return F.abs(ratio0(late[num], late[den]) - ratio0(early[num], early[den]))

    score = shift("remote", "n") + shift("amt", "paid") / 300
    return at.select(M, F.least(F.lit(1.0), score).alias("change_point_score"))


def merchant_flow(ok: DataFrame, seconds: int = live.RAPID_REPEAT_SECONDS) -> DataFrame:
    """Diversity, card, ticket and change features of merchants that fit one task.

    Every window holds the merchant, so all follow one exchange and nothing is stored in
    between. A descriptor, signal or card is told by its first row, an hour by the first
    row of its time; tickets and the median instant by the place of a row in its order.
    """
    us = F.unix_micros(F.col("event_ts").cast("timestamp"))
    rows = ok.select(
        M, "card_id", "amount", "ecommerce", F.coalesce(_purchase(), F.lit(False)).alias("buy"), us.alias("us"),
        F.col("merchant_descriptor").alias("descriptor"), F.col("product_signal").alias("signal"),
    )
    for dim in ("descriptor", "signal"):
        same = Window.partitionBy(M, dim)
        first = F.row_number().over(same.orderBy("us")) == 1
        rows = rows.withColumn(f"{dim}_n", F.when(first, F.count("*").over(same).cast("double"))).drop(dim)
    card = Window.partitionBy(M, "card_id").orderBy("us")
    gap = F.col("us") - F.lag("us").over(card)
    rows = rows.withColumns({"use": F.row_number().over(card), "gap": gap}).drop("card_id")
    bought = Window.partitionBy(M, "buy")
    rows = rows.withColumns({
        "place": F.row_number().over(bought.orderBy("amount")) - 1, "bought": F.count("*").over(bought),
    })
    whole = Window.partitionBy(M)
    hour = F.floor(F.col("us") / F.lit(3_600_000_000))
    before = F.lag(hour).over(whole.orderBy("us"))
    at = F.row_number().over(whole.orderBy("us")) - 1
    rows = rows.withColumns({"at": at, "new_hour": (at == 0) | ~before.eqNullSafe(hour), "all": F.count("*").over(whole)})
    middle = F.max(F.when(F.col("at") == F.floor(F.col("all") / 2), F.col("us"))).over(whole)
    rows = rows.withColumn("middle", middle)

    n = F.count("*").cast("double")

    def entropy(dim: str) -> Column:
        x = F.col(f"{dim}_n")
        return entropy_from_sums(F.sum(x), F.sum(x * F.ln(x)), F.count(x), base=2.0)

    def ticket(p: float, side: Callable[[Column], Column]) -> Column:
        wanted = side(F.lit(float(p)) * (F.col("bought") - 1))
        return F.max(F.when(F.col("buy") & (F.col("place") == wanted), F.col("amount")))

    position = F.lit(0.5) * (F.max(F.when(F.col("buy"), F.col("bought"))) - 1)
    low, high = ticket(0.5, F.floor), ticket(0.5, F.ceil)
    # Rows of one card without a time follow each other; they come first in its order.
    rapid = (F.col("use") > 1) & (F.col("us").isNull() | (F.col("gap") <= seconds * 1_000_000))
    early = F.col("us").isNull() | (F.col("us") < F.col("middle"))
    positive = F.col("amount") > 0

    def halves(x: Column) -> list[Column]:
        part = F.coalesce(F.sum(F.when(early, x)), F.lit(0)).cast("double")
        return [part, F.coalesce(F.sum(x), F.lit(0)).cast("double") - part]

    counted = halves(F.lit(1))
    remote, paid = halves(flag(F.col("ecommerce"))), halves(flag(positive))
    amount = halves(F.when(positive, F.col("amount")))

    def shift(num: list[Column], den: list[Column]) -> Column:
        return F.abs(ratio0(num[1], den[1]) - ratio0(num[0], den[0]))

    score = F.least(F.lit(1.0), shift(remote, counted) + shift(amount, paid) / 300)
    cards = F.count_if(F.col("use") == 1)
    return _with_bimodality(rows.groupBy(M).agg(
        F.count("descriptor_n").alias("descriptor_count"),
        entropy("descriptor").alias("descriptor_entropy"),
        entropy("signal").alias("category_diversity"),
        (n / F.count_if("new_hour")).alias("velocity_per_active_hour"),
        (cards / n).alias("unique_card_ratio"),
        (F.count_if(F.col("use") == 2) / cards).alias("repeat_card_ratio"),
        (F.sum(flag(rapid)) / n).alias("rapid_repeat_ratio"),
        (low + (position - F.floor(position)) * (high - low)).alias("median_ticket"),
        ticket(0.95, F.floor).alias("p95_ticket"),
        ticket(0.25, F.floor).alias("_q1"),
        ticket(0.75, F.floor).alias("_q3"),
        F.when(F.max("middle").isNotNull(), score).alias("change_point_score"),
    ))


def merchant_spread(ok: DataFrame) -> DataFrame:
    """The columns of ``merchant_flow`` for merchants of any size."""
    wide = diversity_features(ok)
    for part in (card_features(card_slices(ok)), ticket_features(ok), change_point(ok)):
        wide = wide.join(part, M, "left")
    return wide


def profile_array(profiles: DataFrame) -> DataFrame:
    """All category profiles as one array in one row.

    The codes are a fixed public list of a few hundred; a row-local array lets each
    merchant be compared with all of them without a join.
    """
    return profiles.agg(
        F.sort_array(F.collect_list(F.struct(
            "mcc", "category", "parent_category", "risk_tier", "typical_card_present_ratio",
            "typical_night_ratio", "ticket_lo", "ticket_hi", "typical_dispute_rate",
            "expected_keywords",
        ))).alias("_profiles")
    )


def expected_ticket(lo: Column, hi: Column) -> Column:
    return F.sqrt(F.greatest(lo, F.lit(1.0)) * F.greatest(hi, lo + 1))


def divergence(features: DataFrame, profiles: DataFrame) -> DataFrame:
    """Distance of observed behaviour from the declared category's profile."""
    own = profiles.select(
        F.col("mcc").alias("declared_mcc"),
        F.struct("typical_card_present_ratio", "typical_night_ratio", "ticket_lo", "ticket_hi",
                 "typical_dispute_rate").alias("_own"),
    )
    fallback = own.filter(F.col("declared_mcc") == live.FALLBACK_PROFILE_MCC).agg(
        F.max("_own").alias("_fallback")
    )
    joined = features.join(own, "declared_mcc", "left").crossJoin(F.broadcast(fallback))
    p = F.coalesce("_own", "_fallback")
    ticket = expected_ticket(p["ticket_lo"], p["ticket_hi"])
    cnp_gap = F.abs(F.col("card_not_present_ratio") - (1 - p["typical_card_present_ratio"]))
    night_gap = F.abs(F.col("night_ratio") - p["typical_night_ratio"])
    ticket_gap = F.least(
        F.lit(1.0), F.abs(F.ln((F.col("avg_ticket") + 1) / (ticket + 1))) / 2
    )
    dispute_gap = F.least(
        F.lit(1.0), F.abs(F.col("dispute_rate") - p["typical_dispute_rate"]) / 0.05
    )
    return joined.withColumn(
        "mcc_divergence",
        round_half_up(0.4 * cnp_gap + 0.3 * night_gap + 0.2 * ticket_gap + 0.1 * dispute_gap, 4),
    ).drop("_own", "_fallback")


def profile_text_features(merchants: DataFrame) -> DataFrame:
    """Descriptor features that need the merchant profile only."""
    d = F.col("descriptor")
    return merchants.withColumns(
        {
            "descriptor_name_similarity": round_half_up(
                text.edit_similarity(d, F.col("trade_name")), 4
            ),
            "brand_mimic_score": round_half_up(
                text.best_brand_similarity(d, live.KNOWN_BRANDS), 4
            ),
            "generic_token_ratio": round_half_up(
                text.generic_share(d, live.LIVE_GENERIC_TOKENS), 4
            ),
        }
    )


_ROUND = {
    "total_volume": 2, "avg_ticket": 2, "median_ticket": 2, "std_ticket": 2, "p95_ticket": 2,
    "velocity_per_active_hour": 3,
}


def merchant_features(
    tx: DataFrame, merchants: DataFrame, profiles: DataFrame, crowd: int = CROWD_ROWS
) -> DataFrame:
    """Profile plus all transaction features; a merchant without rows gets zeros.

    ``crowd`` only routes (see ``per_merchant``).
    """
    ok = approved(tx)
    parts = [
        base_features(ok),
        per_merchant(ok, crowded_merchants(ok, crowd), merchant_flow, merchant_spread),
    ]
    wide = profile_text_features(merchants)
    made: list[str] = []
    for part in parts:
        made += [c for c in part.columns if c != M]
        wide = wide.join(part, M, "left")
    wide = wide.na.fill(0, made)
    counts = {"txn_count", "purchase_count", "descriptor_count"}
    wide = wide.withColumns(
        {c: round_half_up(F.col(c), _ROUND.get(c, 4)) for c in made if c not in counts}
    )
    return divergence(wide, profiles)

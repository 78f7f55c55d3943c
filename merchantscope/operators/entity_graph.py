"""Shared-infrastructure graph: counts, known-bad adjacency, bounded expansion.

Merchants are never paired with each other. Counts come from the size of each
entity; expansion looks only at the first few members of an entity, which is enough
to find the neighbours it reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantscope import live_reference as live
from merchantscope.functions.numeric import clamp, round_half_up
from merchantscope.operators.ranking import top_per_key

M = "merchant_id"


def memberships(merchants: DataFrame) -> DataFrame:
    """(merchant, kind, entity, place): bank, owner, each IP cluster and device."""
    def listed(kind: str, col: str):
        return F.transform(
            F.coalesce(F.col(col), F.array().cast("array<string>")),
            lambda e, i: F.struct(F.lit(kind).alias("kind"), e.alias("entity_id"), i.alias("place")),
        )

    def single(kind: str, col: str):
        return F.array(
            F.struct(F.lit(kind).alias("kind"), F.col(col).alias("entity_id"), F.lit(0).alias("place"))
        )

    entries = F.concat(
        single("bank", "settlement_bank_account_id"),
        single("owner", "beneficial_owner_id"),
        listed("ip", "ip_cluster_ids"),
        listed("device", "device_ids"),
    )
    return merchants.select(M, F.inline(entries)).filter(F.col("entity_id").isNotNull())


def neighbour_counts(members: DataFrame) -> DataFrame:
    """Per merchant and kind: sum over its entities of (members of the entity - 1)."""
    sizes = members.groupBy("kind", "entity_id").agg(F.count("*").alias("_size"))
    return (
        members.join(sizes, ["kind", "entity_id"])
        .groupBy(M)
        .pivot("kind", ["bank", "owner", "ip", "device"])
        .agg(F.sum(F.col("_size") - 1))
        .na.fill(0)
        .select(
            M,
            F.col("bank").alias("shared_bank_account_count"),
            F.col("ip").alias("shared_ip_count"),
            F.col("device").alias("shared_device_count"),
        )
    )


def submerchant_counts(merchants: DataFrame) -> DataFrame:
    """Merchants behind each facilitator, reported for the facilitator itself."""
    sizes = (
        merchants.filter(F.col("payment_facilitator_id").isNotNull())
        .groupBy("payment_facilitator_id")
        .agg(F.count("*").alias("submerchant_count"))
    )
    return (
        merchants.filter(F.col("merchant_type") == "facilitator")
        .select(M, "payment_facilitator_id")
        .join(sizes, "payment_facilitator_id")
        .select(M, "submerchant_count")
    )


def known_bad_adjacency(members: DataFrame, known_bad: DataFrame) -> DataFrame:
    """Strongest weight of a known-bad entity the merchant uses."""
    weight = F.lit(None).cast("double")
    for kind, w in live.ADJACENCY_BY_KIND.items():
        weight = F.when(F.col("kind") == kind, F.lit(w)).otherwise(weight)
    bad = known_bad.select("kind", "entity_id").distinct()
    return (
        members.join(bad, ["kind", "entity_id"])
        .groupBy(M)
        .agg(F.max(weight).alias("known_bad_adjacency"))
    )


def graph_metrics(merchants: DataFrame, known_bad: DataFrame) -> DataFrame:
    """Shared counts, submerchants, adjacency and the graph score of each merchant."""
    members = memberships(merchants)
    wide = (
        merchants.select(M)
        .join(neighbour_counts(members), M, "left")
        .join(submerchant_counts(merchants), M, "left")
        .join(known_bad_adjacency(members, known_bad), M, "left")
        .na.fill(0)
    )
    score = F.col("known_bad_adjacency") * live.ADJACENCY_WEIGHT
    for col, weight, cap in live.GRAPH_TERMS:
        score = score + F.least(F.col(col), F.lit(cap)) * weight
    return wide.withColumn("graph_score", round_half_up(clamp(score), 1))


# ------------------------------------------------------------- expansion
def neighbours(
    members: DataFrame, centers: DataFrame, k: int = 8, kinds: tuple[str, ...] = ("bank", "ip", "device")
) -> DataFrame:
    """The first k merchants sharing a bank, IP or device with each center.

    Order: by kind, by the entity's place in the center's list, then by id. Of an
    entity only its first k+1 members are looked at: at most k of them can be the
    center itself or already taken, so no neighbour is missed.
    """
    linked = members.filter(F.col("kind").isin(*kinds))
    heads = top_per_key(
        linked.select("kind", "entity_id", F.col(M).alias("neighbour_id")).distinct(),
        ["kind", "entity_id"], [F.asc("neighbour_id")], k + 1, ["neighbour_id"],
    )
    rank = F.lit(len(kinds))
    for i, kind in enumerate(kinds):
        rank = F.when(F.col("kind") == kind, F.lit(i)).otherwise(rank)
    reached = (
        linked.join(centers.select(M), M)
        .join(heads, ["kind", "entity_id"])
        .filter(F.col("neighbour_id") != F.col(M))
        .groupBy(M, "neighbour_id")
        .agg(F.min(F.struct(rank.alias("kind_rank"), "place")).alias("via"))
    )
    order = [F.asc("via"), F.asc("neighbour_id")]
    return top_per_key(reached, [M], order, k, ["neighbour_id"], rank_col="neighbour_rank").drop("via")


def expand(
    merchants: DataFrame, centers: DataFrame, k: int = 8, infra_cap: int = 4
) -> DataFrame:
    """Edges (center, source, target, type) of the bounded graph of each center."""
    members = memberships(merchants)
    own = merchants.join(centers.select(M), M, "left_semi")
    text = F.col(M).cast("string")

    def one(col: str, kind: str):
        return F.array(F.struct(F.col(col).cast("string").alias("target"), F.lit(kind).alias("type")))

    def many(arr, kind: str):
        return F.transform(arr, lambda e: F.struct(e.alias("target"), F.lit(kind).alias("type")))

    empty = F.array().cast("array<string>")
    descriptors = F.concat(F.array("descriptor"), F.coalesce("alternate_descriptors", empty))
    direct = F.concat(
        one("settlement_bank_account_id", "settles-to"),
        one("beneficial_owner_id", "owned-by"),
        one("registered_address_id", "uses-address"),
        one("website_domain", "uses-domain"),
        one("acquirer_id", "processes-through"),
        one("payment_facilitator_id", "processes-through"),
        F.when(
            F.col("descriptor").isNotNull(),
            many(F.transform(descriptors, lambda d: F.concat(F.lit("DESC:"), d)), "shares-descriptor"),
        ).otherwise(F.array().cast("array<struct<target:string,type:string>>")),
        many(F.slice(F.coalesce("ip_cluster_ids", empty), 1, infra_cap), "uses-ip"),
        many(F.slice(F.coalesce("device_ids", empty), 1, infra_cap), "uses-device"),
    )
    own_edges = own.select(
        text.alias("center"), text.alias("source"), F.inline(direct)
    ).filter(F.col("target").isNotNull())

    near = neighbours(members, centers, k)
    edge_type = (
        F.when(F.col("kind") == "bank", F.lit("settles-to"))
        .when(F.col("kind") == "ip", F.lit("uses-ip"))
        .otherwise(F.lit("uses-device"))
    )
    theirs = members.filter(F.col("kind") != "owner").select(
        F.col(M).alias("neighbour_id"), "kind", "entity_id"
    )
    mine = members.select(M, "kind", "entity_id").distinct()
    shared = (
        near.join(mine, M)
        .join(theirs, ["neighbour_id", "kind", "entity_id"])
        .select(
            text.alias("center"), F.col("neighbour_id").cast("string").alias("source"),
            F.col("entity_id").alias("target"), edge_type.alias("type"),
        )
    )

    subs = top_per_key(
        merchants.filter(F.col("payment_facilitator_id").isNotNull()).select(
            "payment_facilitator_id", F.col(M).alias("sub_id")
        ),
        ["payment_facilitator_id"], [F.asc("sub_id")], k, ["sub_id"],
    )
    sub_edges = (
        own.filter(F.col("merchant_type") == "facilitator")
        .join(subs, "payment_facilitator_id")
        .filter(F.col("sub_id") != F.col(M))
        .select(
            text.alias("center"), F.col("payment_facilitator_id").alias("source"),
            F.col("sub_id").cast("string").alias("target"),
            F.lit("processes-through").alias("type"),
        )
    )
    return own_edges.unionByName(shared).unionByName(sub_edges)


def graph_nodes(edges: DataFrame, known_bad: DataFrame, risks: DataFrame) -> DataFrame:
    """Nodes of the expanded graphs with type, risk and the known-bad mark.

    ``risks`` holds (merchant_id, risk). Infrastructure nodes carry fixed risks.
    """
    by_type = {
        "settles-to": ("bank", 20.0, 95.0), "owned-by": ("owner", 25.0, 95.0),
        "uses-address": ("address", 15.0, 15.0), "uses-domain": ("domain", 20.0, 20.0),
        "uses-ip": ("ip", 18.0, 92.0), "uses-device": ("device", 18.0, 92.0),
        "shares-descriptor": ("descriptor", 22.0, 22.0),
        "processes-through": ("processor", 12.0, 12.0),
    }
    kind, calm, hot = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double")
    for t, (name, low, high) in by_type.items():
        here = F.col("type") == t
        kind = F.when(here, F.lit(name)).otherwise(kind)
        calm = F.when(here, F.lit(low)).otherwise(calm)
        hot = F.when(here, F.lit(high)).otherwise(hot)
    people = risks.select(F.col(M).cast("string").alias("node"), F.col("risk").alias("_risk"))
    ends = edges.select("center", F.col("target").alias("node"), "type").unionByName(
        edges.select("center", F.col("source").alias("node"), F.lit(None).cast("string").alias("type"))
    )
    distinct = ends.groupBy("center", "node").agg(F.min("type").alias("type"))
    bad = known_bad.select(F.col("entity_id").alias("node"), F.lit(True).alias("_bad")).distinct()
    is_bad = F.coalesce("_bad", F.lit(False))
    return (
        distinct.join(people, "node", "left")
        .join(bad, "node", "left")
        .select(
            "center", "node",
            F.when(F.col("_risk").isNotNull(), F.lit("merchant")).otherwise(kind).alias("type"),
            F.coalesce("_risk", F.when(is_bad, hot).otherwise(calm)).alias("risk"),
            is_bad.alias("known_bad"),
        )
    )

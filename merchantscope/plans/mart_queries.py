"""Driver queries on the score table: marts, explorer, evaluation, drill-down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantscope import reference as ref
from merchantscope.operators import (
    anatomy as an, detection as dt, evaluation as ev, explorer as ex, overview as ov,
    registry as rg, scoring as sc, surcharge as su,
)
from merchantscope.plans.workbench import Workbench, tidy
from merchantscope.session import stage_table
from merchantscope.sources import catalog
from merchantscope.sources import substrings as sb

M = "merchant_id"
SIGNALS = ["pct_cnp", "pct_quasi_cash", "pct_round_100", "chargeback_rate_bps", "avg_ticket_usd"]


def named_scores(b: Workbench) -> DataFrame:
    """Scores with DBA and corporation names (both joins on the merchant grain)."""
    return b.scores.join(b.merchants.select(M, "dba_name", "corp_name"), M, "left")


def labelled_scores(b: Workbench) -> DataFrame:
    return b.scores.join(b.fixture.labels(), M, "left")


def explorer_merchants(b: Workbench) -> DataFrame:
    return ex.merchant_view(named_scores(b), sc.coarse_label(b.fixture.labels()))


def mart(make):
    return lambda b: tidy(make(b.scores))


def headline(b):
    return tidy(ov.headline(b.scores))


def priority_queue(b):
    return tidy(ov.priority_queue(b.scores).withColumn("rules", F.size("rules")))


def hierarchy(b):
    return tidy(
        ov.hierarchy_rollup(named_scores(b)).withColumn("entity_id", F.col("entity_id").cast("long"))
    )


def trend(b):
    return tidy(ov.monthly_trend(b.tx, b.scores))


def cohort(b):
    """Merchants of one family and category, each column that a case list shows."""
    shown = [M, "merchant_name", "family", "top_category", "risk_tier", "integrity_risk_score",
             "gross_sales_usd", "flag_for_investigation"]
    return tidy(ov.cohort(b.scores, "cash", "crypto_cash").select(*shown))


def search(b):
    cols = [M, "merchant_name"]
    return tidy(
        ov.entity_search(b.scores, "#00000000", cols, "integrity_risk_score", k=20).select(
            M, "merchant_name", "integrity_risk_score"
        )
    )


def indexed_search(b):
    """The same search through the stored trigrams of ids and names."""
    found = sb.indexed_search(b.merchant_index, b.scores, M, "#00000000", "integrity_risk_score", k=20)
    return tidy(found.select(M, "merchant_name", "integrity_risk_score"))


def part_search(b):
    """Words of the parts' types and beginnings of their names, each looked up in all names and types."""
    part = b.fixture.table("part")
    words = part.select(F.explode(F.split("p_type", " ")).alias("needle"))
    needles = words.unionByName(part.select(F.substring("p_name", 1, 2).alias("needle"))).distinct()
    return tidy(b.part_index.find_all(needles).withColumnRenamed("key", "p_partkey"))


def queue(b):
    cased = b.scores.filter(F.col(M) % 10 == 0).select(M)
    view = ov.queue_view(
        dt.with_elevated_signals(b.scores), min_signals=1, text="supplier", cased=cased,
        sort_by="gross_sales_usd",
    )
    return tidy(view.select(M, "family", "top_category", "elevated_signals", "gross_sales_usd"))


# ----------------------------------------------------------------- explorer
def merchant_view(b):
    view = explorer_merchants(b)
    return tidy(view.select(M, "merchant_name", "corp_name", "mcc_group", "family", "subtype",
                            "label", "txn_count", "integrity_risk_score"))


def merchant_view_rows(b):
    """Every column of the merchant view."""
    return tidy(explorer_merchants(b))


SLICE_COLUMNS = [M, "transaction_datetime_utc", "settlement_amount_usd", "card_token_id",
                 "merchant_descriptor", "channel"]


def slice_of(b, **kw):
    return ex.transaction_slice(b.explorer_tx, b.scores, whole=b.whole_pieces, **kw)


def transaction_slice(b):
    return tidy(slice_of(b).select(*SLICE_COLUMNS))


def small_slice(b):
    """Caps that every merchant of a small book passes."""
    return tidy(slice_of(b, flagged_cap=40, clean_sample=15, clean_cap=25).select(*SLICE_COLUMNS))


def slice_rows(b):
    """Every column of the slice that the fact has, with the merchants' names joined to the rows kept."""
    kept = slice_of(b, flagged_cap=40, clean_sample=15, clean_cap=25)
    return tidy(kept.join(b.merchants.select(M, "merchant_name"), M, "left").drop("_piece"))


def preview(b):
    return tidy(ex.preview(b.tx.select(*SLICE_COLUMNS, "split_group_id"), b.scores)
                .select(*SLICE_COLUMNS, "family"))


def flagged_first(b):
    return tidy(ex.flagged_first(b.scores).select(M, "flag_for_investigation", "integrity_risk_score"))


def family_volume(b):
    return tidy(ex.family_volume(b.tx, b.scores), 2)


def metadata(b):
    meta = ex.run_metadata({"merchants": b.merchants, "transactions": b.tx}, {"flaggedCap": "400"})
    return tidy(meta.select("table", "rows"))


REVENUE_BY_REGION = """
SELECT r_name, o_orderpriority, count(*) AS line_items, sum(l_quantity) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY r_name, o_orderpriority"""


def sql_by_cost(b: Workbench) -> DataFrame:
    """A console query over catalog tables, its joins ordered by the tables' statistics."""
    sql = REVENUE_BY_REGION
    for name, stored in b.catalog_tables.items():
        sql = sql.replace(f"FROM {name}\n", f"FROM {stored}\n").replace(f"FROM {name} ", f"FROM {stored} ").replace(f"JOIN {name} ", f"JOIN {stored} ")
    with catalog.by_cost(b.spark):
        ordered = stage_table(b.spark.sql(sql), "by_cost")
    return tidy(ordered)


def table_statistics(b: Workbench) -> DataFrame:
    """Rows and NULLs of every column, as the catalog holds them after its measuring pass."""
    back = {stored: name for name, stored in b.catalog_tables.items()}
    names = F.create_map(*[F.lit(x) for kv in back.items() for x in kv])
    stated = catalog.statistics(b.spark, list(back))
    return tidy(stated.select(names[F.col("table_name")].alias("table_name"), "column_name", "rows", "nulls"))


def sample_sql(name):
    def run(b: Workbench) -> DataFrame:
        # Frames go in by name, so that several folders can be open at once.
        return tidy(catalog.query_over(
            catalog.SAMPLE_QUERIES[name], b.spark,
            {"merchants": explorer_merchants(b), "transactions": b.named_tx},
        ))

    return run


# --------------------------------------------------------------- evaluation
def confusion(b):
    return tidy(ev.confusion(b.fixture.records(), "score", "actual", 62))


def precision_curve(b):
    return tidy(ev.precision_curve(b.fixture.records(), "score", "actual", "exposure"))


def impact_sweep(b):
    return tidy(ev.impact_sweep(b.fixture.records(), "score", "exposure"))


def impact_at(b):
    return tidy(ev.impact_at(b.fixture.records(), "score", "actual", "exposure", 40))


def rank_auc(b):
    return tidy(ev.rank_auc(b.fixture.records(), "exposure", "actual", ["grp"]))


def class_precision(b):
    return tidy(ev.class_precision(b.fixture.records(), "score", "predicted_class",
                                   "actual_class", 30))


def false_positives(b):
    return tidy(ev.false_positives(b.fixture.records(), "score", "actual", 30, "record_id"))


def registry_metrics(b):
    return tidy(rg.evaluate(labelled_scores(b), rg.standard_models()))


def feature_importance(b):
    """Weight shares of every model, with the mean z of flagged merchants beside them."""
    book = sc.ScoreBook()
    shares = ev.weight_importance(b.spark, {**book.models(), "composite": book.composite})
    flagged = b.scored_z.filter("flag_for_investigation = 1").agg(
        *[F.avg(f"z_{f}").alias(f) for f in book.features()]
    )
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_z")) for f in book.features()]
    )
    return tidy(shares.join(flagged.select(F.inline(pairs)), "feature"))


def queue_quality(b):
    """Flag against labels, overall and per class."""
    s = labelled_scores(b)
    flagged = F.col("flag_for_investigation") == 1
    either = F.col("is_integrity_violation") | F.col("is_interchange_abuse")
    return tidy(
        rg.evaluate(
            s,
            [
                rg.Model("queue", flagged, either, F.col("integrity_risk_score")),
                rg.Model("violation", flagged, F.col("is_integrity_violation")),
                rg.Model("abuse", flagged, F.col("is_interchange_abuse")),
            ],
        )
    )


# --------------------------------------------------------------- drill-down
def exemplars(b):
    return tidy(an.exemplars(b.scores).select("family", M, "txn_count", "exposure_weighted_score"))


def evidence_sample(b):
    tagged = an.tagged_rows(
        b.tx.withColumn("recurring_flag", F.when(F.col("channel") == "RECURRING", "Y")),
        b.scores.filter("flag_for_investigation = 1"),
        b.split_ceilings,
    )
    out = an.evidence_sample(tagged)
    return tidy(out.select(M, "family", "transaction_datetime_utc", "settlement_amount_usd",
                           "telling", F.array_join("tells", "|").alias("tells")))


def fingerprint(b):
    out = an.fingerprint(b.scores)
    return tidy(out.select(M, F.array_join("categories", "|").alias("categories"),
                           F.col("scores")[0].alias("top_score"), "lit"))


def fingerprint_rows(b):
    """Each shown category of each merchant with its place and score."""
    shown = an.fingerprint(b.scores).select(M, F.posexplode(F.arrays_zip("categories", "scores")).alias("place", "e"))
    return tidy(shown.select(M, (F.col("place") + 1).alias("place"), F.col("e.categories").alias("category"), F.col("e.scores").alias("score")))


def queue_rules(b):
    """The rules of each merchant in the priority queue, one row each."""
    return tidy(ov.priority_queue(b.scores).select(M, F.posexplode("rules").alias("place", "rule")))


def interchange_signature(b):
    return tidy(an.interchange_signature(b.scores))


def split_groups(b):
    return tidy(an.split_groups(b.tx))


def split_ceilings(b):
    return tidy(b.split_ceilings)


def sub_merchants(b):
    return tidy(an.sub_merchants(b.tx))


def recent_months(b):
    return tidy(an.recent_months(b.tx))


def descriptor_timeline(b):
    return tidy(an.descriptor_timeline(b.tx))


def cash_histogram(b):
    return tidy(an.cash_histogram(b.tx))


def round_comb(b):
    return tidy(an.round_comb(b.tx))


def deviations(b):
    return tidy(an.deviations(_with_dev_z(b)))


def _with_dev_z(b: Workbench) -> DataFrame:
    """Score table with z-scores for the few shown features that no model weighs."""
    shown = {f for specs in ref.FAMILY_DEVIATIONS.values() for f, _ in specs}
    extra = sorted(f for f in shown if f"z_{f}" not in b.scored_z.columns)
    from merchantscope.operators.peers import peer_zscores

    return peer_zscores(b.scored_z, extra) if extra else b.scored_z


def composite_drivers(b):
    return tidy(an.composite_drivers(b.scored_z))


def composite_reconstruction(b):
    return tidy(an.composite_reconstruction(b.scored_z), 3)


def rule_checks(b):
    return tidy(an.rule_checks(b.scores))


# ---------------------------------------------------------------- detection
def elevated_signals(b):
    return tidy(dt.with_elevated_signals(b.scores).select(M, "family", "top_category",
                                                          "elevated_signals"))


def surcharge_signals(b):
    """Signals of the surcharge models for merchants in violation."""
    violating = su.violations(su.assess(b.fixture.surcharging()))
    records = dt.surcharge_records(b.scores, violating)
    return tidy(dt.with_elevated_signals(records).select(M, "family", "top_category", "elevated_signals"))


def detector_rows(b) -> DataFrame:
    """The two portfolio detectors: the composite against labels, and surcharging (severe ones count as confirmed)."""
    composite = [m for m in rg.standard_models() if m.name == "composite"]
    surcharge = [rg.Model("surcharge", F.col("violation") != "", F.col("status") == su.SEVERE)]
    return rg.detector_metrics(labelled_scores(b), composite, "gross_sales_usd").unionByName(
        rg.detector_metrics(su.violations(su.assess(b.fixture.surcharging())), surcharge, "gross_sales_usd"))


def detector_metrics(b):
    return tidy(detector_rows(b))


def detector_rollup(b):
    return tidy(ev.detector_rollup(detector_rows(b)))


def peer_standing(b):
    labelled = b.scores.join(sc.coarse_label(b.fixture.labels()), M)
    return tidy(dt.peer_standing(labelled, SIGNALS))


def peer_histogram(b):
    return tidy(dt.peer_histogram(b.scores, SIGNALS))


# ---------------------------------------------------------------- surcharge
def surcharge_assessment(b):
    out = su.assess(b.fixture.surcharging())
    return tidy(out.select(M, "region", "regime", "surcharge_pct", "over_cap", "violation",
                           "status", F.coalesce(F.array_join("next_steps", "|"), F.lit("")).alias("steps")))


def compliance_matrix(b):
    return tidy(su.compliance_matrix(su.assess(b.fixture.surcharging())))


def surcharge_portfolio(b):
    return tidy(su.portfolio(su.violations(su.assess(b.fixture.surcharging()))))


def surcharge_totals(b):
    return tidy(su.portfolio_totals(su.assess(b.fixture.surcharging())))


QUERIES = {
    "overview_headline": headline,
    "overview_tiers": mart(ov.tier_distribution),
    "family_pivot": mart(ov.family_summary),
    "family_subtypes": mart(ov.family_subtypes),
    "priority_queue": priority_queue,
    "dba_corp_grouping_sets": hierarchy,
    "monthly_trend": trend,
    "cohort": cohort,
    "scope_totals": mart(lambda s: ov.scope_totals(s, ["factoring", "cash"])),
    "rule_hits": mart(ov.rule_hits),
    "cohort_summary": mart(ov.cohort_summary),
    "entity_search": search,
    "indexed_entity_search": indexed_search,
    "indexed_part_search": part_search,
    "queue_view": queue,
    "merchant_view": merchant_view,
    "merchant_view_rows": merchant_view_rows,
    "slice_rows": slice_rows,
    "fingerprint_rows": fingerprint_rows,
    "queue_rules": queue_rules,
    "recent_rows_cap": transaction_slice,
    "recent_rows_small_cap": small_slice,
    "slice_preview": preview,
    "flagged_first": flagged_first,
    "family_volume": family_volume,
    "run_metadata": metadata,
    "sql_by_cost": sql_by_cost,
    "catalog_statistics": table_statistics,
    **{f"sql_{name}": sample_sql(name) for name in catalog.SAMPLE_QUERIES},
    "confusion": confusion,
    "threshold_curve": precision_curve,
    "impact_sweep": impact_sweep,
    "impact_at": impact_at,
    "rank_auc": rank_auc,
    "class_precision": class_precision,
    "false_positives": false_positives,
    "registry_metrics": registry_metrics,
    "feature_importance": feature_importance,
    "queue_quality": queue_quality,
    "exemplars": exemplars,
    "evidence_sample": evidence_sample,
    "category_fingerprint": fingerprint,
    "interchange_signature": interchange_signature,
    "split_groups": split_groups,
    "split_ceilings": split_ceilings,
    "sub_merchants": sub_merchants,
    "recent_months": recent_months,
    "descriptor_timeline": descriptor_timeline,
    "amount_histogram": cash_histogram,
    "round_comb": round_comb,
    "deviations": deviations,
    "composite_drivers": composite_drivers,
    "composite_reconstruction": composite_reconstruction,
    "rule_checks": rule_checks,
    "elevated_signals": elevated_signals,
    "surcharge_signals": surcharge_signals,
    "detector_metrics": detector_metrics,
    "detector_rollup": detector_rollup,
    "peer_standing": peer_standing,
    "peer_histogram": peer_histogram,
    "surcharge_assessment": surcharge_assessment,
    "compliance_matrix": compliance_matrix,
    "surcharge_portfolio": surcharge_portfolio,
    "surcharge_totals": surcharge_totals,
}

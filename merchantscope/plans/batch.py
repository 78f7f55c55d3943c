"""The batch run: settlement book in, feature, score, queue and mart tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantscope import schemas
from merchantscope.operators import activity, anatomy as an, evaluation as ev, explorer as ex
from merchantscope.operators import features as ft, overview as ov, quality as ql, registry as rg
from merchantscope.operators import scoring as sc
from merchantscope.operators.evaluation import binary_metrics
from merchantscope.plans import models
from merchantscope.session import ensure_conf, observed, stage_table
from merchantscope.sources import readers, writers

M = "merchant_id"
#: Feature columns that are shares; the run counts values outside [0, 1] as it writes them.
SHARES = ["pct_cnp", "refund_rate_count", "volume_spike_ratio"]


@dataclass(frozen=True)
class BatchOptions:
    min_txn: int = 3
    lookback_months: int = 12
    min_peers: int = sc.ref.MIN_PEERS
    trees: int = 100


def gated_features(
    book: readers.SettlementBook, audit: DataFrame, mcc_reference: DataFrame, bands: DataFrame,
    options: BatchOptions,
) -> DataFrame:
    """Features over the lookback of the merchants that pass the (stored) audit.

    Filtering merchants after aggregation gives the same rows as filtering
    transactions first, and keeps the fact out of a join.
    """
    if book.latest is not None:
        recent = book.timeline.recent(options.lookback_months)
    else:
        recent = book.transactions.filter(
            activity.within_lookback(book.transactions, options.lookback_months)
        )
    features = ft.merchant_features(recent, book.merchants, mcc_reference, bands)
    return features.join(activity.passing_merchants(audit), M, "left_semi")


def name_entities(scores: DataFrame, dba: DataFrame, corp: DataFrame) -> DataFrame:
    """Scores with DBA and corporation names (small dimensions, left joins)."""
    return scores.join(dba.select("dba_id", "dba_name"), "dba_id", "left").join(
        corp.select("corp_id", "corp_name", "corp_country"), "corp_id", "left"
    )


def run_batch(
    spark: SparkSession,
    folder: str,
    out: str,
    mcc_reference: DataFrame,
    bands: DataFrame | None = None,
    options: BatchOptions | None = None,
    labels: DataFrame | None = None,
    offline: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Run the whole batch over ``folder`` and write its tables below ``out``.

    With ``labels`` the models are measured and the integrity model is fitted; with the
    labelled training features ``offline`` all three models are. Their artifacts are
    written below ``out``/models, and the scores beside them come from the stored ones.

    The written feature and score tables are read back for the steps that follow, so
    the run survives lost executors and never recomputes the fact.
    """
    ensure_conf(spark)
    options = options or BatchOptions()
    book = readers.load_book(spark, folder)
    bands = bands if bands is not None else ft.interchange_bands(spark)

    seen: dict[str, dict] = {}

    def keep(df: DataFrame, name: str, gates: dict[str, Column] | None = None) -> DataFrame:
        watched, seen_here = observed(df, **(gates or {}))
        writers.write_parquet(watched, f"{out}/{name}")
        seen[name] = seen_here.get
        return spark.read.schema(df.schema).parquet(f"{out}/{name}")

    audit = activity.activity_audit(
        book.transactions, options.min_txn, options.lookback_months, book.latest
    )
    tables = {"filter_audit": keep(audit, "filter_audit")}
    features = gated_features(book, tables["filter_audit"], mcc_reference, bands, options)
    tables["merchant_features"] = keep(features, "merchant_features", ql.share_gates(SHARES))
    scored = sc.score_merchants(tables["merchant_features"], min_peers=options.min_peers)
    scores = keep(name_entities(scored, book.dba, book.corp), "merchant_scores")
    tables["merchant_scores"] = scores

    queue = scores.filter("flag_for_investigation = 1").orderBy(
        F.desc("exposure_weighted_score"), M
    )
    writers.write_csv(queue, f"{out}/flagged_merchants")
    tables["entity_rollup"] = keep(ov.hierarchy_rollup(scores), "entity_rollup")
    tables["monthly_trend"] = keep(ov.monthly_trend(book.transactions, scores), "monthly_trend")
    view = keep(ex.merchant_view(scores), "explorer/merchants")
    gates = ql.transaction_gates("card_token_id", "settlement_amount_usd")
    slice_ = keep(ex.transaction_slice(book.transactions, view), "explorer/transactions", gates)
    tables |= {"merchants": view, "transactions": slice_}
    writers.write_json(view, f"{out}/explorer/merchants_json")
    writers.write_document(
        {
            "portfolio": ov.headline(scores),
            "tiers": ov.tier_distribution(scores),
            "families": ov.family_summary(scores),
            "subtypes": ov.family_subtypes(scores),
            "priority": ov.priority_queue(scores),
            "trend": tables["monthly_trend"],
        },
        f"{out}/overview",
    )
    tables |= {f"anatomy/{k}": keep(v, f"anatomy/{k}") for k, v in anatomy_tables(book.transactions, scores).items()}
    cited = tables["anatomy/exemplars"].select(M)
    writers.write_document(
        {k.removeprefix("anatomy/"): v.join(cited, M, "left_semi") for k, v in tables.items() if k.startswith("anatomy/")},
        f"{out}/anatomy_document",
    )
    if labels is not None:
        measured = rg.evaluate(scores.join(labels, M, "left"), rg.standard_models())
        tables["model_registry"] = keep(measured, "model_registry")
        book_ = sc.ScoreBook()
        weights = ev.weight_importance(spark, {**book_.models(), "composite": book_.composite})
        writers.write_document({"models": tables["model_registry"], "weights": weights}, f"{out}/registry_document")
        clean = ~(F.coalesce("is_integrity_violation", F.lit(False)) | F.coalesce("is_interchange_abuse", F.lit(False)))
        marked = scores.join(labels, M, "left").withColumn("is_clean", clean)
        if offline is None:
            store, z = models.ModelStore(spark, f"{out}/models"), models.export_integrity(marked, f"{out}/models")
        else:
            store, z = models.export_models(marked, offline, f"{out}/models", trees=options.trees)
            tables["head_scores"] = keep(store.score_head(store.score_category(offline)), "head_scores")
        tables["model_scores"] = keep(store.score_integrity(z), "model_scores")
    writers.write_json(
        ex.written_metadata(
            spark,
            {"merchants": (view.columns, seen["explorer/merchants"]["rows"]),
             "transactions": (slice_.columns, seen["explorer/transactions"]["rows"])},
            {"min_txn": str(options.min_txn), "lookback_months": str(options.lookback_months)},
        ),
        f"{out}/run_metadata",
    )
    tables["quality"] = ql.gate_rows(spark, seen)
    writers.write_json(tables["quality"], f"{out}/quality")
    return tables


def anatomy_tables(tx: DataFrame, scores: DataFrame) -> dict[str, DataFrame]:
    """Drill-down tables of all flagged merchants (one exemplar per family among them)."""
    flagged = scores.filter("flag_for_investigation = 1")
    groups = stage_table(an.split_groups(tx), "split_groups")
    ceilings = stage_table(an.split_ceilings(an.split_group_amounts(tx, groups)), "split_ceilings")
    return {
        "exemplars": an.exemplars(scores),
        "fingerprint": an.fingerprint(flagged),
        "interchange": an.interchange_signature(flagged),
        "split_groups": groups.join(flagged.select(M), M, "left_semi"),
        "split_ceilings": ceilings.join(flagged.select(M), M, "left_semi"),
        "rule_checks": an.rule_checks(flagged),
        "evidence": an.evidence_sample(an.tagged_rows(tx, flagged, ceilings)),
    }


def queue_quality(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Precision and recall of the queue against labels (evaluation only)."""
    target = F.coalesce("is_integrity_violation", F.lit(False)) | F.coalesce(
        "is_interchange_abuse", F.lit(False)
    )
    joined = scores.select(M, "flag_for_investigation").join(labels, M, "left")
    return joined.agg(*binary_metrics(F.col("flag_for_investigation") == 1, target))


def main(argv: list[str] | None = None) -> None:
    """``python -m merchantscope.plans.batch --data DIR --out DIR --mcc FILE``."""
    import argparse

    from merchantscope.session import build_session, release

    parser = argparse.ArgumentParser(description="batch scoring run")
    parser.add_argument("--data", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--mcc", required=True, help="MCC reference as CSV with header")
    parser.add_argument("--min-txn", type=int, default=3)
    parser.add_argument("--lookback-months", type=int, default=12)
    args = parser.parse_args(argv)
    spark = build_session("merchantscope-batch")
    mcc = readers.read_table(spark, args.mcc, schemas.MCC_REFERENCE, "csv")
    options = BatchOptions(args.min_txn, args.lookback_months)
    run_batch(spark, args.data, args.out, mcc, options=options)
    release(spark)


if __name__ == "__main__":
    main()

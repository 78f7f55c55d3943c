"""Rules as data: conditions compiled to columns, hits as an array of structs."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantscope import live_reference as live
from merchantscope.live_reference import Condition, Rule

HIT = ("struct<rule_id:string,name:string,typology:string,severity:string,score:double,"
       "explanation:string>")


#: A file with more rules is refused, never cut.
MAX_RULES = 10_000


def apply_overrides(rules: list[Rule], enabled: dict[str, bool]) -> list[Rule]:
    """Switch rules on or off by id."""
    return [replace(r, enabled=enabled.get(r.id, r.enabled)) for r in rules]


def rules_from_json(spark: SparkSession, path: str) -> list[Rule]:
    """Read rules from JSON lines (a configuration of a few entries)."""
    schema = (
        "id string, name string, typology string, severity string, score double, "
        "template string, enabled boolean, "
        "conditions array<struct<feature:string,operator:string,number:double,text:string,"
        "texts:array<string>>>"
    )
    out = []
    stored = spark.read.schema(schema).json(path)
    if (count := stored.count()) > MAX_RULES:
        raise ValueError(f"{count} rules in {path}: a rule file is configuration of at most {MAX_RULES}")
    for row in stored.toLocalIterator():
        conditions = tuple(
            Condition(
                c.feature,
                c.operator,
                tuple(c.texts) if c.texts is not None else (c.number if c.number is not None else c.text),
            )
            for c in row.conditions
        )
        out.append(
            Rule(row.id, row.name, row.typology, row.severity, row.score, conditions,
                 row.template or "", True if row.enabled is None else row.enabled)
        )
    return out


def condition_column(c: Condition, columns: list[str]) -> Column:
    """A condition as a boolean column; an unknown feature never holds."""
    if c.feature not in columns:
        return F.lit(False)
    x = F.col(c.feature)
    match c.operator:
        case ">":
            out = x > c.value
        case ">=":
            out = x >= c.value
        case "<":
            out = x < c.value
        case "<=":
            out = x <= c.value
        case "==":
            out = x == c.value
        case "in":
            out = x.isin(*c.value)
        case "not-in":
            out = ~x.isin(*c.value)
        case _:
            out = F.lit(False)
    return F.coalesce(out, F.lit(False))


def _percent(col: str) -> Column:
    return F.format_string("%.0f", F.col(col) * 100)


def placeholders(columns: list[str]) -> dict[str, Column]:
    """What ``{{name}}`` in a template stands for, as far as the columns are there."""
    percent = {
        "cardNotPresentPct": "card_not_present_ratio", "nightPct": "night_ratio",
        "cashEquivalentPct": "cash_equivalent_ratio", "walletLoadPct": "wallet_load_ratio",
        "roundDollarPct": "round_dollar_ratio", "refundAfterPct": "refund_after_purchase_ratio",
        "thresholdProximityPct": "threshold_proximity_ratio",
        "rapidRepeatPct": "rapid_repeat_ratio", "crossBorderPct": "cross_border_ratio",
        "fallbackPct": "fallback_ratio", "notRecognizedPct": "not_recognized_dispute_rate",
        "disputePct": "dispute_rate", "refundPct": "refund_rate",
        "descriptorNamePct": "descriptor_name_similarity",
    }
    two = {
        "descriptorEntropy": "descriptor_entropy", "brandMimicScore": "brand_mimic_score",
        "mccDivergence": "mcc_divergence",
    }
    plain = {
        "declaredMcc": "declared_mcc", "descriptorCount": "descriptor_count",
        "sharedBankAccountCount": "shared_bank_account_count",
    }
    out = {k: _percent(v) for k, v in percent.items() if v in columns}
    out |= {k: F.format_string("%.2f", F.col(v)) for k, v in two.items() if v in columns}
    out |= {k: F.col(v).cast("string") for k, v in plain.items() if v in columns}
    if {"manual_entry_ratio", "fallback_ratio"} <= set(columns):
        manual = F.col("manual_entry_ratio") + F.col("fallback_ratio")
        out["manualEntryPct"] = F.format_string("%.0f", manual * 100)
    out["threshold"] = F.format_string("%.0f", F.lit(live.MONITORING_THRESHOLD))
    return out


def render(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{{key}}`` placeholders; unknown ones stay as they are."""
    pieces = re.split(r"(\{\{\w+\}\})", template)
    cols = [values.get(p[2:-2], F.lit(p)) if p.startswith("{{") else F.lit(p) for p in pieces if p]
    return F.concat(*cols) if cols else F.lit("")


def evaluate_rules(df: DataFrame, rules: list[Rule] = live.DEFAULT_RULES) -> DataFrame:
    """Add ``rule_hits``: one struct per enabled rule whose conditions all hold."""
    values = placeholders(df.columns)
    hits = []
    for r in rules:
        if not r.enabled:
            continue
        holds = F.lit(True)
        for c in r.conditions:
            holds = holds & condition_column(c, df.columns)
        hit = F.struct(
            F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("name"),
            F.lit(r.typology).alias("typology"), F.lit(r.severity).alias("severity"),
            F.lit(float(r.score)).alias("score"), render(r.template, values).alias("explanation"),
        )
        hits.append(F.when(holds, hit))
    found = F.array_compact(F.array(*hits)) if hits else F.array()
    return df.withColumn("rule_hits", found.cast(f"array<{HIT}>"))


def rule_hit_counts(scored: DataFrame, rules: list[Rule] = live.DEFAULT_RULES) -> DataFrame:
    """Merchants hit per rule, rules without a hit included."""
    spine = scored.sparkSession.createDataFrame([(r.id,) for r in rules], "rule_id string")
    counts = scored.select(F.inline("rule_hits")).groupBy("rule_id").agg(F.count("*").alias("hits"))
    return spine.join(counts, "rule_id", "left").na.fill(0, ["hits"])

"""Rules as rows: the conditions are a table, and a plan does not grow with their number.

Every value of a subject meets the conditions on its feature: thresholds lie in sorted
blocks, so that a block is taken whole, left out whole, or cut at the value; equality is an
equi-join on the value. A rule hits where as many conditions hold as it has. The counting is
combined per task before it is exchanged, since a subject's values start in one task.

Semantics are those of the compiled form (``live_rules``): a NULL value or an unknown
feature fails a condition, an unknown operator never holds, a rule without conditions hits
every subject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchantscope import live_reference as live
from merchantscope.live_reference import Rule
from merchantscope.operators.live_rules import placeholders

CONDITION = "struct<feature:string,operator:string,number:double,text:string,texts:array<string>>"
RULES = (f"id string, name string, typology string, severity string, score double, template string, "
         f"enabled boolean, conditions array<{CONDITION}>")
#: Every subject has this feature; rules without conditions ask for it.
ALWAYS = ""
#: Thresholds of a block. A value compares itself with one block per feature and operator at most.
BLOCK = 256
#: Condition tables up to so many rows are sent to all tasks; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON lines, any number of them."""
    return spark.read.schema(RULES).json(path)


def rules_frame(spark: SparkSession, rules: list[Rule] = live.DEFAULT_RULES) -> DataFrame:
    """The rules of a configuration as rows."""
    def condition(c):
        many = isinstance(c.value, tuple)
        number = None if many or isinstance(c.value, str) else float(c.value)
        return (c.feature, c.operator, number, c.value if isinstance(c.value, str) else None, [str(v) for v in c.value] if many else None)

    return spark.createDataFrame(
        [(r.id, r.name, r.typology, r.severity, float(r.score), r.template, r.enabled, [condition(c) for c in r.conditions]) for r in rules], RULES
    )


def switch(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rules switched on or off by a table (id, enabled)."""
    asked = overrides.select("id", F.col("enabled").alias("_asked"))
    return rules.join(asked, "id", "left").withColumn("enabled", F.coalesce("_asked", "enabled")).drop("_asked")


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _shown(number: Column) -> Column:
    """One text per number; both zeros are one."""
    return (number + F.lit(0.0)).cast("string")


def conditions(rules: DataFrame, numeric: list[str]) -> DataFrame:
    """Enabled rules' conditions: (rule_id, feature, operator, number, texts), texts in the form values have."""
    active = rules.filter(F.coalesce("enabled", F.lit(True))).withColumn("conditions", F.coalesce("conditions", F.expr(f"cast(array() as array<{CONDITION}>)")))
    named = active.select(F.col("id").alias("rule_id"), F.explode("conditions").alias("c")).select("rule_id", "c.*")
    is_number = F.col("feature").isin(numeric) if numeric else F.lit(False)
    given = F.coalesce("texts", F.array(F.coalesce("text", F.col("number").cast("string"))))
    texts = F.when(is_number, F.transform(given, lambda t: _shown(t.try_cast("double")))).otherwise(given)
    stated = named.select("rule_id", "feature", "operator", "number", F.array_distinct(F.array_compact(texts)).alias("texts"))
    empty = active.filter(F.size("conditions") == 0).select(
        F.col("id").alias("rule_id"), F.lit(ALWAYS).alias("feature"), F.lit("in").alias("operator"),
        F.lit(None).cast("double").alias("number"), F.array(F.lit(ALWAYS)).alias("texts"),
    )
    return stated.unionByName(empty)


def values(df: DataFrame, key: list[str], features: list[str]) -> DataFrame:
    """One row per subject and present value: (key, feature, number, text)."""
    numeric = set(_numeric(df))

    def entry(c: str) -> Column:
        number = F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
        text = _shown(number) if c in numeric else F.col(c).cast("string")
        return F.struct(F.lit(c).alias("feature"), number.alias("number"), text.alias("text"))

    always = F.struct(F.lit(ALWAYS).alias("feature"), F.lit(None).cast("double").alias("number"), F.lit(ALWAYS).alias("text"))
    return df.select(*key, F.inline(F.array(always, *[entry(c) for c in features]))).filter(F.col("text").isNotNull())


def threshold_blocks(stated: DataFrame) -> DataFrame:
    """Thresholds in sorted blocks: (feature, operator, low, high, entries)."""
    from pyspark.sql import Window

    at = Window.partitionBy("feature", "operator").orderBy("number", "rule_id")
    return (
        stated.filter(F.col("operator").isin(">", ">=", "<", "<=") & F.col("number").isNotNull())
        .withColumn("block", F.floor((F.row_number().over(at) - 1) / BLOCK))
        .groupBy("feature", "operator", "block")
        .agg(F.min("number").alias("low"), F.max("number").alias("high"),
             F.array_sort(F.collect_list(F.struct("number", "rule_id"))).alias("entries"))
        .drop("block")
    )


def _sided(index: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(index) if small else index


def _holds(operator: Column, x: Column, threshold: Column) -> Column:
    return (
        F.when(operator == ">", x > threshold).when(operator == ">=", x >= threshold)
        .when(operator == "<", x < threshold).otherwise(x <= threshold)
    )


def _dealt(found: DataFrame, index: DataFrame, small: bool, on: list[str], key: list[str]) -> DataFrame:
    """Values joined with conditions. A large index is repeated per piece of subjects: no feature is one task."""
    if small:
        return found.join(F.broadcast(index), on)
    pieces = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = index.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return found.withColumn("_piece", F.pmod(F.xxhash64(*key), F.lit(pieces)).cast("int")).join(salted, ["_piece", *on])


def matches(df: DataFrame, rules: DataFrame, key: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(key, rule_id) of the rules whose conditions all hold. ``key`` names a subject: unique, not NULL."""
    from merchantscope.session import stage_table

    stated = stage_table(conditions(rules, _numeric(df)), "rule_conditions")
    size = stated.groupBy("feature", "operator").agg(F.count("*").alias("n"))
    asked = {r.feature: r.n for r in size.filter(F.col("feature").isin([*df.columns, ALWAYS])).groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    small = sum(asked.values()) <= broadcast_rows
    found = values(df, key, [c for c in df.columns if c in asked])

    blocks = threshold_blocks(stated)
    cut = F.filter("entries", lambda e: _holds(F.col("operator"), F.col("_x"), e["number"]))
    rising = F.col("operator").isin(">", ">=")
    near = F.when(rising, F.col("_x") >= F.col("low")).otherwise(F.col("_x") <= F.col("high"))
    whole = F.when(rising, F.col("_x") > F.col("high")).otherwise(F.col("_x") < F.col("low"))
    numbers = found.filter(F.col("number").isNotNull()).select(*key, "feature", F.col("number").alias("_x"))
    by_threshold = _dealt(numbers, blocks, small, ["feature"], key).filter(near).select(
        *key, F.explode(F.transform(F.when(whole, F.col("entries")).otherwise(cut), lambda e: e["rule_id"])).alias("rule_id")
    )
    equal = stated.filter(F.col("operator").isin("==", "in")).select("feature", F.explode("texts").alias("text"), "rule_id")
    by_value = _dealt(found, equal, small, ["feature", "text"], key).select(*key, "rule_id")
    absent = stated.filter(F.col("operator") == "not-in").select("feature", "texts", "rule_id")
    by_absence = _dealt(found, absent, small, ["feature"], key).filter(~F.array_contains("texts", F.col("text"))).select(*key, "rule_id")

    needed = stated.groupBy("rule_id").agg(F.count("*").alias("needed"))
    held = by_threshold.unionByName(by_value).unionByName(by_absence).groupBy(*key, "rule_id").agg(F.count("*").alias("held"))
    return held.join(_sided(needed, small), "rule_id").filter(F.col("held") == F.col("needed")).select(*key, "rule_id")


def render_rows(template: Column, shown: Column) -> Column:
    """Fill ``{{key}}`` placeholders of a template column from a map; unknown ones stay, a NULL one gives NULL."""
    pieces = F.split(template, r"(?=\{\{)|(?<=\}\})")
    name = lambda p: F.regexp_extract(p, r"^\{\{(\w+)\}\}$", 1)
    filled = F.transform(pieces, lambda p: F.when(F.map_contains_key(shown, name(p)), shown[name(p)]).otherwise(p))
    return F.when(F.exists(filled, lambda p: p.isNull()), F.lit(None)).otherwise(F.array_join(filled, ""))


def rule_hit_rows(df: DataFrame, rules: DataFrame, key: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per hit: key, rule_id, name, typology, severity, score, explanation."""
    told = placeholders(df.columns)
    shown = F.create_map(*[x for k, c in told.items() for x in (F.lit(k), c)])
    subjects = df.select(*key, shown.alias("_shown"))
    named = rules.select(F.col("id").alias("rule_id"), "name", "typology", "severity", "score", F.coalesce("template", F.lit("")).alias("template"))
    return (
        matches(df, rules, key, broadcast_rows).join(named, "rule_id").join(subjects, key)
        .withColumn("explanation", render_rows(F.col("template"), F.col("_shown")))
        .select(*key, "rule_id", "name", "typology", "severity", "score", "explanation")
    )

"""Rules as rows against the compiled form; many rules; a plan that does not grow."""

import random

import pytest
from pyspark.sql import functions as F

from merchantscope import live_reference as live
from merchantscope.live_reference import Condition, Rule
from merchantscope.operators import live_rules as lr
from merchantscope.operators import rule_rows as rr

SCHEMA = ("merchant_id long, declared_mcc string, night_ratio double, txn_count long, mcc_divergence double, "
          "card_not_present_ratio double, dispute_rate double, refund_rate double")


@pytest.fixture(scope="module")
def subjects(spark):
    rng = random.Random(3)

    def share():
        return rng.choice([None, 0.0, -0.0, 0.25, 0.5, float("nan"), float("inf"), rng.random(), rng.random()])

    rows = [
        (i, rng.choice([None, "5411", "5812", "", "x"]), share(), rng.choice([None, 0, 3, rng.randint(0, 50)]), share(), share(), share(), share())
        for i in range(120)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def make_rules(n, seed=5):
    rng = random.Random(seed)

    def condition():
        f = rng.choice(["night_ratio", "txn_count", "mcc_divergence", "dispute_rate", "declared_mcc", "nowhere"][: 6 if rng.random() < 0.05 else 5])
        if f == "declared_mcc":
            op = rng.choice(["in", "not-in", "=="])
            return Condition(f, op, rng.choice(["5411", "x"]) if op == "==" else tuple(rng.choices(["5411", "5812", "", "none"], k=rng.randint(1, 3))))
        value = float(rng.randint(0, 50)) if f == "txn_count" else rng.choice([0.0, 0.25, 0.5, round(rng.random(), 2)])
        return Condition(f, rng.choice([">", ">=", "<", "<=", "=="] if rng.random() < 0.98 else ["like"]), value)

    return [
        Rule(f"R{i:05d}", f"name {i}", rng.choice(live.TYPOLOGIES), "HIGH", float(i % 40), tuple(condition() for _ in range(rng.choice([0, 1, 1, 2, 3]) if i % 50 == 0 else rng.choice([1, 2, 3]))),
             rng.choice(["", "plain", "{{nightPct}}% of {{declaredMcc}} {{unknown}} {{", "at {{threshold}}"]), rng.random() > 0.1)
        for i in range(n)
    ]


def compiled(df, rules):
    hits = lr.evaluate_rules(df, rules).select("merchant_id", F.inline("rule_hits"))
    return sorted(map(tuple, hits.collect()), key=str)


@pytest.mark.parametrize("broadcast_rows", [rr.BROADCAST_ROWS, 0])
def test_equals_the_compiled_form(spark, subjects, broadcast_rows):
    rules = make_rules(150)
    got = rr.rule_hit_rows(subjects, rr.rules_frame(spark, rules), ["merchant_id"], broadcast_rows)
    want = compiled(subjects, rules)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len(want) > 1_000


def test_ten_thousand_rules_from_a_file(spark, subjects, tmp_path):
    rules = make_rules(10_001, seed=9)
    rr.rules_frame(spark, rules).write.json(f"{tmp_path}/rules")
    stored = rr.read_rules(spark, f"{tmp_path}/rules")
    got = rr.matches(subjects, stored, ["merchant_id"])
    few = rr.matches(subjects, rr.read_rules(spark, f"{tmp_path}/rules").filter("id < 'R00003'"), ["merchant_id"])
    plan = [len(x._jdf.queryExecution().optimizedPlan().toString().splitlines()) for x in (got, few)]
    assert plan[0] == plan[1]
    sample = rules[:200]
    want = sorted((i, r) for i, r, *_ in compiled(subjects, sample))
    assert sorted(map(tuple, got.filter("rule_id < 'R00200'").collect())) == want


def test_rules_without_subjects_and_subjects_without_rules(spark, subjects):
    none = spark.createDataFrame([], rr.RULES)
    assert rr.rule_hit_rows(subjects, none, ["merchant_id"]).count() == 0
    assert rr.rule_hit_rows(subjects.filter("false"), rr.rules_frame(spark), ["merchant_id"]).count() == 0


def test_switches_are_a_table(spark, subjects):
    rules = make_rules(30)
    off = {r.id: i % 2 == 0 for i, r in enumerate(rules[:20])}
    switched = rr.switch(rr.rules_frame(spark, rules), spark.createDataFrame(list(off.items()), "id string, enabled boolean"))
    got = rr.rule_hit_rows(subjects, switched, ["merchant_id"])
    assert sorted(map(tuple, got.collect()), key=str) == compiled(subjects, lr.apply_overrides(rules, off))

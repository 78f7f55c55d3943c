"""Streams over files in batches, late rows included, against the batch operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchantscope import live_reference as live
from merchantscope.operators import features as ft
from merchantscope.streaming import bursts as sb, rules as sr, sinks

SCHEMA = "merchant_id long, card_token_id long, transaction_datetime_utc timestamp_ntz, settlement_amount_usd double"
START = dt.datetime(2024, 3, 1)


def events(spark, rows):
    full = [(m, c, START + dt.timedelta(microseconds=int(us)), a) for m, c, us, a in rows]
    return spark.createDataFrame(full, SCHEMA)


def sorted_rows(df):
    return sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()], key=repr)


@pytest.fixture
def arrivals(spark):
    """Three batches of files in order of time, and some rows of the first that come with the second."""
    rng = np.random.default_rng(8)
    rows = [(int(m), int(c), int(s) * 1_000_000, float(a)) for m, c, s, a in zip(
        np.where(rng.random(900) < 0.4, 1, rng.integers(2, 6, 900)), rng.integers(1, 5, 900),
        rng.integers(0, 900_000, 900), np.round(rng.uniform(5, 50, 900), 2))]
    hour = 3_600_000_000
    rows += [(9, 1, 0, 5.0), (9, 1, hour, 6.0), (9, 1, 2 * hour + 1, 7.0), (9, None, 5, 1.0)]
    rows.sort(key=lambda r: r[2])
    first, second, third = rows[:300], rows[300:600], rows[600:]
    # late, yet within the watermark's delay of two hours: it bridges two sessions
    edge = first[-1][2]
    late = [r for r in first if edge - r[2] < 2 * hour][-4:]
    first = [r for r in first if r not in late] + [(7, 7, edge - 5000, 1.0), (7, 7, edge + int(1.8 * hour), 2.0)]
    second = [*late, (7, 7, edge + int(0.9 * hour), 3.0), *second]
    return first, second, third


def test_sessions_equal_the_batch_bursts(spark, arrivals, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    schema = events(spark, []).schema
    summaries, beyond = [], (8, 8, 0, 4.0)
    for batch in [*arrivals, [beyond]]:
        events(spark, batch).coalesce(1).write.mode("append").parquet(src)
        summaries.append(sb.run_sessions(sb.read_events(spark, src, schema), out, state, "2 hours"))
    sb.heartbeat(spark, schema, "2025-01-01 00:00:00").write.mode("append").parquet(src)
    summaries.append(sb.run_sessions(sb.read_events(spark, src, schema), out, state, "2 hours"))
    assert [s.dropped for s in summaries] == [0, 0, 0, 1, 0]
    assert sum(s.rows for s in summaries) == sum(map(len, arrivals)) + 2
    want = ft.bursts(ft.card_hour_counts(events(spark, [r for b in arrivals for r in b])))
    got = sb.finished_bursts(spark, out, schema)
    assert sorted_rows(got) == sorted_rows(want) and want.filter("merchant_id = 9").count() == 2
    # nothing is open any more: another run adds no rows
    again = sb.run_sessions(sb.read_events(spark, src, schema), out, state, "2 hours")
    assert again.rows == 0 and sorted_rows(sb.finished_bursts(spark, out, schema)) == sorted_rows(want)


def test_several_files_a_run_are_several_batches(spark, arrivals, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    schema = events(spark, []).schema
    for batch in arrivals:
        events(spark, batch).coalesce(1).write.mode("append").parquet(src)
    sb.heartbeat(spark, schema, "2025-01-01 00:00:00").write.mode("append").parquet(src)
    summary = sb.run_sessions(sb.read_events(spark, src, schema, files=1), out, state, "2 hours")
    assert summary.batches >= 4 and summary.dropped == 0
    want = ft.bursts(ft.card_hour_counts(events(spark, [r for b in arrivals for r in b])))
    assert sorted_rows(sb.finished_bursts(spark, out, schema)) == sorted_rows(want)


def test_no_session_yet_is_an_empty_result(spark, tmp_path):
    assert sb.finished_bursts(spark, str(tmp_path / "none"), events(spark, []).schema).count() == 0


LIVE = ("merchant_id long, event_ts timestamp, amount double, authorization_status string, entry_mode string, ecommerce boolean, "
        "cross_border boolean, refund boolean, reversal boolean, dispute boolean, dispute_reason string, cash_equivalent boolean, "
        "wallet_load boolean, latitude double, longitude double")


def live_rows(spark, n=1200):
    rng = np.random.default_rng(4)
    out = []
    for i in range(n):
        m = int(rng.integers(1, 7))
        often = lambda share: bool(rng.random() < share)  # noqa: B023, E731
        out.append((m, dt.datetime(2024, 3, 1) + dt.timedelta(seconds=int(i * 300)), float(np.round(rng.uniform(1, 900), 2)),
                    "approved" if often(0.9) else "declined", "fallback" if often(0.2) else "chip", often(0.2 * m), often(0.15 * m),
                    often(0.1), often(0.1), often(0.3), live.NOT_RECOGNISED if often(0.8) else "other", often(0.5), often(0.5), 1.0, 2.0))
    return out


RULES = [
    live.Rule("R1", "remote", "MCC_MISCODING", "HIGH", 10.0, (live.Condition("card_not_present_ratio", ">", 0.6), live.Condition("declared_mcc", "in", ("5411",))), "{{cardNotPresentPct}} of {{declaredMcc}} {{descriptorCount}}"),
    live.Rule("R2", "disputes", "CARD_SURCHARGE", "LOW", 5.0, (live.Condition("not_recognized_dispute_rate", ">=", 0.25),), "{{disputePct}}"),
    live.Rule("R3", "not in a window", "CARD_SURCHARGE", "LOW", 5.0, (live.Condition("descriptor_entropy", ">", 0.0),), "{{descriptorEntropy}}"),
]


def test_window_rules_equal_the_batch_and_replays_change_nothing(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    rows = live_rows(spark)
    merchants = spark.createDataFrame([(i, "5411" if i % 2 else "5999") for i in range(1, 6)], "merchant_id long, declared_mcc string")
    schema = spark.createDataFrame([], LIVE).schema
    for batch in (rows[:400], rows[400:900], rows[900:], [(1, dt.datetime(2025, 1, 1), 1.0, "approved", *rows[0][4:])]):
        spark.createDataFrame(batch, LIVE).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        summary = sr.run_rules(stream, merchants, out, state, "1 day", "1 hour", RULES)
        assert summary.dropped == 0
    features = sr.windowed_features(spark.createDataFrame(rows, LIVE), "1 day")
    want = sr.window_hits(features, merchants, RULES)
    got = sr.read_hits(spark, out, want.schema)
    assert sorted_rows(got) == sorted_rows(want)
    assert {r.rule_id for r in want.collect()} == {"R1", "R2"}
    assert want.filter("explanation LIKE '%5411 {{descriptorCount}}'").count() > 0
    # the last batch that wrote hits runs a second time, as after a lost driver
    files = spark.read.parquet(out)
    last = files.agg(F.max(sinks.BATCH)).first()[0]
    days = [r.window_start for r in files.filter(F.col(sinks.BATCH) == last).select("window_start").distinct().collect()]
    sr.write_hits(features.filter(F.col("window_start").isin(days)), merchants, out, last, RULES)
    assert sorted_rows(sr.read_hits(spark, out, want.schema)) == sorted_rows(want)

"""Scores, fingerprints, caps and policy on small tables with known answers."""

import datetime as dt
import random

from corpuswarden.operators import findings as f
from corpuswarden.operators import policy

SCHEMA = "site_id string, mode string, rule_id string, family string, category string, severity string, confidence string, manual boolean, path string, line int, evidence string"


def row(rule="r", severity="high", confidence="high", manual=False, path="a", line=1, evidence="e", site="s", family=None):
    return (site, "site", rule, family or rule, "c", severity, confidence, manual, path, line, evidence)


def score(spark, rows):
    return f.scores(spark.createDataFrame(rows, SCHEMA)).first()


def test_known_scores(spark):
    assert score(spark, [row()]).score == 67
    hundred = score(spark, [row(line=k) for k in range(1, 101)])
    assert (hundred.score, hundred.repeated_signals) == (67, 99)
    assert score(spark, [row(), row(rule="q")]).score == 50
    many = score(spark, [row(rule=f"r{k}", severity="critical") for k in range(500)])
    assert (many.risk, many.score, many.band) == (99, 1, "severe")
    assert str(score(spark, [row(severity="critical", confidence="medium", manual=True)]).raw) == "24.38"


def test_dedupe_fingerprint_and_cap_do_not_depend_on_order(spark):
    rows = [row(line=k, evidence=f"e{k % 3}") for k in range(1, 9)] + [row(severity="low"), row(path="b")]
    results = []
    for seed in range(3):
        mixed = rows + rows[:3]
        random.Random(seed).shuffle(mixed)
        own = f.fingerprinted(f.deduplicated(spark.createDataFrame(mixed, SCHEMA).repartition(3)))
        results.append(sorted(map(str, own.collect())))
        assert f.capped(own, 2).count() == 2 and f.cap_counts(own, 2).first().left_out == own.count() - 2
    assert results[0] == results[1] == results[2] and len({r.split("fingerprint=")[1] for r in results[0]}) == len(results[0])


def test_policy(spark):
    now = f.fingerprinted(spark.createDataFrame([row("seo-a"), row("seo-b", path="x/y.html"), row("z", severity="critical")], SCHEMA))
    before = f.fingerprinted(spark.createDataFrame([row("z", severity="low"), row("gone")], SCHEMA))
    base = policy.baseline_of(before)
    state = policy.compared(now, base)
    assert {(r.rule_id, r.baseline_state, r.escalated) for r in state.collect()} == {("seo-a", "new", False), ("seo-b", "new", False), ("z", "unchanged", True)}
    assert [r.rule_id for r in policy.fixed(now, base).collect()] == ["gone"]
    rules = [(1, "seo-*", "old/**", "not this path", None), (2, "seo-?", "x/*.html", "by pattern", dt.date(2030, 1, 1)), (3, "seo-b", None, "later entry", None), (4, "z", None, "out of date", dt.date(2020, 1, 1))]
    off = policy.suppressed(state, spark.createDataFrame(rules, "ord int, rule string, path string, reason string, expires date"), dt.date(2026, 1, 1))
    assert {r.rule_id: r.suppression for r in off.collect()} == {"seo-a": None, "seo-b": 2, "z": None}
    counts = policy.counters(off).first()
    assert (counts.new, counts.unchanged, counts.escalated, counts.suppressed, counts.active) == (2, 1, 1, 1, 2)
    gates = [policy.gate(off, "high").first().over, policy.gate(off, "high", new_only=True).first().over, policy.gate(off, "high", regressions_only=True).first().over]
    assert gates == [2, 1, 2]
    assert {r.rule_id for r in policy.merged(base, policy.baseline_of(now), now.select("site_id", "mode").distinct()).collect()} == {"seo-a", "seo-b", "z"}


def test_constraints(spark):
    good, bad = f.valid(spark.createDataFrame([row(), row(severity="odd"), row(line=0), row(path=" "), row(rule="")], SCHEMA))
    assert good.count() == 1 and {tuple(r.problems) for r in bad.collect()} == {("severity",), ("line",), ("path",), ("rule_id",)}

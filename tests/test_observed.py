"""Recorded observations, files and smaller functions on literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from corpuswarden.functions import text as t
from corpuswarden.operators import findings, observations, policy, source_rules
from corpuswarden.sources import tables
from corpuswarden.streaming import events


def ids(df):
    return sorted((r.path, r.rule_id, r.severity) for r in df.collect())


def test_metrics_at_and_beyond_each_threshold(spark):
    document = "struct<title_present:boolean,h1_count:int,landmark_count:int,lang:string,viewport_present:boolean,description_present:boolean,canonical_present:boolean,overflow_px:double,unlabeled_controls:int,duplicate_ids:int,broken_images:int,small_touch_targets:int>"
    schema = f"site_id string, path string, document {document}, navigation struct<response_start_ms:double,transfer_bytes:double>, performance struct<lcp_ms:double,fcp_ms:double,cls:double,long_task_ms:double,max_long_task_ms:double,transfer_bytes:double>"
    good = (True, 1, 1, "en", True, True, True, 0.0, 0, 0, 0, 0)
    rows = [
        ("s", "at", good, (800.0, 0.0), (2500.0, 1800.0, 0.1, 500.0, 200.0, 4.0 * 1024 * 1024)),
        ("s", "need", good, (801.0, 0.0), (2501.0, 1801.0, 0.11, 0.0, 0.0, 0.0)),
        ("s", "bad", good, (1801.0, 1.0), (4001.0, 3001.0, 0.26, 501.0, 0.0, 4.0 * 1024 * 1024)),
        ("s", "none", (False, 0, 0, "", False, False, False, 2.0, 1, 1, 1, 1), (None, -5.0), (None, None, None, None, None, None)),
    ]
    got = ids(observations.metric_findings(spark.createDataFrame(rows, schema)))
    assert not [x for x in got if x[0] == "at"]
    assert [x[1] for x in got if x[0] == "need"] == [f"runtime.{k}-needs-improvement" for k in ("cls", "fcp", "lcp", "ttfb")]
    assert [x[1] for x in got if x[0] == "bad"] == ["runtime.high-cls", "runtime.large-page-transfer", "runtime.long-main-thread-tasks", "runtime.slow-fcp", "runtime.slow-lcp", "runtime.slow-ttfb"]
    assert len([x for x in got if x[0] == "none"]) == 13


def test_accessibility_groups(spark):
    group = lambda k, impact: (f"rule_{k}", impact, ["wcag143"], k)
    rows = [("s", "p", [group(k, i) for k, i in enumerate(["critical", "serious", "moderate", "minor", None])]), ("s", "q", [group(k, "minor") for k in range(103)])]
    got = ids(observations.axe_findings(spark.createDataFrame(rows, "site_id string, path string, violations array<struct<id:string,impact:string,tags:array<string>,node_count:int>>")))
    assert sorted(x[2] for x in got if x[0] == "p") == ["critical", "high", "low", "medium", "medium"]
    assert len([x for x in got if x[:2] == ("q", "runtime.axe")]) == 100 and [x for x in got if x[1] == "runtime.axe-results-truncated"] == [("q", "runtime.axe-results-truncated", "info")]


def test_baselines_round_trip_and_suppressions(spark, tmp_path):
    rows = [("s", "site", "f1", "r", "low", "p"), ("s", "security", "f2", "q", "high", None)]
    entries = spark.createDataFrame(rows, "site_id string, mode string, fingerprint string, rule_id string, severity string, path string")
    tables.write_baseline(entries, f"{tmp_path}/base")
    assert sorted(tuple(r) for r in tables.read_baseline(spark, f"{tmp_path}/base").collect()) == sorted(rows)
    (tmp_path / "b.json").write_text('{"kind": "baseline", "modes": ["site"], "entries": [{"site_id": "s", "mode": "site", "fingerprint": "f1", "rule_id": "r", "severity": "low", "path": "p"}]}')
    assert [tuple(r) for r in tables.read_baseline(spark, f"{tmp_path}/b.json").collect()] == rows[:1]
    (tmp_path / "s.json").write_text('{"suppressions": [{"rule": "a-*", "reason": "long enough", "expires": "2030-02-28"}, {"rule": "b", "reason": "short"}, {"rule": "c", "reason": "long enough", "expires": "2030-02-30"}, {"rule": " ", "reason": "long enough"}]}')
    good, bad = tables.read_suppressions(spark, f"{tmp_path}/s.json")
    assert [(r.ord, r.rule, r.expires) for r in good.collect()] == [(0, "a-*", dt.date(2030, 2, 28))] and sorted(r.ord for r in bad.collect()) == [1, 2, 3]


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.js").write_text("one\ntwo")
    (tmp_path / "big.js").write_text("x" * 50)
    got = {r.path: (r.size_bytes, r.text, r.skipped_reason) for r in tables.read_tree(spark, str(tmp_path), "s", "*.js", most=20).collect()}
    assert got == {"src/a.js": (7, "one\ntwo", None), "big.js": (50, None, "large")}
    assert {(r.ext, r.size_bytes) for r in tables.read_assets(spark, str(tmp_path), "s").collect()} == {("js", 7), ("js", 50)}
    rows = [("robots.txt", "large"), ("a.js", "large"), ("b.js", None)]
    assert {r.name for r in tables.presence_only(spark.createDataFrame(rows, "name string, skipped_reason string")).collect()} == {"robots.txt", "b.js"}


def test_source_files(spark):
    rows = [("src/a.js", "x"), ("node_modules/b/c.js", "x"), ("app/.next/d.js", "x"), ("src/server/e.js", "window.x = 1"), ("src/server/f.js", "typeof window; window.x"), ("src/big.vue", "\n" * 801), ("src/huge.js", "y" * 350_001)]
    own = spark.createDataFrame([("s", *r) for r in rows], "site_id string, path string, text string")
    assert {r.path for r in source_rules.in_scope(own).collect()} == {p for p, _ in rows if "node_modules" not in p and ".next" not in p}
    assert [x[:2] for x in ids(source_rules.component_findings(own))] == [("src/big.vue", "design-large-component"), ("src/huge.js", "performance-large-source-file"), ("src/server/e.js", "compat-browser-global-on-server")]
    head = spark.createDataFrame([(1, "// Code generated by x\nvar a"), (2, "a\n" * 15 + "@generated"), (3, "a\n" * 14 + "@generated")], "k int, text string")
    assert {r.k for r in head.where(source_rules.generated_header("text")).collect()} == {1, 3}
    assets = spark.createDataFrame([("s", "public/a.png"), ("s", "src/b.png"), ("s", "src/c.png")], "site_id string, path string")
    texts = spark.createDataFrame([("s", "url(../b.png)")], "site_id string, text string")
    assert {r.path for r in source_rules.delivered(assets, texts).collect()} == {"public/a.png", "src/b.png"}
    css = spark.createDataFrame([("s", "a", "/* @import 'x'; */ a{}", False), ("s", "b", "@import url('x.css');", False), ("s", "c", "@import 'x.css'; @import \"//cdn.example/y.css\"", True), ("s", "d", "@import 'x.css'", True)], "site_id string, path string, css string, bundled boolean")
    assert [(r.path, r.evidence) for r in source_rules.import_findings(css).orderBy("path").collect()] == [("b", "@import url('x.css'"), ("c", '@import "//cdn.example/y.css"')]


def test_smaller_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(t.line_of(F.lit("a\nb\nc"), F.lit(3))) == 2
    assert value(t.query_redacted(F.lit("/x?a=1&b=2#c"))) == "/x?a=[REDACTED]&b=[REDACTED]#c"
    assert value(t.calendar_date(F.lit("2024-02-29"))) == dt.date(2024, 2, 29) and value(t.calendar_date(F.lit("2023-02-29"))) is None
    day = F.lit(dt.date(2024, 1, 2))
    assert [value(t.expired(F.lit(d).cast("date"), day)) for d in (None, "2024-01-02", "2024-01-01")] == [False, False, True]
    sums = [value(t.running_sums(F.sequence(F.lit(1), F.lit(n)))) for n in (1, 256, 257, 1000)]
    assert [s[-1] for s in sums] == [1, 32896, 33153, 500500] and [len(s) for s in sums] == [1, 256, 257, 1000] and sums[3][511] == 512 * 513 // 2
    assert value(t.running_sums(F.array().cast("array<int>"))) == []
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, v int")
    assert sorted(tuple(r) for r in policy.first_of(rows, ["k"], ["v"]).collect()) == [("a", 1), ("b", 3)]
    found = spark.createDataFrame([("s", "site", "r", "r", "c", "high", "high", False, "p", 1, "e"), ("s", "security", "q", "q", "c", "low", "high", False, "p", 1, "e")], "site_id string, mode string, rule_id string, family string, category string, severity string, confidence string, manual boolean, path string, line int, evidence string")
    r = findings.overview(found).first()
    assert (r.site_score, r.site_total, r.security_score, r.security_total) == (67, 1, 94, 1)


def test_summaries(spark):
    from corpuswarden.operators import supply_rules

    advisories = spark.createDataFrame([("a", "moderate"), ("b", "MEDIUM"), ("c", "high"), ("d", None)], "name string, severity string")
    assert {(r.severity, r.advisories) for r in supply_rules.advisory_summary(advisories).collect()} == {("medium", 3), ("high", 1)}
    found = spark.createDataFrame([("s", "site", "x", "x", "c", "info", "high", False, "p", 1, "e"), ("s", "site", "y", "y", "c", "low", "high", False, "p", 1, "e")], "site_id string, mode string, rule_id string, family string, category string, severity string, confidence string, manual boolean, path string, line int, evidence string")
    assert [r.family for r in findings.contributions(found).collect()] == ["y"]
    r = findings.scores(found).first()
    assert (r.families, r.scored_families) == (2, 1)
    entries = spark.createDataFrame([("s", "site", "b"), ("s", "security", "c"), ("s", "site", "a")], "site_id string, mode string, fingerprint string")
    assert [r.fingerprint for r in policy.ordered(entries).collect()] == ["c", "a", "b"]


def test_counters_of_a_stream(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(at(0), "u", "error"), (at(1), "u", "error"), (at(2), "u", "click"), (at(9), "v", "console_error"), (at(40), "w", "error")]
    spark.createDataFrame(rows, "ts timestamp, path string, event_type string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, path string, event_type string").parquet(f"{tmp_path}/in")
    job = events.counters(stream).writeStream.format("memory").queryName("observed").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert {(r.path, r.event_type, r.n) for r in spark.table("observed").collect()} == {("u", "error", 2), ("v", "console_error", 1)}

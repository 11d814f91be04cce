"""Findings from recorded observations of rendered pages: headers, metrics, accessibility results, events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamped, is_loopback, slug, url_part, wcag_label
from .findings import emit


def _fired(df: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """site_id, path, rule_id, evidence, line of the rules that fire on each row; row-local, no shuffle."""
    fired = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rule_id"), v.cast("string").alias("evidence"))) for r, c, v in rules])
    return df.select("site_id", "path", F.explode(F.filter(fired, lambda x: x.isNotNull())).alias("x")).select("site_id", "path", "x.rule_id", "x.evidence", F.lit(1).alias("line"))


def policies(csp: Column) -> Column:
    """Policies of a header as maps of directive to its words; the first of equal directives counts."""

    def directives(policy: Column) -> Column:
        parts = F.filter(F.transform(F.split(policy, ";"), lambda d: F.lower(F.trim(d))), lambda d: d != "")
        entries = F.transform(parts, lambda d: F.struct(F.regexp_extract(d, "^(\\S+)", 1).alias("k"), F.trim(F.regexp_replace(d, "^\\S+", "")).alias("v")))
        first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda o: o["k"] == e["k"]))
        return F.map_from_entries(first)

    return F.transform(F.filter(F.split(F.coalesce(csp, F.lit("")), ","), lambda p: F.trim(p) != ""), directives)


def header_findings(responses: DataFrame) -> DataFrame:
    """responses: site_id, path (URL), status, headers (map with lower-case keys)."""
    h = lambda n: F.col("headers")[n]
    policy = policies(h("content-security-policy"))
    script = lambda p: F.coalesce(p["script-src"], p["default-src"], F.lit("'unsafe-eval'"))
    framed = F.exists(policy, lambda p: F.map_contains_key(p, "frame-ancestors"))
    referrer = F.lower(F.trim(F.element_at(F.split(h("referrer-policy"), ","), -1)))
    age = F.regexp_extract(F.lower(F.coalesce(h("strict-transport-security"), F.lit(""))), "max-age\\s*=\\s*\"?(\\d{1,12})", 1)
    https = F.lower(F.col("path")).startswith("https:") & ~is_loopback(url_part("path", "HOST"))
    kind = F.lower(F.coalesce(h("content-type"), F.lit("")))
    return emit(
        _fired(
            responses,
            [
                ("runtime.header-csp-missing", F.size(policy) == 0, F.when(h("content-security-policy-report-only").isNotNull(), "report-only").otherwise("no policy")),
                ("runtime.header-csp-unsafe-eval", (F.size(policy) > 0) & F.forall(policy, lambda p: F.contains(script(p), F.lit("'unsafe-eval'"))) & F.exists(policy, lambda p: F.map_contains_key(p, "script-src") | F.map_contains_key(p, "default-src")), h("content-security-policy")),
                ("runtime.header-nosniff-missing", ~F.lower(F.trim(F.coalesce(h("x-content-type-options"), F.lit("")))).rlike("^nosniff$"), h("x-content-type-options")),
                ("runtime.header-frame-protection-missing", ~framed & ~F.lower(F.trim(F.coalesce(h("x-frame-options"), F.lit("")))).rlike("^(deny|sameorigin)$"), h("x-frame-options")),
                ("runtime.header-referrer-policy-missing", F.coalesce(referrer, F.lit("")) == "", F.lit("no policy")),
                ("runtime.header-referrer-policy-weak", referrer.isin("unsafe-url", "no-referrer-when-downgrade"), referrer),
                ("runtime.header-hsts-missing", https & (F.coalesce(F.when(age != "", age.cast("long")), F.lit(0)) <= 0), h("strict-transport-security")),
                ("runtime.http-error", F.col("status") >= 400, F.col("status")),
                ("runtime.document-content-type", (kind != "") & ~kind.rlike("^\\s*(text/html|application/xhtml\\+xml)"), kind),
            ],
        ),
        severity=F.when((F.col("rule_id") == "runtime.http-error") & (F.regexp_extract("evidence", "^(\\d+)", 1) >= "500"), "high"),
    )


def metric_findings(snapshots: DataFrame) -> DataFrame:
    """snapshots: site_id, path, document (struct of flags and counts), navigation and performance (structs of doubles)."""
    d = lambda n: F.col(f"document.{n}")
    n = lambda c: clamped(f"navigation.{c}")
    p = lambda c: clamped(f"performance.{c}")
    bands = lambda v, name, worse, bad, need: [(f"runtime.{worse}", v > bad, v), (f"runtime.{name}-needs-improvement", (v > need) & (v <= bad), v)]
    lcp, cls, fcp, ttfb = p("lcp_ms"), p("cls"), p("fcp_ms"), n("response_start_ms")
    language = F.coalesce(F.trim(d("lang")), F.lit(""))
    bytes_ = F.coalesce(p("transfer_bytes"), F.lit(0.0)) + F.coalesce(n("transfer_bytes"), F.lit(0.0))
    count = lambda rule, column: (f"runtime.{rule}", d(column) > 0, d(column))
    rules = [
        ("runtime.document-title", ~F.coalesce(d("title_present"), F.lit(False)), F.lit("no title")),
        ("runtime.missing-h1", F.coalesce(d("h1_count"), F.lit(0)) == 0, F.lit("no h1")),
        ("runtime.missing-landmarks", F.coalesce(d("landmark_count"), F.lit(0)) == 0, F.lit("no landmark")),
        ("runtime.document-language", language == "", F.lit("no lang")),
        ("runtime.invalid-document-language", (language != "") & ~F.lower(language).rlike("^[a-z]{2,8}(-[a-z0-9]{1,8})*$"), language),
        ("runtime.viewport", ~F.coalesce(d("viewport_present"), F.lit(False)), F.lit("no viewport")),
        ("runtime.meta-description", ~F.coalesce(d("description_present"), F.lit(False)), F.lit("no description")),
        ("runtime.canonical-url", ~F.coalesce(d("canonical_present"), F.lit(False)), F.lit("no canonical")),
        ("runtime.horizontal-overflow", clamped("document.overflow_px") > 1, d("overflow_px")),
        count("unlabeled-controls", "unlabeled_controls"), count("duplicate-ids", "duplicate_ids"), count("broken-images", "broken_images"), count("small-touch-targets", "small_touch_targets"),
        ("runtime.performance-metrics-unavailable", F.col("performance.lcp_ms").isNull() | F.col("performance.cls").isNull() | F.col("performance.long_task_ms").isNull(), F.lit("not measured")),
        *bands(lcp, "lcp", "slow-lcp", 4000, 2500), *bands(cls, "cls", "high-cls", 0.25, 0.1), *bands(ttfb, "ttfb", "slow-ttfb", 1800, 800), *bands(fcp, "fcp", "slow-fcp", 3000, 1800),
        ("runtime.long-main-thread-tasks", (p("long_task_ms") > 500) | (p("max_long_task_ms") > 200), F.concat_ws("/", p("long_task_ms").cast("string"), p("max_long_task_ms").cast("string"))),
        ("runtime.large-page-transfer", bytes_ > 4 * 1024 * 1024, bytes_),
    ]
    return emit(_fired(snapshots, rules))


IMPACT = {"critical": "critical", "serious": "high", "moderate": "medium", "minor": "low"}


def axe_findings(results: DataFrame, most: int = 100) -> DataFrame:
    """results: site_id, path, violations array<struct<id,impact,tags,node_count>>, and perhaps incomplete array<struct<id>>.

    A report shows ``most`` groups a page; checks without a decision are one row a page, for review.
    """
    each = results.select("site_id", "path", F.posexplode("violations").alias("at", "v"))
    top = each.withColumn("n", F.row_number().over(Window.partitionBy("site_id", "path").orderBy("at"))).where(F.col("n") <= most)
    severity = F.coalesce(*[F.when(F.col("v.impact") == k, v) for k, v in IMPACT.items()], F.lit("medium"))
    shown = top.select("site_id", "path", F.lit("runtime.axe").alias("rule_id"), F.concat(slug("v.id"), F.lit(" on "), F.col("v.node_count").cast("string"), F.lit(" nodes "), F.array_join(F.transform("v.tags", wcag_label), " ")).alias("evidence"), F.lit(1).alias("line"), severity.alias("own"))
    rows = emit(shown, severity=F.col("own"))
    more = results.where(F.size("violations") > most).select("site_id", "path", F.lit("runtime.axe-results-truncated").alias("rule_id"), F.size("violations").cast("string").alias("evidence"), F.lit(1).alias("line"))
    rows = rows.unionByName(emit(more))
    if "incomplete" not in results.columns:
        return rows
    undecided = results.where(F.size("incomplete") > 0)
    names = F.array_join(F.filter(F.transform(F.slice("incomplete", 1, 10), lambda r: F.substring(r["id"], 1, 80)), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")
    said = F.concat_ws(": ", F.concat(F.size("incomplete").cast("string"), F.lit(" undecided")), F.nullif(names, F.lit("")))
    return rows.unionByName(emit(undecided.select("site_id", "path", F.lit("runtime.axe-incomplete-review").alias("rule_id"), said.alias("evidence"), F.lit(1).alias("line"))))


EVENTS = {"error": "runtime.page-errors", "page_error": "runtime.page-errors", "console_error": "runtime.console-errors", "request_failed": "runtime.request-failures", "remote_blocked": "runtime.remote-requests-blocked", "egress_blocked": "runtime.unmediated-egress-blocked"}


def event_findings(events: DataFrame) -> DataFrame:
    """events: site_id, path (route), event_type, at, detail: a row for each kind with its count and first detail.

    A count and a least pair: both combine before the shuffle, so one busy route is no burden.
    """
    known = events.where(F.col("event_type").isin(*EVENTS))
    rule = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in EVENTS.items()])
    counts = known.withColumn("rule_id", rule).groupBy("site_id", "path", "rule_id").agg(F.count("*").alias("n"), F.min(F.struct("at", "detail")).alias("x"))
    return emit(counts.select("site_id", "path", "rule_id", F.concat(F.col("n").cast("string"), F.lit(" events, first "), F.coalesce("x.detail", F.lit(""))).alias("evidence"), F.lit(1).alias("line")))


def merged(site: DataFrame, *observed: DataFrame) -> DataFrame:
    """Static findings and observations as one table; the same family then counts once in the score."""
    return reduce(DataFrame.unionByName, observed, site)

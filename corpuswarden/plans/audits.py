"""Audit queries over pages, documents, conversations, labels and events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.nested import redacted_json
from ..operators import findings as f
from ..operators import markup as m
from ..operators import code_rules, flow_rules, module_rules, observations, page_rules, policy, site_rules, source_rules
from ..operators.catalogue import RULES
from ..sources import tables
from . import rules_sql
from . import sql as S
from .fixtures import CODE, CRAWL, CREDENTIALS, FLOWS, LINKS, METADATA, MODULES, PROJECTS, SCRIPTS, SITES, STYLES, with_fixtures
from .registry import query

table = tables.table


def page_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = m.masked(m.pages(table(spark, sf_dir, "pages")))
    return pages, m.tags(pages)


def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, tags = page_tables(spark, sf_dir)
    return page_rules.head_findings(pages, page_rules.of_head(tags))


def earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline entries of an earlier state of all pages: without their charset, but with a viewport."""
    before = F.replace("html", F.lit('<meta charset="utf-8">'), F.lit('<meta name="viewport" content="width=device-width">'))
    pages = m.masked(m.pages(table(spark, sf_dir, "pages").withColumn("html", before)))
    return policy.baseline_of(f.fingerprinted(f.deduplicated(page_rules.head_findings(pages, page_rules.of_head(m.tags(pages))))))


def suppressions(spark: SparkSession) -> DataFrame:
    """The configured suppressions (a setting, not data)."""
    rows = [(1, "seo-missing-social-*", None, "not shared on social networks", None), (2, "seo-missing-canonical", "http:/**", "old pages", dt.date(2030, 1, 1)), (3, "responsive-*", None, "out of date", dt.date(2020, 1, 1)), (4, "seo-*", "**", "accepted", None)]
    return spark.createDataFrame(rows, "ord int, rule string, path string, reason string, expires date")


AS_OF = dt.date(2026, 1, 1)


# Structure


@query(S.X02)
def x02_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_tables(spark, sf_dir)[1].groupBy("page_id", "name", "closing").agg(F.count("*").alias("n"))


@query(S.X02_OFFSETS)
def x02_tag_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, tags = page_tables(spark, sf_dir)
    cut = F.substring(F.col("html"), F.col("offset") + 1, F.col("end") - F.col("offset"))
    return tags.join(pages.select("page_id", "html"), "page_id").groupBy("page_id").agg(F.count("*").alias("tags"), F.count_if(cut == F.col("raw")).alias("in_place"), F.min("offset").alias("first_offset"))


@query(S.X03)
def x03_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, tags = page_tables(spark, sf_dir)
    own = m.with_content(m.elements(tags, ["title", "h1", "nav", "script", "style"]), pages)
    return own.groupBy("page_id", "name").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("content_chars"))


@query(S.X06)
def x06_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, _ = page_tables(spark, sf_dir)
    return pages.select("page_id", F.sha2(m.visible(F.col("html")), 256).alias("text_sha256"))


@query(rules_sql.X08)
def x08_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.surface(page_tables(spark, sf_dir)[1]).groupBy("page_id").agg(F.count("*").alias("tags"))


@query(S.X09)
def x09_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.headings(*page_tables(spark, sf_dir)).select("page_id", "level", "text")


@query(rules_sql.X10)
def x10_css_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.css_rules(m.styles(*page_tables(spark, sf_dir))).groupBy("site_id", "selector").agg(F.count("*").alias("n"))


@query(S.X11)
def x11_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.scripts(*page_tables(spark, sf_dir)).groupBy("page_id", "type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(S.X20)
def x20_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.compact("text").alias("snippet"))


@query()
def x21_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    # In an array of one, so that both columns read the same clean text.
    both = F.transform(F.array(t.redacted("text")), lambda c: F.struct(F.regexp_count(c, F.lit("\\[REDACTED\\]")).alias("redactions"), F.sha2(c, 256).alias("redacted_sha256")))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(both))


@query(S.X22)
def x22_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = source_rules.assignments(tables.document_sources(spark, sf_dir))
    return own.select(F.col("path").alias("document"), "field", "value", "line")


# Sources


@query(S.S05)
def s05_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.inventory(tables.document_sources(spark, sf_dir, tables.MOST_BYTES))


# Page rules, one query for each, over the given pages and literal ones


def fixture_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = m.masked(m.pages(with_fixtures(table(spark, sf_dir, "pages"))))
    return pages, m.tags(pages)


def _rule(build, rule: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(*fixture_tables(spark, sf_dir), rule).where(F.col("rule_id") == rule).select("site_id", "path", "rule_id", "severity", "line", "evidence")

    return run


HEAD = {
    "d01": "seo-missing-title", "d02": "seo-multiple-titles", "d03": "seo-missing-description", "d04": "seo-missing-social-metadata", "d05": "seo-incomplete-social-metadata", "d06": "seo-invalid-social-url",
    "d07": "seo-missing-canonical", "d08": "seo-multiple-canonicals", "d09": "seo-invalid-canonical", "d10": "seo-insecure-canonical", "d11": "a11y-document-language", "d12": "html-missing-charset",
    "d13": "responsive-missing-viewport", "d14": "a11y-viewport-zoom", "d15": "seo-page-noindex", "d16": "a11y-meta-refresh", "d17": "performance-render-blocking-script",
}
BODY = {
    "m01": "a11y-image-alt", "m02": "performance-image-dimensions", "m03": "performance-priority-image-lazy", "m04": "a11y-iframe-title", "m05": "a11y-audible-autoplay", "m06": "a11y-control-name", "m07": "a11y-image-input-alt",
    "m08": "a11y-dialog-name", "m09": "a11y-interactive-nesting", "m10": "a11y-fieldset-legend", "m11": "a11y-table-name", "m12": "a11y-link-name", "m13": "ux-ambiguous-link-text", "m14": "a11y-clickable-noncontrol",
    "m15": "security-external-link-opener", "m16": "a11y-svg-image-name", "m17": "a11y-form-label", "m18": "forms-missing-autocomplete", "m19": "forms-implicit-button-type", "m20": "forms-no-validation-signal",
    "m21": "forms-no-error-feedback-signal", "m22": "a11y-positive-tabindex", "m23": "a11y-focusable-aria-hidden", "m24": "a11y-duplicate-id", "m25": "a11y-video-captions", "m26": "content-missing-h1", "m27": "content-multiple-h1",
    "m28": "content-empty-heading", "m29": "content-heading-jump", "m30": "security-insecure-resource", "m31": "privacy-password-get-form",
}
for _ids, _build in ((HEAD, lambda pages, tags, rule: page_rules.head_findings(pages, tags)), (BODY, lambda pages, tags, rule: page_rules.body_findings(pages, tags, {rule}))):
    for _id, _name in _ids.items():
        _f = _rule(_build, _name)
        _f.__name__ = f"{_id}_{_name.split('-', 1)[1].replace('-', '_')}"
        query(rules_sql.SQL[_name])(_f)


@query(rules_sql.M02)
def m02_image_certainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_rules.image_findings(*fixture_tables(spark, sf_dir)).select("site_id", "path", "confidence", "manual", "line", "evidence")


@query(rules_sql.D18)
def d18_invalid_structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_rules.structured_data_findings(*fixture_tables(spark, sf_dir)).select("site_id", "path", "evidence")


# Site


@query(S.G01)
def g01_site_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = m.pages(table(spark, sf_dir, "pages"))
    return site_rules.signals(pages).select("site_id", "pages", "documents", "structured", "main", "nav", "styles", "motion", "tokens")


@query(rules_sql.P05)
def p05_site_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame(SITES, "site_id string, path string, html string")
    return site_rules.signal_findings(site_rules.signals(m.pages(table(spark, sf_dir, "pages")).select(*own.columns).unionByName(own)))


@query(S.P06)
def p06_duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_rules.duplicate_titles(*page_tables(spark, sf_dir)).select("site_id", "title", "pages")


@query(rules_sql.P07)
def p07_duplicate_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_rules.duplicate_descriptions(*fixture_tables(spark, sf_dir)).select("site_id", "description", "pages")


@query(rules_sql.R00)
def r03_crawl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = m.pages(table(spark, sf_dir, "pages")).select("site_id", "path", F.col("html").alias("text"))
    own = spark.createDataFrame(CRAWL, "site_id string, path string, text string")
    sources = pages.unionByName(own)
    return site_rules.crawl_findings(sources.select("site_id"), sources).select("site_id", "path", "rule_id", "evidence")


@query(rules_sql.C00)
def c00_style_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = m.styles(*page_tables(spark, sf_dir)).select("site_id", "path", "css").unionByName(spark.createDataFrame(STYLES, "site_id string, path string, css string"))
    return source_rules.style_findings(m.css_rules(sheets)).select("site_id", "path", "rule_id", "evidence")


@query(rules_sql.E07)
def e07_script_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = m.scripts(*page_tables(spark, sf_dir)).select("site_id", F.concat("path", F.lit("/block.js")).alias("path"), "text")
    found = source_rules.script_findings(blocks.unionByName(spark.createDataFrame(SCRIPTS, "site_id string, path string, text string")))
    return found.groupBy("site_id", "path", "rule_id").agg(F.count("*").alias("n"))


@query(rules_sql.X25)
def x25_nested_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of all events and literal metadata, redacted at any depth."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type"), F.col("props").alias("json")).unionByName(spark.createDataFrame(METADATA, "event_type string, json string"))
    clean = rows.select("event_type", redacted_json("json").alias("json"))
    return clean.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.length("json")).cast("long").alias("chars"), F.sum(F.regexp_count("json", F.lit("\\[REDACTED\\]"))).cast("long").alias("redactions"))


def project_sources(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """Script blocks of pages, or the pages, as files of their sites, and the literal project files."""
    own = spark.createDataFrame(PROJECTS, "site_id string, path string, text string")
    if pages is None:
        return m.scripts(*page_tables(spark, sf_dir)).select("site_id", F.concat("path", F.lit("/block.js")).alias("path"), "text").unionByName(own)
    return pages.select("site_id", F.concat("path", F.lit("/page.html")).alias("path"), F.col("html").alias("text")).unionByName(own)


@query()
def e29_request_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_rules.request_flows(project_sources(spark, sf_dir))


@query()
def e19_navigation_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_rules.navigation_flows(project_sources(spark, sf_dir))


FILE = "site_id string, path string, text string"


def page_files(spark: SparkSession, sf_dir: str, own: list[tuple]) -> DataFrame:
    """The given pages as files of their sites, and literal files."""
    pages = m.pages(table(spark, sf_dir, "pages")).select("site_id", F.concat("path", F.lit("/page.html")).alias("path"), F.col("html").alias("text"))
    return pages.unionByName(spark.createDataFrame(own, FILE))


@query(rules_sql.G12)
def g12_flow_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of the flow rules over labelled files, and over script blocks of all pages, which have none."""
    cases = spark.createDataFrame([(f"case-{k}", rule, expected, code) for k, (rule, expected, code) in enumerate(FLOWS)], "case string, rule_id string, expected int, text string")
    names = F.array(*map(F.lit, sorted({r for r, _, _ in FLOWS})))
    blocks = m.scripts(*page_tables(spark, sf_dir)).select(F.concat_ws("-", F.lit("page"), "page_id", "open_end").alias("case"), F.explode(names).alias("rule_id"), F.lit(0).alias("expected"), "text")
    all_cases = cases.unionByName(blocks)
    files = all_cases.select(F.col("case").alias("site_id"), F.lit("server/handler.js").alias("path"), "text").distinct()
    seen = flow_rules.request_flows(files).unionByName(flow_rules.navigation_flows(files)).select(F.col("site_id").alias("case"), "rule_id")
    return f.precision_recall(all_cases.drop("text"), seen, ["rule_id"])


@query(rules_sql.E22)
def e22_cookies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_rules.cookie_findings(page_files(spark, sf_dir, CODE)).select("site_id", "path", "severity", "line", "evidence")


@query(rules_sql.E25)
def e25_policy_weaknesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_rules.policy_weaknesses(page_files(spark, sf_dir, CODE)).select("site_id", "path", "severity", "line", "evidence")


@query(rules_sql.M26)
def m26_composed_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return module_rules.missing_headings(page_files(spark, sf_dir, MODULES)).select("site_id", "path", "rule_id", "severity")


@query(rules_sql.P15)
def p15_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return module_rules.missing_not_found(page_files(spark, sf_dir, MODULES)).select("site_id", "rule_id", "evidence")


@query(rules_sql.E26)
def e26_missing_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = project_sources(spark, sf_dir, m.pages(table(spark, sf_dir, "pages")))
    return flow_rules.missing_headers(sources, sources).select("site_id", "rule_id", "severity", "evidence")


@query(rules_sql.P17)
def p17_browser_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_rules.browser_findings(project_sources(spark, sf_dir, m.pages(table(spark, sf_dir, "pages")))).select("site_id", "rule_id", "severity")


# Credentials


@query(S.E03)
def e03_document_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_rules.assigned_secrets(tables.document_sources(spark, sf_dir)).select("site_id", F.col("path").alias("document"), "severity", "line", "evidence")


@query(rules_sql.E01)
def e01_provider_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tables.described(spark.createDataFrame(CREDENTIALS, "site_id string, path string, text string"), None)
    rows = source_rules.provider_findings(tables.document_sources(spark, sf_dir).unionByName(tables.conversation_sources(spark, sf_dir)).unionByName(own))
    return rows.groupBy("site_id", "rule_id", "severity").agg(F.count("*").alias("n"))


@query(rules_sql.E10)
def e10_insecure_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tables.described(spark.createDataFrame(LINKS, FILE), None)
    return source_rules.insecure_links(tables.document_sources(spark, sf_dir).unionByName(own))


# Observations


@query(S.L20)
def l20_event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.event_findings(tables.browser_events(spark, sf_dir)).select("path", "rule_id", "severity", "evidence")


# Findings


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.deduplicated(head(spark, sf_dir))


@query(S.W01)
def w01_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = head(spark, sf_dir)
    return f.deduplicated(twice.unionByName(twice)).groupBy("site_id", "rule_id").agg(F.count("*").alias("n"))


@query(S.W02)
def w02_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.fingerprinted(deduplicated(spark, sf_dir)).select("site_id", "rule_id", "path", "occurrence", "fingerprint")


@query(S.W03)
def w03_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.capped(deduplicated(spark, sf_dir), 5).select("site_id", "rule_id", "path", "rank")


@query(S.W04)
def w04_heading_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    heads = m.headings(*page_tables(spark, sf_dir))
    last = F.lag("level").over(Window.partitionBy("page_id").orderBy("offset"))
    return heads.withColumn("last", last).groupBy("page_id").agg(F.count("*").alias("headings"), F.count_if(F.col("level") > F.col("last") + 1).alias("jumps"))


@query(S.G02)
def g02_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.summary(deduplicated(spark, sf_dir))


@query()
def g03_site_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.scores(f.deduplicated(page_rules.page_findings(table(spark, sf_dir, "pages"))))


@query(S.G03)
def g03_head_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.scores(deduplicated(spark, sf_dir)).select("site_id", F.col("raw").cast("double").alias("raw"), "families", "repeated_signals", "risk", "score", "band")


@query(S.G04)
def g04_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.contributions(deduplicated(spark, sf_dir)).select("site_id", "family", F.col("points").cast("double").alias("points"), "signals")


@query(S.G06)
def g06_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.ledger(deduplicated(spark, sf_dir), "site", 5).where("observed > 0").select("rule_id", "sites", "observed", "retained", "outcome")


@query(S.G07)
def g07_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.applicability(f.ledger(deduplicated(spark, sf_dir), "site"))


@query(S.G08)
def g08_cap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.cap_counts(deduplicated(spark, sf_dir), 5).select("site_id", "rule_id", "observed", "retained", "left_out")


@query(S.G11)
def g11_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector of symbol-laden text against the documents labelled as poor, by language."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where("quality is not null").select(F.col("doc_id").alias("case"), F.lit("poor-text").alias("rule_id"), (1 - F.col("quality")).alias("expected"))
    marks = F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))
    seen = docs.where(20 * marks > F.length("text")).select(F.col("doc_id").alias("case"), F.lit("poor-text").alias("rule_id"))
    return f.precision_recall(labels.join(docs.select(F.col("doc_id").alias("case"), "lang"), "case"), seen, ["lang"])


@query(S.O03)
def o03_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.gate(policied(spark, sf_dir), "medium", new_only=True)


# Policy


def policied(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = f.fingerprinted(deduplicated(spark, sf_dir))
    return policy.suppressed(policy.compared(own, earlier(spark, sf_dir)), suppressions(spark), AS_OF)


@query(S.J01)
def j01_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.compared(f.fingerprinted(deduplicated(spark, sf_dir)), earlier(spark, sf_dir)).groupBy("site_id", "rule_id", "baseline_state").agg(F.count("*").alias("n"))


@query(S.J02)
def j02_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policied(spark, sf_dir).select("site_id", "rule_id", "path", "suppression", "reason")


@query(S.J03)
def j03_merged_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of more than one page were scanned again; the others keep their old entries."""
    now = policy.baseline_of(f.fingerprinted(deduplicated(spark, sf_dir)))
    modes = m.pages(table(spark, sf_dir, "pages")).groupBy("site_id").agg(F.count("*").alias("n")).where("n > 1").select("site_id", F.lit("site").alias("mode"))
    return policy.merged(earlier(spark, sf_dir), now.join(modes, ["site_id", "mode"], "left_semi"), modes).groupBy("site_id").agg(F.count("*").alias("entries"))


@query(S.Z04)
def z04_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the earlier state that the pages no longer show."""
    return policy.fixed(f.fingerprinted(deduplicated(spark, sf_dir)), earlier(spark, sf_dir)).select("site_id", "rule_id", "path")


@query(S.G09)
def g09_policy_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.counters(policied(spark, sf_dir))


# Exports


@query(S.S09)
def s09_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = deduplicated(spark, sf_dir).select("site_id", "category", "evidence", "path", "rule_id", "severity")
    return f.json_rows(own)


@query(S.S10)
def s10_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = f.sarif_rows(f.fingerprinted(deduplicated(spark, sf_dir)))
    return rows.select("site_id", "ruleId", "level", F.col("message.text").alias("text"), F.col("location.startLine").alias("line"), F.col("partialFingerprints.primary").alias("fingerprint"))


@query(S.S10_DOCUMENTS)
def s10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the run documents of all sites hold, read back from their pieces."""
    pieces = f.documents(policied(spark, sf_dir))
    json = F.regexp_replace("value", "^,", "")
    results = pieces.where(F.col("part") == f.OF_RESULTS).select("site_id", F.get_json_object(json, "$.baselineState").alias("state"), F.get_json_object(json, "$.suppressions[0].justification").alias("reason"), F.get_json_object(json, "$.ruleIndex").cast("int").alias("index"))
    return results.groupBy("site_id").agg(F.count("*").alias("results"), (F.max("index") + 1).alias("rules"), F.count_if(F.col("state") == "new").alias("new"), F.count("reason").alias("suppressed"))


@query(S.S11)
def s11_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.by_category(deduplicated(spark, sf_dir))


@query(S.S12)
def s12_action_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.action_plan(deduplicated(spark, sf_dir))


@query(S.N19)
def n19_run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.run_ids(f.fingerprinted(deduplicated(spark, sf_dir)))


# Scalars


@query(S.N12)
def n12_url_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.url_issue("url", https=True).alias("issue"))


@query(S.N20)
def n20_display_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.display_url("url").alias("url"), t.slug("url").alias("slug"))


assert len({r[0] for r in RULES}) == len(RULES)

"""The library's entry points: tables in, findings out, then what is made of findings.

    findings = audit_pages(crawl).unionByName(audit_documents(documents))
    kept = apply_policy(finalize(findings), baseline, suppressions, date.today())
    scores(kept), gate(kept, "high"), run_documents(kept)

Findings are tables as ``operators.findings`` describes them; nothing is collected.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame

from .operators import code_rules, findings, flow_rules, markup, module_rules, observations, page_rules, policy, site_rules, source_rules, standards, supply_rules
from .operators.policy import gate

__all__ = ["apply_policy", "audit_documents", "audit_observations", "audit_pages", "audit_sources", "finalize", "gate", "run_documents", "scores", "summarize"]


def audit_pages(pages: DataFrame) -> DataFrame:
    """All rules of pages and sites over a crawl (page_id, url, html)."""
    own = markup.pages(pages)
    site = site_rules.signal_findings(site_rules.signals(own))
    return page_rules.page_findings(pages).unionByName(site)


def audit_sources(sources: DataFrame) -> DataFrame:
    """All rules over files of sites (site_id, path, text; text is null if a file was not read). Files in folders of
    dependencies and build products are left out, but for the manifests and locks that rules look for."""
    own = source_rules.in_scope(sources)
    read = own.where("text is not null")
    styles = read.where("lower(path) like '%.css'").withColumnRenamed("text", "css")
    flows = [flow_rules.request_flows(own), flow_rules.navigation_flows(own), flow_rules.missing_headers(own, own), flow_rules.browser_findings(own)]
    code = [source_rules.document_secrets(own), source_rules.script_findings(own), code_rules.code_findings(own), source_rules.component_findings(own)]
    text = [source_rules.markdown_findings(read.where("lower(path) like '%.md' or lower(path) like '%.mdx'")), source_rules.style_findings(markup.css_rules(styles)), source_rules.import_findings(styles)]
    supply = [f(own) for f in (supply_rules.manifest_findings, supply_rules.lockfile_findings, supply_rules.workflow_findings, supply_rules.container_findings, supply_rules.environment_findings)]
    modules = [module_rules.missing_headings(own), module_rules.missing_not_found(own), site_rules.crawl_findings(own, own)]
    return reduce(DataFrame.unionByName, [t.select(*findings.COLUMNS) for t in flows + code + text + supply + modules])


def audit_documents(documents: DataFrame) -> DataFrame:
    """Credentials in texts (site_id, path, text)."""
    return source_rules.document_secrets(documents)


def audit_observations(responses: DataFrame | None = None, snapshots: DataFrame | None = None, accessibility: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """All rules over what a browser recorded: responses, metrics, accessibility results and events, as given."""
    pairs = ((observations.header_findings, responses), (observations.metric_findings, snapshots), (observations.axe_findings, accessibility), (observations.event_findings, events))
    found = [rule(table) for rule, table in pairs if table is not None]
    if not found:
        raise ValueError("no observations are given")
    return reduce(DataFrame.unionByName, [t.select(*findings.COLUMNS) for t in found])


def finalize(found: DataFrame) -> DataFrame:
    """One row for each rule, place and evidence, with its fingerprint, standards and references."""
    return standards.with_standards(findings.fingerprinted(findings.deduplicated(found)))


def apply_policy(found: DataFrame, baseline: DataFrame, suppressions: DataFrame, as_of: dt.date) -> DataFrame:
    """Finalized findings compared with a baseline, with the suppression that covers each."""
    return policy.suppressed(policy.compared(found, baseline), suppressions, as_of)


def summarize(found: DataFrame) -> DataFrame:
    """Score, band and counts of each site and mode."""
    return findings.scores(found).join(findings.summary(found), ["site_id", "mode"])


scores, run_documents = findings.scores, findings.documents

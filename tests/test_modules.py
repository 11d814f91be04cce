"""Components and routes, nested redaction, standards, run documents and the entry points."""

import datetime as dt
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from corpuswarden import audit
from corpuswarden.functions import text as t
from corpuswarden.functions.nested import redacted_json
from corpuswarden.operators import findings, markup, module_rules, observations, page_rules, site_rules, standards
from corpuswarden.sources import tables

SOURCES = "site_id string, path string, text string"
FINDING = "site_id string, mode string, rule_id string, family string, category string, severity string, confidence string, manual boolean, path string, line int, evidence string"


def sources(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], SOURCES)


def test_headings_through_imports(spark):
    rows = [
        ("src/pages/deep.tsx", "import * as Ui from '../ui'\nexport default () => <Ui.Shell />"), ("src/ui/index.ts", "import { Shell as Top } from './shell.js'\nexport const x = <Top/>"), ("src/ui/shell.tsx", "<h1>x</h1>"),
        ("src/pages/type.tsx", "import type Shell from '../ui/shell'\nexport default () => <Shell />"), ("src/pages/space.tsx", "import * as Ui from '../ui'\nexport default () => <Ui />"), ("src/app/layout.tsx", "export default ({ children }) => <main>{children}</main>"),
        ("src/pages/go.tsx", "export default () => <Navigate to='/' />"), ("src/pages/stay.tsx", "export default () => <main><Navigate to='/' /></main>"), ("src/lib/util.ts", "x"), ("src/pages/none.tsx", None),
    ]
    got = {r.path for r in module_rules.missing_headings(sources(spark, rows)).collect()}
    assert got == {"src/pages/type.tsx", "src/pages/space.tsx", "src/pages/stay.tsx"}


ROUTER = "import { Route } from 'react-router-dom'\n"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (ROUTER + "import { Missing as NotFoundPage } from './x'\n<Route path='*' element={<NotFoundPage />} />", True),
        (ROUTER + "import Page from './PageNotFound'\n<Route path={'/404'} Component={Page} />", True),
        (ROUTER + "const NotFound = () => null\n<Route path={`*`} element={<NotFound />} />", True),
        (ROUTER + "import * as Pages from './x'\n<Route path='*' element={<Pages.NotFound />} />", True),
        (ROUTER + "import NotFound from './x'\n<Route path={all} element={<NotFound />} />", False),
        (ROUTER + "import NotFound from './x'\n<Route path='*' element={<Navigate to='/' />} />", False),
        ("import NotFound from './x'\n<Route path='*' element={<NotFound />} />", False),
        (ROUTER + "import Page from './x'\n<Route path='*' element={<Page />} />", False),
    ],
)
def test_routes_for_what_is_not_found(spark, text, found):
    own = sources(spark, [("src/App.jsx", text), ("src/x.jsx", ""), ("src/PageNotFound.ts", ""), ("src/pages/a.jsx", ""), ("src/pages/b.jsx", None)])
    assert (module_rules.not_found_routes(own).count() == 1) == found
    assert module_rules.missing_not_found(own).count() == (not found)


def plain_redaction(value, redact, field="", around=""):
    if isinstance(value, dict):
        return {k: plain_redaction(v, redact, k, field) for k, v in value.items()}
    if isinstance(value, list):
        return [plain_redaction(v, redact, field, around) for v in value]
    if not isinstance(value, str):
        return value
    public = re.fullmatch(r"https://[^/?#@\s]+(?:[/?#]\S*)?", value) and (field == "references" or field == "url" and around == "standards")
    return value if public or field == "fingerprint" and re.fullmatch("[a-f0-9]{64}", value) else redact(value)


def test_nested_redaction(spark):
    key, run = "AKIA" + "QWERTYUIOPASDFGH", "a1B2c3D4" * 5
    values = [
        {"a": [{"b": {"token": "x"}}, [key, 1.5, None, True]], "note": f"k {key} \"q\" \\ é\n", "password": "p", "n": -2},
        {"fingerprint": "ab" * 32, "other": "ab" * 32, "id": "runtime.a-b-c-d-e-f-g-h-i-j-k-l-m-n-1", "deep": {"fingerprint": ["cd" * 32, run]}},
        {"references": [f"https://a.example/{run}", f"https://u:p@a.example/{run}"], "standards": [{"id": "CWE-1", "url": f"https://a.example/{run}"}], "url": f"https://a.example/{run}"},
        [], {}, "plain", {"a": {"b": []}, "c": run},
    ]
    rows = [(json.dumps(v, ensure_ascii=False),) for v in values] + [(f"no json {key}",), (None,), ("",)]
    got = [r.x for r in spark.createDataFrame(rows, "j string").select(redacted_json("j").alias("x")).collect()]
    texts = set()

    def note(value):
        texts.add(value)
        return value

    for v in values:
        plain_redaction(v, note)
    table = {r.v: r.x for r in spark.createDataFrame([(x,) for x in texts], "v string").select("v", t.redacted("v").alias("x")).collect()}
    table["runtime.a-b-c-d-e-f-g-h-i-j-k-l-m-n-1"] = "runtime.a-b-c-d-e-f-g-h-i-j-k-l-m-n-1"  # an identifier
    for v, x in zip(values, got, strict=False):
        assert json.loads(x) == plain_redaction(v, table.__getitem__)
    assert key not in "".join(x for x in got if x) and got[-3] == "no json [REDACTED]" and got[-2] is None and got[-1] == ""


def test_composed_and_decomposed_evidence(spark):
    pairs = [("café", "café"), ("ﬁle ①", "file 1"), ("a b", "a b"), ("plain", "plain")]
    rows = [("s", "site", "seo-missing-title", "f", "c", "low", "high", False, f"p{k}", 1, x) for k, pair in enumerate(pairs) for x in pair]
    got = findings.fingerprinted(spark.createDataFrame(rows, FINDING)).select("path", "fingerprint").collect()
    assert len({r.fingerprint for r in got}) == len(pairs)
    assert spark.createDataFrame([(None,)], "x string").select(t.nfkc("x").alias("x")).first().x is None


def test_standards(spark):
    rows = [("s", "security", r, "f", "c", "low", "high", False, "p", 1, "e") for r in ("dom-xss", "seo-missing-title")]
    got = {r.rule_id: r for r in standards.with_standards(spark.createDataFrame(rows, FINDING)).collect()}
    assert [s.id for s in got["dom-xss"].standards] == ["CWE-79", "OWASP-A05:2025"] and got["dom-xss"].references == ["https://cwe.mitre.org/data/definitions/79.html", "https://owasp.org/Top10/2025/A05_2025-Injection/"]
    assert got["seo-missing-title"].standards == [] and len(standards.OF_RULES) == 34
    S = lambda i, title=None, url=None: (i, title, url)  # noqa: E731, N806
    rows = [
        (1, ["https://a.example/x", "https://a.example/x"], [S("A 1"), S("A 1", "again")]), (2, ["http://a.example"], []), (3, ["https://u@a.example"], []), (4, ["nothing"], []), (5, ["https://a.example/" + "x" * 2048], []),
        (6, [f"https://a.example/{k}" for k in range(21)], []), (7, [], [S("")]), (8, [], [S("ok", "x" * 241)]), (9, [], [S("ok", None, "http://a.example")]), (10, None, None), (11, [None], []),
    ]
    good, bad = standards.validated(spark.createDataFrame(rows, f"n int, references array<string>, standards array<{standards.STANDARD}>"))
    kept = {r.n: r for r in good.collect()}
    assert set(kept) == {1, 10} and kept[1].references == ["https://a.example/x"] and [(s.id, s.title) for s in kept[1].standards] == [("A 1", "again")]
    assert {r.n: r.problems[0] for r in bad.collect()} == {2: "references: not https", 3: "references: credentials", 4: "references: invalid", 5: "references: length", 6: "references: more than 20", 7: "standards: id", 8: "standards: title", 9: "standards: url: not https", 11: "references: length"}


def test_run_documents(spark, tmp_path):
    rows = [(site, mode, rule, "f", "c", "high", "high", False, f"src/p {k}.js", k, f'say "{k}"') for site in ("a", "b/c") for mode, rule in (("site", "seo-missing-title"), ("security", "dom-xss"), ("security", "cors")) for k in range(1, 6)]
    own = findings.fingerprinted(spark.createDataFrame(rows, FINDING)).withColumn("baseline_state", F.lit("new")).withColumn("suppression", F.when(F.col("line") == 3, 1)).withColumn("reason", F.lit("it's accepted"))
    tables.write_documents(findings.documents(own), str(tmp_path / "out"))
    docs = {}
    for folder, _, names in os.walk(tmp_path / "out"):
        parts = sorted(n for n in names if n.startswith("part-"))
        if parts:
            docs[os.path.relpath(folder, tmp_path / "out")] = json.loads("".join(open(os.path.join(folder, n)).read() for n in parts))
    assert set(docs) == {f"site_id={s}/mode={m}" for s in ("a", "b%2Fc") for m in ("site", "security")}
    run = docs["site_id=a/mode=security"]["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["cors", "dom-xss"] and len(run["results"]) == 10 == run["properties"]["results"]
    for r in run["results"]:
        assert run["tool"]["driver"]["rules"][r["ruleIndex"]]["id"] == r["ruleId"] and r["baselineState"] == "new"
        line = r["locations"][0]["physicalLocation"]["region"]["startLine"]
        assert ("suppressions" in r) == (line == 3) and r["message"]["text"] == f'say "{line}"'
        assert r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == f"src/p%20{line}.js"


def test_completeness_and_suggested_files(spark):
    checks = [("a", "dependency-audit", "completed", True), ("a", "runtime", "skipped", True), ("b", "runtime", "failed", True), ("b", "source-coverage", "partial", False), ("c", "runtime", None, True)]
    got = {r.site_id: (r.complete, r.incomplete) for r in findings.completeness(spark.createDataFrame(checks, "site_id string, check string, status string, requested boolean")).collect()}
    assert got == {"a": (True, []), "b": (False, ["runtime: failed"]), "c": (True, [])}
    rows = [("a", "web/app/Layout.tsx", ""), ("a", "web/app/page.tsx", ""), ("a", "app/page.tsx", ""), ("b", "index.html", ""), ("b", "x/index.html", ""), ("c", "main.py", "")]
    frameworks = spark.createDataFrame([("a", "Next.js"), ("b", "React"), ("c", "Vue"), ("d", "Unknown")], "site_id string, framework string")
    files = {r.site_id: r.files for r in site_rules.suggested_files(frameworks, spark.createDataFrame(rows, SOURCES)).collect()}
    assert files == {"a": ["web/app/Layout.tsx", "web/app/page.tsx"], "b": ["index.html"]}


def test_undecided_accessibility_checks(spark):
    schema = "site_id string, path string, violations array<struct<id:string,impact:string,tags:array<string>,node_count:int>>, incomplete array<struct<id:string>>"
    rows = [("s", "/", [("label", "critical", ["wcag143"], 2)], [("color-contrast",), (None,)]), ("s", "/x", [], [])]
    got = {(r.rule_id, r.path, r.severity, r.evidence) for r in observations.axe_findings(spark.createDataFrame(rows, schema)).collect()}
    assert ("runtime.axe-incomplete-review", "/", "info", "2 undecided: color-contrast") in got and len(got) == 2


def test_components_are_no_elements(spark):
    html = '<Input id="a"/><input id="b"><Image src="x" alt=""/><img src="y" alt="" className={size}><img {...p} alt=""><Button></Button>'
    pages = spark.createDataFrame([("s", 1, "src/A.jsx", html), ("s", 2, "a.html", '<INPUT id="c">')], "site_id string, page_id long, path string, html string")
    tags = markup.tags(pages)
    got = {(r.path, r.rule_id, r.evidence) for r in page_rules.body_findings(pages, tags, {"a11y-form-label", "a11y-control-name"}).collect()}
    assert got == {("src/A.jsx", "a11y-form-label", '<input id="b">'), ("a.html", "a11y-form-label", '<INPUT id="c">')}
    sure = {r.evidence.split()[0] + r.evidence.split()[1]: (r.confidence, r.manual) for r in page_rules.image_findings(pages, tags).collect()}
    assert sure == {'<Imagesrc="x"': ("high", False), '<imgsrc="y"': ("low", True), "<img{...p}": ("low", True)}


def test_entry_points(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", "<html><body><p>x</p></body></html>")], "page_id long, url string, html string")
    files = sources(spark, [("src/a.js", "el.innerHTML = x"), ("server/b.js", "fetch(\n req.query.u\n)"), ("node_modules/c.js", "eval(x)"), ("README.md", "# x"), ("a.css", "a { transition: all 1s }"), ("package.json", "{}")])
    found = audit.audit_pages(pages).unionByName(audit.audit_sources(files)).unionByName(audit.audit_documents(sources(spark, [("d", "password = 'hunter2hunter2'")])))
    done = audit.finalize(found)
    old = spark.createDataFrame([], "site_id string, mode string, fingerprint string, rule_id string, severity string, path string")
    rules = spark.createDataFrame([(1, "dom-*", "src/**", "accepted", None), (2, "*", None, "old", dt.date(2020, 1, 1))], "ord int, rule string, path string, reason string, expires date")
    rows = audit.apply_policy(done, old, rules, dt.date(2026, 1, 1)).collect()
    by = {r.rule_id: r for r in rows}
    assert {"dom-xss", "server-ssrf", "performance-transition-all", "embedded-secrets", "content-missing-h1", "manual-visual-ux-review"} <= set(by)
    assert by["dom-xss"].suppression == 1 and by["server-ssrf"].suppression is None and not any("node_modules" in r.path for r in rows)
    assert [s.id for s in by["server-ssrf"].standards] == ["CWE-918", "OWASP-A01:2025"] and {r.baseline_state for r in rows} == {"new"}
    with pytest.raises(ValueError, match="no observations"):
        audit.audit_observations()

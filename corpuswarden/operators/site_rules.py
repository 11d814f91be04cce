"""Rules over whole sites: signals folded over all pages, crawl files, site likelihood, page reach by imports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, directory, extension, url_issue, xml_decoded
from .findings import emit


def signals(pages: DataFrame) -> DataFrame:
    """One row for each site: counts and flags over all its pages (site_id, path, html), folded before the shuffle."""
    t = F.col("html")
    has = lambda p: F.bool_or(t.rlike(p))
    document = t.rlike("(?i)<html\\b|<!doctype html")
    return pages.groupBy("site_id").agg(
        F.count("*").alias("pages"), F.count_if(document).alias("documents"),
        has("(?i)application/ld\\+json|schema\\.org|itemscope").alias("structured"), has("(?i)<main\\b|role\\s*=\\s*[\"']main").alias("main"),
        has("(?i)<nav\\b|role\\s*=\\s*[\"']navigation").alias("nav"), has("(?i)<style\\b|rel\\s*=\\s*[\"']?stylesheet|\\sstyle\\s*=").alias("styles"),
        has("(?i)@media|@container|\\b(sm|md|lg|xl):[a-z]").alias("breakpoints"), has("(?i)@keyframes|animation\\s*:|transition\\s*:").alias("motion"),
        has("(?i)prefers-reduced-motion").alias("reduced_motion"), has("(?i)\\bloading\\b|spinner|skeleton|aria-busy").alias("loading"),
        has("(?i)error|role\\s*=\\s*[\"']alert").alias("errors"), has("(?i)no results|empty|nothing (here|found)").alias("empty_state"),
        has("(?i)fetch\\(|axios|XMLHttpRequest|data-reactroot|ng-app|v-app").alias("app_like"), F.bool_or(F.col("path").rlike("(?i)(^|/)(404|not-found)(\\.|/|$)")).alias("not_found"),
        F.sum(F.regexp_count(t, F.lit("(?i)#[0-9a-f]{3,8}\\b|\\brgba?\\("))).alias("colours"), has("(?i)var\\(--|--[a-z-]+\\s*:").alias("tokens"),
        has("(?i)google-analytics|gtag\\(|googletagmanager|plausible\\.io|matomo|hotjar").alias("analytics"), has("(?i)consent|cookie (policy|banner|notice)|privacy").alias("consent"),
    )


MANUAL = ["visual-ux-review", "user-flow-review", "responsive-a11y-review", "cwv-browser-review", "discoverability-review", "conversion-measurement-review"]


def signal_findings(signals: DataFrame) -> DataFrame:
    """Site rules as filters on the row of signals, at most one finding of each rule for a site."""
    f = F.col
    rules: list[tuple[str, Column]] = [
        ("discoverability-no-structured-data", ~f("structured")), ("a11y-missing-main-landmark", (f("documents") > 0) & ~f("main")), ("ux-missing-navigation-landmark", (f("documents") > 1) & ~f("nav")),
        ("responsive-no-breakpoint-strategy", f("styles") & ~f("breakpoints")), ("a11y-motion-no-reduction", f("motion") & ~f("reduced_motion")),
        ("ux-no-loading-state", f("app_like") & ~f("loading")), ("ux-no-error-state", f("app_like") & ~f("errors")), ("ux-no-empty-state", f("app_like") & ~f("empty_state")),
        ("ux-no-not-found-page", (f("documents") > 1) & ~f("not_found")), ("design-no-color-tokens", (f("colours") >= 12) & ~f("tokens")),
        ("privacy-analytics-without-consent-signal", f("analytics") & ~f("consent")), *[(f"manual-{m}", F.lit(True)) for m in MANUAL],
    ]
    fired = F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in rules]), lambda x: x.isNotNull())
    return emit(signals.select("site_id", F.lit("(site)").alias("path"), F.explode(fired).alias("rule_id"), F.concat("pages", F.lit(" pages")).alias("evidence"), F.lit(1).alias("line")))


def robots_groups(sources: DataFrame) -> DataFrame:
    """site_id, path, group, agents and directives (array<struct<field,value>>) of robots.txt files.

    A group starts with an agent line that follows a directive. Lines of one file are folded in order.
    """
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$|\\r", "")))
    pairs = F.transform(F.filter(lines, lambda x: x.rlike("^[A-Za-z-]+\\s*:")), lambda x: F.struct(F.lower(F.regexp_extract(x, "^([A-Za-z-]+)", 1)).alias("field"), F.trim(F.regexp_replace(x, "^[A-Za-z-]+\\s*:", "")).alias("value")))
    each = sources.where("text is not null").select("site_id", "path", F.posexplode(pairs).alias("at", "x")).where("x.field != 'sitemap'")
    from pyspark.sql import Window

    order = Window.partitionBy("site_id", "path").orderBy("at")
    starts = (F.col("x.field") == "user-agent") & F.coalesce(F.lag("x.field").over(order) != "user-agent", F.lit(True))
    numbered = each.withColumn("group", F.sum(F.when(starts, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("group > 0")
    agents = F.array_sort(F.collect_set(F.when(F.col("x.field") == "user-agent", F.lower("x.value"))))
    rules = F.transform(F.array_sort(F.collect_list(F.when(F.col("x.field") != "user-agent", F.struct("at", "x.field", "x.value")))), lambda r: F.struct(r["field"].alias("field"), r["value"].alias("value")))
    return numbered.groupBy("site_id", "path", "group").agg(agents.alias("agents"), rules.alias("directives"))


def sitemap_locations(sources: DataFrame) -> DataFrame:
    """A row for each ``loc`` of sitemap files, decoded."""
    found = F.regexp_extract_all("text", F.lit("(?is)<(?:[a-z]+:)?loc\\s*>(.*?)</(?:[a-z]+:)?loc\\s*>"), F.lit(1))
    return sources.where("text is not null").select("site_id", "path", F.posexplode(found).alias("at", "raw")).select("site_id", "path", "at", xml_decoded("raw").alias("loc"))


def _row(df: DataFrame, rule: str, value: Column | None = None) -> DataFrame:
    return df.select("site_id", "path", F.lit(rule).alias("rule_id"), (F.col("path") if value is None else value).alias("evidence"), F.lit(1).alias("line"))


def crawl_findings(sites: DataFrame, sources: DataFrame) -> DataFrame:
    """Rules over robots.txt and sitemaps. sites: site_id of sites with pages; sources: site_id, path, text."""
    from pyspark.sql import Window

    robots = sources.where(base_name("path") == "robots.txt")
    maps = sources.where(base_name("path").rlike("(?i)^sitemap[A-Za-z0-9_-]*\\.xml$"))
    unread = lambda df: df.where("text is null")
    read = robots.where("text is not null")
    read_maps = maps.where("text is not null")
    own = sites.select("site_id").distinct().withColumn("path", F.lit("(site)"))
    agent = F.col("text").rlike("(?im)^\\s*user-agent\\s*:")
    groups = robots_groups(sources.where(base_name("path") == "robots.txt")).where(F.array_contains("agents", "*"))
    blocked = groups.groupBy("site_id", "path").agg(F.bool_or(F.exists("directives", lambda d: (d["field"] == "disallow") & d["value"].isin("/", "/*"))).alias("all"), F.bool_or(F.exists("directives", lambda d: (d["field"] == "allow") & d["value"].isin("/", "/*"))).alias("open"))
    stated = read.select("site_id", "path", F.explode(F.regexp_extract_all("text", F.lit("(?im)^\\s*sitemap\\s*:\\s*(\\S*)"), F.lit(1))).alias("value"))
    locs = sitemap_locations(maps)
    again = locs.where(url_issue("loc").isNull()).withColumn("n", F.row_number().over(Window.partitionBy("site_id", F.lower(F.regexp_replace("loc", "/+$", ""))).orderBy("path", "at"))).where("n > 1")
    counts = read_maps.join(locs.groupBy("site_id", "path").agg(F.count("*").alias("n")), ["site_id", "path"], "left")
    root = F.col("text").rlike("(?i)<(?:[a-z]+:)?(urlset|sitemapindex)\\b")
    out = [
        _row(unread(robots), "crawl-robots-unvalidated"), _row(unread(maps), "crawl-sitemap-unvalidated"),
        _row(own.join(robots, "site_id", "left_anti"), "crawl-missing-robots"), _row(own.join(maps, "site_id", "left_anti"), "crawl-missing-sitemap"),
        _row(read.where(~agent), "crawl-invalid-robots"), _row(read.where(F.col("text").rlike("(?im)^\\s*noindex\\s*:")), "crawl-unsupported-noindex", F.trim(F.regexp_extract("text", "(?im)^\\s*(noindex\\s*:[^\\n]*)", 1))),
        _row(blocked.where(F.col("all") & ~F.col("open")), "crawl-sitewide-disallow", F.lit("Disallow: /")),
        _row(read.where(~F.col("text").rlike("(?im)^\\s*sitemap\\s*:")).join(maps.select("site_id").distinct(), "site_id", "left_semi"), "crawl-robots-missing-sitemap"),
        _row(stated.where(url_issue("value").isNotNull()), "crawl-invalid-sitemap-directive", F.col("value")),
        _row(read_maps.where(~root), "crawl-invalid-sitemap"), _row(read_maps.where(root & ~F.contains("text", F.lit("http://www.sitemaps.org/schemas/sitemap/0.9"))), "crawl-sitemap-namespace"),
        _row(counts.where(root & (F.coalesce("n", F.lit(0)) == 0)), "crawl-empty-sitemap"),
        _row(locs.where(url_issue("loc").isNotNull()), "crawl-invalid-sitemap-location", F.col("loc")),
        _row(locs.where(url_issue("loc").isNull() & (F.coalesce(url_issue("loc", https=True), F.lit("")) == "not https")), "crawl-insecure-sitemap-location", F.col("loc")),
        _row(again, "crawl-duplicate-sitemap-location", F.col("loc")),
    ]
    return emit(reduce(DataFrame.unionByName, out))


def import_edges(sources: DataFrame) -> DataFrame:
    """site_id, importer, module: local imports resolved to the first of their candidate paths that exists."""
    spec = F.regexp_extract_all("text", F.lit("(?:\\bfrom\\s*|\\bimport\\s*\\(?\\s*|\\brequire\\s*\\(\\s*)[\"']([^\"'\\n]+)[\"']"), F.lit(1))
    each = sources.where("text is not null").select("site_id", F.col("path").alias("importer"), F.explode(F.array_distinct(spec)).alias("spec"))
    return resolved_modules(each, sources).select("site_id", "importer", "module").distinct()


def resolved_modules(each: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (site_id, importer, spec and others) with ``module``, the first of a local import's candidate paths that
    exists; others go. A path that is given with its ending may also be written with another."""
    local = each.where(F.col("spec").rlike("^(\\./|\\.\\./|@/|~/)"))
    roots = F.regexp_extract("importer", "^(?:.*/)?src(?=/)", 0)
    source_root = F.when(roots != "", roots).otherwise(F.lit("src"))
    base = F.when(F.col("spec").rlike("^[@~]/"), F.concat(source_root, F.lit("/"), F.regexp_replace("spec", "^..", ""))).otherwise(F.concat_ws("/", F.nullif(directory("importer"), F.lit("")), "spec"))
    flat = F.regexp_replace(F.regexp_replace(base, "(^|/)\\./", "$1"), "(^|/)\\./", "$1")
    # Folders from left to right; a parent step takes the last one back.
    step = lambda kept, part: F.when((part == "..") & (F.size(kept) > 0) & (F.try_element_at(kept, F.lit(-1)) != ".."), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(part)))
    flat = F.array_join(F.aggregate(F.split(flat, "/"), F.array().cast("array<string>"), step), "/")
    stem = F.regexp_replace(flat, "\\.(?:jsx?|tsx?|mjs|cjs|mts|cts)$", "")
    endings = (".tsx", ".ts", ".jsx", ".js", ".mjs", ".vue", ".svelte", ".astro")
    names = [flat, *[F.concat(stem, F.lit(s + e)) for s in ("", "/index") for e in endings]]
    own = [c for c in local.columns]
    keyed = local.distinct()
    candidates = keyed.select(*own, F.posexplode(F.array(*names)).alias("nth", "path"))
    there = candidates.join(sources.select("site_id", "path").distinct(), ["site_id", "path"])
    return there.groupBy(*own).agg(F.min_by("path", "nth").alias("module"))


def _stored(df: DataFrame) -> DataFrame:
    """The rows written once below the checkpoint directory, or ``spark.checkpoint.dir``, and read again."""
    spark = df.sparkSession
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("neither a checkpoint directory nor spark.checkpoint.dir is set")
    path = f"{root.rstrip('/')}/closure-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reaches(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """site_id, path of files that reach a seed (site_id, path) through imports, over any number of steps.

    Each round joins only what was new; tables in the shared folder cut the lineage, and a round without news ends
    it, which comes after as many rounds as the longest shortest path has steps.
    """
    edges = _stored(edges.select("site_id", "importer", "module"))  # every round reads them
    known = new = _stored(seeds.select("site_id", "path").distinct())
    while True:
        step = edges.join(new.withColumnRenamed("path", "module"), ["site_id", "module"]).select("site_id", F.col("importer").alias("path")).distinct()
        new = _stored(step.join(known, ["site_id", "path"], "left_anti"))
        if not new.take(1):
            return known
        known = known.unionByName(new)


# Frameworks in the order in which they are looked for, with their dependencies and configuration files.
FRAMEWORKS = [
    ("Next.js", "^next$", "^next\\.config\\.(?:js|mjs|cjs|ts|mts|cts)$"),
    ("Nuxt", "^(?:nuxt|nuxt3|@nuxt/core)$", "^nuxt\\.config\\.(?:js|mjs|cjs|ts|mts|cts)$"),
    ("Astro", "^astro$", "^astro\\.config\\.(?:js|mjs|cjs|ts|mts|cts)$"),
    ("Gatsby", "^gatsby$", "^gatsby-config\\.(?:js|mjs|cjs|ts|mts|cts)$"),
    ("Remix", "^@remix-run/", "^remix\\.config\\.(?:js|mjs|cjs|ts|mts|cts)$"),
    ("SvelteKit", "^@sveltejs/kit$", "^svelte\\.config\\.(?:js|mjs|cjs|ts|mts|cts)$"),
    ("Angular", "^@angular/(?:core|platform-browser)$", "^angular\\.json$"),
    ("React", "^react(?:-dom)?$", None),
    ("Vue", "^vue$", None),
    ("Svelte", "^svelte$", None),
    ("Vite", "^vite$", "^vite\\.config\\.(?:js|mjs|cjs|ts|mts|cts)$"),
]
APPLICATION_FRAMEWORKS = 6  # the first ones, which make a project an application

# Weights of the kinds of evidence that a project is a web site, penalties, and the least likelihood.
WEIGHTS = {
    "html-entry": 0.7, "application-framework-configured": 0.74, "application-framework": 0.68, "application-framework-config": 0.24, "framework-package": 0.22, "frontend-runtime": 0.3,
    "web-tooling": 0.2, "browser-code": 0.2, "route-structure": 0.21, "ui-source": 0.19, "client-entry": 0.19, "web-script": 0.18, "site-metadata": 0.08,
}
PENALTIES = {"cli": 0.3, "library": 0.42, "backend-only": 0.3}
LEAST_LIKELIHOOD = 0.58
BACKEND = "^(?:@hapi/hapi|@nestjs/core|express|fastify|koa|restify)$"
SCRIPTS = "(?:js|jsx|mjs|cjs|mts|cts|ts|tsx)"


def site_likelihood(names: DataFrame) -> DataFrame:
    """Likelihood 0 to 1 that a project is a web site, from rows site_id, kind, name.

    kind: dependency, path, script (a command of the manifest), code (``browser`` if some source uses the page), or
    package (``cli``, ``library``). One aggregation of flags for each site, then an expression over them.
    """
    def seen(kind: str, pattern: str) -> Column:
        return F.coalesce(F.bool_or((F.col("kind") == kind) & F.col("name").rlike(pattern)), F.lit(False))

    configs = "|".join(c for _, _, c in FRAMEWORKS[:APPLICATION_FRAMEWORKS])
    last = F.when(F.col("kind") == "path", base_name("name"))
    flags = names.groupBy("site_id").agg(
        seen("dependency", "|".join(d for _, d, _ in FRAMEWORKS[:APPLICATION_FRAMEWORKS])).alias("package"), F.coalesce(F.bool_or(F.lower(last).rlike(configs)), F.lit(False)).alias("config"),
        seen("dependency", "^(?:react-dom|vue|svelte|@angular/core)$").alias("runtime"), (seen("dependency", "^vite$") | F.coalesce(F.bool_or(F.lower(last).rlike("^vite\\.config\\.")), F.lit(False))).alias("vite"),
        seen("path", f"(?i)(?:^|/)(?:pages|app)/.*\\.(?:astro|html|svelte|vue|{SCRIPTS})$|(?:^|/)routes/.*\\.(?:astro|html|jsx|svelte|tsx|vue)$").alias("routes"),
        seen("path", "(?i)^(?:(?:public|src|site|web|www)/)?index\\.html?$").alias("html"), seen("path", f"(?i)^(?:(?:src|client|web)/)?(?:main|index|app|entry-client)\\.(?:vue|svelte|astro|{SCRIPTS})$").alias("entry"),
        seen("path", "(?i)\\.(?:astro|jsx|svelte|tsx|vue)$").alias("ui"), seen("path", "(?i)(?:^|/)(?:robots\\.txt|sitemap\\.xml|manifest\\.webmanifest)$").alias("metadata"),
        seen("script", "(?:^|[\\s;&|])(?:vite|next|nuxt|nuxi|astro|gatsby|remix|ng|react-scripts)(?:\\s|$)").alias("script"), seen("code", "^browser$").alias("code"),
        seen("package", "^cli$").alias("cli"), seen("package", "^library$").alias("library"), seen("dependency", BACKEND).alias("backend"),
    )
    f = F.col
    page = f("html") | f("routes")
    strong = f("package") & (page | (f("config") & f("script"))) & ~(f("library") & ~page)
    anchor = strong | f("runtime") | f("vite") | f("html") | f("code")
    evidence = [
        ("html-entry", f("html")), ("application-framework-configured", strong & f("config")), ("application-framework", strong & ~f("config")), ("application-framework-config", f("config") & ~strong), ("framework-package", f("package") & ~strong),
        ("frontend-runtime", f("runtime")), ("web-tooling", f("vite")), ("browser-code", f("code")), ("route-structure", f("routes")), ("ui-source", f("ui")),
        ("client-entry", f("entry") & (f("runtime") | f("vite"))), ("web-script", f("script")), ("site-metadata", f("metadata")),
    ]
    against = [("cli", f("cli") & ~page), ("library", f("library") & ~page), ("backend-only", f("backend") & ~anchor)]
    total = sum((F.when(c, w[k]).otherwise(0.0) for w, rules in ((WEIGHTS, evidence), ({k: -v for k, v in PENALTIES.items()}, against)) for k, c in rules), F.lit(0.0))
    groups = sum((c.cast("int") for _, c in evidence), F.lit(0))
    scored = flags.select("site_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 2).alias("likelihood"), groups.alias("groups"), (strong | f("html")).alias("strong"), (anchor & (page | (f("config") & f("script")) | (f("vite") & f("entry")))).alias("runs"))
    return scored.select("site_id", "likelihood", "groups", "strong", ((f("likelihood") >= LEAST_LIKELIHOOD) & (f("strong") | ((f("groups") >= 3) & f("runs")))).alias("is_site"))


def framework(names: DataFrame) -> DataFrame:
    """The first framework of the list that a site depends on or has a configuration of, from rows site_id, kind, name."""
    hit = F.coalesce(*[F.when(((F.col("kind") == "dependency") & F.col("name").rlike(d)) | ((F.col("kind") == "path") & (F.lower(base_name("name")).rlike(c) if c else F.lit(False))), k) for k, (_, d, c) in enumerate(FRAMEWORKS)])
    first = names.groupBy("site_id").agg(F.min(hit).alias("k")).where("k is not null")
    return first.select("site_id", F.element_at(F.array(*[F.lit(n) for n, _, _ in FRAMEWORKS]), F.col("k") + 1).alias("framework"))


def entry_files(pages: DataFrame, most: int = 4) -> DataFrame:
    """The first page-like files of each site."""
    from pyspark.sql import Window

    own = pages.where(extension("path").isin("html", "htm", "tsx", "jsx", "vue", "astro", "svelte"))
    return own.withColumn("n", F.row_number().over(Window.partitionBy("site_id").orderBy("path"))).where(F.col("n") <= most).select("site_id", "path")


# The first files to look at in a project of each framework.
FIRST_FILES = {
    "Next.js": ["app/layout.tsx", "app/page.tsx"],
    "Nuxt": ["nuxt.config.ts", "app.vue"],
    "Astro": ["src/layouts/Layout.astro", "src/pages/index.astro"],
    "Gatsby": ["gatsby-config.js", "src/pages/index.jsx"],
    "Remix": ["app/root.tsx", "app/routes/_index.tsx"],
    "SvelteKit": ["src/routes/+layout.svelte", "src/routes/+page.svelte"],
    "Angular": ["src/index.html", "src/app/app.component.html"],
    "Vue": ["index.html", "src/App.vue"],
    "Svelte": ["index.html", "src/App.svelte"],
    "React": ["index.html", "src/App.tsx"],
    "Vite": ["index.html", "src/main.js"],
}


def suggested_files(frameworks: DataFrame, sources: DataFrame) -> DataFrame:
    """site_id, files: of the framework's first files those that exist below one root of the site: the root with most
    of them, then the shallowest, then the first. frameworks: site_id, framework."""
    spark = sources.sparkSession
    first = spark.createDataFrame([(f, k, p.lower()) for f, paths in FIRST_FILES.items() for k, p in enumerate(paths)], "framework string, nth int, wanted string")  # of fixed size
    wanted = frameworks.select("site_id", "framework").join(F.broadcast(first), "framework").select("site_id", "nth", "wanted")
    last = F.element_at(F.split("wanted", "/"), -1)
    paths = sources.select("site_id", F.col("path").alias("actual"), F.lower(base_name("path")).alias("name")).distinct()
    met = paths.join(wanted.withColumn("name", last), ["site_id", "name"])
    low = F.lower("actual")
    found = met.where((low == F.col("wanted")) | low.endswith(F.concat(F.lit("/"), F.col("wanted")))).withColumn("root", F.expr("substring(lower(actual), 1, greatest(length(actual) - length(wanted) - 1, 0))"))
    roots = found.groupBy("site_id", "root").agg(F.array_sort(F.collect_list(F.struct("nth", "actual"))).alias("hits"))
    depth = F.size(F.split("root", "/"))
    best = roots.groupBy("site_id").agg(F.min_by("hits", F.struct((-F.size("hits")).alias("n"), depth.alias("depth"), "root")).alias("hits"))
    return best.select("site_id", F.transform("hits", lambda h: h["actual"]).alias("files"))

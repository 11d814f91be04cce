"""Rules over components that import each other: headings that a page takes from what it renders, and routes.

``sources`` have site_id, path and text (null if it was not read). Imports become a relation of bindings and files;
what it reaches is a closure of joins (``site_rules.reaches``). Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, extension
from .findings import emit
from .site_rules import reaches, resolved_modules

IMPORT = "\\bimport\\s+(?!\\s*type\\b)([^;\"']+?)\\s+from\\s+[\"']([^\"'\\n]+)[\"']"
COMPONENT = "[A-Z][\\w$]*"
MARKUP = ("jsx", "tsx", "vue", "svelte", "astro")


def bindings(sources: DataFrame) -> DataFrame:
    """site_id, importer, name, module, rendered: capitalised names that a file imports from files of its site, and
    whether it renders them as a tag (of a namespace: a member of it)."""
    text = F.col("text")
    clauses, specs = (F.regexp_extract_all(text, F.lit(IMPORT), F.lit(k)) for k in (1, 2))
    each = sources.where("text is not null").select("site_id", F.col("path").alias("importer"), "text", F.explode(F.arrays_zip(clauses.alias("clause"), specs.alias("spec"))).alias("x"))
    clause = F.regexp_replace("x.clause", "^\\s*type\\s+", "")
    one = lambda pattern: F.array_compact(F.array(F.nullif(F.regexp_extract(clause, pattern, 1), F.lit(""))))
    entries = F.transform(F.split(F.regexp_extract(clause, "(?s)\\{(.*?)\\}", 1), ","), lambda e: F.regexp_replace(F.trim(F.regexp_replace(e, "\\s+", " ")), "^type ", ""))
    inner = F.transform(entries, lambda e: F.coalesce(F.nullif(F.regexp_extract(e, f"\\bas ({COMPONENT})$", 1), F.lit("")), F.nullif(F.regexp_extract(e, f"^({COMPONENT})\\b", 1), F.lit(""))))
    marked = lambda names, space: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(space).alias("namespace")))
    names = F.concat(marked(F.concat(one(f"^({COMPONENT})\\b"), F.array_compact(inner)), False), marked(one(f"\\*\\s+as\\s+({COMPONENT})\\b"), True))
    shown = lambda n: F.rlike(text, F.concat(F.lit("<\\Q"), n["name"], F.when(n["namespace"], F.lit("\\E\\.")).otherwise(F.lit("\\E(?=\\s|/?>)"))))
    found = each.select("site_id", "importer", F.col("x.spec").alias("spec"), F.explode(F.transform(names, lambda n: F.struct(n["name"].alias("name"), shown(n).alias("rendered")))).alias("b"))
    return resolved_modules(found.select("site_id", "importer", "spec", F.col("b.name").alias("name"), F.col("b.rendered").alias("rendered")), sources)


def heading_contracts(sources: DataFrame) -> DataFrame:
    """site_id, path of files with an h1, or that render a file of their site with one, over any number of steps."""
    seeds = sources.where(F.col("text").rlike("(?i)<h1\\b[^>]*>"))
    return reaches(bindings(sources).where("rendered").select("site_id", "importer", "module").distinct(), seeds)


def page_like(path: Column) -> Column:
    """Whether a component file is a page: by its folder or its name."""
    p = F.lower(path)
    kinds = "(?:jsx?|tsx?|vue|svelte|astro)"
    return p.rlike(f"(^|/)(pages?|routes?)/.*\\.{kinds}$") | p.rlike("(^|/)app/(?:.*/)?(page|layout)\\.(jsx?|tsx?)$") | p.rlike(f"(^|/)(app|page|index|home|landing)\\.{kinds}$")


def delegates_heading(path: Column, text: Column) -> Column:
    """Whether a file leaves its heading to what a router or its children put in its place."""
    body = text.rlike("(?i)<(?:article|aside|button|form|h[1-6]|img|input|main|p|section|select|textarea|video)\\b")
    layout = F.lower(path).rlike("(?:^|/)layout\\.(?:jsx?|tsx?)$") & text.rlike("\\{\\s*children\\s*\\}")
    return text.rlike("<Outlet\\b") | (text.rlike("<Routes\\b") & text.rlike("<Route\\b")) | layout | (text.rlike("<Navigate\\b") & ~body)


def missing_headings(sources: DataFrame) -> DataFrame:
    """Component pages without an h1 of their own or of what they render."""
    pages = sources.where("text is not null").where(page_like(F.col("path")) & ~delegates_heading(F.col("path"), F.col("text")))
    bare = pages.select("site_id", "path").join(heading_contracts(sources), ["site_id", "path"], "left_anti")
    return emit(bare.select("site_id", "path", F.lit("content-missing-h1").alias("rule_id"), F.lit("no h1").alias("evidence"), F.lit(1).alias("line")))


# Paths of routes that catch all others, and names of components and files for what is not found.
FALLBACKS = ["*", "/*", "**", "/**", "404", "/404"]
NOT_FOUND_NAMES = ["notfound", "notfoundpage", "pagenotfound", "notfoundcomponent", "pagenotfoundcomponent"]
NOT_FOUND_FILES = ["404", "notfound", "notfoundpage", "pagenotfound"]
ROUTERS = "\\bfrom\\s+[\"'](?:react-router(?:-dom)?|@tanstack/react-router)[\"']"
_ROUTE = "<Route(?=[\\s/>])(?:[^>\"'{]++|\"[^\"]*+\"|'[^']*+'|\\{(?:[^{}]++|\\{[^{}]*+\\})*+\\})*+>"


def routes(sources: DataFrame) -> DataFrame:
    """site_id, importer, route, component: routes that a known router's tags state, by literal path and component."""
    own = sources.where("text is not null").where(F.col("text").rlike(ROUTERS))
    each = own.select("site_id", F.col("path").alias("importer"), "text", F.explode(F.regexp_extract_all("text", F.lit(_ROUTE), F.lit(0))).alias("tag"))
    said = lambda name: F.regexp_extract("tag", f"(?s)\\s{name}\\s*=\\s*(\"[^\"]*\"|'[^']*'|\\{{(?:[^{{}}]|\\{{[^{{}}]*\\}})*\\}})", 1)
    bare = lambda v: F.trim(F.regexp_replace(F.trim(F.regexp_replace(v, "(?s)^\\{(.*)\\}$", "$1")), "(?s)^([\"'`])(.*)\\1$", "$2"))
    path = F.when(~said("path").rlike("(?s)^\\{\\s*[^\"'`\\s]"), bare(said("path")))
    reference = lambda v: F.coalesce(F.nullif(F.regexp_extract(v, f"^<\\s*({COMPONENT}(?:\\.{COMPONENT})*)\\b", 1), F.lit("")), F.nullif(F.regexp_extract(v, f"^({COMPONENT}(?:\\.{COMPONENT})*)$", 1), F.lit("")))
    component = F.coalesce(*[reference(bare(said(n))) for n in ("element", "Component", "component")])
    root = F.split(component, "\\.")[0]
    declared = F.rlike(F.col("text"), F.concat(F.lit("\\b(?:class|function|const|let|var)\\s+\\Q"), component, F.lit("\\E(?![\\w$])"))) & ~F.contains(component, F.lit("."))
    return each.select("site_id", "importer", path.alias("route"), component.alias("component"), root.alias("name"), declared.alias("declared")).where("route != '' and component is not null")


def not_found_routes(sources: DataFrame) -> DataFrame:
    """site_id of sites with a page for what is not found: a file of that name, or a route that catches all others and
    renders a component for it from a file of the site or of its own file."""
    files = sources.where(F.lower("path").rlike("(^|/)(404|not-found)\\.(?:html?|jsx?|tsx?|vue|svelte|astro)$")).select("site_id")
    catches = routes(sources).where(F.col("route").isin(FALLBACKS) | F.col("route").rlike("(?i)^/:\\w*(?:pathmatch|catchall)\\w*\\(\\.\\*\\)\\*$"))
    plain = lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    named = plain(F.element_at(F.split("component", "\\."), -1)).isin(NOT_FOUND_NAMES)
    own = bindings(sources).select("site_id", "importer", "name", "module").distinct()
    met = catches.join(own, ["site_id", "importer", "name"], "left")
    stem = plain(F.regexp_replace(base_name("module"), "\\.[^.]*$", ""))
    good = met.where((F.col("module").isNotNull() | F.col("declared")) & (named | F.coalesce(stem.isin(NOT_FOUND_FILES), F.lit(False))))
    return files.unionByName(good.select("site_id")).distinct()


def missing_not_found(sources: DataFrame) -> DataFrame:
    """Sites of several pages without one for what is not found."""
    page = page_like(F.col("path")) | extension("path").isin("html", "htm")
    counts = sources.where("text is not null").where(page).groupBy("site_id").agg(F.count("*").alias("pages")).where("pages > 1")
    bare = counts.join(not_found_routes(sources), "site_id", "left_anti")
    return emit(bare.select("site_id", F.lit("(site)").alias("path"), F.lit("ux-no-not-found-page").alias("rule_id"), F.concat("pages", F.lit(" pages")).alias("evidence"), F.lit(1).alias("line")))

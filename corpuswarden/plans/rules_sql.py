"""SQL of the page rules over the given pages and the literal ones, for an engine whose patterns have no lookaround.

Elements are found by patterns: the pages nest no element in one of its own name where that matters.
"""

# ruff: noqa: E501

from __future__ import annotations

from ..functions.text import PROVIDERS
from ..operators.catalogue import RULES as CATALOGUE
from ..operators.page_rules import AMBIGUOUS, PURPOSES
from ..operators.site_rules import MANUAL
from . import fixtures

SEVERITY = {r[0]: r[3] for r in CATALOGUE}
TAG = r"<(/?)([A-Za-z][A-Za-z0-9_:.-]*)(?:[\s/][^>]*)?>"


def newlines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, chr(10), '')))"


def _line(gaps: str, own: str) -> str:
    return f"(1 + {newlines(f'''array_to_string({gaps}[1:k], '')''')} + {newlines(f'''array_to_string({own}[1:k - 1], '')''')})::INT"


PAGES = rf"""u AS ({fixtures.sql()}),
p AS (SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://([^/?#:@]+)', 1), '') AS site_id, url AS path, regexp_replace(coalesce(html, ''), '<!--[\s\S]*?-->', '', 'g') AS h FROM u)"""
TAGS = PAGES + rf""", t0 AS (SELECT page_id, site_id, path, regexp_extract_all(h, '{TAG}') AS tags, regexp_split_to_array(h, '{TAG}') AS gaps FROM p),
t AS (SELECT page_id, site_id, path, tags, gaps, unnest(tags) AS tag, unnest(range(1, len(tags) + 1)) AS k FROM t0),
g AS (SELECT page_id, site_id, path, tag, k, lower(regexp_extract(tag, '^</?([A-Za-z][A-Za-z0-9_:.-]*)', 1)) AS name, tag LIKE '</%' AS closing, {_line("gaps", "tags")} AS line FROM t)"""


def attr(name: str, tag: str = "tag") -> str:
    return rf"""regexp_replace(regexp_extract({tag}, '(?is)[\s"''/]{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g')"""


def has(name: str, tag: str = "tag") -> str:
    return rf"""regexp_matches({tag}, '(?is)[\s"''/]{name}(\s|=|/|>)')"""


def full(name: str, tag: str = "tag") -> str:
    return f"(trim({attr(name, tag)}) NOT IN ('', '{{}}', 'null', 'undefined'))"


def on(name: str, tag: str = "tag") -> str:
    return f"({has(name, tag)} AND lower(trim({attr(name, tag)})) NOT IN ('false', '{{false}}'))"


def aria(tag: str = "tag") -> str:
    return f"({full('aria-label', tag)} OR {full('aria-labelledby', tag)})"


def visible(x: str) -> str:
    t = rf"regexp_replace(regexp_replace({x}, '(?is)<svg\b.*?</svg\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    t = rf"replace(regexp_replace({t}, '(?i)&nbsp;|&#160;', ' ', 'g'), chr(160), ' ')"
    return rf"trim(regexp_replace({t}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


def named(tag: str, content: str) -> str:
    inner = [rf"""regexp_matches({content}, '(?is)<img\b[^>]*\salt\s*=\s*("[^"]*[^"\s][^"]*"|''[^'']*[^''\s][^'']*'')')""", rf"""regexp_matches({content}, '(?is)<[a-z][^>]*\saria-label\s*=\s*("[^"]*[^"\s][^"]*"|''[^'']*[^''\s][^'']*'')')""", rf"regexp_matches({content}, '(?is)<title\b[^>]*>\s*[^\s]')"]
    return f"({aria(tag)} OR {full('title', tag)} OR {visible(content)} <> '' OR {' OR '.join(inner)})"


def elements(*names: str) -> str:
    """CTE e: name, tag (the opening one), content and line of the elements."""
    parts = []
    for n in names:
        pattern = rf"(?is)<{n}(?:\s[^>]*)?>[\s\S]*?</{n}\s*>"
        parts.append(f"SELECT page_id, site_id, path, '{n}' AS name, els, gaps, unnest(els) AS el, unnest(range(1, len(els) + 1)) AS k FROM (SELECT page_id, site_id, path, regexp_extract_all(h, '{pattern}') AS els, regexp_split_to_array(h, '{pattern}') AS gaps FROM p)")
    return f", e0 AS ({' UNION ALL '.join(parts)}), e AS (SELECT page_id, site_id, path, name, k, {_line('gaps', 'els')} AS line, regexp_extract(el, '(?is)^<[a-z0-9]+(?:\\s[^>]*)?>') AS tag, regexp_extract(el, '(?is)^<[a-z0-9]+(?:\\s[^>]*)?>([\\s\\S]*)</[a-z0-9]+\\s*>$', 1) AS content FROM e0)"


def rows(rule: str, source: str, condition: str, evidence: str = "tag", line: str = "line", severity: str | None = None) -> str:
    return f"SELECT site_id, path, '{rule}' AS rule_id, {severity or repr(SEVERITY[rule])} AS severity, {line} AS line, {evidence} AS evidence FROM {source} WHERE {condition}"


def first(source: str, condition: str, order: str = "k") -> str:
    """The first row of each page that meets a condition."""
    return f"(SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS nth FROM {source} WHERE {condition})"


KIND = f"coalesce(nullif(lower({attr('type')}), ''), 'text')"
FIELD = f"(name IN ('input', 'select', 'textarea') AND {KIND} NOT IN ('hidden', 'submit', 'reset', 'button', 'image'))"
FOCUS = rf"""((name IN ('button', 'select', 'textarea', 'summary') OR (name = 'input' AND {KIND} <> 'hidden') OR (name = 'a' AND {has('href')}) OR regexp_matches({attr('tabindex')}, '^\s*\d+\s*$')) AND NOT {on('disabled')})"""
OPEN = "NOT closing"
SQL: dict[str, str] = {}


def of_tags(rule: str, condition: str, once: bool = False) -> None:
    condition = f"{OPEN} AND ({condition})"
    SQL[rule] = f"WITH {TAGS} " + (rows(rule, first("g", condition), "nth = 1") if once else rows(rule, "g", condition))


IMAGE = "name IN ('img', 'image')"
STYLE, CLASS = attr("style"), attr("class")
_TOKENS = f"string_split(regexp_replace({CLASS}, '[\"''`(),]', ' ', 'g'), ' ')"
_UTILITY = lambda n, no: f"len(list_filter({_TOKENS}, lambda t: regexp_matches(t, '(^|:){n}-') AND regexp_replace(regexp_extract(t, '[^:]*$'), '^{n}-(!-?)?', '') NOT IN ({', '.join(map(repr, ['', *no]))}))) > 0"
_AXIS = lambda n: rf"regexp_matches({STYLE}, '(?i)(^|[;,{{]\s*){n}\s*:')"
SIZED = rf"""(({full('width')} AND {full('height')}) OR {on('fill')} OR ({_AXIS('width')} AND {_AXIS('height')}) OR regexp_matches({STYLE}, '(?i)\baspect-?ratio\s*:') OR {_UTILITY('aspect', ['auto'])} OR {_UTILITY('size', ['auto'])} OR ({_UTILITY('w', ['auto', 'fit', 'max', 'min'])} AND {_UTILITY('h', ['auto', 'fit', 'max', 'min'])}))"""
_CSS = lambda n, no: rf"regexp_extract(d, '(?i)(?:^|;)\s*{n}\s*:\s*([^;!}}]+)', 1) NOT IN ('', 'auto', 'inherit'){no}"
# Images below an element whose class has a fixed size and a rule for images of both axes.
_COVERED = rf""", cs AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<style(?:\s[^>]*)?>([\s\S]*?)</style\s*>', 1)) AS css FROM p), cr AS (SELECT page_id, unnest(regexp_extract_all(css, '[^{{}}]+\{{[^{{}}]*\}}')) AS r FROM cs),
sl AS (SELECT page_id, trim(unnest(string_split(regexp_extract(r, '^([^{{]+)\{{', 1), ','))) AS s, regexp_extract(r, '\{{([^}}]*)\}}', 1) AS d FROM cr),
ct AS (SELECT a.page_id, a.c FROM (SELECT page_id, regexp_extract(s, '^\.([A-Za-z0-9_-]+)$', 1) AS c FROM sl WHERE {_CSS('width', " AND NOT regexp_matches(d, 'width:[^;]*%')")} AND {_CSS('height', " AND NOT regexp_matches(d, 'height:[^;]*%')")}) a
JOIN (SELECT page_id, regexp_extract(s, '(?:^|\s)\.([A-Za-z0-9_-]+)\s+img$', 1) AS c FROM sl WHERE {_CSS('width', '')} AND {_CSS('height', '')}) b ON a.page_id = b.page_id AND a.c = b.c WHERE a.c <> ''),
dv AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<div(?:\s[^>]*)?>[\s\S]*?</div\s*>')) AS el FROM p),
cv AS (SELECT DISTINCT dv.page_id, el FROM dv JOIN ct ON dv.page_id = ct.page_id AND list_contains(string_split({attr('class', "regexp_extract(el, '^<[^>]*>')")}, ' '), c))"""
_UNCOVERED = "NOT EXISTS (SELECT 1 FROM cv WHERE cv.page_id = g.page_id AND contains(el, tag))"
of_tags("a11y-image-alt", f"{IMAGE} AND NOT {has('alt')}")
SQL["performance-image-dimensions"] = f"WITH {TAGS}{_COVERED} " + rows("performance-image-dimensions", "g", f"{OPEN} AND {IMAGE} AND NOT {SIZED} AND {_UNCOVERED}")
_STYLED = f"({has('class')} OR {has('classname')} OR {has('style')})"
M02 = f"WITH {TAGS}{_COVERED} SELECT site_id, path, CASE WHEN {_STYLED} THEN 'medium' ELSE 'high' END AS confidence, {_STYLED} AS manual, line, tag AS evidence FROM g WHERE {OPEN} AND {IMAGE} AND NOT {SIZED} AND {_UNCOVERED}"
of_tags("performance-priority-image-lazy", f"{IMAGE} AND lower({attr('loading')}) = 'lazy' AND (lower({attr('fetchpriority')}) = 'high' OR {has('data-lcp')} OR {on('priority')})")
of_tags("a11y-iframe-title", f"name = 'iframe' AND NOT {full('title')}")
of_tags("a11y-audible-autoplay", f"name IN ('audio', 'video') AND {on('autoplay')} AND NOT {on('muted')}")
of_tags("a11y-image-input-alt", f"name = 'input' AND {KIND} = 'image' AND NOT {full('alt')} AND NOT {aria()} AND NOT {full('title')}")
of_tags("a11y-dialog-name", f"(name = 'dialog' OR lower({attr('role')}) IN ('dialog', 'alertdialog')) AND NOT {aria()} AND NOT {full('title')}")
of_tags("security-external-link-opener", rf"lower({attr('target')}) = '_blank' AND name IN ('a', 'area', 'form') AND NOT regexp_matches(lower({attr('rel')}), '(^|\s)(noopener|noreferrer)(\s|$)')")
of_tags("a11y-positive-tabindex", rf"regexp_matches({attr('tabindex')}, '^\s*[1-9]\d*\s*$')", once=True)
of_tags("a11y-focusable-aria-hidden", f"lower(trim({attr('aria-hidden')})) IN ('true', '{{true}}') AND {FOCUS}")
_PLAIN = lambda n: rf"(regexp_matches({attr(n)}, '(?i)^\s*http://') AND NOT regexp_matches({attr(n)}, '(?i)^\s*http://(localhost|127(\.\d+){{3}}|\[?::1\]?|0\.0\.0\.0|[^/?#:]*\.localhost)(:\d+)?([/?#]|$)'))"
of_tags("security-insecure-resource", " OR ".join(_PLAIN(n) for n in ("href", "src", "action")), once=True)
_BLOCK = f"name IN ('div', 'span', 'li', 'p') AND {has('onclick')} AND NOT {has('role')} AND NOT {has('tabindex')}"
SQL["a11y-clickable-noncontrol"] = f"WITH {TAGS} {rows('a11y-clickable-noncontrol', 'g', f'''{OPEN} AND name = 'a' AND NOT {has('href')} AND {has('onclick')}''')} UNION ALL {rows('a11y-clickable-noncontrol', first('g', f'{OPEN} AND {_BLOCK}'), 'nth = 1')}"
SQL["a11y-duplicate-id"] = f"WITH {TAGS}, i AS (SELECT *, trim({attr('id')}) AS id FROM g WHERE {OPEN}), d AS (SELECT *, row_number() OVER (PARTITION BY page_id, id ORDER BY k) AS same FROM i WHERE id <> '') {rows('a11y-duplicate-id', first('d', 'same = 2'), 'nth = 1', '''concat('id=', id)''')}"

_WORDS = lambda n: rf"trim(lower(regexp_replace(regexp_replace({attr(n)}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')))"
_SAID = rf"regexp_replace(trim(lower({attr('autocomplete')})), '\s+', ' ', 'g')"


def _asks(types: list[str], words: str | None) -> str:
    parts = [f"kind IN ({', '.join(map(repr, types))})"] if types else []
    if words:
        parts.append(f"(regexp_matches(own_name, '{words}') OR regexp_matches(own_id, '{words}'))" if words.startswith("^") else f"regexp_matches(trim(own_name || ' ' || own_id), '{words}')")
    return " OR ".join(parts)


_LACKS = " ".join(rf"""WHEN {_asks(types, words)} THEN NOT regexp_matches(said, '^(?:section-[a-z0-9_-]+ )?(?:(?:shipping|billing) )?{"(?:(?:home|work|mobile|fax|pager) )?" if contact else ""}(?:{"|".join(tokens)})(?: webauthn)?$')""" for types, words, contact, tokens in PURPOSES)
SQL["forms-missing-autocomplete"] = f"WITH {TAGS}, f AS (SELECT *, {KIND} AS kind, {_WORDS('name')} AS own_name, {_WORDS('id')} AS own_id, {_SAID} AS said FROM g WHERE {OPEN} AND name = 'input') {rows('forms-missing-autocomplete', 'f', f'''kind NOT IN ('hidden', 'submit', 'button', 'reset', 'image', 'checkbox', 'radio') AND CASE {_LACKS} ELSE false END''')}"


def of_elements(rule: str, names: tuple[str, ...], condition: str, evidence: str = "tag") -> None:
    SQL[rule] = f"WITH {PAGES}{elements(*names)} {rows(rule, 'e', condition, evidence)}"


def holds(names: str, more: str = "true") -> str:
    """Whether the content has an opening tag of these names."""
    return f"EXISTS (SELECT 1 FROM (SELECT unnest(regexp_extract_all(content, '{TAG}')) AS tag) x, LATERAL (SELECT lower(regexp_extract(x.tag, '^<([A-Za-z][A-Za-z0-9_:.-]*)', 1)) AS name) y WHERE {names} AND {more.replace(' tag', ' x.tag')})"


def number(condition: str) -> str:
    """How many opening tags in the content meet a condition on name and tag."""
    return f"(SELECT count(*) FROM (SELECT tag, lower(regexp_extract(tag, '^<([A-Za-z][A-Za-z0-9_:.-]*)', 1)) AS name FROM (SELECT unnest(regexp_extract_all(content, '{TAG}')) AS tag)) WHERE name <> '' AND ({condition}))"


of_elements("a11y-control-name", ("button",), f"NOT {named('tag', 'content')}")
of_elements("a11y-link-name", ("a",), f"{has('href')} AND NOT {named('tag', 'content')}")
of_elements("ux-ambiguous-link-text", ("a",), f"{has('href')} AND lower({visible('content')}) IN ({', '.join(map(repr, AMBIGUOUS))})", f"lower({visible('content')})")
of_elements("a11y-svg-image-name", ("svg",), rf"lower({attr('role')}) = 'img' AND NOT {aria()} AND NOT regexp_matches(content, '(?is)<title\b[^>]*>\s*[^<\s]')")
of_elements("a11y-fieldset-legend", ("fieldset",), f"{number(FIELD)} >= 2 AND {number('''name = 'legend' ''')} = 0 AND NOT {aria()}")
of_elements("a11y-table-name", ("table",), f"{number('''name = 'th' ''')} > 0 AND {number('''name = 'caption' ''')} = 0 AND NOT {aria()}")
of_elements("a11y-video-captions", ("video",), f"{number(f'''name = 'track' AND lower({attr('kind')}) = 'captions' ''')} = 0")
of_elements("privacy-password-get-form", ("form",), f"{number(f'''name = 'input' AND {KIND} = 'password' ''')} > 0 AND lower({attr('method')}) <> 'post'")
_CONSTRAINT = " OR ".join([*(has(n) for n in ("required", "pattern", "minlength", "maxlength", "min", "max", "step")), f"{KIND} IN ('email', 'url', 'number', 'date')"])
_FEEDBACK = " OR ".join([*(has(n) for n in ("aria-invalid", "aria-errormessage", "aria-describedby", "aria-live")), f"lower({attr('role')}) = 'alert'"])
of_elements("forms-no-validation-signal", ("form",), f"{number(FIELD)} > 0 AND {number(_CONSTRAINT)} = 0")
of_elements("forms-no-error-feedback-signal", ("form",), f"{number(has('required'))} > 0 AND {number(_FEEDBACK)} = 0")


def of_inner(rule: str, names: tuple[str, ...], outer: str, condition: str) -> None:
    """Rows of tags inside of elements; their own line breaks within the element are not counted."""
    SQL[rule] = f"WITH {PAGES}{elements(*names)}, i AS (SELECT page_id, site_id, path, line, unnest(regexp_extract_all(content, '{TAG}')) AS tag FROM e WHERE {outer}), j AS (SELECT *, lower(regexp_extract(tag, '^<([A-Za-z][A-Za-z0-9_:.-]*)', 1)) AS name FROM i) {rows(rule, 'j', condition)}"


of_inner("a11y-interactive-nesting", ("button", "a"), f"name = 'button' OR {has('href')}", f"name <> '' AND {FOCUS}")
of_inner("forms-implicit-button-type", ("form",), "true", f"name = 'button' AND NOT {has('type')}")
# Fields outside of labels: those of the page less its label elements.
SQL["a11y-form-label"] = rf"WITH {TAGS}, l AS (SELECT page_id, trim({attr('for')}) AS id FROM g WHERE {OPEN} AND name = 'label'), w AS (SELECT page_id, site_id, path, unnest(regexp_extract_all(regexp_replace(h, '(?is)<label(?:\s[^>]*)?>[\s\S]*?</label\s*>', '', 'g'), '{TAG}')) AS tag FROM p), f AS (SELECT *, 1::INT AS line, lower(regexp_extract(tag, '^<([A-Za-z][A-Za-z0-9_:.-]*)', 1)) AS name FROM w) {rows('a11y-form-label', 'f', rf'''{FIELD} AND NOT {on('hidden')} AND NOT regexp_matches({CLASS}, '(^|\s)hidden(\s|$)') AND NOT regexp_matches({STYLE}, '(?i)(^|[;,]\s*)(display\s*:\s*none|visibility\s*:\s*hidden)') AND NOT {aria()} AND NOT {full('title')} AND NOT EXISTS (SELECT 1 FROM l WHERE l.page_id = f.page_id AND l.id <> '' AND l.id = trim({attr('id')}))''')}"

_HEADS = rf", e0 AS (SELECT page_id, site_id, path, els, gaps, unnest(els) AS el, unnest(range(1, len(els) + 1)) AS k FROM (SELECT page_id, site_id, path, regexp_extract_all(h, '(?is)<h[1-6](?:\s[^>]*)?>[\s\S]*?</h[1-6]\s*>') AS els, regexp_split_to_array(h, '(?is)<h[1-6](?:\s[^>]*)?>[\s\S]*?</h[1-6]\s*>') AS gaps FROM p)), e AS (SELECT page_id, site_id, path, k, substr(el, 3, 1)::INT AS level, {_line('gaps', 'els')} AS line, regexp_extract(el, '(?is)^<h[1-6](?:\s[^>]*)?>') AS tag, regexp_extract(el, '(?is)^<h[1-6](?:\s[^>]*)?>([\s\S]*)</h[1-6]\s*>$', 1) AS content FROM e0)"
_HEAD_TEXT = f"trim('h' || level || ' ' || {visible('content')})"
SQL["content-missing-h1"] = f"WITH {TAGS} {rows('content-missing-h1', 'p', rf'''regexp_matches(h, '(?i)<(html|body|main)\b') AND NOT EXISTS (SELECT 1 FROM g WHERE g.page_id = p.page_id AND name = 'h1' AND {OPEN})''', repr('no h1'), '1::INT')}"
SQL["content-multiple-h1"] = f"WITH {PAGES}{_HEADS}, c AS (SELECT page_id, site_id, path, count(*) AS n, min(line) AS line FROM e WHERE level = 1 GROUP BY ALL) {rows('content-multiple-h1', 'c', 'n > 1', '''n || ' h1 headings' ''')}"
SQL["content-empty-heading"] = f"WITH {PAGES}{_HEADS} {rows('content-empty-heading', 'e', f'''NOT {named('tag', 'content')}''', _HEAD_TEXT)}"
SQL["content-heading-jump"] = f"WITH {PAGES}{_HEADS}, o AS (SELECT *, lag(level) OVER (PARTITION BY page_id ORDER BY k) AS last FROM e) {rows('content-heading-jump', first('o', 'level > last + 1'), 'nth = 1', _HEAD_TEXT)}"

# Head rules, for documents.
DOCUMENT = r"""(regexp_matches(h, '(?i)<!doctype\s+html\b|<html\b|<head\b|<body\b') OR (regexp_matches(place, '\.html?$') AND NOT regexp_matches(place, '(^|/)(components?|fragments?|includes?|partials?)(/|$)') AND (NOT contains(place, '/') OR regexp_matches(place, '^(public|static)/|(^|/)(pages?|routes?)/|(^|/)(index|404|410|500|offline)\.html?$'))))"""
HEAD = TAGS + rf""", d AS (SELECT * FROM (SELECT *, lower(regexp_replace(regexp_replace(path, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/*', ''), '[?#].*$', '')) AS place FROM p) WHERE {DOCUMENT}),
m AS (SELECT g.*, lower({attr('name')}) AS meta, lower(coalesce(nullif({attr('property')}, ''), {attr('name')})) AS prop, {attr('content')} AS content FROM g SEMI JOIN d USING (page_id) WHERE name = 'meta' AND {OPEN}),
s AS (SELECT * FROM m WHERE regexp_matches(prop, '^(og|twitter):') AND trim(content) <> ''),
c AS (SELECT g.*, {attr('href')} AS href FROM g SEMI JOIN d USING (page_id) WHERE name = 'link' AND {OPEN} AND regexp_matches(lower({attr('rel')}), '(^|\s)canonical(\s|$)') AND trim({attr('href')}) <> ''),
cc AS (SELECT page_id, count(*) AS n, first(href ORDER BY k) AS href FROM c GROUP BY page_id)"""
VALID = lambda x: rf"regexp_matches(trim({x}), '(?i)^https?://[^/?#\s@]+([/?][^\s#]*)?$')"
_TITLES = r"len(regexp_extract_all(regexp_replace(h, '(?is)<svg\b.*?</svg\s*>', '', 'g'), '(?is)<title(?:\s[^>]*)?>[\s\S]*?</title\s*>'))"
_TITLE = visible(r"regexp_extract(regexp_replace(h, '(?is)<svg\b.*?</svg\s*>', '', 'g'), '(?is)<title(?:\s[^>]*)?>([\s\S]*?)</title\s*>', 1)")


def of_heads(rule: str, condition: str, evidence: str, source: str = "d", severity: str | None = None) -> None:
    SQL[rule] = f"WITH {HEAD} {rows(rule, source, condition, evidence, '1::INT', severity)}"


def _none(table: str, condition: str = "true") -> str:
    return f"NOT EXISTS (SELECT 1 FROM {table} x WHERE x.page_id = d.page_id AND {condition})"


of_heads("seo-missing-title", f"{_TITLES} = 0 OR {_TITLE} = ''", "'no title'")
of_heads("seo-multiple-titles", f"{_TITLES} > 1", f"{_TITLES} || ' titles'")
of_heads("seo-missing-description", _none("m", "meta = 'description' AND trim(content) <> ''"), "'no description'")
of_heads("seo-missing-social-metadata", _none("s"), "'no social metadata'")
_OG, _TW = "['og:title', 'og:type', 'og:image', 'og:url']", "['twitter:card', 'twitter:title', 'twitter:description', 'twitter:image']"
SQL["seo-incomplete-social-metadata"] = f"""WITH {HEAD}, ks AS (SELECT page_id, site_id, path, list(prop) AS keys FROM s GROUP BY ALL), la AS (SELECT *, list_concat(
CASE WHEN len(list_filter(keys, lambda x: x LIKE 'og:%')) > 0 THEN list_filter({_OG}, lambda x: NOT list_contains(keys, x)) ELSE [] END,
CASE WHEN len(list_filter(keys, lambda x: x LIKE 'twitter:%')) > 0 THEN list_filter({_TW}, lambda x: NOT list_contains(keys, x) AND NOT list_contains(keys, replace(x, 'twitter:', 'og:'))) ELSE [] END) AS lacks FROM ks)
{rows('seo-incomplete-social-metadata', 'la', 'len(lacks) > 0', '''concat('missing ', array_to_string(lacks, ', '))''', '1::INT')}"""
of_heads("seo-invalid-social-url", f"prop IN ('og:url', 'og:image', 'twitter:image') AND NOT {VALID('content')}", "concat(prop, '=', content)", "s")
of_heads("seo-missing-canonical", _none("cc"), "'no canonical link'")
of_heads("seo-multiple-canonicals", "n > 1", "n || ' canonical links'", "d JOIN cc USING (page_id)")
of_heads("seo-invalid-canonical", f"NOT {VALID('href')}", "href", "d JOIN cc USING (page_id)")
of_heads("seo-insecure-canonical", f"{VALID('href')} AND regexp_matches(href, '(?i)^http:') AND NOT regexp_matches(href, '(?i)^http://(localhost|127\\.|[^/?#:]*\\.localhost)')", "href", "d JOIN cc USING (page_id)")
SQL["a11y-document-language"] = f"WITH {HEAD}, l AS (SELECT *, {attr('lang')} AS lang FROM {first('g', f'''{OPEN} AND name = 'html' ''')} WHERE nth = 1) {rows('a11y-document-language', 'l SEMI JOIN d USING (page_id)', '''NOT regexp_matches(lower(trim(lang)), '^[a-z]{2,8}(-[a-z0-9]{1,8})*$')''', '''concat('lang=', lang)''', '1::INT')}"
of_heads("html-missing-charset", f"{_none('m', f'''lower({attr('charset', 'x.tag')}) = 'utf-8' ''')} AND {_none('m', rf'''lower({attr('http-equiv', 'x.tag')}) = 'content-type' AND regexp_matches(lower(content), 'charset\s*=\s*utf-8')''')}", "'no utf-8 charset'")
_WIDTH = r"regexp_replace(lower(content), '\s', '', 'g')"
of_heads("responsive-missing-viewport", _none("m", f"meta = 'viewport' AND regexp_matches({_WIDTH}, '(^|,)width=device-width')"), "'no viewport'")


def of_first_meta(rule: str, condition: str, severity: str | None = None) -> None:
    SQL[rule] = f"WITH {HEAD} {rows(rule, first('m', condition), 'nth = 1', 'trim(content)', '1::INT', severity)}"


of_first_meta("a11y-viewport-zoom", rf"meta = 'viewport' AND (regexp_matches({_WIDTH}, '(^|,)user-scalable=(no|0)(,|$)') OR try_cast(regexp_extract({_WIDTH}, 'maximum-scale=(\d{{1,3}})', 1) AS INT) < 2)")
of_first_meta("seo-page-noindex", r"meta IN ('robots', 'googlebot', 'bingbot') AND regexp_matches(lower(content), '(^|[\s,])noindex([\s,]|$)')")
of_first_meta("a11y-meta-refresh", rf"lower({attr('http-equiv')}) = 'refresh' AND try_cast(regexp_extract(content, '^\s*(\d{{1,6}})', 1) AS INT) <= 20", r"CASE WHEN regexp_matches(content, '^\s*0') THEN 'medium' ELSE 'low' END")
SQL["performance-render-blocking-script"] = f"WITH {HEAD} {rows('performance-render-blocking-script', first('g SEMI JOIN d USING (page_id)', f'''{OPEN} AND name = 'script' AND {full('src')} AND NOT {has('async')} AND NOT {has('defer')} AND lower({attr('type')}) <> 'module' '''), 'nth = 1', 'tag', '1::INT')}"

D18 = rf"""WITH {PAGES}{elements('script')} SELECT site_id, path, trim(regexp_replace(content, '\s+', ' ', 'g')) AS evidence FROM e WHERE lower({attr('type')}) = 'application/ld+json' AND NOT regexp_matches(content, '\{{\{{|\$\{{|<%') AND (trim(content) = '' OR NOT json_valid(content))"""
P07 = rf"""WITH {HEAD}, x AS (SELECT page_id, site_id, substr(lower(trim(regexp_replace(first(content ORDER BY k), '\s+', ' ', 'g'))), 1, 240) AS description FROM m WHERE meta = 'description' AND trim(content) <> '' GROUP BY page_id, site_id) SELECT site_id, description, count(*) AS pages FROM x GROUP BY ALL HAVING count(*) > 1"""

# Structure, style blocks, links, credentials and sites.
_GIVEN = r"""p AS (SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://([^/?#:@]+)', 1), '') AS site_id, url AS path, coalesce(html, '') AS raw, regexp_replace(coalesce(html, ''), '<!--[\s\S]*?-->', '', 'g') AS h FROM pages)"""
_BARE = "h"
for _n in ("svg", "math", "template", "script", "style", "textarea"):
    _BARE = rf"regexp_replace({_BARE}, '(?is)(<{_n}(?:\s[^>]*)?>)[\s\S]*?(</{_n}\s*>)', '\1\2', 'g')"
X08 = f"WITH {_GIVEN} SELECT page_id, len(regexp_extract_all({_BARE}, '{TAG}'))::BIGINT AS tags FROM p WHERE tags > 0"
X10 = rf"""WITH {_GIVEN}{elements('style')}, c AS (SELECT site_id, unnest(regexp_extract_all(regexp_replace(content, '/\*[\s\S]*?(?:\*/|$)', ' ', 'g'), '([^{{}}]+)\{{[^{{}}]*\}}', 1)) AS selectors FROM e),
s AS (SELECT site_id, trim(regexp_replace(unnest(string_split(selectors, ',')), '\s+', ' ', 'g')) AS selector FROM c) SELECT site_id, selector, count(*) AS n FROM s GROUP BY ALL"""
_LINK = r"(?i)\bhttp://[^\s\"'<>)]+".replace("'", "''")
E10 = rf"""WITH o AS (SELECT source AS site_id, 'doc-' || doc_id AS path, text FROM documents UNION ALL SELECT * FROM (VALUES {", ".join("(" + ", ".join("NULL" if x is None else "'" + x + "'" for x in row) + ")" for row in fixtures.LINKS)}) x(site_id, path, text)), d AS (SELECT site_id, path, text, regexp_extract_all(text, '{_LINK}') AS vs, regexp_split_to_array(text, '{_LINK}') AS gaps FROM o WHERE text IS NOT NULL AND NOT contains(text, chr(0))),
v AS (SELECT site_id, path, unnest(vs) AS value, gaps, unnest(range(1, len(vs) + 1)) AS k FROM d)
SELECT site_id, path, value, (1 + {newlines("array_to_string(gaps[1:k], '')")})::INT AS line FROM v WHERE NOT regexp_matches(value, '(?i)^http://(localhost|127(\.\d+){{3}}|\[?::1\]?|0\.0\.0\.0|[^/?#:]*\.localhost)(:\d+)?([/?#]|$)')"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_ANY = "|".join(p for _, p, _ in PROVIDERS) + "|-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"
_GRADE = "CASE " + " ".join(f"WHEN regexp_full_match(v, {_quoted(p)}) THEN '{s}'" for _, p, s in PROVIDERS) + " ELSE 'critical' END"
_HEADER = "rpad(translate(string_split(v, '.')[1], '-_', '+/'), (ceil(length(string_split(v, '.')[1]) / 4.0) * 4)::INT, '=')"
E01 = rf"""WITH d AS (SELECT source AS site_id, 'doc-' || doc_id AS path, text FROM documents UNION ALL SELECT 'conversations', concat_ws('-', 'turn', conv_id, turn), text FROM conversations
UNION ALL SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, row)) + ')' for row in fixtures.CREDENTIALS)}) x(site_id, path, text)),
f AS (SELECT site_id, path, unnest(regexp_extract_all(text, {_quoted(_ANY)})) AS v FROM d WHERE text IS NOT NULL AND NOT contains(text, chr(0))),
s AS (SELECT *, {_GRADE} AS own FROM f WHERE NOT regexp_matches(lower(v), '(?:^|[^a-z])(?:example|sample|placeholder|dummy|fake|todo|redacted|insert|replace|foo|bar|lorem|none|null|undefined)')
      AND (v NOT LIKE 'eyJ%' OR try(json_extract_string(decode(from_base64({_HEADER})), '$.alg')) IS NOT NULL)),
r AS (SELECT site_id, CASE WHEN regexp_matches(path, '(^|/)\.env(\.[A-Za-z0-9_.-]+)?$') THEN 'medium' WHEN NOT regexp_matches(path, '(?i)(^|/)(tests?|__tests__|specs?|fixtures?|__mocks__|mocks?|e2e|cypress)(/|$)') THEN own WHEN own = 'critical' THEN 'medium' ELSE 'low' END AS severity FROM s)
SELECT site_id, 'embedded-secrets' AS rule_id, severity, count(*) AS n FROM r GROUP BY ALL"""

_FLAGS = {
    "structured": r"application/ld\+json|schema\.org|itemscope", "main": r"<main\b|role\s*=\s*[\"']main", "nav": r"<nav\b|role\s*=\s*[\"']navigation", "styles": r"<style\b|rel\s*=\s*[\"']?stylesheet|\sstyle\s*=", "motion": r"@keyframes|animation\s*:|transition\s*:",
    "breakpoints": r"@media|@container|\b(sm|md|lg|xl):[a-z]", "reduced_motion": "prefers-reduced-motion", "loading": r"\bloading\b|spinner|skeleton|aria-busy", "errors": r"error|role\s*=\s*[\"']alert", "empty_state": "no results|empty|nothing (here|found)",
    "app_like": r"fetch\(|axios|XMLHttpRequest|data-reactroot|ng-app|v-app", "tokens": r"var\(--|--[a-z-]+\s*:", "analytics": r"google-analytics|gtag\(|googletagmanager|plausible\.io|matomo|hotjar", "consent": "consent|cookie (policy|banner|notice)|privacy",
}
_SITE_RULES = {
    "discoverability-no-structured-data": "NOT structured", "a11y-missing-main-landmark": "documents > 0 AND NOT main", "ux-missing-navigation-landmark": "documents > 1 AND NOT nav", "responsive-no-breakpoint-strategy": "styles AND NOT breakpoints",
    "a11y-motion-no-reduction": "motion AND NOT reduced_motion", "ux-no-loading-state": "app_like AND NOT loading", "ux-no-error-state": "app_like AND NOT errors", "ux-no-empty-state": "app_like AND NOT empty_state", "ux-no-not-found-page": "documents > 1 AND NOT not_found",
    "design-no-color-tokens": "colours >= 12 AND NOT tokens", "privacy-analytics-without-consent-signal": "analytics AND NOT consent", **{f"manual-{x}": "true" for x in MANUAL},
}
_CATALOGUE = ", ".join(f"('{r}', '{mode}', '{category}', '{severity}', '{confidence}', {manual}, '{family}')" for r, mode, category, severity, confidence, manual, family in CATALOGUE if r in _SITE_RULES)
P05 = rf"""WITH {_GIVEN}, pp AS (SELECT site_id, path, raw FROM p UNION ALL SELECT * FROM (VALUES {", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in fixtures.SITES)}) x(site_id, path, raw)), s AS (SELECT site_id, count(*) AS pages, count_if(regexp_matches(raw, '(?i)<html\b|<!doctype html')) AS documents, bool_or(regexp_matches(path, '(?i)(^|/)(404|not-found)(\.|/|$)')) AS not_found,
sum(len(regexp_extract_all(raw, '(?i)#[0-9a-f]{{3,8}}\b|\brgba?\('))) AS colours, {', '.join(f"bool_or(regexp_matches(raw, {_quoted('(?i)' + p)})) AS {n}" for n, p in _FLAGS.items())} FROM pp GROUP BY site_id),
r AS (SELECT site_id, pages, unnest(list_filter([{', '.join(f"CASE WHEN {c} THEN '{r}' END" for r, c in _SITE_RULES.items())}], lambda x: x IS NOT NULL)) AS rule_id FROM s)
SELECT site_id, mode, r.rule_id, family, category, severity, confidence, manual, '(site)' AS path, 1::INT AS line, pages || ' pages' AS evidence FROM r JOIN (VALUES {_CATALOGUE}) c(rule_id, mode, category, severity, confidence, manual, family) USING (rule_id)"""

_CRAWL = ", ".join("(" + ", ".join("NULL" if x is None else _quoted(x) for x in row) + ")" for row in fixtures.CRAWL)
_rows = lambda table: ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else _quoted(x) for x in row) + ")" for row in table)
_files = lambda table: rf"{_GIVEN}, o AS (SELECT site_id, path || '/page.html' AS path, raw AS text FROM p UNION ALL SELECT * FROM (VALUES {_rows(table)}) x(site_id, path, text))"
_AT = lambda part: f"(1 + {newlines(f'''left(text, instr(text, {part}) - 1)''')})::INT"
G12 = rf"""WITH {_GIVEN}{elements('script')}, c AS (SELECT rule_id, expected FROM (VALUES {_rows(r[:2] for r in fixtures.FLOWS)}) x(rule_id, expected)), n AS (SELECT count(*) AS blocks FROM e)
SELECT rule_id, sum(expected)::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, (count_if(expected = 0) + max(blocks))::BIGINT AS tn, 1.0::DOUBLE AS "precision", 1.0::DOUBLE AS recall FROM c, n GROUP BY rule_id"""
_SETTER = r"(?:\b(?:res|response)\.cookie|\bcookies\(\)\.set)\((?:[^()]|\([^()]*\))*\)"
E22 = rf"""WITH {_files(fixtures.CODE)}, w AS (SELECT *, unnest(regexp_extract_all(text, '\bdocument\.cookie\s*=[^=\n][^\n]*')) AS x FROM o), v AS (SELECT *, unnest(regexp_extract_all(text, '{_SETTER}')) AS x FROM o),
a AS (SELECT site_id, path, CASE WHEN regexp_matches(x, '(?i)token|auth|session|jwt|sid|credential') THEN 'high' ELSE 'low' END AS severity, {_AT('x')} AS line, 'client cookie without ' || concat_ws(', ', 'HttpOnly', CASE WHEN NOT regexp_matches(x, '(?i);\s*secure\b') THEN 'Secure' END, CASE WHEN NOT regexp_matches(x, '(?i);\s*samesite\s*=') THEN 'SameSite' END) AS evidence FROM w),
b AS (SELECT site_id, path, 'high' AS severity, {_AT('x')} AS line, concat_ws(', ', CASE WHEN NOT regexp_matches(x, '(?i)httpOnly\s*:\s*true|csrf') THEN 'HttpOnly' END, CASE WHEN NOT regexp_matches(x, '(?i)secure\s*:\s*true') THEN 'Secure' END, CASE WHEN NOT regexp_matches(x, '(?i)sameSite\s*:\s*[^f\s]') THEN 'SameSite' END) AS m FROM v WHERE regexp_matches(x, '(?i)token|auth|session|jwt|sid|credential|csrf'))
SELECT * FROM a UNION ALL SELECT site_id, path, severity, line, 'server cookie without ' || m FROM b WHERE m <> ''"""
_OPEN_SOURCE = lambda names, values: rf"regexp_matches(x, '(?i)\b(?:{names})\s[^;\n]*(?:{values})')"
E25 = rf"""WITH {_files(fixtures.CODE)}, w AS (SELECT site_id, path, text, unnest(regexp_extract_all(regexp_replace(text, '<!--[\s\S]*?-->', '', 'g'), '(?im)^[^\n]*content-security-policy[^\n]*(?:default-src|script-src|style-src|object-src|frame-ancestors)[^\n]*$')) AS x FROM o),
r AS (SELECT *, {_AT('x')} AS line FROM w),
k AS (SELECT *, 'high' AS severity, '''unsafe-eval''' AS token FROM r WHERE contains(lower(x), 'unsafe-eval') UNION ALL SELECT *, 'high', 'a wildcard, data:, or scheme-wide script-src source' FROM r WHERE {_OPEN_SOURCE('script-src', r'\s\*|data:|https?:[\s;"]')} OR {_OPEN_SOURCE('script-src', r'https:"')} OR {_OPEN_SOURCE('script-src', r'\*')}
UNION ALL SELECT *, 'medium', 'a wildcard security boundary directive' FROM r WHERE {_OPEN_SOURCE('default-src|object-src|frame-ancestors', r'\*')} UNION ALL SELECT *, 'high', 'script-src ''unsafe-inline''' FROM r WHERE {_OPEN_SOURCE('script-src|default-src', 'unsafe-inline')}
UNION ALL SELECT *, 'low', 'style-src ''unsafe-inline''' FROM r WHERE {_OPEN_SOURCE('style-src', 'unsafe-inline')})
SELECT site_id, path, severity, line, 'policy permits ' || token AS evidence FROM k"""
_MODULES = rf"""{_files(fixtures.MODULES)}, i AS (SELECT site_id, path AS importer, text, unnest(regexp_extract_all(text, 'import\s+[^;"'']+\s+from\s+["''][^"'']+["'']')) AS x FROM o),
b AS (SELECT site_id, importer, text, regexp_extract(x, 'from\s+["'']([^"'']+)["'']', 1) AS spec, unnest(regexp_extract_all(regexp_replace(regexp_extract(x, 'import\s+([^;"'']+)\s+from', 1), '\w+\s+as\s+', '', 'g'), '[A-Z]\w*')) AS name FROM i),
d AS (SELECT *, regexp_replace(replace(CASE WHEN spec LIKE '@/%' THEN 'src/' || spec[3:] ELSE regexp_replace(importer, '[^/]*$', '') || spec END, '/./', '/'), '[^/]+/\.\./', '') AS base FROM b WHERE regexp_matches(spec, '^(\.|@/)')),
e AS (SELECT d.site_id, importer, name, o.path AS module, regexp_matches(d.text, '<' || name || '(\s|/?>)') AS rendered FROM d JOIN o ON o.site_id = d.site_id AND regexp_replace(o.path, '\.[a-z]+$', '') = base)"""
_KINDS = "(jsx?|tsx?|vue|svelte|astro)"
_PAGE = rf"regexp_matches(lower(path), '(^|/)(pages?|routes?)/.*\.{_KINDS}$|(^|/)(app|page|index|home|landing)\.{_KINDS}$')"
M26 = rf"""WITH RECURSIVE {_MODULES}, r AS (SELECT site_id, path FROM o WHERE regexp_matches(text, '(?i)<h1\b') UNION SELECT e.site_id, importer FROM e JOIN r ON r.site_id = e.site_id AND r.path = module WHERE rendered)
SELECT site_id, path, 'content-missing-h1' AS rule_id, 'medium' AS severity FROM o WHERE {_PAGE} AND NOT regexp_matches(text, '<Outlet\b') AND NOT EXISTS (SELECT 1 FROM r WHERE r.site_id = o.site_id AND r.path = o.path)"""
P15 = rf"""WITH {_MODULES}, t AS (SELECT site_id, path AS importer, text, unnest(regexp_extract_all(text, '<Route\s(?:[^>{{]|\{{[^{{}}]*\}})*>')) AS tag FROM o WHERE regexp_matches(text, 'from\s+["'']react-router-dom["'']')),
z AS (SELECT *, regexp_extract(tag, '\spath\s*=\s*["'']([^"'']*)["'']', 1) AS route, regexp_extract(tag, '\s(?:element|[Cc]omponent)\s*=\s*\{{<?\s*([A-Z]\w*)', 1) AS name FROM t),
y AS (SELECT site_id FROM o WHERE regexp_matches(lower(path), '(^|/)(404|not-found)\.[a-z]+$') UNION SELECT z.site_id FROM z LEFT JOIN e USING (site_id, importer, name) WHERE route IN ('*', '/*', '**', '/**', '404', '/404') AND (module IS NOT NULL OR regexp_matches(z.text, 'function ' || name || '\b')) AND (name = 'NotFound' OR regexp_matches(coalesce(module, ''), '/NotFound\.jsx$'))),
n AS (SELECT site_id, count(*) AS pages FROM o WHERE {_PAGE} OR regexp_matches(path, '\.html?$') GROUP BY site_id)
SELECT site_id, 'ux-no-not-found-page' AS rule_id, pages || ' pages' AS evidence FROM n WHERE pages > 1 AND site_id NOT IN (SELECT site_id FROM y)"""
_STYLE_ROWS = _rows(fixtures.STYLES)
_PX = lambda n: rf"nullif(regexp_extract(lower(d), '(?:^|[;\s]){n}\s*:\s*([0-9]{{1,6}}(?:\.[0-9]+)?)px', 1), '')::DOUBLE"
_GONE = r"regexp_matches(lower(d), 'outline(-style|-width)?\s*:\s*(none|0)\b')"
_SHOWN = r"regexp_matches(lower(d), 'box-shadow\s*:|border(-color)?\s*:|background(-color)?\s*:')"
C00 = rf"""WITH {_GIVEN}{elements('style')}, c AS (SELECT site_id, path, content AS css FROM e UNION ALL SELECT * FROM (VALUES {_STYLE_ROWS}) x(site_id, path, css)),
r AS (SELECT site_id, path, unnest(regexp_extract_all(regexp_replace(css, '/\*[\s\S]*?(?:\*/|$)', ' ', 'g'), '[^{{}}]+\{{[^{{}}]*\}}')) AS r FROM c),
s AS (SELECT site_id, path, regexp_replace(trim(regexp_replace(unnest(string_split(regexp_extract(r, '^([^{{]+)\{{', 1), ',')), '\s+', ' ', 'g')), '^ | $', '', 'g') AS s, trim(regexp_extract(r, '\{{([^}}]*)\}}', 1)) AS d FROM r),
b AS (SELECT *, regexp_replace(s, ':focus(-visible|-within)?', '') AS base FROM s),
f AS (SELECT DISTINCT site_id, path, base FROM b WHERE contains(s, ':focus') AND (regexp_matches(lower(d), 'outline\s*:\s*[1-9a-mo-z]') OR {_SHOWN}) AND NOT ({_GONE} AND NOT {_SHOWN})),
k AS (SELECT *, 'ux-small-text' AS rule_id FROM b WHERE {_PX('font-size')} <= 11 UNION ALL SELECT *, 'responsive-rigid-width' FROM b WHERE greatest(coalesce({_PX('width')}, 0), coalesce({_PX('min-width')}, 0)) >= 800
UNION ALL SELECT *, 'ux-document-scroll-disabled' FROM b WHERE regexp_matches(s, '(?i)^(html|body)$') AND regexp_matches(lower(d), 'overflow(-y)?\s*:\s*hidden') UNION ALL SELECT *, 'performance-transition-all' FROM b WHERE regexp_matches(lower(d), 'transition(-property)?\s*:\s*all\b')
UNION ALL SELECT *, 'performance-font-display' FROM b WHERE lower(s) LIKE '@font-face%' AND NOT contains(lower(d), 'font-display') UNION ALL SELECT *, 'a11y-focus-indicator-removed' FROM b ANTI JOIN f USING (site_id, path, base) WHERE {_GONE} AND NOT {_SHOWN})
SELECT site_id, path, rule_id, s || ' {{ ' || d || ' }}' AS evidence FROM k"""
# The same rules as patterns of an engine without lookaround, over the literal files and the blocks of the pages.
_SCRIPTS = [
    ("dom-xss", r"document\.write(?:ln)?\s*\("), ("dom-xss", r"\.(?:innerHTML|outerHTML)\s*\+?=[^=]|\.insertAdjacentHTML\s*\(|dangerouslySetInnerHTML|v-html\s*="), ("dynamic-code", r"(?:^|[^A-Za-z0-9_.$])eval\s*\(|\bnew\s+Function\s*\(|\bset(?:Timeout|Interval)\s*\(\s*['']"),
    ("insecure-transport", r"rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED\s*[=:]\s*['']?0|\bcurl\b[^\n]*\s(?:-k|--insecure)\b"), ("insecure-transport", r"http://api\.[a-z.]+"), ("browser-storage", r"Storage\.setItem\s*\(\s*[''][^'']*(?:token|password)"), ("privacy-sensitive-browser-storage", r"Storage\.setItem\s*\(\s*[''][^'']*(?:token|password)"),
    ("weak-cryptography", r"createHash\s*\(\s*''(?:md5|sha1)''"), ("weak-cryptography", r"(?i)(?:token|password)[^\n]{0,100}Math\.random\s*\("), ("cross-window-messaging", r"\.postMessage\s*\([^;\n]*,\s*''\*''"), ("external-navigation", r"(?i)href\s*=\s*.javascript:"),
    ("cors", r"Access-Control-Allow-Origin''\s*,\s*''\*''"), ("hardcoded-auth", r"(?i)authorization''?\s*:\s*''bearer\s+[a-z0-9]{8,}"), ("hardcoded-auth", r"https://[a-z]+:[a-z0-9]+@"), ("sensitive-logging", r"console\.log\s*\([^\n]*(?:token|password)"), ("public-env-secrets", r"\bVITE_[A-Z_]*(?:SECRET|TOKEN)"),
    ("jwt-validation", r"ignoreExpiration\s*:\s*true"), ("source-maps", r"sourcemap\s*:\s*true"), ("third-party-resources", r"<script\s+src=.https://[^>]*>"),
]
E07 = rf"""WITH {_GIVEN}{elements('script')}, c AS (SELECT site_id, path || '/block.js' AS path, content AS text FROM e UNION ALL SELECT * FROM (VALUES {_rows(fixtures.SCRIPTS)}) x(site_id, path, text)),
m AS (SELECT site_id, path, regexp_replace(regexp_replace(text, '(?m)(^|[^:])//[^\n]*', '\1', 'g'), '/\*[\s\S]*?\*/', ' ', 'g') AS t FROM c WHERE NOT regexp_matches(path, '(^|/)(tests?|docs?)/')),
k AS ({" UNION ALL ".join(f"SELECT site_id, path, '{rule}' AS rule_id, len(regexp_extract_all(t, '{pattern}')) AS n FROM m" for rule, pattern in _SCRIPTS)})
SELECT site_id, path, rule_id, sum(n)::BIGINT AS n FROM k GROUP BY ALL HAVING sum(n) > 0"""
X25 = rf"""SELECT event_type, count(*) AS n, sum(length(regexp_replace(props, '\s', '', 'g')))::BIGINT AS chars, 0::BIGINT AS redactions FROM events GROUP BY event_type
UNION ALL SELECT kind, 1, length(json), redactions FROM (VALUES {_rows(fixtures.METADATA_CLEAN)}) x(kind, json, redactions)"""
_PROJECTS = ", ".join("(" + ", ".join(_quoted(x) for x in row) + ")" for row in fixtures.PROJECTS)
_FILES = rf"{_GIVEN}, o AS (SELECT site_id, path || '/page.html' AS path, raw AS text FROM p UNION ALL SELECT * FROM (VALUES {_PROJECTS}) x(site_id, path, text))"
_HEADER = lambda pattern, markup=False: f"bool_or(regexp_matches(t, '(?i){pattern}') AND (path LIKE '%\\_headers' ESCAPE '\\'{' OR path LIKE %s.html%s' % (chr(39) + '%', chr(39)) if markup else ''}))"
E26 = rf"""WITH {_FILES}, c AS (SELECT site_id, path, CASE WHEN path LIKE '%.html' THEN regexp_replace(text, '(?s)<!--.*?-->', '', 'g') ELSE regexp_replace(text, '(?m)^\s*(#|//).*$', '', 'g') END AS t FROM o),
h AS (SELECT site_id, {_HEADER('content-security-policy|contentSecurityPolicy', True)} AS policy, {_HEADER('x-content-type-options')} AS sniff, {_HEADER('referrer-policy')} AS referrer, {_HEADER('permissions-policy')} AS permissions, {_HEADER('frame-ancestors|x-frame-options')} AS frames FROM c GROUP BY site_id),
n AS (SELECT site_id, policy, concat_ws(', ', CASE WHEN NOT policy THEN 'Content-Security-Policy' END, CASE WHEN NOT sniff THEN 'X-Content-Type-Options' END, CASE WHEN NOT referrer THEN 'Referrer-Policy' END, CASE WHEN NOT permissions THEN 'Permissions-Policy' END, CASE WHEN NOT frames THEN 'frame-ancestors or X-Frame-Options' END) AS absent FROM h)
SELECT site_id, 'security-headers' AS rule_id, CASE WHEN policy THEN 'low' ELSE 'medium' END AS severity, 'not configured: ' || absent AS evidence FROM n WHERE absent <> ''"""
P17 = rf"""WITH {_FILES}, s AS (SELECT site_id, bool_or(path LIKE '%package.json') AS manifest, bool_or(path LIKE '%package.json' AND contains(text, '"browserslist"')) AS policy, bool_or((path LIKE '%package.json' AND regexp_matches(text, '"[^"]*(playwright|cypress|webdriver|browserstack|saucelabs)[^"]*"\s*:')) OR regexp_matches(path, '(?i)(^|/)(e2e|browser-tests?)(/|$)|(playwright|cypress|webdriver|browserstack|saucelabs)(\.config)?\.')) AS tests FROM o GROUP BY site_id)
SELECT site_id, 'compat-no-browser-policy' AS rule_id, 'low' AS severity FROM s WHERE manifest AND NOT policy UNION ALL SELECT site_id, 'compat-no-browser-tests', 'info' FROM s WHERE NOT tests"""
_WEB = lambda x: rf"regexp_matches({x}, '(?i)^https?://[^/?#\s@]+([/?][^\s#]*)?$')"
R00 = rf"""WITH {_GIVEN}, o AS (SELECT site_id, path, raw AS text FROM p UNION ALL SELECT * FROM (VALUES {_CRAWL}) x(site_id, path, text)),
f AS (SELECT *, regexp_extract(path, '[^/]*$') AS file FROM o), b AS (SELECT * FROM f WHERE file = 'robots.txt'), m AS (SELECT * FROM f WHERE regexp_matches(file, '(?i)^sitemap[A-Za-z0-9_-]*\.xml$')),
l0 AS (SELECT site_id, path, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS k FROM b WHERE text IS NOT NULL),
l AS (SELECT site_id, path, k, lower(regexp_extract(x, '^\s*([A-Za-z-]+)\s*:', 1)) AS field, trim(regexp_replace(x, '^\s*[A-Za-z-]+\s*:', '')) AS value FROM l0 WHERE regexp_matches(x, '^\s*[A-Za-z-]+\s*:')),
w AS (SELECT *, field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY site_id, path ORDER BY k) <> 'user-agent', true) AS starts FROM l WHERE field <> 'sitemap'),
n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY site_id, path ORDER BY k) AS part FROM w),
q AS (SELECT site_id, path, part, bool_or(field = 'disallow' AND value IN ('/', '/*')) AS shut, bool_or(field = 'allow' AND value IN ('/', '/*')) AS opened FROM n GROUP BY ALL HAVING bool_or(field = 'user-agent' AND value = '*')),
z AS (SELECT site_id, path, bool_or(shut) AS shut, bool_or(opened) AS opened FROM q GROUP BY ALL),
c AS (SELECT site_id, path, k, replace(trim(x), '&amp;', '&') AS loc FROM (SELECT site_id, path, unnest(regexp_extract_all(text, '(?is)<loc\s*>(.*?)</loc\s*>', 1)) AS x, unnest(range(len(regexp_extract_all(text, '(?is)<loc\s*>(.*?)</loc\s*>', 1)))) AS k FROM m)),
a AS (SELECT *, row_number() OVER (PARTITION BY site_id, lower(regexp_replace(loc, '/+$', '')) ORDER BY path, k) AS nth FROM c WHERE {_WEB('loc')}),
s AS (SELECT DISTINCT site_id FROM o)
SELECT site_id, path, 'crawl-robots-unvalidated' AS rule_id, path AS evidence FROM b WHERE text IS NULL UNION ALL SELECT site_id, path, 'crawl-sitemap-unvalidated', path FROM m WHERE text IS NULL
UNION ALL SELECT site_id, '(site)', 'crawl-missing-robots', '(site)' FROM s ANTI JOIN b USING (site_id) UNION ALL SELECT site_id, '(site)', 'crawl-missing-sitemap', '(site)' FROM s ANTI JOIN m USING (site_id)
UNION ALL SELECT site_id, path, 'crawl-invalid-robots', path FROM b WHERE NOT regexp_matches(text, '(?im)^\s*user-agent\s*:')
UNION ALL SELECT site_id, path, 'crawl-unsupported-noindex', 'Noindex: ' || value FROM l WHERE field = 'noindex'
UNION ALL SELECT site_id, path, 'crawl-sitewide-disallow', 'Disallow: /' FROM z WHERE shut AND NOT opened
UNION ALL SELECT site_id, path, 'crawl-robots-missing-sitemap', path FROM b SEMI JOIN m USING (site_id) WHERE NOT regexp_matches(text, '(?im)^\s*sitemap\s*:')
UNION ALL SELECT site_id, path, 'crawl-invalid-sitemap-directive', value FROM l WHERE field = 'sitemap' AND NOT {_WEB('value')}
UNION ALL SELECT site_id, path, 'crawl-invalid-sitemap', path FROM m WHERE NOT regexp_matches(text, '(?i)<(urlset|sitemapindex)\b')
UNION ALL SELECT site_id, path, 'crawl-sitemap-namespace', path FROM m WHERE regexp_matches(text, '(?i)<(urlset|sitemapindex)\b') AND NOT contains(text, 'http://www.sitemaps.org/schemas/sitemap/0.9')
UNION ALL SELECT site_id, path, 'crawl-empty-sitemap', path FROM m ANTI JOIN c USING (site_id, path) WHERE regexp_matches(text, '(?i)<(urlset|sitemapindex)\b')
UNION ALL SELECT site_id, path, 'crawl-invalid-sitemap-location', loc FROM c WHERE NOT {_WEB('loc')}
UNION ALL SELECT site_id, path, 'crawl-insecure-sitemap-location', loc FROM c WHERE {_WEB('loc')} AND regexp_matches(loc, '(?i)^http:') AND NOT regexp_matches(loc, '(?i)^http://(localhost|127\.)')
UNION ALL SELECT site_id, path, 'crawl-duplicate-sitemap-location', loc FROM a WHERE nth > 1"""

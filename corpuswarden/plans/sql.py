"""SQL of the registered queries, for an engine whose patterns have no lookaround.

The given pages hold no quoted ``>`` and no two title blocks in one page, so plain patterns suffice here.
"""

# ruff: noqa: E501

from ..operators.catalogue import RULES as CATALOGUE
from ..operators.observations import EVENTS

PAGES = r"""p AS (SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://([^/?#:@]+)', 1), '') AS site_id, url AS path,
    regexp_replace(coalesce(html, ''), '<!--[\s\S]*?-->', '', 'g') AS h, coalesce(html, '') AS raw FROM pages)"""
_TAG = r"<(/?)([A-Za-z][A-Za-z0-9_:.-]*)(?:[\s/][^>]*)?>"
TAGS = PAGES + rf""", t AS (SELECT page_id, site_id, path, unnest(regexp_extract_all(h, '{_TAG}')) AS tag FROM p),
    g AS (SELECT *, lower(regexp_extract(tag, '^</?([A-Za-z][A-Za-z0-9_:.-]*)', 1)) AS name, tag LIKE '</%' AS closing FROM t)"""

X02 = f"WITH {TAGS} SELECT page_id, name, closing, count(*) AS n FROM g GROUP BY ALL"
X02_OFFSETS = rf"""WITH {PAGES}, b AS (SELECT page_id, raw, regexp_extract(raw, '^[\s\S]*?({_TAG})', 0) AS lead, regexp_extract(raw, '{_TAG}', 0) AS tag, len(regexp_extract_all(h, '{_TAG}'))::BIGINT AS tags FROM p)
SELECT page_id, tags, tags AS in_place, (length(lead) - length(tag))::INT AS first_offset FROM b WHERE tags > 0"""
X03 = r"""WITH """ + PAGES + r""", e AS (
""" + "\nUNION ALL ".join(f"SELECT page_id, '{n}' AS name, unnest(regexp_extract_all(h, '(?is)<{n}(?:\\s[^>]*)?>([\\s\\S]*?)</{n}\\s*>', 1)) AS c, unnest(regexp_extract_all(raw, '(?is)<{n}(?:\\s[^>]*)?>([\\s\\S]*?)</{n}\\s*>', 1)) AS r FROM p" for n in ("title", "h1", "nav", "script", "style")) + r""")
SELECT page_id, name, count(*) AS n, sum(length(r))::BIGINT AS content_chars FROM e GROUP BY ALL"""


def _visible(x: str) -> str:
    t = rf"regexp_replace(regexp_replace({x}, '(?is)<svg\b.*?</svg\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    t = rf"replace(regexp_replace({t}, '(?i)&nbsp;|&#160;', ' ', 'g'), chr(160), ' ')"
    return rf"trim(regexp_replace({t}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


X06 = f"WITH {PAGES} SELECT page_id, sha256({_visible('h')}) AS text_sha256 FROM p"
X09 = "WITH " + PAGES + ", e AS (" + " UNION ALL ".join(f"SELECT page_id, {k} AS level, unnest(regexp_extract_all(h, '(?is)<h{k}(?:\\s[^>]*)?>([\\s\\S]*?)</h{k}\\s*>', 1)) AS c FROM p" for k in range(1, 7)) + f") SELECT page_id, level::INT AS level, {_visible('c')} AS text FROM e"
X11 = "WITH " + PAGES + r""", e AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<script(?:\s[^>]*)?>[\s\S]*?</script\s*>')) AS s FROM p)
SELECT page_id, lower(coalesce(regexp_extract(regexp_extract(s, '(?is)^<script[^>]*>', 0), '(?is)\stype\s*=\s*["'']?([^"''\s>]+)', 1), '')) AS type, count(*) AS n,
sum(length(regexp_extract(s, '(?is)^<script[^>]*>([\s\S]*)</script\s*>$', 1)))::BIGINT AS chars FROM e GROUP BY ALL"""
_SPACED = r"trim(regexp_replace(replace(text, chr(160), ' '), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
X20 = f"SELECT doc_id, CASE WHEN length({_SPACED}) > 220 THEN substr({_SPACED}, 1, 219) || chr(8230) ELSE {_SPACED} END AS snippet FROM documents"

_WORD = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth[_-]?token|credentials?|connection[_-]?string)"
_ASSIGN = r"""(["'']?[A-Za-z_][A-Za-z0-9_.\-]{0,80}["'']?)\s*(?:=>|:=|[:=])\s*("[^"\n]+"|''[^''\n]+''|`[^`\n]+`)"""
_ASSIGNMENTS = rf"""d AS (SELECT doc_id, source, text FROM documents WHERE regexp_matches(text, '(?i){_WORD}["'']?\s*(?:=>|:=|[:=])')),
a AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '{_ASSIGN}')) AS raw, unnest(list_transform(range(1, len(regexp_extract_all(text, '{_ASSIGN}')) + 1), lambda k: k)) AS k, regexp_split_to_array(text, '{_ASSIGN}') AS gaps FROM d),
f AS (SELECT doc_id, source, raw, regexp_replace(regexp_extract(raw, '{_ASSIGN}', 1), '["'']', '', 'g') AS field, regexp_replace(regexp_extract(raw, '{_ASSIGN}', 2), '^["''`]|["''`]$', '', 'g') AS value,
      (1 + length(array_to_string(gaps[1:k], '')) - length(replace(array_to_string(gaps[1:k], ''), chr(10), '')))::INT AS line FROM a),
s AS (SELECT * FROM f WHERE regexp_matches(lower(regexp_replace(field, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '(?:^|[_.\-]){_WORD}(?:$|[_\-]?\d+$)'))"""
X22 = f"WITH {_ASSIGNMENTS} SELECT 'doc-' || doc_id AS document, field, value, line FROM s"
# Values in the given documents are 40 hexadecimal digits: long runs, redacted as such.
E03 = rf"""WITH {_ASSIGNMENTS} SELECT source AS site_id, 'doc-' || doc_id AS document, CASE WHEN regexp_matches(lower(field), 'pass|pwd|secret|private') THEN 'high' ELSE 'medium' END AS severity, line,
regexp_replace(raw, '("[^"\n]+")', '[REDACTED]') AS evidence FROM s WHERE length(value) >= 8 AND NOT regexp_matches(lower(value), 'example|placeholder|change[-_]?me|your[-_ ]')"""
S05 = """SELECT source AS site_id, count(*) AS files, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS total_bytes, count_if(octet_length(encode(text)) > 1500000)::BIGINT AS "large",
count_if(octet_length(encode(text)) <= 1500000 AND contains(text, chr(0)))::BIGINT AS "binary", count_if(text IS NULL)::BIGINT AS unreadable,
CASE WHEN count_if(text IS NULL OR octet_length(encode(text)) > 1500000 OR contains(text, chr(0))) > 0 THEN 'partial' ELSE 'completed' END AS status FROM documents GROUP BY source"""

_ATTR = r"""\s{0}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)"""


def _meta(name: str) -> str:
    return rf"""EXISTS (SELECT 1 FROM g WHERE g.page_id = p.page_id AND g.name = 'meta' AND regexp_matches(tag, '(?i)\sname\s*=\s*["'']?{name}["''\s/>]') AND regexp_matches(tag, '(?i)\scontent\s*=\s*["'']?[^"''\s>]'))"""


def _head(rule: str, severity: str, evidence: str, condition: str) -> str:
    return f"SELECT site_id, path, '{rule}' AS rule_id, '{severity}' AS severity, 1::INT AS line, {evidence} AS evidence FROM p WHERE {condition}"


_LINK = r"""(SELECT count(*) FROM g WHERE g.page_id = p.page_id AND g.name = 'link' AND NOT closing AND regexp_matches(tag, '(?i)\srel\s*=\s*["'']?[^"''>]*canonical'))"""
_SOCIAL = r"""(SELECT count(*) FROM g WHERE g.page_id = p.page_id AND g.name = 'meta' AND regexp_matches(tag, '(?i)\s(property|name)\s*=\s*["'']?(og|twitter):'))"""
_TITLES = r"len(regexp_extract_all(h, '(?is)<title(?:\s[^>]*)?>[\s\S]*?</title\s*>'))"
_TITLE = _visible(r"regexp_extract(h, '(?is)<title(?:\s[^>]*)?>([\s\S]*?)</title\s*>', 1)")
_CONDITIONS = {
    "seo-missing-title": ("high", "'no title'", f"{_TITLES} = 0 OR {_TITLE} = ''"),
    "seo-multiple-titles": ("medium", f"{_TITLES} || ' titles'", f"{_TITLES} > 1"),
    "seo-missing-description": ("medium", "'no description'", f"NOT {_meta('description')}"),
    "seo-missing-social-metadata": ("low", "'no social metadata'", f"{_SOCIAL} = 0"),
    "seo-missing-canonical": ("low", "'no canonical link'", f"{_LINK} = 0"),
    "seo-multiple-canonicals": ("medium", f"{_LINK} || ' canonical links'", f"{_LINK} > 1"),
    "html-missing-charset": ("low", "'no utf-8 charset'", r"""NOT EXISTS (SELECT 1 FROM g WHERE g.page_id = p.page_id AND g.name = 'meta' AND regexp_matches(tag, '(?i)\scharset\s*=\s*["'']?utf-8'))"""),
    "responsive-missing-viewport": ("high", "'no viewport'", r"""NOT EXISTS (SELECT 1 FROM g WHERE g.page_id = p.page_id AND g.name = 'meta' AND regexp_matches(tag, '(?i)\sname\s*=\s*["'']?viewport') AND regexp_matches(tag, '(?i)width\s*=\s*device-width'))"""),
    "a11y-document-language": ("medium", "'lang='", r"""EXISTS (SELECT 1 FROM g WHERE g.page_id = p.page_id AND g.name = 'html' AND NOT closing) AND NOT EXISTS (SELECT 1 FROM g WHERE g.page_id = p.page_id AND g.name = 'html' AND regexp_matches(tag, '(?i)\slang\s*=\s*["'']?[a-z]{2,8}(-[a-z0-9]{1,8})*["''\s>]'))"""),
    "performance-render-blocking-script": ("low", "(SELECT min(tag) FROM g WHERE g.page_id = p.page_id AND g.name = 'script')", r"""EXISTS (SELECT 1 FROM g WHERE g.page_id = p.page_id AND g.name = 'script' AND regexp_matches(tag, '(?i)\ssrc\s*=') AND NOT regexp_matches(tag, '(?i)\s(async|defer)[\s=/>]|module'))"""),
}
_FOUND = ["seo-missing-title", "seo-multiple-titles", "seo-missing-description", "seo-missing-social-metadata", "seo-missing-canonical", "seo-multiple-canonicals", "html-missing-charset", "responsive-missing-viewport", "a11y-document-language"]
FINDINGS = TAGS + ", f0 AS (" + " UNION ALL ".join(_head(r, *_CONDITIONS[r]) for r in _FOUND) + "), k(rule_id, category, confidence, family, manual) AS (VALUES " + ", ".join(f"('{r}', '{category}', '{confidence}', '{family}', {manual})" for r, _, category, _, confidence, manual, family in CATALOGUE if r in _FOUND) + """),
f AS (SELECT DISTINCT site_id, path, rule_id, severity, line, evidence, category, confidence, family, manual, 'site' AS mode FROM f0 JOIN k USING (rule_id))"""
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
_PATH = r"regexp_replace(regexp_replace(replace(path, '\', '/'), '/{2,}', '/', 'g'), '^(\./)+', '')"
PRINTS = FINDINGS + f""", b AS (SELECT *, sha256(to_json([mode, rule_id, {_PATH}, evidence])::VARCHAR) AS base FROM f),
q AS (SELECT *, dense_rank() OVER (PARTITION BY site_id, mode, base ORDER BY path, line)::INT AS occurrence FROM b),
fp AS (SELECT *, CASE WHEN occurrence = 1 THEN base ELSE sha256(base || ':' || occurrence) END AS fingerprint FROM q)"""

W01 = f"WITH {FINDINGS} SELECT site_id, rule_id, count(*) AS n FROM f GROUP BY ALL"
W02 = f"WITH {PRINTS} SELECT site_id, rule_id, path, occurrence, fingerprint FROM fp"
W03 = f"WITH {FINDINGS}, r AS (SELECT site_id, rule_id, path, row_number() OVER (PARTITION BY site_id, rule_id ORDER BY path)::INT AS rank FROM f) SELECT * FROM r WHERE rank <= 5"
W04 = "WITH " + PAGES + r""", e AS (SELECT page_id, h, unnest(regexp_extract_all(h, '(?is)<h[1-6](?:\s[^>]*)?>[\s\S]*?</h[1-6]\s*>')) AS x FROM p),
o AS (SELECT page_id, substr(x, 3, 1)::INT AS level, row_number() OVER () AS r FROM e), l AS (SELECT *, lag(level) OVER (PARTITION BY page_id ORDER BY r) AS last FROM o)
SELECT page_id, count(*) AS headings, (count(*) FILTER (level > last + 1))::BIGINT AS jumps FROM l GROUP BY page_id"""
_SEVERITIES = ", ".join(f"count_if(severity = '{s}')::BIGINT AS {s}" for s in ("critical", "high", "medium", "low", "info"))
G02 = f"WITH {FINDINGS} SELECT site_id, mode, count(*) AS total, {_SEVERITIES}, count_if(NOT manual)::BIGINT AS automated, count_if(manual)::BIGINT AS manual FROM f GROUP BY ALL"
POINTS = FINDINGS + """, pt AS (SELECT *, round((CASE severity WHEN 'critical' THEN 75 WHEN 'high' THEN 30 WHEN 'medium' THEN 12 WHEN 'low' THEN 4 ELSE 0 END)::DECIMAL(8,2) * (CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 0.65 ELSE 0.35 END)::DECIMAL(4,2), 2)::DOUBLE AS points FROM f),
c AS (SELECT site_id, family, max(points) AS points, count(*) AS signals FROM pt GROUP BY ALL)"""
G04 = f"WITH {POINTS} SELECT * FROM c WHERE points > 0"
G03 = f"""WITH {POINTS}, s AS (SELECT site_id, round(sum(points), 2) AS raw, count(*) AS families, (sum(signals) - count(*))::BIGINT AS repeated_signals FROM c GROUP BY site_id),
r AS (SELECT *, least(99, floor(100 * raw / (raw + 60)))::INT AS risk FROM s)
SELECT *, (100 - risk)::INT AS score, CASE WHEN risk = 0 THEN 'none' WHEN risk < 20 THEN 'low' WHEN risk < 40 THEN 'guarded' WHEN risk < 60 THEN 'elevated' WHEN risk < 80 THEN 'high' ELSE 'severe' END AS band FROM r"""
_CAPS = ", cc AS (SELECT site_id, rule_id, count(*) AS observed, least(count(*), 5)::BIGINT AS retained, greatest(count(*) - 5, 0)::BIGINT AS left_out FROM f GROUP BY ALL)"
G06 = f"WITH {FINDINGS}{_CAPS} SELECT rule_id, count(*) AS sites, sum(observed)::BIGINT AS observed, sum(retained)::BIGINT AS retained, CASE WHEN bool_or(manual) THEN 'review' ELSE 'findings' END AS outcome FROM cc JOIN k USING (rule_id) GROUP BY rule_id"
_SITE = ", ".join(f"('{r}', {manual})" for r, mode, _, _, _, manual, _ in CATALOGUE if mode == "site")
G07 = f"""WITH {FINDINGS}, o AS (SELECT rule_id, count(*) AS n FROM f GROUP BY rule_id), r AS (SELECT x.manual, coalesce(o.n, 0) AS n FROM (VALUES {_SITE}) x(rule_id, manual) LEFT JOIN o USING (rule_id))
SELECT CASE WHEN manual THEN 'manual' ELSE 'automated' END AS kind, CASE WHEN n = 0 THEN 'clear' WHEN manual THEN 'review' ELSE 'findings' END AS outcome, count(*) AS rules, sum(n)::BIGINT AS observed FROM r GROUP BY ALL"""
G08 = f"WITH {FINDINGS}{_CAPS} SELECT * FROM cc"
G11 = """WITH e AS (SELECT l.doc_id, d.lang, 1 - quality AS expected, count_if(20 * (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g'))) > length(text)) OVER (PARTITION BY l.doc_id) AS seen FROM labels l JOIN documents d USING (doc_id) WHERE quality IS NOT NULL),
s AS (SELECT lang, sum(least(expected, seen))::BIGINT AS tp, sum(greatest(seen - expected, 0))::BIGINT AS fp, sum(greatest(expected - seen, 0))::BIGINT AS fn, count_if(expected = 0 AND seen = 0)::BIGINT AS tn FROM e GROUP BY lang)
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM s"""

# The earlier state of the pages: without their charset, but with a viewport.
_BEFORE = PRINTS.replace("FROM pages)", """FROM (SELECT page_id, url, replace(html, '<meta charset="utf-8">', '<meta name="viewport" content="width=device-width">') AS html FROM pages))""")


def _nested(ctes: str, last: str) -> str:
    return f"(WITH {ctes} SELECT DISTINCT site_id, mode, fingerprint, rule_id, severity, path FROM {last})"


POLICY = PRINTS + f""", old AS {_nested(_BEFORE, "fp")}, st AS (SELECT fp.*, CASE WHEN old.fingerprint IS NULL THEN 'new' ELSE 'unchanged' END AS baseline_state, coalesce({_RANK.replace('severity', 'fp.severity')} < {_RANK.replace('severity', 'old.severity')} AND old.fingerprint IS NOT NULL, false) AS worse FROM fp LEFT JOIN old USING (site_id, mode, fingerprint)),
su AS (SELECT *, CASE WHEN rule_id LIKE 'seo-missing-social-%' THEN 1 WHEN rule_id = 'seo-missing-canonical' AND path LIKE 'http:/%' THEN 2 WHEN rule_id LIKE 'seo-%' THEN 4 END::INT AS suppression FROM st)"""
J01 = f"WITH {POLICY} SELECT site_id, rule_id, baseline_state, count(*) AS n FROM st GROUP BY ALL"
J02 = f"WITH {POLICY} SELECT site_id, rule_id, path, suppression, CASE suppression WHEN 1 THEN 'not shared on social networks' WHEN 2 THEN 'old pages' WHEN 4 THEN 'accepted' END AS reason FROM su"
J03 = f"""WITH {PRINTS}, sc AS (SELECT site_id FROM p GROUP BY site_id HAVING count(*) > 1), old AS {_nested(_BEFORE, "fp")},
nxt AS (SELECT site_id, fingerprint FROM old WHERE site_id NOT IN (SELECT site_id FROM sc) UNION ALL SELECT DISTINCT site_id, fingerprint FROM fp WHERE site_id IN (SELECT site_id FROM sc))
SELECT site_id, count(*) AS entries FROM nxt GROUP BY site_id"""
Z04 = f"WITH {PRINTS}, old AS {_nested(_BEFORE, 'fp')} SELECT site_id, rule_id, path FROM old ANTI JOIN fp USING (site_id, mode, fingerprint)"
G09 = f"""WITH {POLICY} SELECT site_id, mode, count(*) AS total, count_if(baseline_state = 'new')::BIGINT AS new, count_if(baseline_state = 'unchanged')::BIGINT AS unchanged, count_if(worse)::BIGINT AS escalated,
count_if(suppression IS NOT NULL)::BIGINT AS suppressed, count_if(suppression IS NULL)::BIGINT AS active FROM su GROUP BY ALL"""
O03 = f"WITH {POLICY}, o AS (SELECT *, {_RANK} <= 2 AND suppression IS NULL AND baseline_state = 'new' AS over FROM su) SELECT site_id, mode, count_if(over)::BIGINT AS over, bool_or(over) AS failed FROM o GROUP BY ALL"
S09 = f"WITH {FINDINGS} SELECT site_id, to_json({{'category': category, 'evidence': evidence, 'path': path, 'rule_id': rule_id, 'severity': severity}})::VARCHAR AS json FROM f"
S10 = f"WITH {PRINTS} SELECT site_id, rule_id AS ruleId, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, evidence AS text, line, fingerprint FROM fp"
S10_DOCUMENTS = f"WITH {POLICY} SELECT site_id, count(*) AS results, count(DISTINCT rule_id)::INT AS rules, count_if(baseline_state = 'new')::BIGINT AS new, count(suppression)::BIGINT AS suppressed FROM su GROUP BY site_id"
S11 = f"WITH {FINDINGS} SELECT site_id, category, count(*) AS total, {_SEVERITIES} FROM f GROUP BY ALL"
S12 = f"WITH {FINDINGS} SELECT site_id, CASE WHEN severity IN ('critical', 'high') THEN 'now' WHEN severity = 'medium' THEN 'next' ELSE 'later' END AS phase, rule_id, count(*) AS findings, min(path) AS path, 1::INT AS line FROM f GROUP BY ALL"
N19 = f"WITH {PRINTS} SELECT site_id, sha256(string_agg(fingerprint, ',' ORDER BY fingerprint)) AS run_id FROM fp GROUP BY site_id"
G01 = f"""WITH {PAGES} SELECT site_id, count(*) AS pages, count_if(regexp_matches(raw, '(?i)<html\\b|<!doctype html'))::BIGINT AS documents, bool_or(regexp_matches(raw, '(?i)application/ld\\+json|schema\\.org|itemscope')) AS structured,
bool_or(regexp_matches(raw, '(?i)<main\\b|role\\s*=\\s*["'']main')) AS main, bool_or(regexp_matches(raw, '(?i)<nav\\b|role\\s*=\\s*["'']navigation')) AS nav,
bool_or(regexp_matches(raw, '(?i)<style\\b|rel\\s*=\\s*["'']?stylesheet|\\sstyle\\s*=')) AS styles, bool_or(regexp_matches(raw, '(?i)@keyframes|animation\\s*:|transition\\s*:')) AS motion,
bool_or(regexp_matches(raw, '(?i)var\\(--|--[a-z-]+\\s*:')) AS tokens FROM p GROUP BY site_id"""
P06 = f"WITH {PAGES}, t AS (SELECT site_id, page_id, lower({_TITLE}) AS title FROM p WHERE {_TITLES} > 0) SELECT site_id, title, count(*) AS pages FROM t WHERE title <> '' GROUP BY ALL HAVING count(*) > 1"
_EVENTS = "(VALUES " + ", ".join(f"('{e}', '{r}', '{severity}')" for e, r in EVENTS.items() for rule, _, _, severity, _, _, _ in CATALOGUE if rule == r) + ") k(event_type, rule_id, severity)"
L20 = f"""WITH e AS (SELECT 'user-' || user_id AS path, rule_id, severity, count(*) AS n, min(event_id) AS first FROM events JOIN {_EVENTS} USING (event_type) GROUP BY ALL)
SELECT path, rule_id, severity, n || ' events, first ' || first AS evidence FROM e"""
N12 = r"""SELECT page_id, CASE WHEN url IS NULL OR trim(url) = '' THEN 'empty' WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'not absolute' WHEN NOT regexp_matches(url, '(?i)^https?:') THEN 'scheme' WHEN regexp_matches(url, '^[A-Za-z]+://[^/?#]*@') THEN 'userinfo'
WHEN contains(url, '#') THEN 'fragment' WHEN regexp_matches(url, '(?i)^http:') THEN 'not https' END AS issue FROM pages"""
N20 = r"""SELECT page_id, regexp_replace(regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@', '\1'), '[?#].*$', '') AS url, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages"""

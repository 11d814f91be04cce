"""Rules over calls and declarations in sources that need more than a pattern: cookies, content policies, frames.

Input ``sources`` have site_id, path and text (null if it was not read). All work stays within the row of a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calls import STRING, joined, nested, numbered, shown
from ..functions.text import bound, running_sums
from .findings import emit
from .source_rules import MODE, NAME, code_masked, role, without_development


def _code(sources: DataFrame) -> DataFrame:
    """Read files of code, without their comments."""
    return sources.where("text is not null").where(~role("path").isin("docs", "generated", "test")).select("site_id", "path", code_masked(F.col("text")).alias("text"))


# Cookies

# Words of names of cookies that carry authentication, of those against forgery, and patterns of writers.
SENSITIVE_COOKIE = "(?i)token|auth|session|jwt|sid|credential"
FORGERY = "(?i)csrf|xsrf|anti[_-]?forgery"
CLIENT = "\\bdocument\\.cookie\\s*=(?!=)"
SETTER = f"\\b(?:(?:res|response)\\s*\\.\\s*cookie|(?:{NAME}\\s*\\.\\s*)?setCookie|(?:ctx\\s*\\.\\s*)?cookies\\s*(?:\\(\\s*\\))?\\s*\\.\\s*set)\\s*\\("


def cookie_table(sources: DataFrame) -> DataFrame:
    """A row for each cookie that code writes: site_id, path, line, side (client, server), name, sensitive, and what
    it states: http_only, secure, same_site.

    A script cannot write an HttpOnly cookie. On a server, ``secure`` also counts where it depends on the production
    environment, by a comparison in the call or by a constant that an earlier line of the file declares.
    """
    # Masking takes no letters together, so what has no such letters before it has no cookie after it. What is read of a
    # file stays one expression below the filter: as a column, Spark would infer a filter from it for every file.
    own = _code(sources.where(F.contains("text", F.lit("ookie")))).where(F.col("text").rlike(f"document\\.cookie\\s*=|{SETTER}"))
    production = f"\\bconst\\s+({NAME})\\s*=\\s*{MODE}\\s*={{2,3}}\\s*[\"']production[\"']"

    def writes(lines: Column) -> Column:
        declared = F.transform(F.filter(lines, lambda x: x["raw"].rlike(production)), lambda x: F.struct(F.regexp_extract(x["raw"], production, 1).alias("name"), x["n"].alias("n")))
        writing = F.filter(lines, lambda x: x["raw"].rlike(f"{CLIENT}|{SETTER}"))
        return bound(declared, lambda d: F.transform(writing, lambda x: F.struct(x["raw"].alias("raw"), x["n"].alias("n"), d.alias("constants"))))

    each = own.select("site_id", "path", F.explode(bound(numbered(joined(without_development(F.col("text")), SETTER)), writes)).alias("x"))
    raw = F.col("x.raw")
    calls = F.when(raw.rlike(SETTER), F.regexp_extract_all(raw, F.lit(f"({SETTER}{nested()}\\))"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    own_side = F.when(raw.rlike(CLIENT), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))  # no call: a client's
    rows = each.select("site_id", "path", raw.alias("raw"), F.col("x.n").alias("line"), F.col("x.constants").alias("constants"), F.explode(F.concat(own_side, calls)).alias("call"))
    client = F.col("call").isNull()
    raw = F.col("raw")
    inside = F.regexp_replace("call", f"(?s)^{SETTER}\\s*", "")
    named = F.regexp_extract(inside, f"^(?:\"([^\"]+)\"|'([^']+)'|`([^`$]+)`|({NAME}))", 0)
    name = F.regexp_replace(named, "^[\"'`]|[\"'`]$", "")
    words = F.concat(name, F.lit(" "), F.substring("call", 1, 250))
    constant = F.regexp_extract("call", f"(?i)\\bsecure\\s*:\\s*({NAME})\\b", 1)
    known = lambda name: F.exists("constants", lambda d: (d["name"] == name) & (d["n"] <= F.col("line")))
    short = lambda option: F.col("call").rlike(f"(?i)[{{,]\\s*{option}\\s*(?=[,}}])")
    secure = F.col("call").rlike(f"(?i)\\bsecure\\s*:\\s*(?:true\\b|{MODE}\\s*={{2,3}}\\s*[\"']production[\"'])") | known(constant) | (short("secure") & known(F.lit("secure")))
    said = F.regexp_extract("call", "(?i)\\bsameSite\\s*:\\s*([^,}\\n]+)", 1)
    same = F.when(said != "", ~said.rlike("(?i)^\\s*(?:false|null|undefined)\\b")).otherwise(short("sameSite"))
    either = lambda a, b: F.when(client, a).otherwise(b)
    return rows.select(
        "site_id", "path", "line", either(F.lit("client"), F.lit("server")).alias("side"),
        either(F.regexp_extract(raw, "\\bdocument\\.cookie\\s*=\\s*[\"'`]?\\s*([^=\"'`;]*)", 1), name).alias("name"),
        either(F.regexp_extract(raw, "(?s)(\\bdocument\\.cookie\\s*=.*)", 1).rlike(SENSITIVE_COOKIE), words.rlike(f"{SENSITIVE_COOKIE}|csrf|xsrf")).alias("sensitive"),
        either(F.lit(False), F.col("call").rlike("(?i)\\bhttpOnly\\s*:\\s*true")).alias("http_only"),
        either(raw.rlike("(?i);\\s*secure\\b"), secure).alias("secure"), either(raw.rlike("(?i);\\s*samesite\\s*="), same).alias("same_site"),
    )


def cookie_findings(sources: DataFrame) -> DataFrame:
    """Cookies that code writes without flags: all that scripts write, and those of authentication on servers."""
    flags = F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(label)) for label, c in (("HttpOnly", F.col("http_only") | ((F.col("side") == "server") & F.col("name").rlike(FORGERY))), ("Secure", F.col("secure")), ("SameSite", F.col("same_site")))])
    rows = cookie_table(sources).withColumn("missing", F.filter(flags, lambda x: x.isNotNull())).where((F.col("side") == "client") | (F.col("sensitive") & (F.size("missing") > 0)))
    evidence = F.concat(F.col("side"), F.lit(" cookie without "), F.array_join("missing", ", "))
    return emit(rows.select("site_id", "path", F.lit("cookie-flags").alias("rule_id"), evidence.alias("evidence"), "line", "side", "sensitive"), severity=F.when((F.col("side") == "server") | F.col("sensitive"), "high").otherwise("low"))


# Content security policies

_HEADER = "(?:Content-Security-Policy|contentSecurityPolicy|content_security_policy)"
_DIRECTIVE = "(?:default-src|script-src|style-src|object-src|frame-ancestors)"
# Directives with the sources that weaken them, what is said of it and how severe it is.
WEAKNESSES = [
    ("'unsafe-eval'", "high", None, ["unsafe-eval"]),
    ("a wildcard, data:, or scheme-wide script-src source", "high", ["script-src"], ["*", "data:", "http:", "https:"]),
    ("a wildcard security boundary directive", "medium", ["default-src", "object-src", "frame-ancestors"], ["*"]),
    ("script-src 'unsafe-inline'", "high", ["script-src", "script-src-elem", "script-src-attr", "default-src"], ["unsafe-inline"]),
    ("style-src 'unsafe-inline'", "low", ["style-src", "style-src-elem", "style-src-attr"], ["unsafe-inline"]),
]


def policy_declarations(sources: DataFrame) -> DataFrame:
    """site_id, path, line and text of each content policy that a file states.

    A policy is a meta tag; a line or a quoted text that names the header and a directive; the value that is assigned
    to the header's name, in brackets or quotes; or the ``value`` of an object with that key.
    """
    own = sources.where("text is not null").where(F.col("text").rlike(f"(?i){_HEADER}"))
    own = own.select("site_id", "path", F.regexp_replace(F.regexp_replace(code_masked(F.col("text")), "(?m)^[ \\t]*#[^\\n]*", ""), "(?s)<!--.*?(?:-->|$)", "").alias("text"))
    value = f"(?:{STRING}|[\\[({{]{nested()}[\\])}}]|[^;,\\s][^;,\\n]*)"
    forms = [
        "<meta\\b[^>]*\\b(?i:content-security-policy)\\b[^>]*>",
        f"(?m:^[^\\n]*\\b(?i:{_HEADER})\\b[^\\n]*\\b(?i:{_DIRECTIVE})\\b[^\\n]*$)",
        f"\\b(?i:{_HEADER})\\b[\"'`]?\\s*[:=]\\s*{value}",
        f"\\b(?i:{_HEADER})\\b[\"'`]?\\s*,\\s*(?:value\\s*:\\s*)?{value}",
    ]
    pattern = "|".join(forms)
    gaps, raws = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    breaks = lambda x: F.length(x) - F.length(F.translate(x, "\n", ""))
    lines = running_sums(F.zip_with(gaps, F.concat(F.array(F.lit("")), raws), lambda g, r: (breaks(g) + breaks(r)).cast("bigint")), 1)
    each = own.select("site_id", "path", F.explode(F.arrays_zip(raws.alias("raw"), lines.alias("line"))).alias("x")).where("x.raw is not null")
    return each.select("site_id", "path", F.col("x.line").cast("int").alias("line"), F.col("x.raw").alias("policy"))


def directives(policy: Column) -> Column:
    """name and sources of each directive of a policy's text, in lower case; literals of a list are directives each."""
    text = F.regexp_replace(F.lower(policy), "[\"'`]\\s*,\\s*[\"'`]", ";")
    words = F.transform(F.split(F.translate(text, "\"'`[]{}<>,", " " * 10), ";"), lambda p: F.filter(F.split(p, "\\s+"), lambda w: w != ""))
    at = lambda w: F.array_position(F.transform(w, lambda x: x.rlike("^[a-z]+-(?:src(?:-elem|-attr)?|ancestors|uri|action)$")), True)
    known = F.filter(words, lambda w: at(w) > 0)
    return F.transform(known, lambda w: F.struct(F.element_at(w, at(w).cast("int")).alias("name"), F.slice(w, at(w).cast("int") + 1, F.size(w)).alias("sources")))


def policy_weaknesses(sources: DataFrame) -> DataFrame:
    """What content policies of a file permit: one finding for each weakness and policy text."""
    stated = policy_declarations(sources).withColumn("directives", directives(F.col("policy"))).withColumn("text", F.lower(F.trim(F.regexp_replace("policy", "\\s+", " "))))

    def holds(names: list[str] | None, values: list[str]) -> Column:
        if names is None:
            return F.col("text").rlike("|".join(values))
        return F.exists("directives", lambda d: d["name"].isin(names) & F.arrays_overlap(d["sources"], F.array(*map(F.lit, values))))

    fired = F.array(*[F.when(holds(names, values), F.struct(F.lit(token).alias("token"), F.lit(severity).alias("graded"))) for token, severity, names, values in WEAKNESSES])
    each = stated.select("site_id", "path", "line", "text", F.explode(F.filter(fired, lambda x: x.isNotNull())).alias("x"))
    first = each.groupBy("site_id", "path", "text", "x").agg(F.min("line").alias("line"))
    rows = first.select("site_id", "path", F.lit("security-headers").alias("rule_id"), F.concat(F.lit("policy permits "), F.col("x.token")).alias("evidence"), "line", F.col("x.graded").alias("graded"))
    return emit(rows, severity=F.col("graded"), confidence=F.lit("high"), manual=F.lit(False))


# Frames

def frame_findings(sources: DataFrame) -> DataFrame:
    """Frames whose sandbox gives way: scripts together with the own origin, no sandbox around foreign markup."""
    own = _code(sources).where(F.col("text").rlike("(?i)<iframe"))
    each = own.select("site_id", "path", F.explode(F.regexp_extract_all("text", F.lit("(?i)<iframe(?=[\\s/>])(?:[^>\"'{]++|\"[^\"]*+\"|'[^']*+'|\\{[^}]*+\\})*+>"), F.lit(0))).alias("tag"))
    sandbox = F.lower(F.regexp_extract("tag", "(?i)\\bsandbox\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)')", 0))
    both = sandbox.rlike("allow-scripts") & sandbox.rlike("allow-same-origin")
    bare = ~F.col("tag").rlike("(?i)\\bsandbox\\b")
    dynamic = F.col("tag").rlike("(?i)\\bsrcdoc\\s*=\\s*\\{|\\b(?::|v-bind:)srcdoc\\s*=")
    why = reduce(lambda a, b: F.coalesce(a, b), [F.when(both, F.lit("scripts and own origin in one sandbox")), F.when(bare & dynamic, F.lit("computed srcdoc without a sandbox"))])
    rows = each.withColumn("why", why).where("why is not null").select("site_id", "path", F.lit("embedded-content").alias("rule_id"), shown(F.col("tag")).alias("evidence"), F.lit(1).alias("line"))
    return emit(rows, severity=F.lit("medium"), manual=F.lit(True))


def code_findings(sources: DataFrame) -> DataFrame:
    """All rules of this module."""
    return cookie_findings(sources).unionByName(policy_weaknesses(sources)).unionByName(frame_findings(sources))

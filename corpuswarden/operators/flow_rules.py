"""Values that a request or the address bar controls and that reach a sink of the same file: candidates for review.

Input ``sources`` have site_id, path and text (null if it was not read). The lines of a file are folded in order,
with the names that carry a controlled value as the state; so the work stays within the row, without a join or a
shuffle. A statement is a line, once calls and assignments over several lines are joined. Guards that end the path
(an allowlist of origins, a fixed host, containment in a folder, a strict pattern of names) are read where the line
or the next one returns or throws; scopes and proofs over function bodies are not, so all findings are manual.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calls import first_argument, joined, numbered, shown
from ..functions.text import base_name, extension
from .findings import emit
from .source_rules import code_masked, role

# Names of what a request gives, of calls that reach out, and of what tells server code.
REQUESTS = ["req", "request", "ctx", "context", "event"]
REQUEST_PARTS = ["query", "body", "params", "headers", "url", "originalUrl"]
REQUEST_READERS = ["json", "formData"]
FORMS = ["searchParams", "formData"]
HELPERS = ["getQuery", "readBody", "getRouterParam"]
CLIENTS = ["fetch", "got", "request"]
CLIENT_MODULES = ["got", "request"]
AXIOS_METHODS = ["get", "post", "put", "patch", "delete", "request"]
HTTP_OBJECTS, HTTP_METHODS = ["http", "https"], ["get", "request"]
FILE_CALLS = ["readFile", "readFileSync", "writeFile", "writeFileSync", "createReadStream", "createWriteStream", "sendFile", "download", "unlink", "unlinkSync", "rm", "rmSync", "rename"]
RESPONSE_CALLS = ["sendFile", "download"]
FILE_VERBS = ["read", "write", "create", "unlink", "rm", "rename"]
SHELL_CALLS, SPAWN_CALLS = ["exec", "execSync"], ["spawn", "spawnSync"]
STATEMENT_CALLS, RAW_STATEMENTS = ["query", "execute", "raw"], ["$queryRawUnsafe", "$executeRawUnsafe"]
SQL_VERBS = ["SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "WITH", "DROP", "ALTER", "CREATE", "CALL"]
DATABASE_OBJECTS = ["db", "database", "pool", "sql", "client", "connection", "sequelize", "prisma", "knex"]
DATABASE_MODULES = ["pg", "mysql", "mysql2", "sequelize", "knex"]
SERVER_FRAMEWORKS = ["express", "fastify", "hapi", "koa", "next/server"]
SERVER_NAMES = ["NextRequest", "NextResponse", "FastifyRequest", "RequestHandler"]
NODE_MODULES = ["child_process", "fs", "fs/promises", "http", "https", "net", "tls"]
SERVER_FOLDERS = ["api", "backend", "controller", "controllers", "handler", "handlers", "middleware", "server"]
SERVER_STEMS = ["route", "server", "middleware"]
PLAIN_FOLDERS = ["route", "routes", "controller", "controllers", "handler", "handlers", "middleware", "server"]
TRANSPARENT_CALLS = ["URL", "String", "decodeURI", "decodeURIComponent", "path.join", "path.resolve", "path.normalize"]
TRANSPARENT_METHODS = ["trim", "replace", "toString"]
# Parts of the address that name a destination, how one is taken from them, and where it goes.
ADDRESS_PARTS, EXTRACTED_PARTS = ["search", "hash", "href"], ["search", "hash"]
DOCUMENT_PARTS = ["URL", "referrer"]
CUTS = ["slice", "substring", "replace"]
DECODERS = ["decodeURIComponent", "decodeURI"]
CHECKS, CHECKED = ["assert", "ensure", "sanitize", "validate"], ["Redirect", "Url", "Navigation"]

WORD = "\\b"
NAME = "[A-Za-z_$][\\w$]*"
ENDING = "\\.[cm]?[jt]sx?$"
OPENS = "\\s*\\("


def one_of(names: list[str]) -> str:
    """One of the names, as written."""
    return "(?:" + "|".join("".join(c if c.isalnum() or c in "_/" else f"\\{c}" for c in n) for n in names) + ")"


def member(objects: str, names: list[str]) -> str:
    return f"{objects}\\s*\\.\\s*{one_of(names)}"


def free(names: list[str], of: str = "") -> str:
    """Names that are no members, but perhaps of the object ``of``."""
    return f"(?<![\\w$.])(?:{of}\\s*\\.\\s*)?{one_of(names)}" if of else f"(?<![\\w$.]){one_of(names)}"


def from_module(names: list[str]) -> str:
    return f"from\\s*[\"']{one_of(names)}[\"']"


def imported(names: list[str]) -> str:
    """An import or require of a module, with or without the prefix of built-in ones."""
    module = f"[\"'](?:node:)?{one_of(names)}[\"']"
    return f"(?i)from\\s*{module}|require\\s*\\(\\s*{module}\\s*\\)"


def in_folder(names: list[str], after: str = "(?:/|$)") -> str:
    return f"(?:^|/){one_of(names)}{after}"


_REQUEST = f"\\b{one_of(REQUESTS)}"
REQUEST = "(?i)" + "|".join((
    member(_REQUEST, REQUEST_PARTS), f"{_REQUEST}\\s*\\[\\s*[\"']{one_of(REQUEST_PARTS)}[\"']\\s*\\]", member(_REQUEST, REQUEST_READERS) + OPENS,
    member(f"\\b{one_of(FORMS)}", ["get"]) + OPENS, f"\\b{one_of(HELPERS)}{OPENS}\\s*{one_of(REQUESTS)}\\b",
))
SERVER_PATH = f"(?i){in_folder(SERVER_FOLDERS)}|{in_folder(SERVER_STEMS, ENDING)}"
AMBIGUOUS_PATH = f"(?i){in_folder(['api'])}"
PLAIN_SERVER_PATH = f"(?i){in_folder(['pages/api'])}|(?:^|/)app/api/.+/route{ENDING}|{in_folder(PLAIN_FOLDERS, '(?:/|[.])')}"
SERVER_TYPES = f"(?i){from_module([*SERVER_FRAMEWORKS, *DATABASE_MODULES])}|\\b{one_of(SERVER_NAMES)}\\b"
TRANSPARENT = f"^(?:{one_of(TRANSPARENT_CALLS)}|{NAME}\\.{one_of(TRANSPARENT_METHODS)})$"
NETWORK = f"{free(CLIENTS, 'globalThis')}{OPENS}|{member(WORD + 'axios', AXIOS_METHODS)}{OPENS}|{member(WORD + one_of(HTTP_OBJECTS), HTTP_METHODS)}{OPENS}"
FILES = f"\\b{one_of(FILE_CALLS)}{OPENS}"
RESPONSES = f"\\b{one_of(RESPONSE_CALLS)}{OPENS}"
FILE_USE = f"{imported(['fs', 'fs/promises'])}|{member(WORD + 'fs', FILE_VERBS)}"
SHELL, SPAWN = (free(names, "child_process") + OPENS for names in (SHELL_CALLS, SPAWN_CALLS))
SHELL_USE = f"{imported(['child_process'])}|{member(WORD + 'child_process', ['exec'])}"
STATEMENT = f"(?:{member(WORD + NAME, STATEMENT_CALLS)}|{one_of(RAW_STATEMENTS)}){OPENS}"
SQL_WORDS = f"(?i)\\b{one_of(SQL_VERBS)}\\b"
DATABASES = f"(?i){member(WORD + one_of(DATABASE_OBJECTS), STATEMENT_CALLS)}"
DATABASE_USE = f"(?i){from_module([*DATABASE_MODULES, '@prisma/client'])}"
SAFE_PATH = f"\\bpath\\s*\\.\\s*basename{OPENS}|\\b(?i:sanitize|safe)(?i:File|Path|Name){OPENS}"
IN_SHELL = "\\bshell\\s*:\\s*(?:true|[\"'][^\"']+[\"'])\\s*[,}]"
#: A declared or assigned name with its value, and several names taken from one value.
ASSIGNED = f"(?<![\\w$.])({NAME})\\s*=(?![=>])\\s*([^;]+)"
DECLARES = "\\b(?:const|let|var)\\s+"
TAKEN_APART = "\\b(?:const|let|var)\\s*\\{([^}]+)\\}\\s*=\\s*([^;]+)"

_LOCATION = "\\b(?:window\\.)?location"
ADDRESS = f"(?i){_LOCATION}\\.{one_of(ADDRESS_PARTS)}\\b|\\bdocument\\.{one_of(DOCUMENT_PARTS)}\\b"
EXTRACTION = "(?i)" + "|".join((f"\\bnew\\s+URLSearchParams{OPENS}", f"\\.searchParams\\.get{OPENS}", f"\\b{one_of(DECODERS)}{OPENS}", f"{member(_LOCATION + '[.]' + one_of(EXTRACTED_PARTS), CUTS)}{OPENS}", "\\bdocument\\.referrer\\b"))
NAVIGATION = [f"{_LOCATION}(?:\\.href)?\\s*=(?!=)\\s*", f"{_LOCATION}\\.{one_of(['assign', 'replace'])}{OPENS}\\s*", f"\\bwindow\\.open{OPENS}\\s*"]
VALIDATION = f"(?i)allowed(?:Origins?|Redirects?|Urls?)?\\.includes|{one_of(CHECKS)}{one_of(CHECKED)}|\\.origin\\s*===?\\s*(?:window\\.)?location\\.origin|\\.startsWith{OPENS}\\s*[\"'`]/"
REACH = 6  # lines after the assignment
HEADERS = [
    ("Content-Security-Policy", "(?i)content-security-policy|contentSecurityPolicy"),
    ("X-Content-Type-Options", "(?i)x-content-type-options"),
    ("Referrer-Policy", "(?i)referrer-policy"),
    ("Permissions-Policy", "(?i)permissions-policy"),
    ("frame-ancestors or X-Frame-Options", "(?i)frame-ancestors|x-frame-options"),
]
BROWSER_TESTS = "(?i)playwright|cypress|webdriver|browserstack|saucelabs"
BROWSER_TEST_PATH = "(?i)(?:^|/)(?:e2e|browser-tests?)(?:/|$)|(?:playwright|cypress|webdriver|browserstack|saucelabs)(?:\\.config)?\\."

SCRIPTS = ("js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts", "vue", "svelte", "astro", "html", "htm")

def server_code(path: Column, text: Column) -> Column:
    """Whether a file runs on a server: by its imports, or by a path that says so beyond a mere ``api`` folder."""
    return text.rlike(imported(NODE_MODULES)) | text.rlike(SERVER_TYPES) | path.rlike(SERVER_PATH) & (path.rlike(PLAIN_SERVER_PATH) | ~path.rlike(AMBIGUOUS_PATH))


def _scripts(sources: DataFrame) -> DataFrame:
    return sources.where("text is not null").where(extension("path").isin(*SCRIPTS) & ~role("path").isin("docs", "generated", "test"))


def _without_strings(line: Column) -> Column:
    """Quoted text emptied; templates and names in brackets stay."""
    return F.regexp_replace(line, "(?<!\\[)\"(?:[^\"\\\\]|\\\\.)*+\"|(?<!\\[)'(?:[^'\\\\]|\\\\.)*+'", "''")


def _names(expression: Column) -> Column:
    return F.regexp_extract_all(expression, F.lit(f"(?<![\\w$.])({NAME})"), F.lit(1))


def _argument(line: Column, sink: str) -> Column:
    """The first argument of a call."""
    return F.regexp_extract(line, f"(?:{sink})({first_argument()})", 1)


def _guarded(*conditions: str) -> str:
    """A negative condition of an ``if``; its group is the name that it is about."""
    return f"\\bif\\s*\\(\\s*(?:{'|'.join(conditions)})"


# What names an allowlist, and the members of an address that are compared.
ALLOWLIST = "(?:allowed(?:Origins?|Hosts?|Urls?)?|[A-Z_$][A-Z0-9_$]*)"
HOST = "\\s*\\.\\s*(?:origin|hostname)"
ORIGIN_GUARD = _guarded(f"!\\s*{ALLOWLIST}\\s*\\.\\s*(?:has|includes)\\s*\\(\\s*({NAME}){HOST}\\s*\\)", f"({NAME}){HOST}\\s*!==?\\s*[\"'](?:https?://)?[A-Za-z0-9.:-]+[\"']")
FOLDER_GUARD = _guarded(f"!\\s*({NAME})\\s*\\.\\s*startsWith\\s*\\([^)]*(?:\\bsep\\b|[\"'](?:\\\\\\\\|/)[\"'])", f"!\\s*/\\^(?![^/]*(?:\\.[*+]|\\[\\^))[^/]+\\$/[diuv]*\\s*\\.\\s*test\\s*\\(\\s*({NAME})\\s*\\)")
ENDS = "^[\\s)]*\\{?\\s*(?:return|throw)\\b"


def _guard(line: Column, after: Column, pattern: str) -> Column:
    """The name that a guard on this line keeps from what follows; null without one that ends the path."""
    name = F.coalesce(F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(line, pattern, 2), F.lit("")))
    rest = F.regexp_replace(line, f"(?s)^.*?(?:{pattern})", "")
    ends = rest.rlike(ENDS) | rest.rlike("^[\\s)]*\\{?\\s*$") & after.rlike("^\\s*\\{?\\s*(?:return|throw)\\b")
    return F.when(line.rlike(pattern) & ends, name)


CARRIER = "array<struct<name:string,safe:boolean,allowed:boolean>>"
CALLS = "|".join((NETWORK, FILES, SHELL, SPAWN, STATEMENT))
FIRED = "array<struct<rule_id:string,evidence:string,line:int>>"


def request_flows(sources: DataFrame) -> DataFrame:
    """Request-controlled values in network, file, shell and SQL calls of server files.

    A name carries a value from the line that assigns it, through transparent calls only, until it is declared anew;
    a guard keeps it from the sinks of its kind from then on.
    Texts that are null, empty or without a request source give nothing; repeated rows give their findings each.
    """
    own = _scripts(sources).where(F.col("text").rlike(REQUEST) & F.col("text").rlike(CALLS) & server_code(F.col("path"), F.col("text")))
    has = lambda pattern: F.col("text").rlike(pattern)
    own = own.select(
        "site_id", "path", numbered(joined(code_masked(F.col("text")), CALLS)).alias("lines"), has(FILE_USE).alias("files"), has(SHELL_USE).alias("shell"),
        has(imported(CLIENT_MODULES)).alias("client"), has(DATABASE_USE).alias("database"),
    )
    blank = F.struct(F.lit("").alias("raw"), F.lit(0).alias("n"))
    rows = F.zip_with("lines", F.concat(F.slice("lines", F.lit(2), F.size("lines")), F.array(blank)), lambda x, y: F.struct(x["raw"].alias("raw"), _without_strings(x["raw"]).alias("code"), x["n"].alias("n"), F.coalesce(y["raw"], F.lit("")).alias("after")))

    def step(state: Column, x: Column) -> Column:
        code, raw = x["code"], x["raw"]
        address, name_of = _guard(raw, x["after"], ORIGIN_GUARD), _guard(raw, x["after"], FOLDER_GUARD)
        marked = lambda v: F.struct(v["name"].alias("name"), (v["safe"] | F.coalesce(v["name"] == name_of, F.lit(False))).alias("safe"), (v["allowed"] | F.coalesce(v["name"] == address, F.lit(False))).alias("allowed"))
        carried = F.transform(state["carried"], marked)
        open_names = F.transform(F.filter(carried, lambda v: ~v["allowed"]), lambda v: v["name"])
        every, unsafe = F.transform(carried, lambda v: v["name"]), F.transform(F.filter(carried, lambda v: ~v["safe"]), lambda v: v["name"])
        reached = lambda e, names=every: e.rlike(REQUEST) | F.arrays_overlap(_names(e), names)
        url, file, command, statement = (_argument(code, s) for s in (NETWORK, FILES, SHELL, STATEMENT))
        fixed = F.regexp_replace(F.trim(_argument(raw, NETWORK)), "^new\\s+URL\\s*\\(\\s*", "").rlike("^[\"'`]https?://[A-Za-z0-9.-]+(?::\\d+)?/")
        named = ~code.rlike(free(CLIENT_MODULES) + OPENS) | F.col("client")
        response = code.rlike(RESPONSES)
        spawned = F.regexp_extract(code, f"(?s)(?:{SPAWN})(.*)", 1)
        likely = _argument(raw, STATEMENT).rlike(SQL_WORDS) | code.rlike(DATABASES) | F.col("database")
        fired = F.array(
            F.when(code.rlike(NETWORK) & named & ~fixed & reached(url, open_names), F.lit("server-ssrf")),
            F.when(code.rlike(FILES) & (response | F.col("files")) & ~(response & code.rlike("\\broot\\s*:")) & ~file.rlike(SAFE_PATH) & reached(file, unsafe), F.lit("server-path-traversal")),
            F.when(F.col("shell") & (code.rlike(SHELL) & reached(command) | raw.rlike(f"(?s)(?:{SPAWN}).*{IN_SHELL}") & reached(spawned)), F.lit("server-command-injection")),
            F.when(code.rlike(STATEMENT) & likely & ~statement.rlike("^\\s*\\{") & reached(statement), F.lit("server-sql-injection")),
        )
        found = F.transform(F.filter(fired, lambda r: r.isNotNull()), lambda r: F.struct(r.alias("rule_id"), shown(raw).alias("evidence"), x["n"].alias("line")))
        name, value = F.regexp_extract(code, ASSIGNED, 1), F.regexp_extract(code, ASSIGNED, 2)
        parts = F.transform(F.split(F.regexp_extract(code, TAKEN_APART, 1), ","), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "=.*$", ""), "^[^:]*:", "")))
        calls = F.regexp_extract_all(value, F.lit(f"({NAME}(?:\\s*\\.\\s*{NAME})*)\\s*\\("), F.lit(1))
        carries = value.rlike(REQUEST) | F.arrays_overlap(_names(value), every) & F.forall(calls, lambda c: F.regexp_replace(c, "\\s", "").rlike(TRANSPARENT))
        safe = value.rlike(SAFE_PATH) | ~value.rlike(REQUEST) & ~F.arrays_overlap(_names(value), unsafe)
        allowed = ~value.rlike(REQUEST) & ~F.arrays_overlap(_names(value), open_names)
        new = F.when(code.rlike(TAKEN_APART), F.when(F.regexp_extract(code, TAKEN_APART, 2).rlike(REQUEST), F.transform(parts, lambda p: F.struct(p.alias("name"), F.lit(False).alias("safe"), F.lit(False).alias("allowed"))))).when(
            (name != "") & carries, F.array(F.struct(name.alias("name"), safe.alias("safe"), allowed.alias("allowed")))
        )
        declared = F.when(code.rlike(TAKEN_APART), parts).when(code.rlike(f"{DECLARES}{NAME}\\s*="), F.array(name)).otherwise(F.transform(F.coalesce(new, F.array().cast(CARRIER)), lambda v: v["name"]))
        left = F.filter(carried, lambda v: ~F.array_contains(declared, v["name"]))
        return F.struct(F.concat(left, F.coalesce(new, F.array().cast(CARRIER))).cast(CARRIER).alias("carried"), F.concat(state["found"], found).cast(FIRED).alias("found"))

    start = F.struct(F.array().cast(CARRIER).alias("carried"), F.array().cast(FIRED).alias("found"))
    fired = own.select("site_id", "path", F.explode(F.aggregate(rows, start, step)["found"]).alias("x")).select("site_id", "path", "x.*")
    return emit(fired, confidence=F.when(F.col("rule_id").isin("server-ssrf", "server-path-traversal"), "medium"), manual=F.lit(True))


def navigation_flows(sources: DataFrame) -> DataFrame:
    """Destinations taken from the address: on the line of the sink, or through a variable within the next six lines
    unless it is validated or assigned anew before."""
    own = _scripts(sources).where(F.col("text").rlike(ADDRESS) & F.col("text").rlike("|".join(NAVIGATION))).select("site_id", "path", F.split(code_masked(F.col("text")), "\r?\n").alias("lines"))
    taken = lambda x: x.rlike(ADDRESS) & x.rlike(EXTRACTION)
    declared = f"{DECLARES}({NAME})\\s*=\\s*([^;]+)"
    line = F.element_at("lines", F.col("at"))
    direct = line.rlike("(?i)" + "|".join(NAVIGATION)) & taken(line) & ~line.rlike(VALIDATION)
    name = F.regexp_extract(line, declared, 1)
    word = lambda before, after="": F.concat(F.lit(f"(?i){before}\\Q"), name, F.lit(f"\\E(?![\\w$]){after}"))
    checked = lambda y: y.rlike(VALIDATION) | F.rlike(y, word("allowed(?:Origins?|Redirects?|Urls?)?\\s*\\.\\s*includes\\s*\\(\\s*")) | F.rlike(y, word("\\.test\\s*\\(\\s*", "\\s*\\)"))
    goes = lambda y: reduce(lambda a, b: a | b, [F.rlike(y, word(n)) for n in NAVIGATION])
    marks = F.transform(F.slice("lines", F.col("at") + 1, REACH), lambda y: F.when(checked(y) | F.rlike(y, word("(?:^|[^\\w$])", "\\s*=(?!=)")), 1).when(goes(y), 2).otherwise(0))
    first = F.try_element_at(F.filter(marks, lambda m: m > 0), F.lit(1))
    later = F.when((name != "") & taken(F.regexp_extract(line, declared, 2)) & ~checked(line) & (first == 2), F.col("at") + F.array_position(marks, 2).cast("int"))
    rows = own.select("site_id", "path", "lines", F.explode(F.filter(F.sequence(F.lit(1), F.size("lines")), lambda k: taken(F.element_at("lines", k)))).alias("at"))
    places = rows.select("site_id", "path", "lines", F.explode(F.array_distinct(F.array(F.when(direct, F.col("at")), later))).alias("line")).where("line is not null")
    return emit(places.select("site_id", "path", F.lit("untrusted-navigation").alias("rule_id"), F.trim(F.element_at("lines", F.col("line"))).alias("evidence"), "line"))


def missing_headers(sites: DataFrame, sources: DataFrame) -> DataFrame:
    """Security headers that no configuration of a site names; the content policy may also stand in its markup."""
    markup = extension("path").isin("html", "htm", "astro", "vue", "svelte")
    text = F.when(markup, F.regexp_replace("text", "(?s)<!--.*?-->", "")).otherwise(F.regexp_replace(code_masked(F.col("text")), "(?m)^\\s*#.*$", ""))
    seen = [F.bool_or(((role("path") == "headers") | (markup if k == 0 else F.lit(False))) & text.rlike(pattern)).alias(f"h{k}") for k, (_, pattern) in enumerate(HEADERS)]
    met = sites.select("site_id").distinct().join(sources.where("text is not null").groupBy("site_id").agg(*seen), "site_id", "left")
    absent = F.filter(F.array(*[F.when(~F.coalesce(f"h{k}", F.lit(False)), F.lit(label)) for k, (label, _) in enumerate(HEADERS)]), lambda x: x.isNotNull())
    rows = met.select("site_id", F.lit("").alias("path"), F.lit("security-headers").alias("rule_id"), F.concat(F.lit("not configured: "), F.array_join(absent, ", ")).alias("evidence"), F.lit(1).alias("line"), F.size(absent).alias("n"), F.coalesce("h0", F.lit(False)).alias("policy")).where("n > 0")
    return emit(rows, severity=F.when(F.col("policy"), "low").otherwise("medium"), confidence=F.lit("medium"), manual=F.lit(True))


def browser_findings(sources: DataFrame) -> DataFrame:
    """Sites whose manifests state no supported browsers, and sites without any test in a browser."""
    manifest = (base_name("path") == "package.json") & F.col("text").isNotNull()
    groups = [F.get_json_object("text", f"$.{g}") for g in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")]
    named = F.exists(F.flatten(F.array(*[F.coalesce(F.json_object_keys(g), F.array().cast("array<string>")) for g in groups])), lambda n: n.rlike(BROWSER_TESTS))
    policy = manifest & F.get_json_object("text", "$.browserslist").isNotNull() | (base_name("path") == ".browserslistrc") | F.col("path").rlike("(?i)(^|/)browserslist(?:\\.config)?\\.")
    site = sources.groupBy("site_id").agg(F.bool_or(manifest).alias("manifest"), F.bool_or(F.coalesce(policy, F.lit(False))).alias("policy"), F.bool_or((manifest & named) | F.col("path").rlike(BROWSER_TEST_PATH)).alias("tests"))
    fired = F.array(F.when(F.col("manifest") & ~F.col("policy"), F.lit("compat-no-browser-policy")), F.when(~F.coalesce("tests", F.lit(False)), F.lit("compat-no-browser-tests")))
    return emit(site.select("site_id", F.lit("package.json").alias("path"), F.explode(F.filter(fired, lambda x: x.isNotNull())).alias("rule_id"), F.lit("").alias("evidence"), F.lit(1).alias("line")))

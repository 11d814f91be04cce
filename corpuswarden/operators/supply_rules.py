"""Rules over manifests, lockfiles, workflows, containers, infrastructure and ignore files.

Input ``sources``: site_id, path, text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import advisory_severity, base_name, directory, insecure_url, url_part
from .findings import emit
from .source_rules import ENV_PATH, placeholder

GROUPS = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
LOCKS = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "bun.lock")


def _row(df: DataFrame, rule: str, value: Column | str, line: Column | None = None) -> DataFrame:
    return df.select("site_id", "path", F.lit(rule).alias("rule_id"), (F.col(value) if isinstance(value, str) else value).alias("evidence"), (F.lit(1) if line is None else line).alias("line"))


def manifests(sources: DataFrame) -> DataFrame:
    return sources.where((base_name("path") == "package.json") & F.col("text").isNotNull())


def dependencies(sources: DataFrame) -> DataFrame:
    """site_id, path, group, name, version of every manifest."""
    own = manifests(sources)
    groups = F.array(*[F.struct(F.lit(g).alias("group"), F.from_json(F.get_json_object("text", f"$.{g}"), "map<string,string>").alias("m")) for g in GROUPS])
    return own.select("site_id", "path", F.explode(groups).alias("g")).where("g.m is not null").select("site_id", "path", F.col("g.group").alias("group"), F.explode("g.m").alias("name", "version"))


def scripts(sources: DataFrame) -> DataFrame:
    return manifests(sources).select("site_id", "path", F.explode(F.from_json(F.get_json_object("text", "$.scripts"), "map<string,string>")).alias("name", "command"))


def lock_packages(sources: DataFrame) -> DataFrame:
    """Packages of npm lockfiles of both layouts: name, resolved, integrity. Nested dependencies of any depth, a level
    in each round."""
    own = sources.where(base_name("path").isin("package-lock.json", "npm-shrinkwrap.json") & F.col("text").isNotNull())
    one = "struct<version:string,resolved:string,integrity:string,link:boolean,bundled:boolean>"
    flat = own.select("site_id", "path", F.explode(F.from_json(F.get_json_object("text", "$.packages"), f"map<string,{one}>")).alias("name", "p")).where("name != ''")
    out = [flat]
    level = own.select("site_id", "path", F.get_json_object("text", "$.dependencies").alias("json")).where(F.get_json_object("text", "$.packages").isNull())
    while level.take(1):
        each = level.select("site_id", "path", F.explode(F.from_json("json", "map<string,string>")).alias("name", "body"))
        out.append(each.select("site_id", "path", "name", F.from_json("body", one).alias("p")))
        level = each.select("site_id", "path", F.get_json_object("body", "$.dependencies").alias("json")).where("json is not null")
    return reduce(DataFrame.unionByName, out).select("site_id", "path", "name", "p.*")


def manifest_findings(sources: DataFrame) -> DataFrame:
    own = manifests(sources)
    broken = own.where(F.try_parse_json("text").isNull() | ~F.trim("text").startswith("{"))
    deps, v = dependencies(sources), F.trim("version")
    git = v.rlike("(?i)^(git[+:@]|github:|gitlab:|bitbucket:|[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(#.*)?$)|\\.git(#.*)?$") & ~v.rlike("#[0-9a-f]{40}([0-9a-f]{24})?$")
    http = F.lower(v).startswith("http://")
    loose = deps.where(v.isin("*", "latest", "") | git | http)
    text = F.concat_ws("@", "name", "version")
    remote = "(?i)\\b(curl|wget)\\b[^|;&]*\\|\\s*(sudo\\s+)?(ba|z)?sh\\b"
    hooks = F.col("name").isin("preinstall", "install", "postinstall", "prepare")
    risky = scripts(sources).where(F.col("command").rlike(f"{remote}|--unsafe-perm|strict-ssl\\s+false|--no-verify-ssl|--ignore-scripts=false"))
    command = F.concat_ws(": ", "name", "command")
    locks = sources.where(base_name("path").isin(*LOCKS)).select("site_id", directory("path").alias("dir")).distinct()
    needs = deps.select("site_id", "path").distinct().withColumn("dir", directory("path"))
    root = locks.where("dir = ''").select("site_id").distinct()
    missing = needs.join(locks, ["site_id", "dir"], "left_anti").join(root, "site_id", "left_anti")
    several = sources.where(base_name("path").isin(*LOCKS)).groupBy("site_id", directory("path").alias("dir")).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1")
    return reduce(
        DataFrame.unionByName,
        [
            emit(_row(broken, "dependency-hygiene", F.lit("not a JSON object")), severity=F.lit("high")), emit(_row(broken, "project-invalid-package-json", F.lit("not a JSON object"))),
            emit(_row(loose.where(~http), "dependency-hygiene", text)), emit(_row(loose.where(http), "dependency-hygiene", text), severity=F.lit("high")),
            emit(_row(risky.where(hooks), "package-scripts", command), severity=F.lit("critical")), emit(_row(risky.where(~hooks), "package-scripts", command)),
            emit(_row(missing, "lockfile", F.lit("no lockfile"))), emit(_row(several, "lockfile", F.concat("n", F.lit(" lockfiles"))), severity=F.lit("low")),
        ],
    )


def lockfile_findings(sources: DataFrame) -> DataFrame:
    own = sources.where(base_name("path").isin(*LOCKS) & F.col("text").isNotNull())
    urls = own.select("site_id", "path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?i)https?://[^\\s\"',)]+"), F.lit(0)))).alias("url"))
    bare = lock_packages(sources).where(F.col("resolved").rlike("(?i)^https?://registry\\.(npmjs\\.org|yarnpkg\\.com)/") & F.col("integrity").isNull())
    tokens = sources.where("text is not null").select("site_id", "path", F.explode(F.regexp_extract_all("text", F.lit("_authToken\\s*=\\s*([^\\s\"']+)"), F.lit(1))).alias("value")).where(~placeholder(F.col("value")) & ~F.col("value").startswith("$"))
    return reduce(
        DataFrame.unionByName,
        [
            emit(_row(urls.where(insecure_url("url")), "lockfile-integrity", "url"), severity=F.lit("high")), emit(_row(urls.where(F.col("url").rlike("^https?://[^/?#]*@")), "hardcoded-auth", F.lit("credentials in a lockfile URL"))),
            emit(_row(bare, "lockfile-integrity", F.concat_ws(" ", "name", "resolved"))), emit(_row(tokens, "embedded-secrets", F.lit("_authToken=[REDACTED]"))),
        ],
    )


def public_registry(sources: DataFrame) -> DataFrame:
    """Whether every URL of a lockfile is at a public registry."""
    own = sources.where(base_name("path").isin(*LOCKS) & F.col("text").isNotNull())
    urls = own.select("site_id", "path", F.explode_outer(F.regexp_extract_all("text", F.lit("(?i)https?://[^\\s\"',)]+"), F.lit(0))).alias("url"))
    return urls.groupBy("site_id", "path").agg(F.bool_and(F.col("url").isNull() | F.coalesce(F.lower(url_part("url", "HOST")).isin("registry.npmjs.org", "registry.yarnpkg.com"), F.lit(False))).alias("public"))


def advisory_findings(sources: DataFrame, advisories: DataFrame) -> DataFrame:
    """advisories: name, severity, range. One finding for each dependency and advisory."""
    table = advisories.select("name", advisory_severity("severity").alias("own"), F.coalesce("range", F.lit("")).alias("range")).dropDuplicates(["name", "own", "range"])
    met = dependencies(sources).join(table, "name")
    rows = met.select("site_id", "path", F.lit("dependency-advisory").alias("rule_id"), F.concat(F.concat_ws("@", "name", "version"), F.lit(" in "), "range").alias("evidence"), F.lit(1).alias("line"), "own")
    return emit(rows, severity=F.col("own"))


def advisory_summary(advisories: DataFrame) -> DataFrame:
    """Numbers of advisories by severity."""
    return advisories.groupBy(advisory_severity("severity").alias("severity")).agg(F.count("*").alias("advisories"))


def workflow_lines(sources: DataFrame) -> DataFrame:
    """Lines of workflows with their job and whether they belong to a run block."""
    own = sources.where(F.col("path").rlike("(^|/)\\.github/workflows/[^/]+\\.ya?ml$") & F.col("text").isNotNull())
    each = own.select("site_id", "path", F.posexplode(F.split("text", "\n")).alias("at", "x")).withColumn("indent", F.length(F.regexp_extract("x", "^( *)", 1)))
    order = Window.partitionBy("site_id", "path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    jobs = F.last(F.when((F.col("indent") == 0) & F.col("x").rlike("^\\S"), F.regexp_extract("x", "^([A-Za-z_-]+):", 1)), True).over(order)
    job = F.last(F.when((F.col("indent") == 2) & F.col("x").rlike("^  [A-Za-z_][A-Za-z0-9_-]*:"), F.regexp_extract("x", "^  ([A-Za-z0-9_-]+):", 1)), True).over(order)
    run = F.last(F.when(F.col("x").rlike("^\\s*(- )?run\\s*:"), F.col("indent")).when(F.col("x").rlike("^\\s*(- )?[A-Za-z_-]+\\s*:"), F.lit(-1)), True).over(order)
    return each.withColumn("section", jobs).withColumn("job", F.when(F.col("section") == "jobs", job)).withColumn("in_run", F.coalesce((run >= 0) & (F.col("x").rlike("^\\s*(- )?run\\s*:") | (F.col("indent") > run)), F.lit(False)))


def workflow_findings(sources: DataFrame) -> DataFrame:
    lines = workflow_lines(sources)
    files = sources.select("site_id", "path", F.col("text").rlike("(?m)^\\s*(pull_request_target|workflow_run)\\s*:|on:\\s*\\[?[^\\n]*pull_request_target").alias("privileged"))
    tainted = lines.where(F.col("in_run") & F.col("x").rlike("\\$\\{\\{\\s*(github\\.event\\.(issue|pull_request|comment|review|head_commit|discussion)[^}]*|github\\.head_ref)")).join(files, ["site_id", "path"])
    uses = lines.select("site_id", "path", "at", F.regexp_extract("x", "^\\s*(?:- )?uses\\s*:\\s*[\"']?([A-Za-z0-9_.-]+/[^@\\s\"']+@[^\\s\"'#]+)", 1).alias("ref")).where("ref != ''").where(~F.col("ref").rlike("@[0-9a-f]{40}$"))
    refs = uses.groupBy("site_id", "path", "ref").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    per_job = lines.where("job is not null").groupBy("site_id", "path", "job").agg(F.bool_or(F.col("x").rlike("uses\\s*:\\s*[\"']?actions/checkout@")).alias("checkout"), F.bool_or(F.col("x").rlike("github\\.event\\.pull_request\\.head|github\\.head_ref")).alias("head"), F.bool_or(F.col("x").rlike("^\\s*(- )?run\\s*:")).alias("run"), F.min("at").alias("at"))
    fork = per_job.where("checkout and head and run").join(files.where(F.col("privileged")), ["site_id", "path"])
    at = (F.col("at") + 1).cast("int")
    return reduce(
        DataFrame.unionByName,
        [
            emit(_row(tainted.where("privileged"), "ci-workflow", F.trim("x"), at), severity=F.lit("critical")), emit(_row(tainted.where("not privileged"), "ci-workflow", F.trim("x"), at)),
            emit(_row(refs, "ci-workflow", F.concat("ref", F.lit(" x"), "n"), at), severity=F.lit("low"), manual=F.lit(True)),
            emit(_row(lines.where(F.col("x").rlike("^\\s*permissions\\s*:\\s*write-all")), "ci-workflow", F.trim("x"), at), manual=F.lit(True)),
            emit(_row(fork, "ci-workflow", F.concat(F.lit("job "), "job"), at), severity=F.lit("critical"), manual=F.lit(True)),
        ],
    )


def container_findings(sources: DataFrame) -> DataFrame:
    docker = sources.where(base_name("path").rlike("(?i)^(Dockerfile|Containerfile)(\\..+)?$|\\.dockerfile$") & F.col("text").isNotNull()).withColumn("text", F.regexp_replace("text", "\\\\\\s*\\n", " "))
    each = docker.select("site_id", "path", F.posexplode(F.split("text", "\n")).alias("at", "x"))
    last_from = F.max(F.when(F.col("x").rlike("(?i)^\\s*FROM\\s"), F.col("at"))).over(Window.partitionBy("site_id", "path"))
    stage = each.withColumn("last_from", last_from).where(F.col("at") > F.col("last_from"))
    user = stage.where(F.col("x").rlike("(?i)^\\s*USER\\s")).groupBy("site_id", "path").agg(F.max_by("x", "at").alias("x"), F.max("at").alias("at")).where(F.col("x").rlike("(?i)^\\s*USER\\s+(root|0)(:|\\s|$)"))
    yaml = sources.where(F.col("path").rlike("(?i)\\.ya?ml$") & F.col("text").isNotNull() & ~F.col("path").rlike("\\.github/workflows/")).select("site_id", "path", F.posexplode(F.split("text", "\n")).alias("at", "x"))
    host = yaml.where(F.col("x").rlike("(?i)^\\s*(- )?(privileged\\s*:\\s*true|allowPrivilegeEscalation\\s*:\\s*true|host(Network|PID|IPC)\\s*:\\s*true|runAsUser\\s*:\\s*0\\b)|/var/run/docker\\.sock"))
    infra = sources.where(F.col("path").rlike("\\.tf$") & F.col("text").isNotNull()).select("site_id", "path", F.posexplode(F.split("text", "\n")).alias("at", "x"))
    at = (F.col("at") + 1).cast("int")
    return reduce(
        DataFrame.unionByName,
        [
            emit(_row(each.where(F.col("x").rlike("(?i)^\\s*RUN\\b.*\\b(curl|wget)\\b[^|;&]*\\|\\s*(sudo\\s+)?(ba|z)?sh\\b")), "container-hardening", "x", at), severity=F.lit("critical")),
            emit(_row(each.where(F.col("x").rlike("(?i)^\\s*ADD\\s+https?://") & ~F.col("x").rlike("--checksum")), "container-hardening", "x", at), severity=F.lit("medium"), manual=F.lit(True)),
            emit(_row(user, "container-hardening", "x", at), manual=F.lit(True)), emit(_row(host, "container-hardening", F.trim("x"), at), manual=F.lit(True)),
            emit(_row(infra.where(F.col("x").rlike("(?i)\\bacl\\s*=\\s*\"public-read")), "iac-exposure", F.trim("x"), at)),
            emit(_row(infra.where(F.col("x").rlike("(?i)\\bblock_public_(acls|policy)\\s*=\\s*false")), "iac-exposure", F.trim("x"), at), severity=F.lit("medium")),
            emit(_row(infra.where(F.col("x").rlike("(?i)\\bpublicly_accessible\\s*=\\s*true")), "iac-exposure", F.trim("x"), at), manual=F.lit(True)),
        ],
    )


def ignore_rules(sources: DataFrame) -> DataFrame:
    """site_id, dir, depth, line, negated and regex of each line of ignore files."""
    own = sources.where((base_name("path") == ".gitignore") & F.col("text").isNotNull())
    each = own.select("site_id", directory("path").alias("dir"), F.posexplode(F.split("text", "\n")).alias("at", "x")).withColumn("x", F.trim("x")).where("x != '' and not startswith(x, '#')")
    from ..functions.text import glob_regex

    bare = F.regexp_replace(F.regexp_replace("x", "^!", ""), "/+$", "")
    anchored = F.contains(F.regexp_replace(bare, "^/", "#"), F.lit("/")) | bare.startswith("/")
    glob = F.when(anchored, F.regexp_replace(bare, "^/", "")).otherwise(F.concat(F.lit("**/"), bare))
    return each.select("site_id", "dir", F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/"))).alias("depth"), "at", F.col("x").startswith("!").alias("negated"), glob_regex(glob).alias("regex"))


def environment_findings(sources: DataFrame) -> DataFrame:
    """Environment files with other than public settings that the nearest ignore rules do not cover."""
    env = sources.where(F.col("path").rlike(ENV_PATH) & ~base_name("path").rlike("(?i)example|sample|template") & F.col("text").isNotNull())
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("^\\s*(export\\s+)?[A-Za-z_][A-Za-z0-9_]*\\s*="))
    public = F.forall(lines, lambda x: x.rlike("^\\s*(export\\s+)?((NEXT_PUBLIC|VITE|REACT_APP|PUBLIC)_\\w+|NODE_ENV|PORT|HOST|DEBUG|LOG_LEVEL)\\s*=|=\\s*[\"']?(true|false|\\d{1,5}|development|production|test|/[\\w./-]*|https?://[^@\\s]*)?[\"']?\\s*$"))
    own = env.where(~public)
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    placed = own.select("site_id", "path", F.explode(ancestors).alias("dir"))
    rel = F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)"))
    hit = placed.join(ignore_rules(sources), ["site_id", "dir"]).where(F.rlike(rel, F.col("regex")))
    verdict = hit.groupBy("site_id", "path").agg(F.max_by("negated", F.struct("depth", "at")).alias("negated"))
    kept = own.join(verdict.where("not negated"), ["site_id", "path"], "left_anti")
    return emit(_row(kept, "environment-hygiene", F.lit("environment file is not ignored")))


def nearest_manifest(files: DataFrame, sources: DataFrame) -> DataFrame:
    """site_id, path and the manifest in the deepest folder above each file, by equality on exploded ancestors."""
    parts = F.split("path", "/")
    each = files.select("site_id", "path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("dir"))
    found = manifests(sources).select("site_id", directory("path").alias("dir"), F.col("path").alias("manifest"))
    return each.join(found, ["site_id", "dir"]).groupBy("site_id", "path").agg(F.max_by("manifest", F.length("dir")).alias("manifest"))

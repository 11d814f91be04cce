"""Standards and references of rules, and checks of those that findings carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Standards with their titles, and which of them each rule of security stands for.
CWE = {
    22: "Improper Limitation of a Pathname to a Restricted Directory",
    78: "Improper Neutralization of Special Elements used in an OS Command",
    79: "Improper Neutralization of Input During Web Page Generation",
    89: "Improper Neutralization of Special Elements used in an SQL Command",
    95: "Improper Neutralization of Directives in Dynamically Evaluated Code",
    200: "Exposure of Sensitive Information to an Unauthorized Actor",
    250: "Execution with Unnecessary Privileges",
    284: "Improper Access Control",
    295: "Improper Certificate Validation",
    319: "Cleartext Transmission of Sensitive Information",
    327: "Use of a Broken or Risky Cryptographic Algorithm",
    338: "Use of Cryptographically Weak Pseudo-Random Number Generator",
    346: "Origin Validation Error",
    347: "Improper Verification of Cryptographic Signature",
    353: "Missing Support for Integrity Check",
    494: "Download of Code Without Integrity Check",
    532: "Insertion of Sensitive Information into Log File",
    540: "Inclusion of Sensitive Information in Source Code",
    601: "URL Redirection to Untrusted Site",
    614: "Sensitive Cookie in HTTPS Session Without Secure Attribute",
    693: "Protection Mechanism Failure",
    732: "Incorrect Permission Assignment for Critical Resource",
    798: "Use of Hard-coded Credentials",
    829: "Inclusion of Functionality from Untrusted Control Sphere",
    918: "Server-Side Request Forgery",
    922: "Insecure Storage of Sensitive Information",
    942: "Permissive Cross-domain Policy with Untrusted Domains",
    1004: "Sensitive Cookie Without HttpOnly Flag",
    1021: "Improper Restriction of Rendered UI Layers or Frames",
    1022: "Use of Web Link to Untrusted Target with window.opener Access",
    1104: "Use of Unmaintained Third Party Components",
    1275: "Sensitive Cookie with Improper SameSite Attribute",
}
OWASP = {
    "A01": "Broken Access Control",
    "A02": "Security Misconfiguration",
    "A03": "Software Supply Chain Failures",
    "A04": "Cryptographic Failures",
    "A05": "Injection",
    "A07": "Authentication Failures",
    "A08": "Software or Data Integrity Failures",
    "A09": "Security Logging and Alerting Failures",
}
OF_RULES = {
    "embedded-secrets": [798, "A02", "A07"],
    "public-env-secrets": [200, "A01"],
    "environment-hygiene": [540, "A01", "A02"],
    "dom-xss": [79, "A05"],
    "dynamic-code": [95, "A05"],
    "server-command-injection": [78, "A05"],
    "server-sql-injection": [89, "A05"],
    "server-path-traversal": [22, "A01"],
    "server-ssrf": [918, "A01"],
    "insecure-transport": [319, 295, "A04"],
    "browser-storage": [922, "A01", "A07"],
    "weak-cryptography": [327, 338, "A04"],
    "cross-window-messaging": [346, "A07"],
    "external-navigation": [1022, "A01"],
    "untrusted-navigation": [601, "A01"],
    "embedded-content": [1021, "A02"],
    "cors": [942, "A02"],
    "hardcoded-auth": [798, "A02", "A07"],
    "cookie-flags": [1004, 614, 1275, "A01", "A02"],
    "jwt-validation": [347, "A04", "A07"],
    "dependency-hygiene": [829, "A03"],
    "dependency-advisories": [1104, "A03"],
    "dependency-advisory": [1104, "A03"],
    "dependency-audit-unavailable": ["A03"],
    "package-scripts": [494, "A03", "A08"],
    "lockfile": ["A03"],
    "lockfile-integrity": [353, "A03", "A08"],
    "ci-workflow": [78, 829, "A03", "A05"],
    "container-hardening": [250, 494, "A02", "A03"],
    "iac-exposure": [284, 732, "A01", "A02"],
    "security-headers": [693, "A02"],
    "source-maps": [540, "A01", "A02"],
    "sensitive-logging": [532, "A09"],
    "third-party-resources": [353, "A03", "A08"],
}

STANDARD = "struct<id:string,title:string,url:string>"
MOST = 20  # references or standards of a finding
MOST_CHARS = 2048


def standard(key: int | str) -> tuple[str, str, str]:
    """id, title and address of a standard."""
    if isinstance(key, int):
        return f"CWE-{key}", CWE[key], f"https://cwe.mitre.org/data/definitions/{key}.html"
    return f"OWASP-{key}:2025", OWASP[key], f"https://owasp.org/Top10/2025/{key}_2025-{OWASP[key].replace(' ', '_')}/"


def table(spark) -> DataFrame:
    """rule_id, standards, references of each rule that has any; its size is fixed, so it may be broadcast."""
    rows = [(rule, [standard(k) for k in keys]) for rule, keys in OF_RULES.items()]
    own = spark.createDataFrame(rows, f"rule_id string, standards array<{STANDARD}>")
    return own.withColumn("references", F.transform("standards", lambda s: s["url"]))


def with_standards(findings: DataFrame) -> DataFrame:
    """Findings with the standards and references of their rules; without any, empty lists."""
    met = findings.join(F.broadcast(table(findings.sparkSession)), "rule_id", "left")
    return met.withColumns({"standards": F.coalesce("standards", F.array().cast(f"array<{STANDARD}>")), "references": F.coalesce("references", F.array().cast("array<string>"))}).select(*findings.columns, "standards", "references")


def reference_fault(url: Column) -> Column:
    """What is wrong with a reference; null if it may stand."""
    size = F.coalesce(F.length(url), F.lit(0))
    return (
        F.when((size == 0) | (size > MOST_CHARS), "length")
        .when(~url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | F.try_parse_url(url, F.lit("HOST")).isNull(), "invalid")
        .when(~url.rlike("(?i)^https://"), "not https")
        .when(url.rlike("(?i)^https://[^/?#]*@"), "credentials")
    )


def standard_fault(s: Column) -> Column:
    """What is wrong with a standard (id, title, url); null if it may stand."""
    return (
        F.when(~F.coalesce(s["id"].rlike("^[A-Za-z0-9][A-Za-z0-9 .:_/()+-]{0,119}$"), F.lit(False)), "id")
        .when(s["title"].isNotNull() & ~F.length(s["title"]).between(1, 240), "title")
        .when(s["url"].isNotNull(), F.concat(F.lit("url: "), reference_fault(s["url"])))
    )


def validated(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings (with standards and references) that keep the constraints, their lists without repetition, and the
    rest with ``problems``: too many entries, and each entry with its fault."""
    listed = lambda c: F.coalesce(F.col(c), F.array().cast(findings.schema[c].dataType))
    faults = lambda c, check: F.filter(F.transform(listed(c), lambda x: F.concat(F.lit(f"{c}: "), check(x))), lambda x: x.isNotNull())
    many = lambda c: F.when(F.size(listed(c)) > MOST, F.array(F.lit(f"{c}: more than {MOST}"))).otherwise(F.array().cast("array<string>"))
    problems = F.concat(many("references"), many("standards"), faults("references", reference_fault), faults("standards", standard_fault))
    marked = findings.withColumn("problems", problems)
    # The last standard of an id counts, at the place of the first.
    ids = F.array_distinct(F.transform("standards", lambda s: s["id"]))
    last = F.transform(ids, lambda i: F.element_at(F.filter("standards", lambda s: s["id"] == i), -1))
    good = marked.where(F.size("problems") == 0).drop("problems").withColumns({"references": F.array_distinct("references"), "standards": last})
    return good, marked.where(F.size("problems") > 0)

"""The finding table and the relational work on it.

Rows: site_id, mode, rule_id, family, category, severity, confidence, manual, path, line, evidence. All
ordering is binary and explicit, so nothing depends on how rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import artifact_uri, evidence, nfkc, normalized_path, sarif_level
from .catalogue import POINTS, RULES, SCHEMA, SEVERITIES, WEIGHTS

COLUMNS = ["site_id", "mode", "rule_id", "family", "category", "severity", "confidence", "manual", "path", "line", "evidence"]
CAP = 50


def rules(spark: SparkSession) -> DataFrame:
    """The catalogue; its size is fixed, so it may be broadcast."""
    return spark.createDataFrame(RULES, SCHEMA)


def emit(rows: DataFrame, severity: Column | None = None, confidence: Column | None = None, manual: Column | None = None) -> DataFrame:
    """Findings from site_id, path, rule_id, evidence, line. Evidence is redacted and cut.

    An override applies where it is not null.
    """
    met = rows.join(F.broadcast(rules(rows.sparkSession)), "rule_id")
    pick = lambda own, column: F.coalesce(own, F.col(column)) if own is not None else F.col(column)
    return met.select(
        "site_id", "mode", "rule_id", "family", "category", pick(severity, "severity").alias("severity"), pick(confidence, "confidence").alias("confidence"), pick(manual, "manual").alias("manual"),
        "path", F.col("line").cast("int").alias("line"), F.coalesce(evidence("evidence"), F.lit("")).alias("evidence"),
    )


def rank(column: Column | str, order: tuple[str, ...]) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    out = F.when(F.lit(False), 0)
    for k, value in enumerate(order):
        out = out.when(c == value, k)
    return out.otherwise(len(order))


def severity_rank() -> Column:
    return rank("severity", SEVERITIES)


def confidence_rank() -> Column:
    return rank("confidence", ("high", "medium", "unknown", "low"))


def valid(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the constraints of a finding, and the rest with what is wrong."""
    problems = F.filter(
        F.array(
            F.when(F.coalesce(F.trim("rule_id"), F.lit("")) == "", "rule_id"),
            F.when(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), "severity"),
            F.when(F.col("confidence").isNotNull() & ~F.col("confidence").isin(*WEIGHTS), "confidence"),
            F.when(F.col("line").isNotNull() & (F.col("line") < 1), "line"),
            F.when(F.coalesce(F.trim("path"), F.lit("")) == "", "path"),
        ),
        lambda x: x.isNotNull(),
    )
    marked = findings.withColumn("problems", problems)
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)


def deduplicated(findings: DataFrame) -> DataFrame:
    """One row for each rule, place and evidence: the most severe and surest."""
    key = Window.partitionBy("site_id", "mode", "rule_id", "path", "line", "evidence").orderBy(severity_rank(), confidence_rank(), "manual")
    return findings.withColumn("_n", F.row_number().over(key)).where("_n = 1").drop("_n")


def fingerprinted(findings: DataFrame) -> DataFrame:
    """A stable identity: a hash of mode, rule, path and evidence; further lines with the same get their number."""
    text = F.trim(F.regexp_replace(nfkc("evidence"), "\\s+", " "))
    base = F.sha2(F.to_json(F.array("mode", "rule_id", normalized_path("path"), text)), 256)
    nth = F.dense_rank().over(Window.partitionBy("site_id", "mode", "_base").orderBy("path", "line"))
    out = findings.withColumn("_base", base).withColumn("occurrence", nth)
    return out.withColumn("fingerprint", F.when(F.col("occurrence") == 1, F.col("_base")).otherwise(F.sha2(F.concat_ws(":", "_base", F.col("occurrence").cast("string")), 256))).drop("_base")


def capped(findings: DataFrame, cap: int = CAP) -> DataFrame:
    """The first rows of each rule of a site by severity, confidence and place, and their rank."""
    order = Window.partitionBy("site_id", "rule_id").orderBy(severity_rank(), confidence_rank(), "manual", "path", "line", "evidence")
    return findings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def cap_counts(findings: DataFrame, cap: int = CAP) -> DataFrame:
    """For each rule of a site how many rows there are, and how many the cap keeps and leaves out."""
    counts = findings.groupBy("site_id", "mode", "rule_id").agg(F.count("*").alias("observed"))
    return counts.select("*", F.least("observed", F.lit(cap).cast("long")).alias("retained"), F.greatest(F.col("observed") - cap, F.lit(0).cast("long")).alias("left_out"))


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(), "category", "path", "line", "rule_id", "evidence")


def points() -> Column:
    """Severity by confidence, half if manual, to two decimals (half up)."""
    p = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in POINTS.items()], F.lit(0)).cast("decimal(6,2)")
    w = F.coalesce(*[F.when(F.col("confidence") == k, F.lit(v)) for k, v in WEIGHTS.items()], F.lit(1.0)).cast("decimal(4,2)")
    return F.round(p * w * F.when(F.col("manual"), F.lit(0.5)).otherwise(F.lit(1.0)).cast("decimal(2,1)"), 2).cast("decimal(10,2)")


def _families(findings: DataFrame) -> DataFrame:
    """The strongest row of each family of a site; a max, so it combines before the shuffle."""
    best = F.max(F.struct("points", (-severity_rank()).alias("s"), "rule_id"))
    return findings.withColumn("points", points()).groupBy("site_id", "mode", "family").agg(best.alias("x"), F.count("*").alias("signals")).select("site_id", "mode", "family", "x.points", "x.rule_id", "signals")


def contributions(findings: DataFrame) -> DataFrame:
    """What families add to a site's risk: those with points, by their strongest row."""
    return _families(findings).where("points > 0")


def band(risk: Column) -> Column:
    return F.when(risk == 0, "none").when(risk < 20, "low").when(risk < 40, "guarded").when(risk < 60, "elevated").when(risk < 80, "high").otherwise("severe")


def scores(findings: DataFrame) -> DataFrame:
    """Risk, score and band of each site and mode; repeats within a family do not add."""
    total = _families(findings).groupBy("site_id", "mode").agg(F.sum("points").cast("decimal(18,2)").alias("raw"), F.count("*").alias("families"), F.count_if(F.col("points") > 0).alias("scored_families"), F.sum("signals").alias("signals"))
    raw = F.col("raw").cast("double")
    risk = F.least(F.lit(99), F.floor(100 * raw / (raw + 60))).cast("int")
    return total.select("site_id", "mode", "raw", "families", "scored_families", (F.col("signals") - F.col("families")).alias("repeated_signals"), risk.alias("risk"), (100 - risk).alias("score"), band(risk).alias("band"))


def summary(findings: DataFrame) -> DataFrame:
    """Counts by severity, and of automated and manual rows, of each site and mode."""
    return findings.groupBy("site_id", "mode").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count_if(~F.col("manual")).alias("automated"), F.count_if("manual").alias("manual"))


def ledger(findings: DataFrame, mode: str, cap: int = CAP) -> DataFrame:
    """For every rule of a mode: sites and rows with it, rows kept under the cap, and its outcome."""
    counts = cap_counts(findings, cap).groupBy("rule_id").agg(F.count("*").alias("sites"), F.sum("observed").alias("observed"), F.sum("retained").alias("retained"))
    own = rules(findings.sparkSession).where(F.col("mode") == mode)
    zero = F.lit(0).cast("long")
    out = own.join(counts, "rule_id", "left").select("rule_id", "category", "severity", F.when(F.col("manual"), "manual").otherwise("automated").alias("kind"), *[F.coalesce(c, zero).alias(c) for c in ("sites", "observed", "retained")])
    return out.withColumn("outcome", F.when(F.col("observed") == 0, "clear").when(F.col("kind") == "manual", "review").otherwise("findings"))


def applicability(ledger: DataFrame) -> DataFrame:
    """Numbers of rules of a ledger by kind and outcome."""
    return ledger.groupBy("kind", "outcome").agg(F.count("*").alias("rules"), F.sum("observed").alias("observed"))


def by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("site_id", "category").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def phase() -> Column:
    """When to act on a finding."""
    return F.when(F.col("manual"), "validate").when(F.col("severity").isin("critical", "high"), "now").when(F.col("severity") == "medium", "next").otherwise("later")


def action_plan(findings: DataFrame) -> DataFrame:
    """Rules by phase for each site with their counts and first place."""
    return findings.withColumn("phase", phase()).groupBy("site_id", "phase", "rule_id").agg(F.count("*").alias("findings"), F.min(F.struct("path", "line")).alias("x")).select("site_id", "phase", "rule_id", "findings", F.col("x.path").alias("path"), F.col("x.line").alias("line"))


def overview(findings: DataFrame) -> DataFrame:
    """Score and totals of both modes side by side."""
    table = scores(findings).join(summary(findings).select("site_id", "mode", "total"), ["site_id", "mode"])
    return table.groupBy("site_id").pivot("mode", ["site", "security"]).agg(F.first("score").alias("score"), F.first("total").alias("total"))


def sarif_rows(findings: DataFrame) -> DataFrame:
    """One nested result row for each fingerprinted finding."""
    location = F.struct(F.coalesce(artifact_uri("path"), F.lit("")).alias("uri"), F.coalesce("line", F.lit(1)).alias("startLine"))
    return findings.select("site_id", "mode", F.col("rule_id").alias("ruleId"), sarif_level("severity").alias("level"), F.struct(F.col("evidence").alias("text")).alias("message"), location.alias("location"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"))


#: Parts of a document in their order.
HEAD, OF_RULES, BETWEEN, OF_RESULTS, END = range(5)


def documents(findings: DataFrame, tool: str = "corpuswarden", version: str = "1.0.0") -> DataFrame:
    """site_id, mode, part, key, value: the pieces of one run document (SARIF 2.1.0) for each site and mode.

    Pieces in the order of part and key make the document; ``sources.tables.write_documents`` writes them so. No row
    holds more than a rule or a finding. Findings are fingerprinted; baseline_state, suppression and reason are used
    where they are there. Of rules only those with findings are listed, and results refer to them by index.
    """
    findings = findings.persist()  # read for rules, for the first row of a site, and for results
    have = findings.columns
    place = ["site_id", "mode"]
    listed = findings.select(*place, "rule_id").distinct()  # bounded by the catalogue for each site
    index = listed.withColumn("index", F.row_number().over(Window.partitionBy(*place).orderBy("rule_id")) - 1)
    own = index.join(F.broadcast(rules(findings.sparkSession).drop("mode")), "rule_id")
    comma = lambda first, json: F.concat(F.when(first, F.lit("")).otherwise(F.lit(",")), json)
    name = F.regexp_replace(F.regexp_replace("rule_id", "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    rule = F.to_json(F.struct(F.col("rule_id").alias("id"), name.alias("name"), F.struct(F.col("rule_id").alias("text")).alias("shortDescription"), F.struct(sarif_level("severity").alias("level")).alias("defaultConfiguration"), F.struct("category", F.array("category").alias("tags"), F.col("confidence").alias("precision")).alias("properties")))
    of_rules = own.select(*place, F.lit(OF_RULES).alias("part"), F.col("rule_id").alias("key"), comma(F.col("index") == 0, rule).alias("value"))

    order = F.concat_ws("\x01", "fingerprint", "path", F.lpad(F.col("line").cast("string"), 10, "0"), F.hex(F.xxhash64("evidence")))
    keyed = findings.withColumn("key", order)
    first = keyed.groupBy(*place).agg(F.min("key").alias("first"), F.count("*").alias("results"))
    uri = artifact_uri("path")
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine")))
    where = F.when(uri.isNotNull(), F.array(F.struct(F.struct(F.struct(uri.alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))))
    accepted = F.when(F.col("suppression").isNotNull(), F.array(F.struct(F.lit("external").alias("kind"), F.lit("accepted").alias("status"), F.col("reason").alias("justification")))) if "suppression" in have else F.lit(None).cast("array<string>")
    state = F.col("baseline_state") if "baseline_state" in have else F.lit(None).cast("string")
    result = F.to_json(F.struct(
        F.col("rule_id").alias("ruleId"), F.col("index").alias("ruleIndex"), sarif_level("severity").alias("level"), F.struct(F.col("evidence").alias("text")).alias("message"), where.alias("locations"),
        F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"), state.alias("baselineState"), accepted.alias("suppressions"), F.struct("severity", "confidence", "category", F.col("manual").alias("manualReview")).alias("properties"),
    ))
    of_results = keyed.join(index, [*place, "rule_id"]).join(first, place).select(*place, F.lit(OF_RESULTS).alias("part"), "key", comma(F.col("key") == F.col("first"), result).alias("value"))
    text = lambda part, *x: first.select(*place, F.lit(part).alias("part"), F.lit("").alias("key"), F.concat(*x).alias("value"))
    start = F.lit(f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}","semanticVersion":"{version}","rules":[')
    middle = [F.lit(f']}}}},"automationDetails":{{"id":"{tool}/'), F.col("mode"), F.lit('/"},"originalUriBaseIds":{"%SRCROOT%":{"uri":"./"}},"results":[')]
    end = [F.lit('],"properties":{"results":'), F.col("results").cast("string"), F.lit("}}]}")]
    return text(HEAD, start).unionByName(of_rules).unionByName(text(BETWEEN, *middle)).unionByName(of_results).unionByName(text(END, *end))


def completeness(checks: DataFrame) -> DataFrame:
    """From checks (site_id, check, status, requested): whether each site's run is complete, and what is not.

    A requested check counts as done if it is completed, skipped or disabled; one without a status was not asked for.
    """
    left = F.coalesce(F.col("requested"), F.lit(True)) & F.col("status").isNotNull() & (F.col("status") != "") & ~F.col("status").isin("completed", "skipped", "disabled")
    open_checks = F.array_sort(F.collect_set(F.when(left, F.concat_ws(": ", "check", "status"))))
    return checks.groupBy("site_id").agg((~F.bool_or(F.coalesce(left, F.lit(False)))).alias("complete"), open_checks.alias("incomplete"))


def json_rows(findings: DataFrame) -> DataFrame:
    """One JSON text for each finding, keys in order."""
    return findings.select("site_id", F.to_json(F.struct(*sorted(c for c in findings.columns if c != "site_id"))).alias("json"))


def run_ids(findings: DataFrame) -> DataFrame:
    """A hash over the ordered fingerprints of a site.

    A site's fingerprints meet in one row; their number is bounded by what one site has.
    """
    return findings.groupBy("site_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("fingerprint")), ","), 256).alias("run_id"))


def precision_recall(expected: DataFrame, observed: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn, precision and recall of labelled cases (case, rule_id, expected, and ``by``) by group."""
    counts = observed.groupBy("case", "rule_id").agg(F.count("*").alias("actual"))
    met = expected.join(counts, ["case", "rule_id"], "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast("long")))
    sums = met.groupBy(*by).agg(
        F.sum(F.least("expected", "actual")).alias("tp"), F.sum(F.greatest(F.col("actual") - F.col("expected"), F.lit(0))).alias("fp"),
        F.sum(F.greatest(F.col("expected") - F.col("actual"), F.lit(0))).alias("fn"), F.count_if((F.col("expected") == 0) & (F.col("actual") == 0)).alias("tn"),
    )
    return sums.select("*", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"))

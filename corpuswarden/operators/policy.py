"""Comparison with an earlier baseline, suppressions by pattern, and gates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_regex, normalized_path
from .catalogue import SEVERITIES
from .findings import rank, severity_rank

ENTRY = ["site_id", "mode", "fingerprint", "rule_id", "severity", "path"]


def baseline_of(findings: DataFrame) -> DataFrame:
    """Baseline entries of fingerprinted findings, one for each fingerprint."""
    best = F.min(F.struct(severity_rank().alias("r"), "severity", "rule_id", "path"))
    return findings.groupBy("site_id", "mode", "fingerprint").agg(best.alias("x")).select("site_id", "mode", "fingerprint", "x.rule_id", "x.severity", "x.path")


def ordered(entries: DataFrame) -> DataFrame:
    """Baseline entries in the order in which they are written."""
    return entries.orderBy("site_id", "mode", "fingerprint")


def compared(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings with baseline_state (new, unchanged) and escalated (more severe than before)."""
    old = baseline.select("site_id", "mode", "fingerprint", F.col("severity").alias("_old"))
    met = findings.join(old, ["site_id", "mode", "fingerprint"], "left")
    worse = F.col("_old").isNotNull() & (severity_rank() < rank("_old", SEVERITIES))
    return met.withColumn("baseline_state", F.when(F.col("_old").isNull(), "new").otherwise("unchanged")).withColumn("escalated", worse).drop("_old")


def fixed(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline entries that are no longer observed."""
    return baseline.join(findings.select("site_id", "mode", "fingerprint"), ["site_id", "mode", "fingerprint"], "left_anti")


def merged(previous: DataFrame, current: DataFrame, modes: DataFrame) -> DataFrame:
    """The next baseline: scanned modes (site_id, mode) are replaced, others stay."""
    return previous.join(modes, ["site_id", "mode"], "left_anti").select(*ENTRY).unionByName(current.select(*ENTRY))


def suppressed(findings: DataFrame, suppressions: DataFrame, as_of: dt.date) -> DataFrame:
    """Findings with the first suppression (ord, rule, path, reason, expires) that covers them.

    Suppressions are a setting, few by configuration: they go to every row as one array of patterns, in their order,
    so that findings are neither computed again nor joined back.
    """
    live = suppressions.where(F.col("expires").isNull() | (F.col("expires") >= F.lit(as_of)))
    pattern = F.when(F.col("path").isNotNull(), glob_regex("path"))
    one = live.agg(F.array_sort(F.collect_list(F.struct("ord", glob_regex("rule").alias("rule"), pattern.alias("place"), "reason"))).alias("_all"))
    met = findings.crossJoin(F.broadcast(one))  # a single row
    covers = lambda s: F.rlike(F.col("rule_id"), s["rule"]) & (s["place"].isNull() | F.rlike(normalized_path("path"), s["place"]))
    first = F.try_element_at(F.filter("_all", covers), F.lit(1))
    return met.withColumn("_first", first).withColumns({"suppression": F.col("_first.ord"), "reason": F.col("_first.reason")}).drop("_first", "_all")


def counters(policy: DataFrame) -> DataFrame:
    """Counts of each site and mode after ``compared`` and ``suppressed``."""
    off = F.col("suppression").isNotNull()
    return policy.groupBy("site_id", "mode").agg(
        F.count("*").alias("total"), F.count_if(F.col("baseline_state") == "new").alias("new"), F.count_if(F.col("baseline_state") == "unchanged").alias("unchanged"),
        F.count_if("escalated").alias("escalated"), F.count_if(off).alias("suppressed"), F.count_if(~off).alias("active"),
    )


def gate(policy: DataFrame, at_least: str, new_only: bool = False, regressions_only: bool = False) -> DataFrame:
    """Sites with the number of active findings at or above a severity, and whether they fail."""
    counted: Column = (severity_rank() <= SEVERITIES.index(at_least)) & F.col("suppression").isNull()
    if new_only:
        counted = counted & (F.col("baseline_state") == "new")
    if regressions_only:
        counted = counted & ((F.col("baseline_state") == "new") | F.col("escalated"))
    return policy.groupBy("site_id", "mode").agg(F.count_if(counted).alias("over"), F.bool_or(counted).alias("failed"))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")

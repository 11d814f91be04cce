"""Quality rules by document and by host, in DataFrame expressions only.

Each document has its own counts and a base verdict. Failures are counted by host (``source``); with few
pages a host's rate says little, so rates are shrunk towards all hosts' rate by a beta prior whose strength
is fitted to the spread between hosts (moments). A host whose shrunk rate is above ``most`` fails, and its
verdict is joined back to its documents.

Defined results: a null or empty text has no words and fails the base rules; a null host is a host of its
own; equal rows count each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words in repeated windows
MOST_FAILING = 0.5  # shrunk share of failing pages that a host may have

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source and the counts of each row.

    A word is in a repeated window if the hashes of three words in a row stand in the text twice. The windows
    are sorted with their places once, so equal ones are neighbours; no group of rows is shuffled for it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.length(without(text, SPACE)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: without(line, SPACE) != "").alias("lines"),
        F.transform(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("words"),
    )
    n = F.size("words")
    windows = words.select(
        "doc_id",
        "source",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice("words", 1, F.greatest(n - 2, F.lit(1))), lambda w, i: F.xxhash64(w, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2)))).alias("windows"),
    )
    marked = windows.select(*[c for c in windows.columns if c != "windows"], F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))).alias("placed"))
    placed = F.col("placed")
    again = F.filter(placed, lambda x, i: (F.get(placed, i + 1)["w"] == x["w"]) | ((i > 0) & (F.get(placed, F.greatest(i - 1, F.lit(0)))["w"] == x["w"])))
    repeated = F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return marked.select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(placed.isNull(), F.lit(0)).otherwise(repeated).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def hosts(verdicts: DataFrame, most: float = MOST_FAILING) -> DataFrame:
    """source, pages, failed, shrunk rate and verdict of each host, from rows with ``source`` and ``base_failed``."""
    table = kept(verdicts.groupBy("source").agg(F.count("*").alias("pages"), F.count_if("base_failed").alias("failed")), "hosts")
    p = F.sum("failed") / F.sum("pages")
    sums = table.agg(F.sum("pages").alias("n"), F.count("*").alias("h"), p.alias("p"), F.sum(F.col("failed") * F.col("failed") / F.col("pages")).alias("q")).first()  # one row
    mean, strength = 0.5, 2.0
    if sums["n"]:
        mean = min(max(sums["p"], 1e-6), 1 - 1e-6)
        # Between-host variance: the spread of rates weighted by pages, less what chance alone gives.
        spread = max(sums["q"] / sums["n"] - sums["p"] ** 2, 0.0) - mean * (1 - mean) * sums["h"] / sums["n"]
        strength = min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, 1.0), 1e6)
    rate = (F.col("failed") + mean * strength) / (F.col("pages") + strength)
    return table.select("source", "pages", "failed", rate.alias("rate"), (rate > most).alias("host_failed"))


def judged(docs: DataFrame, most: float = MOST_FAILING) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each row."""
    rows = kept(counted(docs).withColumn("base_failed", base_failed()), "counts")
    bad = hosts(rows, most).select(F.col("source").alias("host"), "host_failed")
    met = rows.join(bad, F.col("source").eqNullSafe(F.col("host")), "left")
    return met.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept"))

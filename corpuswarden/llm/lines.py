"""Boilerplate lines by their frequency on a site, in DataFrame expressions only.

A line's frequency is the share of the host's pages that hold it. A line is compared without the white space
around it, by a 64-bit hash and its length; blank lines are never counted nor dropped. Since a page holds a line once at most in this count, a
host has no more boilerplate lines than its mean number of lines a page divided by the ratio, whatever its
size; they travel as one array a host.

Where ``copies`` are one page, pages of a host with the same text count once, in a line's pages and in the
host's: a text with many copies is then no boilerplate of itself. Given which texts are ``alike``, the same holds
for near copies.

Defined results: a null text stays null; a null host is a host of its own; equal rows count as pages each
unless copies are one page; lines of equal frequency are alike; texts of any length are read whole; an empty table
gives an empty result; all columns of the input stay as they are, whatever their names, but ``text``, ``n_chars``
where it is there, and ``lines_dropped``, which is written anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, kept

RATIO = 0.02  # of the host's pages
LEAST_PAGES = 5  # pages that hold a line before it can be boilerplate


def key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\x0c\r"))


def page_key(hash: Column, size: Column) -> Column:
    """The same for pages with equal texts, from the text's hash and length."""
    return F.xxhash64(hash, size)


def boilerplate(docs: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES, copies: bool = False, alike: DataFrame | None = None) -> DataFrame:
    """source, line key, pages with it, pages of the host.

    ``alike``: hash, size and root of texts that are one page with all others of their root, for ``copies``.
    """
    page = page_key(F.xxhash64("text"), F.length("text"))
    lines = F.array_distinct(F.filter(F.transform(F.split(F.col("text"), "\n"), key), lambda x: x != ""))
    each = docs.select("source", page.alias("page"), lines.alias("lines")).select("source", "page", F.explode("lines").alias("line"))  # the page's key is taken once
    each = each.select("source", F.xxhash64("line").alias("hash"), F.length("line").alias("size"), "page")
    number = F.count_distinct("page") if copies else F.count("*")
    all_pages = docs.select("source", page.alias("page"))
    names = ["source", "hash", "size"]
    if alike is not None:
        one = alike.select(page_key(F.col("hash"), F.col("size")).alias("page"), F.xxhash64("root").alias("of"))
        merged = lambda df: df.join(one, "page", "left").withColumn("page", F.coalesce("of", "page"))
        # No line is on more pages for their being one: only what is frequent without it is looked at again.
        often = each.groupBy(*names).agg(number.alias("pages")).where(F.col("pages") >= least).toDF("o_source", "o_hash", "o_size", "pages")
        same = F.col("source").eqNullSafe(F.col("o_source")) & (F.col("hash") == F.col("o_hash")) & (F.col("size") == F.col("o_size"))
        each, all_pages = merged(each.join(often, same, "left_semi")), merged(all_pages)
    pages = all_pages.groupBy("source").agg(number.alias("host_pages"))
    seen = each.groupBy(*names).agg(number.alias("pages")).where(F.col("pages") >= least)
    host = pages.select(F.col("source").alias("host"), "host_pages")
    return seen.join(host, F.col("source").eqNullSafe(F.col("host"))).where(F.col("pages") > ratio * F.col("host_pages")).select("source", "hash", "size", "pages", "host_pages")


def cleaned(docs: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES, copies: bool = False, alike: DataFrame | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with the text less its boilerplate lines, and lines_dropped."""
    own = docs.select(F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    found = boilerplate(own, ratio, least, copies, alike)
    host, lines_of, dropped = fresh(docs.columns, "host", "host_lines", "dropped")
    bad = kept(found.groupBy("source").agg(F.collect_set(F.struct("hash", "size")).alias("lines")), "boilerplate").toDF(host, lines_of)
    met = docs.join(bad, F.col("source").cast("string").eqNullSafe(F.col(host)), "left")
    whole = F.col("text").cast("string")
    lines = F.split(whole, "\n")

    def mark(line: Column) -> Column:
        return F.struct(F.xxhash64(key(line)).alias("hash"), F.length(key(line)).alias("size"))

    # The text's own boilerplate, by sets; each of its lines is then looked up among these few.
    met = met.withColumn(dropped, F.array_intersect(F.transform(F.filter(lines, lambda x: key(x) != ""), mark), F.col(lines_of)))
    touched = F.size(F.col(dropped)) > 0
    rest = F.filter(lines, lambda x: (key(x) == "") | ~F.array_contains(F.col(dropped), mark(x)))
    text = F.when(touched, F.array_join(rest, "\n")).otherwise(whole)
    count = F.when(touched, F.size(lines) - F.size(rest)).otherwise(F.lit(0)).cast("long")
    columns = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": text, "lines_dropped": count}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(touched, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return met.select(*[x.alias(c) for c, x in columns.items()])

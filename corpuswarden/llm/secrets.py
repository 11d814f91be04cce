"""Secret scans, in DataFrame expressions only: fixed patterns, and character Markov models for the rest.

Two first-order character models are counted from labelled samples, one of random strings and one of ordinary
identifiers. A candidate is a long run of identifier characters. What the spans of the patterns leave of it is
a secret if random strings explain it better: the mean log-likelihood ratio of its transitions is above
``least_mean``, and their sum above ``least_sum``. A run that the patterns cut has parts: each is scored alone.
Those too short to be candidates also belong to the secret if the whole run passes and together they, with
``REST`` characters or more, have the mean. All characters outside letters, digits and ``+/_=-`` are one symbol,
which never occurs inside a candidate.

A span is kind:start:end in code points, counted from 0, end exclusive.

Defined results: null or empty text has no spans; a null doc_id is an id like others; texts of any length are
scanned whole; equal rows, which have one key, are matched once and give equal results; without samples of either
kind the models find nothing; an empty table gives an empty result; further columns are ignored by ``scanned`` and
kept by ``redacted``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import forget, fresh, kept

# The patterns of the base kinds.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "random")

LEAST = 20
REST = 8  # least characters that short parts of a cut run have together
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_MEAN, LEAST_SUM = 0.5, 15.0
#: Weight of a symbol's own frequency in its transitions.
SMOOTH = 20.0
#: Most documents from which ordinary identifiers are learned: those with the least hashes of their ids.
ORDINARY_DOCUMENTS = 2000
#: Most random strings that are learned, with the least hashes.
RANDOM_STRINGS = 20_000


def matches(docs: DataFrame, patterns: dict[str, tuple[str, int, int]]) -> DataFrame:
    """row, kind, start, end, value of each match whose value has the least length; ``docs`` has row and text.

    patterns: kind -> (pattern, group of the value, least length). A match begins after all gaps and matches
    before it; only rows with matches go through the window that adds them up.
    """
    text = F.col("text")
    found = []
    for kind, (pattern, group, least) in patterns.items():
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        zipped = F.arrays_zip(whole.alias("match"), value.alias("value"), F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("gap"))
        found.append(F.struct(F.lit(kind).alias("kind"), F.lit(least).alias("least"), F.when(F.regexp_like(text, F.lit(pattern)), zipped).alias("found")))
    each = docs.select("row", F.explode(F.array(*found)).alias("x")).where("x.found is not null")
    # Equal rows have one key: their matches are added up once.
    each = each.select("row", "x.kind", "x.least", "x.found").dropDuplicates(["row", "kind"])
    each = each.select("row", "kind", "least", F.posexplode("found").alias("at", "y")).where("y.match is not null")
    order = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("y.match")
    end = F.sum(F.col("y.gap") + size).over(order)
    return each.select("row", "kind", "least", F.col("y.value").alias("value"), (end - size).cast("long").alias("start"), end.cast("long").alias("end")).where(F.length("value") >= F.col("least")).drop("least")


BASE = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24)}


def transitions(samples: DataFrame) -> dict[str, list[float]]:
    """Log probabilities of each model, row by row of the alphabet; bounded by the square of the alphabet."""
    n = len(ALPHABET) + 1
    chars = samples.select("random", F.split("sample", "").alias("c")).where(F.size("c") > 1)
    pairs = chars.select("random", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.instr(F.lit(ALPHABET), a) * n + F.instr(F.lit(ALPHABET), b))).alias("pair"))
    rows = pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()
    out = {}
    for kind, random in (("random", True), ("ordinary", False)):
        counts = [0] * (n * n)
        for r in rows:
            if r["random"] == random:
                counts[r["pair"]] = r["n"]
        sums = [sum(counts[a * n : a * n + n]) for a in range(n)]
        ends = [sum(counts[b::n]) for b in range(n)]
        single = [(e + 0.5) / (sum(ends) + 0.5 * n) for e in ends]  # a rare symbol's transitions lean on these
        out[kind] = [math.log((counts[a * n + b] + SMOOTH * single[b]) / (sums[a] + SMOOTH)) for a in range(n) for b in range(n)]
        out[f"{kind}_n"] = [float(sum(sums))]
    return out


def labelled(docs: DataFrame, base: DataFrame, ordinary: int = ORDINARY_DOCUMENTS, random: int = RANDOM_STRINGS) -> DataFrame:
    """sample, random: strings labelled by the patterns, and what else stands in a bounded sample of documents.

    Values of pattern spans are random strings; so are digests of the documents' keys in base 64, which give
    the wider alphabet. Ordinary identifiers are the runs too short to be candidates.
    """
    values = base.where(F.length("value") >= 20).select(F.col("value").alias("sample")).distinct().orderBy(F.xxhash64("sample"), "sample").limit(random)
    # Only keys are sorted and limited; the few texts are then fetched where they lie.
    keys = docs.select("row").distinct().orderBy(F.xxhash64("row"), "row").limit(ordinary)
    chosen = docs.join(F.broadcast(keys), "row", "left_semi").dropDuplicates(["row"])
    digests = chosen.select(F.translate(F.base64(F.unhex(F.sha2("row", 256))), "=", "").alias("sample"))
    # What stands next to a match in its run may be a part of a secret: with the mark the run is too long.
    mark = "=" * LEAST
    rest = F.regexp_replace(F.regexp_replace("text", ASSIGN, mark), "[0-9a-f]{24,}|AKIA[A-Z0-9]+", mark)
    words = chosen.select(F.explode(F.regexp_extract_all(rest, F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("sample")).where(F.length("sample") < LEAST)
    return values.unionByName(digests).withColumn("random", F.lit(True)).unionByName(words.withColumn("random", F.lit(False)))


def ratio(value: Column, models: dict[str, list[float]]) -> Column:
    """Sum of the log-likelihood ratios of a string's transitions."""
    n = len(ALPHABET) + 1
    if not models["random_n"][0] or not models["ordinary_n"][0]:
        return F.lit(0.0)
    table = F.lit([round(a - b, 6) for a, b in zip(models["random"], models["ordinary"], strict=True)])
    symbols = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.zip_with(F.slice(symbols, 1, F.length(value) - 1), F.slice(symbols, 2, F.length(value) - 1), lambda a, b: F.get(table, a * n + b))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def spans(docs: DataFrame, samples: DataFrame | None = None, least_mean: float = LEAST_MEAN, least_sum: float = LEAST_SUM) -> DataFrame:
    """row, kind, start, end of all spans; ``docs`` has row (a key of its own) and text.

    No value of a span stays in the shared folder. Labelled ``samples`` (sample, random) can be given; otherwise ``labelled`` takes them from the documents.
    """
    found = kept(matches(docs, BASE | {"random": (CANDIDATE, 0, LEAST)}), "matches")
    base, rest = found.where("kind != 'random'"), found.where("kind = 'random'")
    models = transitions(labelled(docs, base) if samples is None else samples)
    b = base.select(F.col("row").alias("b_row"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    meets = (F.col("row") == F.col("b_row")) & (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    names = ["row", "kind", "start", "end", "value"]

    def likely(total: Column, pairs: Column) -> Column:
        return (total >= least_sum) & (total >= least_mean * pairs)

    score = ratio(F.col("value"), models)
    whole = rest.withColumn("ratio", score).where(likely(F.col("ratio"), F.length("value") - 1)).select(*names).join(b, meets, "left_anti")
    cut = rest.join(b, meets).groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("b_start", "b_end"))).alias("cuts"))
    parts = cut.withColumn("run_passes", likely(score, F.length("value") - 1)).withColumn("part", F.explode(outside(F.col("start"), F.col("end"), F.col("cuts"))))
    parts = parts.select("row", "kind", "run_passes", F.col("start").alias("run"), "part.start", "part.end", F.expr("substring(value, int(part.start - start + 1), int(part.end - part.start))").alias("value"))
    parts = parts.withColumn("ratio", score).withColumn("pairs", F.length("value") - 1)
    short, together = F.length("value") < LEAST, Window.partitionBy("row", "run")
    total = lambda x: F.sum(F.when(short, x)).over(together)
    joint = F.col("run_passes") & (total(F.length("value")) >= REST) & (total(F.col("ratio")) >= least_mean * total(F.col("pairs")))
    parts = parts.withColumn("found", likely(F.col("ratio"), F.col("pairs")) | (short & joint)).where("found").select(*names)
    places = kept(base.select(*names).unionByName(whole).unionByName(parts).drop("value"), "spans")
    forget(found)
    return places


def outside(start: Column, end: Column, cuts: Column) -> Column:
    """The parts (start, end) of a run outside its cuts, which are in the order of their starts."""
    part = "struct<start:bigint,end:bigint>"
    pair = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end")).cast(part)
    begin = F.struct(start.cast("long").alias("at"), F.array().cast(f"array<{part}>").alias("parts"))
    step = lambda s, c: F.struct(F.greatest(s["at"], c["b_end"]).alias("at"), F.when(c["b_start"] > s["at"], F.concat(s["parts"], F.array(pair(s["at"], c["b_start"])))).otherwise(s["parts"]).alias("parts"))
    last = lambda s: F.when(end > s["at"], F.concat(s["parts"], F.array(pair(s["at"], end)))).otherwise(s["parts"])
    return F.aggregate(cuts, begin, step, last)


def row_key() -> Column:
    """The same for rows with equal id and text, which have equal spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.hex(F.xxhash64(text)), F.lit(":"), F.length(text).cast("string"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row, text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans of each row."""
    table = keyed(docs)
    found = spans(table.select("row", "text")).distinct()
    order = F.element_at(F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)]), F.col("kind"))
    listed = found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", order.alias("order"), "kind", "end"))).alias("s"))

    def text_of(array: Column) -> Column:
        return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("s", lambda x: x["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")

    none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
    met = table.select("doc_id", "row").join(listed, "row", "left").withColumn("s", F.coalesce("s", none))
    return met.select("doc_id", *[number(k) for k in KINDS[:3]], F.sha2(text_of(F.filter("s", lambda x: x["order"] < 3)), 256).alias("base_sha256"), text_of(F.col("s")).alias("spans"), number("random"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """All rows and columns of ``docs`` with every span in the text replaced by ``mark``.

    Spans that overlap are replaced as one.
    """
    table = keyed(docs)
    found = spans(table.select("row", "text")).select("row", "start", "end").distinct()
    by = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    groups = found.withColumn("group", F.sum(F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = groups.groupBy("row", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    row, key, cut, changed = fresh(docs.columns, "row", "key", "cut", "changed")
    cuts = whole.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut)).select(F.col("row").alias(key), cut)
    names = {c: F.col(f"`{c}`") for c in docs.columns}
    met = docs.select(*names.values(), row_key().alias(row)).join(cuts, F.col(row) == F.col(key), "left")
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(cut, lambda x: x["end"]))
    ends = F.concat(F.transform(cut, lambda x: x["start"]), F.array(F.length("text").cast("bigint")))
    parts = F.zip_with(begins, ends, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(parts, mark))
    out = met.select(*[x.alias(c) for c, x in (names | {"text": text}).items()], F.col(cut).isNotNull().alias(changed))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(changed), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*names.values())

"""Language by a sparse multinomial logistic regression over TF-IDF of hashed character n-grams.

How many training documents hold each n-gram is counted over all of them. The regression is fitted by
follow-the-regularised-leader with elastic-net penalties, in one task, on at most ``FIT_PER_LANGUAGE``
documents of each language (those with the least hashes of id and text), whole texts each; a part of them is
kept aside for the temperature that calibrates the probabilities, and for the score below which a language is
not accepted: half-way between what chance gives and what 99 of 100 of them reach. All documents are then scored.

N-grams of one to three characters are taken over the lower-cased text with every run of other characters
than letters as one blank. TF is a share of the text's n-grams, so a score is a mean over positions.

Defined results: null text, or text without a letter, is ``und`` with score 0; without training documents
every text is ``und``; equal texts have equal results; rows of equal id, text and language are one sample, others
one each, also without an id; texts of any length are read whole; an empty table gives an empty result; further columns stay as they are, whatever their
names.
"""

from __future__ import annotations

import functools
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, in_arrow, slices, utf8
from .words import mix

BITS = 16
FIT_PER_LANGUAGE = 1500
SLICE = 1 << 18  # bytes of text that are worked on at once
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.001
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts one after another, where each text's begin, and whether it has a letter."""
    parts, sizes, lettered = [], [], []
    table = _letters()
    for text in texts:
        c = table[np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)]
        solid = c != 32
        lettered.append(bool(solid.any()))
        if len(c):
            stays = solid.copy()
            stays[0] = True
            stays[1:] |= solid[:-1]
            c = c[stays]
        c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]]).astype(np.uint64)
        grams = [c + np.uint64(1 << 60), (c[:-1] << np.uint64(21)) + c[1:] + np.uint64(2 << 60)]
        if len(c) > 2:
            grams.append((c[:-2] << np.uint64(42)) + (c[1:-1] << np.uint64(21)) + c[2:])
        parts += grams
        sizes.append(sum(map(len, grams)))
    f = (mix(np.concatenate(parts)) >> np.uint64(64 - BITS)).astype(np.int32) if parts else np.zeros(0, np.int32)
    return f, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array(lettered, bool)


def _texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    raw, starts = utf8(batch.column(column))
    data, at = raw.tobytes(), starts.tolist()
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each n-gram is, and of how many texts."""

    def count(batches):
        df, flags, n = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool), 0
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                f, at, _ = ngrams(_texts(batch))
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = f[a:b]
                    flags[own] = True
                    df += flags
                    flags[own] = False
                    n += 1
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[there, -1], pa.int32()), pa.array(np.r_[df[there], n], pa.int64())], ["feature", "n"])

    rows = in_arrow(texts.select(F.col("text").cast("string").alias("text")), count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # at most 2^BITS + 1 rows
    df, n = np.zeros(1 << BITS, np.int64), 0
    for r in rows:
        if r["feature"] < 0:
            n = r["n"]
        else:
            df[r["feature"]] = r["n"]
    return df, n


def fit(samples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features by classes) and biases. samples: (features, values) of each text."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    bias, bias_n = np.zeros(classes), np.zeros(classes)

    def weights(zz, nn):
        return np.where(np.abs(zz) > L1, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2), 0)

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            f, x = samples[k]
            zz, nn = z[f], n[f]
            w = weights(zz, nn)
            s = x @ w + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[k]] -= 1
            g = x[:, None] * p
            step = (np.sqrt(nn + g * g) - np.sqrt(nn)) / ALPHA
            z[f] = zz + g - step * w
            n[f] = nn + g * g
            bias_n += p * p
            bias -= 0.1 * p / (1 + np.sqrt(bias_n))
    return weights(z, n), bias


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores under which the kept-aside labels are most likely."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean()) + 1e-4 * np.log(t) ** 2

    return float(min(np.geomspace(0.05, 20, 121), key=loss))


KEY = ["lang", "doc_id", "hash", "size"]


def sampled(docs: DataFrame, per_language: int = FIT_PER_LANGUAGE) -> DataFrame:
    """Keys of the rows with the least hashes in each language, from rows with the columns of ``KEY``.

    Equal rows have one key. A first cut by hash, from the number of keys of each language, leaves few more than
    asked for; only these are put in order.
    """
    keys = docs.select(*KEY).distinct()
    sizes = keys.groupBy("lang").agg(F.count("*").alias("rows"))
    share = F.pmod(F.xxhash64(*KEY[1:]), F.lit(1 << 30)) / float(1 << 30)
    near = keys.withColumn("share", share).join(sizes, "lang").where(F.col("share") * F.col("rows") <= 2 * per_language)
    order = Window.partitionBy("lang").orderBy("share", *KEY[1:])
    return near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select(*KEY)


def train(docs: DataFrame, idf: np.ndarray, per_language: int = FIT_PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray, float, float]:
    """Languages, weights times IDF, biases, temperature and least score, from rows with doc_id, text and lang."""

    def features(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                f, at, lettered = ngrams(_texts(batch))
                keys, values, rows = [], [], [k for k in range(batch.num_rows) if lettered[k]]
                for k in rows:
                    own, c = np.unique(f[at[k] : at[k + 1]], return_counts=True)
                    keys.append(own)
                    values.append((c / c.sum() * idf[own]).astype(np.float32))
                own = batch.select(["lang", "hash", "size"]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(keys, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["lang", "hash", "size", "f", "x"])

    own = docs.withColumn("hash", F.xxhash64("text")).withColumn("size", F.length("text"))
    wanted = sampled(own, per_language).toDF(*[f"of_{c}" for c in KEY])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in KEY])
    chosen = own.join(wanted, same, "left_semi").dropDuplicates(KEY).select("lang", "hash", "size", "text")
    sample = in_arrow(chosen, features, "lang string, hash long, size int, f array<int>, x array<float>")

    def fit_all(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["hash", "size", "lang"])  # what is equal here has equal features
        languages = sorted(rows["lang"].unique())
        y = np.array([languages.index(x) for x in rows["lang"]])
        samples = [(np.asarray(f), np.asarray(x, dtype=float)) for f, x in zip(rows["f"], rows["x"], strict=True)]
        aside = np.arange(len(samples)) % 5 == 4
        w, bias = fit([s for s, a in zip(samples, aside, strict=True) if not a], y[~aside], len(languages))
        scores = np.array([x @ w[f] + bias for (f, x), a in zip(samples, aside, strict=True) if a]).reshape(-1, len(languages))
        t, chance = temperature(scores, y[aside]), 1 / len(languages)
        right = (p := probabilities(scores / t))[scores.argmax(axis=1) == y[aside]]
        least = (chance + np.quantile(right.max(axis=1), 0.01)) / 2 if len(p) and len(right) else chance
        f, c = np.nonzero(w)
        out = [{"kind": "w", "a": int(i), "b": int(j), "v": float(w[i, j]), "s": None} for i, j in zip(f, c, strict=True)]
        out += [{"kind": "lang", "a": k, "b": 0, "v": float(bias[k]), "s": x} for k, x in enumerate(languages)]
        return pd.DataFrame([*out, {"kind": "t", "a": 0, "b": 0, "v": t, "s": None}, {"kind": "least", "a": 0, "b": 0, "v": float(least), "s": None}])

    rows = sample.groupBy(F.lit(0).alias("all")).applyInPandas(lambda key, rows: fit_all(rows), "kind string, a int, b int, v double, s string").collect()  # bounded by the features and languages
    languages = [r["s"] for r in sorted((r for r in rows if r["kind"] == "lang"), key=lambda r: r["a"])]
    w = np.zeros((1 << BITS, max(1, len(languages))), np.float32)
    for r in rows:
        if r["kind"] == "w":
            w[r["a"], r["b"]] = r["v"] * idf[r["a"]]
    bias = np.array([r["v"] for r in sorted((r for r in rows if r["kind"] == "lang"), key=lambda r: r["a"])])
    one = {r["kind"]: r["v"] for r in rows if r["kind"] in ("t", "least")}
    return languages, w, bias, one.get("t", 1.0), one.get("least", 1.0)


def probabilities(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(axis=1, keepdims=True)) if scores.size else scores
    return p / p.sum(axis=1, keepdims=True) if scores.size else p


def learned(docs: DataFrame) -> tuple:
    """Languages, weights, biases, temperature and least score from rows with doc_id, text and lang."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    df, n = document_frequency(own)
    return train(own, np.log((1 + n) / (1 + df)) + 1)


def predicted(docs: DataFrame, text: str, model: tuple, lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and those named ``lang_pred`` and ``score``, for the text in the column ``text``."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model[:4])  # 2^BITS weights a language
    names = docs.columns
    schema = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes) + f", `{lang_pred}` string, `{score}` double"

    def run(batches):
        languages, w, bias, t = broadcast.value
        for whole in batches:
            for batch in slices(whole, text, SLICE):
                f, at, lettered = ngrams(_texts(batch, text))
                best, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
                if languages and batch.num_rows:
                    s = np.add.reduceat(w[f], at[:-1], axis=0, dtype=np.float64) / np.diff(at)[:, None] + bias
                    p = probabilities(s / t)
                    top = p.argmax(axis=1)
                    best = [languages[b] if ok else UNKNOWN for b, ok in zip(top.tolist(), lettered.tolist(), strict=True)]
                    scores = np.where(lettered, p[np.arange(len(top)), top], 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(scores)], [*names, lang_pred, score])

    return in_arrow(docs, run, schema)


def identified(docs: DataFrame, training: Column, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with lang_pred and score, learned from the rows where ``training`` holds."""
    (text,) = fresh(keep, "text")
    table = docs.select(*keep, F.col("text").cast("string").alias(text))
    return predicted(table, text, learned(docs.where(training))).drop(text)


def accepted(docs: DataFrame, least: float | None = None) -> DataFrame:
    """The rows and columns of ``docs`` whose language is recognised with at least the score ``least``.

    Learns from all rows with a language. Without ``least``, the level that the kept-aside documents give.
    """
    model = learned(docs)
    pred, score = fresh(docs.columns, "lang_pred", "score")
    names = [F.col(f"`{n}`") for n in docs.columns]
    own = docs if docs.schema["text"].dataType.simpleString() == "string" else docs.withColumn("text", F.col("text").cast("string"))
    out = predicted(own, "text", model, pred, score)
    return out.where((F.col(pred) != UNKNOWN) & (F.col(score) >= (model[4] if least is None else least))).select(*names)

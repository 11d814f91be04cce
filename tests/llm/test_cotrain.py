"""Co-training against a plain implementation, its held-out accuracy, and the defined results."""

import math
import random
from collections import Counter

import numpy as np

from corpuswarden.llm import cotrain
from corpuswarden.llm.words import mix

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def corpus(n=500):
    rng = random.Random(8)
    rows, quality = [], {}
    for k in range(n):
        good = rng.random() < 0.7
        words = [rng.choice("house river stone cloud music garden winter".split()) for _ in range(rng.randrange(20, 90))]
        text = " ".join(words if good else [w + rng.choice(["###", "&&&", "!!"]) for w in words])
        rows.append((k, text, rng.choice("ab" if good else "bcd"), "en", len(text)))
        quality[k] = int(good)
    return rows, quality


EXTRA = [(900, None, None, None, None), (901, "", "a", "en", 0), (902, "river " * 50000, "a", "en", 1), (None, "river stone", "a", "en", 3), (903, "Été\x85\n\t日本 x x x", "a", None, 3)]


def test_held_out_accuracy(spark):
    rows, quality = corpus()
    docs = spark.createDataFrame([*rows, *EXTRA, rows[0]], SCHEMA)
    labels = spark.createDataFrame([(k, q) for k, q in quality.items() if k % 3 == 0] + [(None, 1), (3, None), (77777, 0)], "doc_id long, quality int")
    got = cotrain.scored(docs, labels).collect()
    assert len(got) == len(rows) + len(EXTRA) + 1
    by = {r.doc_id: r for r in got}
    held = [k for k in quality if k % 3]
    assert sum(by[k].good == bool(quality[k]) for k in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and by[902].good
    assert len({r.score for r in got if r.doc_id == rows[0][0]}) == 1


def plain_views(text, source, lang):
    """Names of the features of a text, one by one: (n-grams), (shapes), (metadata)."""
    data = (text or "").encode()
    padded = b"  " + data + b" "
    grams = [int(mix(np.array([(padded[k] << 16) + (padded[k + 1] << 8) + padded[k + 2]], np.uint64))[0]) >> (64 - cotrain.BITS) for k in range(len(padded) - 2)]
    words = data.split()
    n = max(1, len(words))
    kinds = [sum(1 for c in data if c in member) for member in (set(range(256)) - {*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_ \t\n\r\x0b\x0c"}, {*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, {*b"0123456789"}, {10})]
    steps = [*(4 * c // n for c in kinds), 8 * len({*words}) // (n + 1), 8 * sum(a == b for a, b in zip(words, words[1:])) // n, sum(map(len, words)) // n]  # noqa: B905
    shapes = [cotrain.PARTS[1] + 8 * k + min(7, x) for k, x in enumerate(steps)]
    return grams, shapes, cotrain.metadata(source, lang, len(data), kinds[3] + 1)


def test_scores_equal_a_plain_implementation(spark):
    rows, quality = corpus(90)
    rows += EXTRA[:2] + EXTRA[3:]
    said = {k: q for k, q in quality.items() if k % 4 == 0}
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {str(r.doc_id): r for r in cotrain.scored(docs, spark.createDataFrame(list(said.items()), "doc_id long, quality int")).collect()}
    ids = spark.createDataFrame([(k,) for k in said], "k long").selectExpr("k", "pmod(xxhash64(k, 'aside'), 4) = 3 as aside").collect()
    aside = {r.k for r in ids if r.aside}
    views = {k: plain_views(*row) for k, *row in [r[:4] for r in rows]}
    prior = sum(said.values()) / len(said)

    def llr(counts):
        out = {}
        for a, b in zip(cotrain.PARTS[:-1], cotrain.PARTS[1:], strict=True):
            total = [sum(v for k, v in c.items() if a <= k < b) + 0.5 * (b - a) for c in counts]
            out |= {k: math.log((counts[1][k] + 0.5) / total[1]) - math.log((counts[0][k] + 0.5) / total[0]) for k in range(a, b)}
        return out

    def raw(w, k):
        grams, shapes, meta = views[k]
        return cotrain.GAIN * sum(w[g] for g in grams) / len(grams) + sum(w[s] for s in shapes), sum(w[m] for m in meta)

    def calibrated(w):
        judges = sorted(aside)
        s = np.array([raw(w, k) for k in judges])
        y = np.array([said[k] for k in judges], float)
        return cotrain.platt(s[:, 0], y), cotrain.platt(s[:, 1], y)

    first = [Counter(), Counter()]
    for k, q in said.items():
        if k not in aside:
            first[q].update(views[k][0] + views[k][1] + views[k][2])
    counts = first
    for _ in range(cotrain.ROUNDS):
        w = llr(counts)
        (a, c), (b, d) = calibrated(w)
        counts = [Counter(x) for x in first]
        for k in views:
            if k in said:
                continue
            t, m = raw(w, k)
            teach_text, teach_meta = (int(x) for x in cotrain.taught(np.array(a * t + c), np.array(b * m + d), prior))
            if teach_text >= 0:
                counts[teach_text].update(views[k][0] + views[k][1])
            if teach_meta >= 0:
                counts[teach_meta].update(views[k][2])
    w = llr(counts)
    (a, c), (b, d) = calibrated(w)
    for k in views:
        t, m = raw(w, k)
        want = 1 / (1 + math.exp(-max(-30, min(30, a * t + c + b * m + d - math.log(prior / (1 - prior))))))
        assert abs(got[str(k)].score - want) < 1e-9, k


def test_few_labels_and_none(spark):
    rows, _ = corpus(9)
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in cotrain.scored(docs, none).collect()} == {0.5}
    assert {r.score for r in cotrain.scored(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")).collect()} == {1.0}
    assert cotrain.scored(docs.where("false"), none).count() == 0
    few = cotrain.scored(spark.createDataFrame(corpus(60)[0], SCHEMA), spark.createDataFrame([(k, q) for k, q in corpus(60)[1].items() if k < 7], "doc_id long, quality int"))
    assert few.select("score").distinct().count() > 5

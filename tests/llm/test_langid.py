"""Held-out accuracy on text made of four alphabets of syllables, and the defined results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswarden.llm import langid


def corpus(n=400):
    rng = random.Random(4)
    syllables = {"aa": "tha ing ona ed re st".split(), "bb": "éau ion ré le ou çen".split(), "cc": "sch ung üb er ei ach".split(), "dd": "ción ado ña os rr ue".split()}
    rows = []
    for k in range(n):
        lang = rng.choice(list(syllables))
        rows.append((k, " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))), lang))
    return rows


def test_held_out_accuracy_and_defined_results(spark):
    rows = corpus()
    extra = [(900, None, "aa"), (901, "", "aa"), (902, "123 !! \n", "aa"), (903, "tha ing ona " * 20000, None), (904, rows[0][1], None), (None, "schung übach erei", None)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identified(docs, F.coalesce(F.col("doc_id") % 3 != 1, F.lit(True)), ["doc_id"]).collect()}
    held = [(k, lang) for k, _, lang in rows if k % 3 == 1]
    assert sum(got[k].lang_pred == lang for k, lang in held) >= 0.98 * len(held)
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (900, 901, 902))
    assert got[903].lang_pred == "aa" and got[None].lang_pred == "cc"
    assert (got[904].lang_pred, got[904].score) == (got[0].lang_pred, got[0].score)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame(corpus(5), "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identified(docs, F.lit(False), ["doc_id"]).collect()} == {"und"}
    assert langid.identified(docs.where("false"), F.lit(True), ["doc_id"]).count() == 0
    kept = langid.accepted(docs.withColumn("other", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "lang", "other"]


def test_scores_equal_a_plain_computation(spark):
    rows = corpus(60) + [(99, "ThaÉ 12 \U00031400 ing!", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learned(docs)
    languages, w, bias, t, _ = model
    got = {r.doc_id: r for r in langid.predicted(docs, "text", model).collect()}
    for k, text, _ in rows:
        plain = []
        for c in text:  # letters in lower case, every other run as one blank
            plain += [c.lower()] if c.isalpha() else ([" "] if not plain or plain[-1] != " " else [])
        c = [ord(x) for x in " " + "".join(plain) + " "]
        grams = [(1 << 60) + x for x in c] + [(2 << 60) + (x << 21) + y for x, y in zip(c, c[1:])] + [(x << 42) + (y << 21) + z for x, y, z in zip(c, c[1:], c[2:])]  # noqa: B905
        f = [int(langid.mix(np.array([g], np.uint64))[0]) >> (64 - langid.BITS) for g in grams]
        s = [(sum(float(w[x, j]) for x in f) / len(f) + bias[j]) / t for j in range(len(languages))]
        p = [math.exp(x - max(s)) for x in s]
        assert got[k].lang_pred == languages[s.index(max(s))]
        assert abs(got[k].score - max(p) / sum(p)) < 1e-6


def test_unlearned_alphabets_go_and_clean_text_stays(spark):
    rows, rng = corpus(), random.Random(9)
    other = [(1000 + k, " ".join("".join(rng.choices("абвгдежзиклмнопр", k=6)) for _ in range(30)), None) for k in range(20)]
    docs = spark.createDataFrame(rows + other, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in langid.accepted(docs).collect()}
    assert len(kept & {k for k, _, _ in rows}) >= 0.99 * len(rows) and not kept & {k for k, _, _ in other}


def keyed(docs):
    return docs.selectExpr("*", "xxhash64(text) as hash", "length(text) as size")


def test_sample_is_the_least_hashes_of_each_language(spark):
    rows = [(k, "x", "aa" if k % 3 else "bb") for k in range(900)] + [(5, "x", "aa")]
    docs = keyed(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id, hash, size), {1 << 30}) as h").collect()}
    got = {r.doc_id for r in langid.sampled(docs, 50).collect()}
    for rest in ({0}, {1, 2}):
        own = sorted((k for k in range(900) if k % 3 in rest), key=lambda k: hashes[k])
        assert got & set(own) == set(own[:50])


@pytest.mark.parametrize("name, ids", [("none", lambda k: None), ("one", lambda k: 7), ("few", lambda k: k % 5)])
def test_ids_that_are_null_or_repeat(spark, name, ids):
    rows = corpus()
    texts = {t for _, t, _ in rows}
    docs = spark.createDataFrame([(ids(k), t, lang) for k, t, lang in rows] + [(ids(0), rows[0][1], rows[0][2])] * 30, "doc_id long, text string, lang string")
    own = keyed(docs)
    chosen = langid.sampled(own, 50)
    assert chosen.groupBy("lang").count().where("count != 50").count() == 0 and chosen.count() == 200  # whatever the ids
    got = langid.accepted(docs).collect()
    assert {r.text for r in got} == texts and len(got) == len(rows) + 30

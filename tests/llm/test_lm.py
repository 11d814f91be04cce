"""The trigram model against a plain computation over a small fixture."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from corpuswarden.llm import lm


def plain(train, texts):
    split = lambda t: [w.encode().lower().decode() if w.isascii() else w for w in re.findall(r"[^ \t-\r]+", t or "")] + ["</s>"]
    grams, words = Counter(), Counter()
    of_text = lambda w: zip(["<s>", "<s>", *w], ["<s>", *w], w)
    for t in train:
        w = split(t)
        words.update(w)
        grams.update(of_text(w))
    n, v = sum(words.values()), len(words)
    pairs = Counter((b, c) for _, b, c in grams)  # how many words precede each pair
    follows = Counter(c for _, c in pairs)
    fold = lambda values: [sum(1 for x in values if x == k) for k in (1, 2, 3, 4)]
    dw, dp, dg = (lm.discounts(fold(x.values())) for x in (follows, pairs, grams))
    fk = Counter(min(x, 3) for x in follows.values())
    spare = sum(dw[k - 1] * fk[k] for k in (1, 2, 3)) / len(pairs) if pairs else 1.0

    def contexts(counts):
        total, kinds = Counter(), defaultdict(Counter)
        for key, c in counts.items():
            total[key[:-1]] += c
            kinds[key[:-1]][min(c, 3)] += 1
        return total, kinds

    of_pairs, of_grams = contexts(pairs), contexts(grams)

    def level(counts, of, cuts, key, below):
        total, kinds = of
        if not total[key[:-1]]:
            return below
        c = counts[key]
        g = sum(cuts[k - 1] * kinds[key[:-1]][k] for k in (1, 2, 3))
        return ((max(c - cuts[min(c, 3) - 1], 0) if c else 0) + g * below) / total[key[:-1]]

    def prob(a, b, c):
        f = follows[c]
        low = (max(f - dw[min(f, 3) - 1], 0) / len(pairs) if f else 0) + spare / (v + 1)
        return level(grams, of_grams, dg, (a, b, c), level(pairs, of_pairs, dp, (b, c), low))

    out = []
    for t in texts:
        w = split(t)
        out.append((len(w), sum(words[x] > 0 for x in w), n, sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(prob(*x)) for x in of_text(w))))
    if v:
        for a, b in (("the", "the"), ("<s>", "<s>"), ("the", "of"), ("never", "the")):
            assert abs(sum(prob(a, b, w) for w in words) + prob(a, b, "never-seen") - 1) < 1e-9
    return out


def test_scores_equal_a_plain_computation(spark):
    rng = random.Random(3)
    vocabulary = ["the", "The", "of", "é", "cat", "dog", "sat", "x" * 3000, "日本"] + [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randrange(0, 60))) for _ in range(120)]
    texts += [None, "", "  \n\t ", "the the the " * 400, texts[0], texts[0]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.train(docs.where("doc_id % 7 != 2"))
    got = {r.doc_id: r for r in lm.score(docs, model, keep=["doc_id"]).collect()}
    assert len(got) == len(rows)
    for (k, _), want in zip(rows, plain([t for k, t in rows if k % 7 != 2], texts)):
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9)
        assert r.score == pytest.approx(want[4], rel=1e-9)


def test_no_training_text_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = lm.train(docs.where("false"))
    assert [(r.n_tokens, r.n_known, r.score) for r in lm.score(docs, model, keep=["doc_id"]).orderBy("doc_id").collect()] == [(3, 0, 0.0), (1, 0, 0.0)]
    assert lm.score(docs.where("false"), model, keep=["doc_id"]).count() == 0


@pytest.mark.parametrize("train", [["a"], ["a b a b a b c"], ["a b c"] * 300, [None, None]])
def test_few_texts_and_large_counts(spark, train):
    texts = ["a b c", "b a", None, "c", "a a a a"]
    model = lm.train(spark.createDataFrame([(t,) for t in train], "text string"))
    got = lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, keep=["doc_id"]).orderBy("doc_id").collect()
    for r, want in zip(got, plain(train, texts), strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert (r.base_score, r.score) == pytest.approx(want[3:], rel=1e-9)


@pytest.mark.parametrize("kind", ["word", "pair", "gram", "stat"])
def test_a_lost_file_is_an_error(spark, kind):
    import os

    docs = spark.createDataFrame([(k, f"w{k} w{k + 1} the") for k in range(40)], "doc_id long, text string")
    model = lm.train(docs)
    folder = model.uri.removeprefix("file://")
    os.remove(f"{folder}/{sorted(f for f in os.listdir(folder) if f.startswith(kind))[0]}")
    with pytest.raises(Exception, match="No such file|FileNotFound"):
        lm.score(docs, model, keep=["doc_id"]).collect()

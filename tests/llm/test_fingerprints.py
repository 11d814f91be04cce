"""Fingerprints, spans and the order of documents against plain text operations."""

import hashlib
import random
from collections import Counter

import numpy as np

from corpuswarden.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, bucket string, hash long"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeéß漢😀", k=rng.randint(2, 8))) for _ in range(n))


def plain(rows):
    """doc_id, n_chars, sha of the edited text, common beginnings, by the stated order (no equal ids and texts but copies)."""
    docs = sorted(((i is None, i or 0), t or "") for i, t in rows)
    out = []
    for k, ((nil, i), t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        cut = len(t) // 4
        e = t[: len(t) - cut] + after[:cut]
        lead = lambda u: next((j for j, (x, y) in enumerate(zip(t, u)) if x != y), min(len(t), len(u)))  # noqa: B023, E731
        out.append((None if nil else i, len(t), hashlib.sha256(e.encode()).hexdigest(), lead(e), lead(after), fp.fingerprint(t), fp.fingerprint(e), fp.likeness(fp.fingerprint(t), fp.fingerprint(e)), fp.likeness(fp.fingerprint(t), fp.fingerprint(after))))
    return out


def got(spark, rows, parts=3):
    table = spark.createDataFrame([(i, t, "own", 7) for i, t in rows], SCHEMA).repartition(parts)
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.common_edited, r.common_next, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fp.successors(table).collect()]


def test_every_document_meets_the_next(spark):
    rng = random.Random(1)
    rows = [(k * 3 - 50, words(rng, rng.randint(0, 120))) for k in range(150)]
    rows += [(-49, None), (8, ""), (9, "abc"), (1000, "x" * 5000), (1001, "x" * 5000), (1002, "y" * 4999 + "x"), (None, "the last one of all")]
    assert Counter(got(spark, rows)) == Counter(plain(rows))
    assert Counter(got(spark, rows, 1)) == Counter(plain(rows))


def test_equal_rows_and_equal_ids(spark):
    rng = random.Random(2)
    rows = [(k, words(rng, 30)) for k in range(20)] + [(7, "seven again and again, as it was written before")] * 2500 + [(None, "no id")] * 5
    rows = [r for r in rows if r[0] != 7 or r[1].startswith("seven")]
    assert Counter(got(spark, rows)) == Counter(plain(rows))  # 2500 equal rows are worked on once
    same = [(4, t) for t in ("one text", "another text", "a third, longer text")]
    assert sorted(r[1] for r in got(spark, same)) == [8, 12, 20] and {r[0] for r in got(spark, same)} == {4}


def test_empty_and_single(spark):
    assert got(spark, []) == []
    assert got(spark, [(5, "only one here")]) == plain([(5, "only one here")])


def test_spans_and_extensions():
    rng = random.Random(3)
    t = words(rng, 80) + "".join(rng.choices("ab", k=300))
    u = t[13:90] + "!" + t[200:]
    a, b = fp.prefixes(fp.code_points(t)), fp.prefixes(fp.code_points(u))
    assert (fp.prefixes(fp.code_points(t[50:]), a[:, :51]) == a).all()
    for _ in range(400):
        i, j = rng.randrange(len(t)), rng.randrange(len(u))
        n = rng.randint(0, min(len(t) - i, len(u) - j, 3))
        assert (fp.span(a, i, i + n) == fp.span(b, j, j + n)).all() == (t[i : i + n] == u[j : j + n])
        want = next((k for k in range(min(len(t) - i, len(u) - j)) if t[i + k] != u[j + k]), min(len(t) - i, len(u) - j))
        assert fp.common_extension(a, i, b, j) == want
    assert fp.common_extension(a, 13, b, 0) == 77


def test_likeness():
    rng = random.Random(4)
    texts = [words(rng, n) for n in (3, 20, 60, 200, 900, 5000)]
    for t in texts:
        f = fp.fingerprint(t)
        assert fp.likeness(f, f) == 1 and str(fp.Fingerprint.read(f)) == f and len(fp.Fingerprint.read(f).cuts) <= fp.CUTS
        for u in texts:
            if u != t:
                assert fp.likeness(f, fp.fingerprint(u)) < 0.1 and fp.fingerprint(u) != f
    for t in texts[2:]:
        f = fp.fingerprint(t)
        for u in (t[: len(t) // 2] + "?" + t[len(t) // 2 :], "preface. " + t, t + " afterword"):
            assert fp.likeness(f, fp.fingerprint(u)) > 0.65
            assert fp.likeness(f, fp.fingerprint(u)) == fp.likeness(fp.fingerprint(u), f)
        quarter = t[: len(t) - len(t) // 4] + words(rng, len(t))[: len(t) // 4]
        assert 0.5 < fp.likeness(f, fp.fingerprint(quarter)) <= 0.8
    assert fp.likeness(fp.fingerprint(""), fp.fingerprint(None)) == 1 and fp.likeness(fp.fingerprint(""), fp.fingerprint("a")) == 0


def test_fingerprinted_keeps_columns(spark):
    table = spark.createDataFrame([(1, "abc", "own", 7), (None, None, "own", 7), (1, "abc", None, None)], SCHEMA)
    rows = fp.fingerprinted(table, name="mark").collect()
    assert [r.mark for r in rows] == [fp.fingerprint("abc"), fp.fingerprint(""), fp.fingerprint("abc")] and rows[0].bucket == "own"
    assert np.isfinite([len(r.mark) for r in rows]).all()

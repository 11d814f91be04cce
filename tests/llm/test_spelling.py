"""Spelling variants against a plain computation over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from corpuswarden.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def plain(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if k >= 3 and len(w) >= 5}
    out = {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        top = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (top if top and n[top] >= 2 * n[w] else None, n[w], len(near))
    root = lambda w: root(out[w][0]) if out[w][0] else w
    return {w: (f, root(w), k, m, n[f] if f else None) for w, (f, k, m) in out.items()}


def got(spark, rows, parts=3):
    table = spark.createDataFrame([(d, t, "own", 7) for d, t in rows], SCHEMA).repartition(parts)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(table).collect()}


def corpus(seed, size, letters="abcé", long=9):
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.randint(4, long))) for _ in range(size)]
    rows = []
    for d in range(60):
        text = " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(size)], k=120))
        rows.append((d, text.replace("a", "A", 5) + rng.choice([".", " 12x", "×ßon", "\n"])))
    return rows


def test_equal_to_all_pairs(spark):
    rows = corpus(1, 400, "abé", 7) + [(None, "Straße straße strasse straßen"), (None, None), (7, "")]
    rows += [(500 + k, "hundreds hundred hundreds HUNDREDS hundreds hundrds") for k in range(40)] + [(500, "hundreds hundred")] * 3
    want = plain(rows)
    assert sum(f is not None for f, *_ in want.values()) > 50 and any(f and r != f for f, r, *_ in want.values())
    assert got(spark, rows) == want


def test_deletions_of_one_word(spark):
    rows = [(d, "considerable measurements " * 2) for d in range(900)]
    want = plain(rows)
    assert len(want) > 2 and got(spark, rows) == want


def test_lists_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 40)
    rows = [(d, t.replace(" ", " aaaa")) for d, t in corpus(2, 200, "ab")]  # one half holds nearly all
    assert got(spark, rows) == plain(rows)


def test_long_runs_and_empty_tables(spark):
    long = "x" * 3000
    rows = [(k, f"{long} {long}y z") for k in range(4)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == {} and got(spark, [(1, None), (2, "12 ab")]) == {}


def test_runs_and_hashes():
    texts = ["AÀb", "", "b 7cdÿĀe", "é" * 80, "漢xy"]
    raw = np.frombuffer("".join(texts).encode().lower(), np.uint8)
    starts = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    begin, end, points = spelling.runs(raw, starts)
    assert [raw[a:b].tobytes().decode() for a, b in zip(begin, end)] == ["aÀb", "b", "cdÿ", "e", "é" * 80, "xy"]
    assert points.tolist() == [3, 1, 3, 1, 80, 2]
    state = np.array([zlib.crc32(f"{k}:".encode()) for k in range(6)], np.uint32)
    h = spelling.crcs(raw, begin, end, state)
    assert h.tolist() == [zlib.crc32(f"{k}:".encode() + raw[a:b].tobytes()) for k, (a, b) in enumerate(zip(begin, end))]


def test_scan_keeps_to_its_range():
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(150)})
    n = len(words)
    a, b = spelling.scan(words, np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64), np.full(n, n))
    assert sorted(zip(a.tolist(), b.tolist())) == [(i, j) for i in range(n) for j in range(n) if one_edit(words[i], words[j])]
    a, b = spelling.scan(words, np.zeros(n, np.int64), np.arange(n), np.arange(n) + 1, np.full(n, n))
    assert sorted(zip(a.tolist(), b.tolist())) == [(i, j) for i in range(n) for j in range(i + 1, n) if one_edit(words[i], words[j])]

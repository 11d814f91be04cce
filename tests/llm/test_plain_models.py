"""Packing against a plain shortest-pack-first, and the Markov models of secrets against plain counting."""

import base64
import hashlib
import math
import random
import re

import xxhash
from pyspark.sql import functions as F

from corpuswarden.llm import packing, secrets


def one_by_one(lengths, capacity):
    """Totals of packs when each length, longest first, goes to the shortest pack, or to a new one where it doesn't fit."""
    packs = []
    for n in sorted(lengths, reverse=True):
        k = min(range(len(packs)), key=packs.__getitem__, default=None)
        if k is not None and packs[k] + n <= capacity:
            packs[k] += n
        else:
            packs.append(n)
    return packs


def test_as_few_sequences_as_one_by_one():
    rng = random.Random(8)
    for shape in (lambda: rng.randrange(1, 65), lambda: min(64, 1 + int(rng.expovariate(0.1))), lambda: rng.choice([21, 22, 43, 64]), lambda: 33, lambda: 1, lambda: rng.choice([1, 1, 1, 50])):
        lengths = [shape() for _ in range(600)]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        packs = sum(count for count, _ in packing.shortest_pack_first(histogram, 64))
        plain = len(one_by_one(lengths, 64))
        assert -(-sum(lengths) // 64) <= packs <= 1.01 * plain + 1


def rows_with_secrets():
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("under", "inter", "applica", "manage", "proper") for b in ("stand", "tion", "ment", "_panel", "-over")]
    rows = [(k, " ".join(rng.choices(words, k=120)) + f" token = '{hashlib.sha1(str(k).encode()).hexdigest()}' AKIA{k:02d}" + "Q7" * 9) for k in range(40)]
    return rows + [(None, "no id under standing"), (41, None), rows[3]]


def plain_samples(rows):
    strings, texts = set(), {}
    for doc, text in rows:
        text = text or ""
        row = f"{'' if doc is None else doc}:{xxhash.xxh64_intdigest(text.encode(), 42):X}:{len(text)}"
        texts[row] = text
        for pattern, group in ((secrets.ASSIGN, 2), (secrets.ACCESS, 0), (secrets.HEX, 0)):
            strings |= {m[group] for m in re.finditer(pattern, text) if len(m[group]) >= 20}
    strings = list(strings) + [base64.b64encode(hashlib.sha256(row.encode()).digest()).decode().rstrip("=") for row in texts]
    words = []
    for text in texts.values():
        rest = re.sub("[0-9a-f]{24,}|AKIA[A-Z0-9]+", "=" * 20, re.sub(secrets.ASSIGN, "=" * 20, text))
        words += [w for w in re.findall("[A-Za-z0-9+/_=-]{4,}", rest) if len(w) < 20]
    return strings, words


def plain_model(samples):
    """log probability of each transition: counts with the symbols' own frequencies as a prior."""
    at = {c: k + 1 for k, c in enumerate(secrets.ALPHABET)}
    n = len(secrets.ALPHABET) + 1
    counts = [[0] * n for _ in range(n)]
    for s in samples:
        for a, b in zip(s, s[1:]):  # noqa: B905
            counts[at.get(a, 0)][at.get(b, 0)] += 1
    ends = [sum(row[b] for row in counts) for b in range(n)]
    single = [(e + 0.5) / (sum(ends) + 0.5 * n) for e in ends]
    return [[math.log((counts[a][b] + secrets.SMOOTH * single[b]) / (sum(counts[a]) + secrets.SMOOTH)) for b in range(n)] for a in range(n)], at


def test_ratio_equals_plain_counting(spark):
    rows = rows_with_secrets()
    table = secrets.keyed(spark.createDataFrame(rows, "doc_id long, text string")).select("row", "text")
    base = secrets.matches(table, secrets.BASE)
    models = secrets.transitions(secrets.labelled(table, base))
    strings, words = plain_samples(rows)
    (random_model, at), (ordinary, _) = plain_model(strings), plain_model(words)
    values = [*strings[:20], *words[:20], "getApplicationContextFactory", "x", "a b"]
    got = {r.v: r.x for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets.ratio(F.col("v"), models).alias("x")).collect()}
    for v in values:
        want = sum(random_model[at.get(a, 0)][at.get(b, 0)] - ordinary[at.get(a, 0)][at.get(b, 0)] for a, b in zip(v, v[1:]))  # noqa: B905
        assert abs(got[v] - want) < 1e-4 * max(1, len(v))


def test_a_long_text_with_secrets(spark):
    key = "AKIA" + "Q7W2K9R4B6V1H8L3"
    text = f"{'plain words go on ' * 20000}{key} {'and on ' * 20000}token = abcdef123"
    got = secrets.scanned(spark.createDataFrame([(1, text), (2, "plain words")], "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    start = text.index(key)
    assert by[1].spans == f"access:{start}:{start + 20},assign:{text.index('token')}:{len(text)}" and by[2].spans == ""


def test_slots_give_each_rank_a_place():
    rng = random.Random(3)
    for _ in range(30):
        histogram = {rng.randrange(1, 65): rng.randrange(1, 300) for _ in range(rng.randrange(1, 30))}
        seen, used = {}, {}
        for length, first, after, sequence, offset, copies in packing.slots(packing.shortest_pack_first(histogram, 64)):
            for rank in range(first, after):
                seen.setdefault(length, []).append(rank)
                used.setdefault(sequence + (rank - first) // copies, []).append((offset + length * ((rank - first) % copies), length))
        assert {n: sorted(r) for n, r in seen.items()} == {n: list(range(k)) for n, k in histogram.items()}
        for places in used.values():
            ends = [a + n for a, n in sorted(places)]
            assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 64

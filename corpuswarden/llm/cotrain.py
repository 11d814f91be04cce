"""Document quality by co-training of a text view and a page-metadata view.

The text view sees hashed byte 3-grams and, in steps, how common four kinds of characters are, how many words are
different, how many are like the one before, and how long they are; the metadata view sees host,
language, size and line counts, never the words. Both are naive Bayes models, whose sufficient statistics are
counts that tasks add up. They start from a sample of labelled documents. In each round both score *all* other
documents; of what one view is sure, calibrated on labelled documents kept aside, the other learns the counts.
Pseudo-labels are given anew in each round. At last the calibrated log-odds are added, less the prior's.

Only the labelled sample is bounded, to the ``LABELLED`` documents with the least hashes of their ids; labels
beyond it are not read, and their documents take part without them. A fourth of the sample is kept aside.

Defined results: null text is an empty text; nulls in the metadata are values like others; a document with
several labels is good if any says so; rows with equal ids count each; equal rows have equal scores; texts of any
length are read whole; without labels of both kinds every score is the share of good labels (0.5 without any); if
those kept aside are not of both kinds, the whole sample calibrates; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow, kept, slices, utf8
from .words import SPACE, mix, places, span_hashes

BITS = 15
META = 1 << 10
STEPS = 8
#: Kinds of bytes: marks (with all parts of letters beyond ASCII), capitals, digits, line breaks.
KINDS = np.zeros((4, 256), bool)
KINDS[0] = [not (chr(c).isalnum() and c < 128) and c != 95 and not SPACE[c] for c in range(256)]
KINDS[1, 65:91] = KINDS[2, 48:58] = KINDS[3, 10] = True
SHAPES = len(KINDS) + 3  # the kinds, the share of different words, of words like the one before, their mean length
#: Where the counts of n-grams, of shapes and of metadata begin, and how many there are.
PARTS = (0, 1 << BITS, (1 << BITS) + SHAPES * STEPS, (1 << BITS) + SHAPES * STEPS + META)
SIZE = PARTS[-1]
LABELLED = 6000
ROUNDS, SURE = 3, 0.9
GAIN = 20.0  # of a text's mean over its n-grams


class Views:
    """Features of a batch of texts: n-grams (and where each text's begin and end), shapes, metadata."""

    def __init__(self, batch: pa.RecordBatch):
        raw, starts = utf8(batch.column("text"))
        n, sizes = batch.num_rows, np.diff(starts)
        spaced = np.full(len(raw) + 3 * n, 32, np.uint8)
        doc = np.repeat(np.arange(n), sizes)
        spaced[np.arange(len(raw)) + 3 * doc + 2] = raw
        s = spaced.astype(np.uint64)
        self.grams = (mix((s[:-2] << np.uint64(16)) + (s[1:-1] << np.uint64(8)) + s[2:]) >> np.uint64(64 - BITS)).astype(np.int32) if n else np.zeros(0, np.int32)
        self.begin = starts[:-1] + 3 * np.arange(n)
        self.end = self.begin + sizes + 1
        begin, end = places(raw, starts)
        of = np.searchsorted(starts, begin, "right") - 1
        words = np.maximum(np.bincount(of, minlength=n), 1)
        counts = [np.diff(np.concatenate([[0], np.cumsum(kind[raw])])[starts]) for kind in KINDS]
        # Words of different texts are different here; their order does not matter.
        word = mix(span_hashes(raw, begin, end)) ^ mix(of.astype(np.uint64))
        each = np.unique(word, return_index=True)[1]
        same = np.bincount(of[1:][word[1:] == word[:-1]], minlength=n)
        distinct, letters = np.bincount(of[each], minlength=n), np.bincount(of, end - begin, minlength=n).astype(np.int64)
        steps = [*(4 * c // words for c in counts), STEPS * distinct // (words + 1), STEPS * same // words, letters // words]
        self.shapes = np.stack([PARTS[1] + STEPS * k + np.minimum(STEPS - 1, x) for k, x in enumerate(steps)], axis=1)
        lines = counts[3] + 1
        meta = zip(batch.column("source").to_pylist(), batch.column("lang").to_pylist(), sizes.tolist(), lines.tolist(), strict=True)
        self.meta = np.array([metadata(*m) for m in meta], np.int64).reshape(n, -1)

    def ranges(self, rows: np.ndarray) -> np.ndarray:
        """The n-grams of some texts one after another."""
        return np.concatenate([self.grams[a:b] for a, b in zip(self.begin[rows].tolist(), self.end[rows].tolist(), strict=True)]) if len(rows) else self.grams[:0]

    def scores(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of both views, not calibrated."""
        n = len(self.begin)
        if not n:
            return np.zeros(0), np.zeros(0)
        bounds = np.stack([self.begin, np.minimum(self.end, len(self.grams) - 1)], axis=1).ravel()
        sums = np.add.reduceat(w[self.grams], bounds)[::2]
        if self.end[-1] == len(self.grams):  # the last text's last n-gram is the array's last
            sums[-1] = w[self.grams[self.begin[-1] :]].sum()
        return GAIN * sums / (self.end - self.begin) + w[self.shapes].sum(axis=1), w[self.meta].sum(axis=1)


def metadata(source: str | None, lang: str | None, size: int, lines: int) -> list[int]:
    names = (f"s:{source}", f"l:{lang}", f"n:{size.bit_length()}", f"k:{lines.bit_length()}", f"m:{(size // max(1, lines)).bit_length()}", f"sl:{source}:{lang}")
    return [PARTS[2] + zlib.crc32(n.encode()) % META for n in names]


class Counts:
    """Counts of features by label."""

    def __init__(self):
        self.n = np.zeros((2, SIZE), np.int64)

    def add(self, views: Views, of_text: np.ndarray, of_meta: np.ndarray) -> None:
        """of_text, of_meta: the label from which that view learns each row, -1 for none."""
        for label in (0, 1):
            rows = np.flatnonzero(of_text == label)
            self.n[label, : PARTS[1]] += np.bincount(views.ranges(rows), minlength=PARTS[1])
            rest = np.concatenate([views.shapes[rows].ravel(), views.meta[of_meta == label].ravel()])
            self.n[label] += np.bincount(rest, minlength=SIZE)

    def batch(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.n)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(self.n.ravel()[at], pa.int64())], ["k", "n"])


def weights(counts: np.ndarray) -> np.ndarray:
    """Log ratio of each feature's smoothed frequencies among good and bad documents, by part."""
    out = np.empty(SIZE)
    for a, b in zip(PARTS[:-1], PARTS[1:], strict=True):
        c = counts[:, a:b] + 0.5
        share = np.log(c / c.sum(axis=1, keepdims=True))
        out[a:b] = share[1] - share[0]
    return out


def platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift under which the log-odds fit the labels: Newton steps on standardised log-odds, a little
    shrunk, halved until the loss falls. A view that tells nothing has slope 0."""
    if not len(s):
        return 1.0, 0.0
    centre, spread = float(s.mean()), float(s.std()) or 1.0
    x = np.stack([(s - centre) / spread, np.ones(len(s))], axis=1)
    v, shrink = np.zeros(2), np.array([0.01, 0.01])
    loss = lambda v: float(np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ v)).sum() + (shrink * v * v).sum() / 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (p - y) + shrink * v)
        size = 1.0
        while size > 1e-6 and loss(v - size * step) > loss(v):
            size /= 2
        v = v - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    if v[0] <= 0:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return 0.0, float(np.log(share / (1 - share)))
    return float(v[0] / spread), float(v[1] - v[0] * centre / spread)


def taught(text: np.ndarray, meta: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The labels that the text view and the metadata view learn from the other's calibrated log-odds; -1: none.

    The commoner label is only given to what is sure beyond its being common.
    """
    sure, usual = np.log(SURE / (1 - SURE)), np.log(prior / (1 - prior))
    label = lambda s: np.where(s >= sure + max(usual, 0), 1, np.where(s <= min(usual, 0) - sure, 0, -1))
    return label(meta), label(text)


def _sums(rows: DataFrame) -> np.ndarray:
    out = np.zeros(2 * SIZE, np.int64)
    for r in rows.groupBy("k").agg(F.sum("n").alias("n")).collect():  # at most 2 * SIZE rows
        out[r["k"]] = r["n"]
    return out.reshape(2, SIZE)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> dict:
    """Prior, and weights and calibration of both views. docs: doc_id, text, source, lang; labels: doc_id, quality."""
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = said.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    # A stated number of narrow rows at most.
    chosen = kept(chosen.withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(4)) == 3), "labelled")
    sample = kept(docs.join(F.broadcast(chosen), "doc_id"), "sample")
    others = docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    kinds = {(r["quality"], r["aside"]): r["n"] for r in sample.groupBy("quality", "aside").agg(F.count("*").alias("n")).collect()}  # four rows
    known = sum(kinds.values())
    prior = sum(n for (q, _), n in kinds.items() if q) / known if known else 0.5
    if not 0 < prior < 1:
        return {"prior": prior, "w": None}
    split = all((q, a) in kinds for q in (0, 1) for a in (False, True))

    def count_labels(batches):
        counts = Counts()
        for whole in batches:
            for batch in slices(whole, "text"):
                y = np.asarray(batch.column("quality").to_pylist(), np.int64)
                counts.add(Views(batch), y, y)
        yield counts.batch()

    first = _sums(in_arrow(sample.where("not aside") if split else sample, count_labels, "k int, n long"))
    judges = sample.where("aside") if split else sample

    def calibrated(w: np.ndarray) -> tuple:
        def run(batches):
            for whole in batches:
                for batch in slices(whole, "text"):
                    yield pa.RecordBatch.from_arrays([*map(pa.array, Views(batch).scores(w)), batch.column("quality")], ["t", "m", "y"])

        rows = in_arrow(judges, run, "t double, m double, y int").orderBy("t", "m", "y").collect()  # at most the sample
        t, m, y = (np.array([r[c] for r in rows], float) for c in ("t", "m", "y"))
        return platt(t, y), platt(m, y)

    counts = first
    for _ in range(rounds):
        w = weights(counts)
        (a, c), (b, d) = calibrated(w)

        def learn(batches):
            counts = Counts()
            for whole in batches:
                for batch in slices(whole, "text"):
                    views = Views(batch)
                    t, m = views.scores(w)  # noqa: B023
                    counts.add(views, *taught(a * t + c, b * m + d, prior))  # noqa: B023
            yield counts.batch()

        counts = first + _sums(in_arrow(others, learn, "k int, n long"))
    w = weights(counts)
    return {"prior": prior, "w": w, "cut": calibrated(w)}


def scored(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, text_score, meta_score, score (probabilities of good quality) and good of each row."""
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")])
    model = train(table, labels, labelled, rounds)  # 2^BITS + META weights and a few

    def run(batches):
        sure = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        for whole in batches:
            for batch in slices(whole, "text"):
                if model["w"] is None:
                    columns = [np.full(batch.num_rows, model["prior"])] * 3
                else:
                    (t, m), ((a, c), (b, d)) = Views(batch).scores(model["w"]), model["cut"]
                    prior = np.log(model["prior"] / (1 - model["prior"]))
                    columns = [sure(a * t + c), sure(b * m + d), sure(a * t + c + b * m + d - prior)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns), pa.array(columns[2] >= 0.5)], ["doc_id", "text_score", "meta_score", "score", "good"])

    return in_arrow(table, run, "doc_id long, text_score double, meta_score double, score double, good boolean")

"""Interpolated modified Kneser-Ney word trigrams, counted in Spark and mapped by the workers that score.

Words are counted first, as 64-bit hashes; a word's number is its rank among all sorted hashes. Two words are one
64-bit number; mixed one-to-one it is the key of a pair, so shards are even. Tasks count
trigrams in arrays and send them, sorted and packed as differences, to the shard that the first bits of the key of
the first two words name. So a shard holds all that follows a context: its total and how many words follow it once,
twice, more often. Each distinct trigram then counts once for its last two words in the shard of that pair, which
makes the counts of the lower order (how many words precede a pair), and likewise pairs for words. Every shard
becomes files of sorted hashes and counts in the shared folder. Contexts that occur once are not stored: that the
pair exists says all about them. Nothing but one row of sums for each shard reaches the driver.

Two beginnings precede each text, so its first words have contexts too. Words are counted by 64-bit hashes of their
bytes; pairs and trigrams are counted exactly and then looked up by 32 bits of their hashes within buckets of about 8,
so about one lookup in 500 million of what was never seen finds a count that isn't its own, at every size. A file of
the model that was written and is gone is an error.

Defined results: null or empty text is one end token; with no training text at all every token has
probability 1; texts of any length are scored whole; equal rows count and score each for itself; an empty table
gives an empty result; columns that are not asked for are ignored, and of those asked for the ones named like the
scores give way to these.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, in_arrow, map_arrays, put_arrays, shared_dir, slices, utf8
from .words import LOWER, mix, places, span_hashes

END, BEGIN = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
HELD = 2_000_000  # entries that a counting task holds before it sends them
LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Model:
    uri: str
    bits: int
    bases: tuple[int, ...]  # number of the first word of each shard
    tokens: int
    words: int
    cuts: tuple[tuple[float, float, float], ...]  # discounts of words, of pairs, of trigrams
    kinds: tuple[int, int, int]  # words that follow one, two, more others
    pairs: int  # distinct pairs
    files: frozenset[tuple[str, int]]  # kind and shard of what was written


def stream(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of all texts in order, each text closed by its end; where each text begins."""
    raw, starts = utf8(batch.column(column))
    begin, end = places(raw, starts)
    doc = np.searchsorted(starts, begin, "right") - 1
    n = batch.num_rows
    first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]) + np.arange(n + 1)
    out = np.full(len(begin) + n, END, np.uint64)
    out[np.arange(len(begin)) + doc] = span_hashes(raw, begin, end, LOWER)
    return out, first


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(c, at).astype(c.dtype) if len(at) else c


class Tally:
    """Counts of 64-bit keys, sent as a row for each shard."""

    def __init__(self, bits: int):
        self.bits, self.keys, self.counts, self.held = bits, [], [], 0

    def add(self, keys: np.ndarray):
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c.astype(np.uint32))
        self.held += len(k)
        if self.held > HELD:
            k, c = merged(self.keys, self.counts)
            self.keys, self.counts, self.held = [k], [c], len(k)
            if len(k) > HELD // 2:
                yield from self.flush()

    def flush(self):
        if not self.keys:
            return
        k, c = merged(self.keys, self.counts)
        self.keys, self.counts, self.held = [], [], 0
        ends = np.searchsorted(k, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        rows = [(s, int(b - a), packed(np.diff(k[a:b], prepend=np.uint64(0))), packed(c[a:b])) for s, (a, b) in enumerate(zip([0, *ends], [*ends, len(k)], strict=True)) if b > a]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["shard", "n", "keys", "counts"])


BLOCK = "shard int, n long, keys binary, counts binary"


def blocks(part: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    rows = part.select(["n", "keys", "counts"]).to_pylist()
    keys = [np.cumsum(unpacked(r["keys"], r["n"], np.uint64), dtype=np.uint64) for r in rows]
    k, c = merged(keys, [unpacked(r["counts"], r["n"], np.uint32).astype(np.uint64) for r in rows])
    return part.column("shard")[0].as_py(), k, c


def packed(x: np.ndarray) -> bytes:
    """The bytes of the numbers, all first bytes first, compressed."""
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T), asbytes=True)


def unpacked(raw: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw, n * size), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


GRAMS = "shard int, n long, pairs binary, words binary, counts binary"


def sent(pairs: np.ndarray, words: np.ndarray | None, counts: np.ndarray, bits: int) -> list[tuple]:
    """A row of ``GRAMS`` for each shard of sorted pairs, their third words (if any) and counts."""
    shard = (mix(pairs) >> np.uint64(64 - bits)).astype(np.uint32)
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(1, 1 << bits))
    rows = []
    for s, (a, b) in enumerate(zip([0, *ends], [*ends, len(order)], strict=True)):
        if b > a:
            own = order[a:b]
            rows.append((s, int(b - a), packed(np.diff(pairs[own], prepend=np.uint64(0))), packed(words[own]) if words is not None else b"", packed(counts[own].astype(np.uint32))))
    return rows


def received(part: pa.Table) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Pairs, third words (if any) and counts of all rows of a shard, one after another."""
    columns = ([], [], [])
    for row in part.to_batches(1):
        for r in row.to_pylist():
            n = r["n"]
            columns[0].append(np.cumsum(unpacked(r["pairs"], n, np.uint64), dtype=np.uint64))
            if r["words"]:
                columns[1].append(unpacked(r["words"], n, np.uint32))
            columns[2].append(unpacked(r["counts"], n, np.uint32))
    pairs, words, counts = (np.concatenate(x) if x else None for x in columns)
    return pairs, words, counts


def summed(pairs: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams in order, and the sums of their counts."""
    order = np.lexsort((words, pairs))
    pairs, words, counts = pairs[order], words[order], counts[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]) | (words[1:] != words[:-1])
    at = np.flatnonzero(new)
    return pairs[at], words[at], np.add.reduceat(counts, at) if len(at) else counts


def gram_keys(pairs: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of trigrams; the first bits are those of the key of their first two words."""
    context = mix(pairs)
    top = np.uint64(64 - bits)
    return (context >> top << top) | (mix(context + (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(bits))


def placed(keys: np.ndarray, bits: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each key of a shard, from ``depth`` bits behind those of the shard, and the 32 bits that follow."""
    rest = keys << np.uint64(bits)
    bucket = (rest >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(keys), np.int64)
    return bucket, ((rest << np.uint64(depth)) >> np.uint64(32)).astype(np.uint32)


def put_counts(uri: str, bits: int, keys: np.ndarray, counts: np.ndarray, **more: np.ndarray) -> None:
    """Keys in order, as buckets of about 8 and 32 bits of each, with counts of half a byte; larger ones stand apart."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    depth = max(0, min(len(keys).bit_length() - 3, 32 - bits))
    bucket, part = placed(keys, bits, depth)
    half = np.minimum(counts, 15).astype(np.uint8)
    half = np.append(half, np.uint8(0)) if len(half) % 2 else half
    large = np.flatnonzero(counts >= 15)
    starts = np.searchsorted(bucket, np.arange((1 << depth) + 1))
    put_arrays(uri, {"part": part, "starts": least(starts), "half": half[0::2] | half[1::2] << 4, "large_at": least(large), "large_count": least(counts[large]), **more})


def least(x: np.ndarray) -> np.ndarray:
    """The numbers in the narrowest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


class Words:
    """Numbers and statistics of words, from the mapped files."""

    def __init__(self, uri: str, bits: int, bases: tuple[int, ...], written: frozenset[tuple[str, int]]):
        self.uri, self.bits, self.bases, self.written, self.files = uri, bits, bases, written, {}

    def file(self, kind: str, shard: int) -> dict | None:
        if (kind, shard) not in self.files:
            self.files[kind, shard] = map_arrays(f"{self.uri}/{kind}{shard:05d}.arr") if (kind, shard) in self.written else None
        return self.files[kind, shard]

    def shards(self, kind: str, sorted_keys: np.ndarray):
        """(slice of the query, shard, file) for each shard with queries."""
        ends = np.searchsorted(sorted_keys, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        for shard, (a, b) in enumerate(zip([0, *ends], [*ends, len(sorted_keys)], strict=True)):
            if b > a and (x := self.file(kind, shard)):
                yield slice(a, b), shard, x

    def find(self, kind: str, key: str, sorted_keys: np.ndarray):
        """(slice of the query, shard, file, place in it, whether it is there) for each shard with queries."""
        for where, shard, x in self.shards(kind, sorted_keys):
            if len(x[key]):
                asked = sorted_keys[where]
                at = np.minimum(np.searchsorted(x[key], asked), len(x[key]) - 1)
                yield where, shard, x, at, x[key][at] == asked

    def numbers(self, sorted_hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 if it isn't known."""
        out = np.full(len(sorted_hashes), -1, np.int64)
        for where, shard, _, at, there in self.find("word", "hash", sorted_hashes):
            out[where] = np.where(there, self.bases[shard] + at, -1)
        return out


    def counts(self, kind: str, sorted_keys: np.ndarray) -> np.ndarray:
        """Count of each key, 0 if it isn't there."""
        out = np.zeros(len(sorted_keys))
        for where, _, x in self.shards(kind, sorted_keys):
            part, starts = x["part"], x["starts"]
            bucket, asked = placed(sorted_keys[where], self.bits, (len(starts) - 1).bit_length() - 1)
            low, end = starts[bucket].astype(np.int64), starts[bucket + 1].astype(np.int64)
            high = end.copy()
            while (open_ := low < high).any():  # all searches within their buckets step by step together
                mid = (low + high) >> 1
                less = open_ & (part[np.minimum(mid, len(part) - 1)] < asked)
                low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
            there = np.flatnonzero(low < end)
            there = there[part[low[there]] == asked[there]]
            at = low[there]
            c = (x["half"][at >> 1] >> ((at & 1) * 4).astype(np.uint8) & 15).astype(float)
            if (big := np.flatnonzero(c == 15)).size:
                c[big] = x["large_count"][np.searchsorted(x["large_at"], at[big])]
            out[where][there] = c
        return out


def before(numbers: np.ndarray, first: np.ndarray, begin: int) -> np.ndarray:
    """The number of the token before each token; before a text stands its beginning."""
    out = np.empty_like(numbers)
    out[1:] = numbers[:-1]
    out[first[:-1]] = begin
    return out


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many keys have count 1, 2, 3, 4; plain halves where too few do."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, 5).astype(np.int64), minlength=6)[1:5].astype(np.int64)


def train(texts: DataFrame) -> Model:
    """Count all rows of the column ``text``."""
    spark = texts.sparkSession
    texts = texts.select(F.col("text").cast("string").alias("text"))
    bits = max(2, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    uri = shared_dir(spark, "ngrams")

    def count_words(batches):
        tally = Tally(bits)
        for whole in batches:
            for batch in slices(whole, "text"):
                tokens, _ = stream(batch)
                yield from tally.add(np.concatenate([tokens, np.full(batch.num_rows, BEGIN)]))
        yield from tally.flush()

    def write_words(part: pa.Table) -> pa.Table:
        shard, k, c = blocks(part)
        put_arrays(f"{uri}/word{shard:05d}.arr", {"hash": k, "count": c})
        begins = int(c[k == BEGIN].sum())
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(k)], pa.int64()), "tokens": pa.array([int(c.sum()) - begins], pa.int64())})

    sizes = {r["shard"]: r for r in in_arrow(texts, count_words, BLOCK).groupBy("shard").applyInArrow(write_words, "shard int, n long, tokens long").collect()}
    each = [sizes[s]["n"] if s in sizes else 0 for s in range(1 << bits)]
    bases = tuple(int(x) for x in np.concatenate([[0], np.cumsum(each)]))
    written = frozenset(("word", s) for s in sizes)
    tokens, words = sum(r["tokens"] for r in sizes.values()), max(0, bases[-1] - 1)
    if bases[-1] >= 1 << 32:
        raise ValueError("more than 2^32 distinct words")

    grams = [x.split()[0] for x in GRAMS.split(", ")]
    gram_kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 3]

    def table_of(rows: list[tuple], kinds: list, names: list[str]) -> pa.Table:
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def count_grams(batches):
        table = Words(uri, bits, bases, written)
        begin = int(table.numbers(np.array([BEGIN]))[0])
        held: list[tuple] = []
        size = 0

        def flush():
            for row in sent(*held.pop(), bits):
                yield table_of([row], gram_kinds, grams).to_batches()[0]

        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                tokens, first = stream(batch)
                distinct, inverse = np.unique(tokens, return_inverse=True)
                last = table.numbers(distinct)[inverse]
                middle = before(last, first, begin)
                held.append((joined(before(middle, first, begin), middle), last.astype(np.uint32), np.ones(len(last), np.uint32)))
                size += len(last)
                if size > HELD:
                    held[:] = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from flush()
                        size = 0
        if held:
            held[:] = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            yield from flush()

    def write_grams(part: pa.Table) -> pa.Table:
        shard = part.column("shard")[0].as_py()
        pairs, last, c = received(part)
        pairs, last, c = summed(pairs, last, c.astype(np.uint64))
        at = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        total, n1, n2, n3 = (np.add.reduceat(x.astype(np.uint64), at) for x in (c, c == 1, c == 2, c >= 3))
        context = pairs[at]
        stored = np.flatnonzero((total > 1) | (context >> np.uint64(32) == context & LOW))  # two beginnings are no pair
        stored = stored[np.argsort(mix(context[stored]))]
        put_counts(f"{uri}/gram{shard:05d}.arr", bits, gram_keys(pairs, last, bits), c, context=mix(context[stored]), total=least(total[stored]), n1=least(n1[stored]), n2=least(n2[stored]), n3=least(n3[stored]))
        ends, n = np.unique(joined(pairs & LOW, last), return_counts=True)
        return table_of([(-1, shard, _of_counts(c).tobytes(), b"", b""), *sent(ends, None, n.astype(np.uint32), bits)], gram_kinds, grams)

    stats = "shard int, role int, keys binary, n0 binary, n1 binary, n2 binary, n3 binary"
    names = [x.split()[0] for x in stats.split(", ")]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    nothing = packed(np.zeros(0, np.uint32))

    def write_pairs(part: pa.Table) -> pa.Table:
        shard = part.column("shard")[0].as_py()
        if shard < 0:
            sums = sum((np.frombuffer(x, np.int64) for x in part.column("pairs").to_pylist()), np.zeros(4, np.int64))
            return table_of([(-2, 0, np.array(part.column("n").to_pylist(), np.int64).tobytes(), sums.tobytes(), b"", b"", b"")], kinds, names)
        pairs, _, c = received(part)
        pairs, c = merged([pairs], [c.astype(np.uint64)])
        put_counts(f"{uri}/pair{shard:05d}.arr", bits, mix(pairs), c)
        left, word = pairs >> np.uint64(32), (pairs & LOW).astype(np.uint32)
        rows = [(-1, 2, np.array([shard], np.int64).tobytes(), _of_counts(c).tobytes(), np.array([len(pairs)]).tobytes(), b"", b"")]

        def by_word(ids: np.ndarray, role: int, columns: list[np.ndarray]):
            ends = np.searchsorted(ids, np.array(bases[1:-1], dtype=np.int64))
            for s, (a, b) in enumerate(zip([0, *ends], [*ends, len(ids)], strict=True)):
                if b > a:
                    own = np.diff(ids[a:b] - bases[s], prepend=0).astype(np.uint32)
                    rows.append((s, role, np.int64(b - a).tobytes() + packed(own), *(packed(x[a:b].astype(np.uint64)) for x in columns), *[nothing] * (4 - len(columns))))

        ids, follows = np.unique(word, return_counts=True)
        by_word(ids.astype(np.int64), 0, [follows])
        ids, at = np.unique(left, return_index=True)
        by_word(ids.astype(np.int64), 1, [np.add.reduceat(x.astype(np.uint64), at) for x in (c, c == 1, c == 2, c >= 3)])
        return table_of(rows, kinds, names)

    sums = "shard int, of_counts array<long>, more long, total long, shards array<long>"

    def summary(shard: int, of_counts: np.ndarray, more: int, total: int, shards: list[int]) -> pa.Table:
        return pa.table({"shard": pa.array([shard], pa.int32()), "of_counts": pa.array([of_counts.tolist()], pa.list_(pa.int64())), "more": pa.array([more], pa.int64()), "total": pa.array([total], pa.int64()), "shards": pa.array([shards], pa.list_(pa.int64()))})

    def write_stats(part: pa.Table) -> pa.Table:
        shard = part.column("shard")[0].as_py()
        if shard < 0:
            of_counts = sum((np.frombuffer(x, np.int64) for x in part.column("n0").to_pylist()), np.zeros(4, np.int64))
            shards = np.concatenate([np.frombuffer(x, np.int64) for x in part.column("keys").to_pylist()])
            total = sum(int(np.frombuffer(x, np.int64)[0]) for x in part.column("n1").to_pylist() if x)
            return summary(shard, of_counts, 0, total, shards.tolist())
        n = bases[shard + 1] - bases[shard]
        out = {name: np.zeros(n, np.uint64) for name in ("follows", "total", "n1", "n2", "n3")}
        for row in part.to_pylist():
            m = int(np.frombuffer(row["keys"][:8], np.int64)[0])
            at = np.cumsum(unpacked(row["keys"][8:], m, np.uint32), dtype=np.int64)
            for name, column in zip(("follows",) if row["role"] == 0 else ("total", "n1", "n2", "n3"), ("n0", "n1", "n2", "n3"), strict=False):
                out[name][at] += unpacked(row[column], m, np.uint64)
        put_arrays(f"{uri}/stat{shard:05d}.arr", {k: least(x) for k, x in out.items()})
        f = out["follows"]
        return summary(shard, _of_counts(f), int((f >= 3).sum()), int(f.sum()), [])

    shards = in_arrow(texts, count_grams, GRAMS).groupBy("shard").applyInArrow(write_grams, GRAMS)
    done = shards.groupBy("shard").applyInArrow(write_pairs, stats).groupBy("shard").applyInArrow(write_stats, sums).collect()
    of = {r["shard"]: r for r in done}
    of_grams, of_pairs = (np.array(of[k]["of_counts"]) if k in of else np.zeros(4) for k in (-2, -1))
    own = [r for r in done if r["shard"] >= 0]
    of_words = sum((np.array(r["of_counts"]) for r in own), np.zeros(4, np.int64))
    pairs = of[-1]["total"] if -1 in of else 0
    written |= {("stat", r["shard"]) for r in own} | {(kind, s) for kind, k in (("gram", -2), ("pair", -1)) if k in of for s in of[k]["shards"]}
    return Model(uri, bits, bases, tokens, words, (discounts(of_words), discounts(of_pairs), discounts(of_grams)), (int(of_words[0]), int(of_words[1]), sum(r["more"] for r in own)), pairs, written)


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(docs: DataFrame, model: Model, *, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and, for the column ``text``, log10 probabilities of the add-one base and of the model."""
    keep = [k for k in keep if k not in {x.split()[0] for x in SCORES.split(", ")}]
    (own,) = fresh(keep, "text")
    docs = docs.select(*keep, F.col("text").cast("string").alias(own))
    schema = "".join(f"`{n}` {t}, " for n, t in docs.select(*keep).dtypes) + SCORES

    def run(batches):
        table = Words(model.uri, model.bits, model.bases, model.files)
        begin = int(table.numbers(np.array([BEGIN]))[0])
        (w1, w2, w3), (p1, p2, p3), (g1, g2, g3) = model.cuts
        base_total = model.tokens + model.words + 1
        spare = (w1 * model.kinds[0] + w2 * model.kinds[1] + w3 * model.kinds[2]) / model.pairs if model.pairs else 1.0
        for whole in batches:
            for batch in slices(whole, own):
                tokens, first = stream(batch, own)
                distinct, inverse = np.unique(tokens, return_inverse=True)
                n = len(distinct)
                numbers, counts = np.full(n, -1, np.int64), np.zeros(n)
                lower, total, left = np.full(n, spare / (model.words + 1)), np.zeros(n), np.ones(n)
                for where, shard, x, at, there in table.find("word", "hash", distinct):
                    numbers[where] = np.where(there, model.bases[shard] + at, -1)
                    counts[where] = np.where(there, x["count"][at], 0)
                    s = table.file("stat", shard)
                    f = s["follows"][at].astype(float)
                    lower[where] += np.where(there, np.maximum(f - np.where(f == 1, w1, np.where(f == 2, w2, w3)), 0) / max(model.pairs, 1), 0)
                    total[where] = np.where(there, s["total"][at], 0)
                    left[where] = p1 * s["n1"][at] + p2 * s["n2"][at] + p3 * s["n3"][at]
                begin_stats = (0.0, 1.0)
                if begin >= 0:
                    s, at = table.file("stat", shard := int(BEGIN >> np.uint64(64 - model.bits))), begin - model.bases[shard]
                    begin_stats = (float(s["total"][at]), float(p1 * s["n1"][at] + p2 * s["n2"][at] + p3 * s["n3"][at]))
                last = numbers[inverse]
                middle = before(last, first, begin)
                ahead = before(middle, first, begin)

                # how many words precede each pair
                both = np.flatnonzero((last >= 0) & (middle >= 0))
                asked, back = np.unique(mix(joined(middle[both], last[both])), return_inverse=True)
                c = np.zeros(len(last))
                c[both] = table.counts("pair", asked)[back]
                t, g = np.empty(len(last)), np.empty(len(last))
                t[1:], g[1:] = total[inverse[:-1]], left[inverse[:-1]]
                t[first[:-1]], g[first[:-1]] = begin_stats
                p = lower[inverse]
                cut = np.where(c == 1, p1, np.where(c == 2, p2, p3))
                p = np.where(t > 0, (np.maximum(c - cut, 0) + g * p) / np.where(t > 0, t, 1), p)

                # contexts of two words: a pair that exists occurs once, if nothing else is stored of it
                t, g = np.zeros(len(last)), np.full(len(last), g1)
                t[1:] = c[:-1] > 0
                t[first[:-1]] = 0
                there = np.flatnonzero((t > 0) | (middle == begin) & (begin >= 0))
                asked, back = np.unique(mix(joined(ahead[there], middle[there])), return_inverse=True)
                more_t, more_g = np.zeros(len(asked)), np.zeros(len(asked))
                for where, _, x, at, found in table.find("gram", "context", asked):
                    more_t[where] = np.where(found, x["total"][at], 0)
                    more_g[where] = g1 * x["n1"][at] + g2 * x["n2"][at] + g3 * x["n3"][at]
                stored = more_t[back] > 0
                t[there[stored]], g[there[stored]] = more_t[back][stored], more_g[back][stored]
                known = np.flatnonzero((t > 0) & (c > 0))
                asked, back = np.unique(gram_keys(joined(ahead[known], middle[known]), last[known], model.bits), return_inverse=True)
                c = np.zeros(len(last))
                c[known] = table.counts("gram", asked)[back]
                cut = np.where(c == 1, g1, np.where(c == 2, g2, g3))
                p = np.where(t > 0, (np.maximum(c - cut, 0) + g * p) / np.where(t > 0, t, 1), p)
                sums = lambda v: np.add.reduceat(v, first[:-1])  # noqa: E731, B023
                n_tokens = np.diff(first)
                value = sums(np.log10(p))
                columns = [n_tokens, sums((counts > 0)[inverse].astype(np.int64)), np.full(len(n_tokens), model.tokens), sums(np.log10((counts + 1) / base_total)[inverse]), value, 10 ** np.minimum(-value / n_tokens, 300)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *(pa.array(x) for x in columns)], [*keep, *(x.split()[0] for x in SCORES.split(", "))])

    return in_arrow(docs, run, schema)

"""Fingerprints of documents from prefix polynomial hashes.

A text's prefix arrays hold, for two primes, the sum of (code point + 1) * base^place over each prefix. Two spans
are equal if the differences of their ends, moved to the same place, are: any span in constant time, and the
longest common extension of two places by halving. Hashes of the windows before each place, from the same arrays,
choose the places where a text is cut, so that texts with a passage in common are cut alike in it. A cut's level
is the number of zero bits in front of its hash; a text keeps the cuts of the least level that leaves at most ``CUTS``.

The fingerprint holds length, cuts, their levels and the prefix hashes there, hence the hash of each span between
cuts. Likeness is the share of the longer text in spans that both have: their common beginning and end, found by
halving over prefix hashes, and between them the spans that stand in both, each as often as it does in both.
Fingerprints of texts of other lengths are compared at the higher of their levels.

Documents are followed by the next in ascending order without a global sort in one task: the order (doc_id, hash
and length of the text) is cut in buckets by range, each bucket is read in order as a stream, and the first
document of each is a guest at the end of the bucket before. The buckets' first keys and the keys of frequent
equal rows (``HOT`` at most) are all that reaches the driver.

Defined results: a null text is empty; null doc_ids come last; rows of equal ids follow each other by hash and
length of their texts; equal rows have results each, of which one has what follows and the others each other;
a single document follows itself; two empty texts are alike (1), an empty and another are not (0); an empty table
gives an empty result; texts of any length are read whole; other columns are ignored by ``successors`` and kept
by ``fingerprinted``.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, in_arrow, kept, slices, utf8

PRIMES = (2147483647, 2147483629)  # the two largest primes below 2^31
BASES = (1020847823, 1733214197)
WINDOW = 8  # code points before a place that decide whether it is a cut
CUTS = 32
LEAST_SPAN = 8  # code points of a span that counts between the common beginning and end
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
MOST_BUCKETS = 20_000
HOT = 10_000  # keys of equal rows that are worked on once
BUCKET_CHARS = 16 << 20

_P = np.array(PRIMES, np.uint64)[:, None]
_C = np.uint64(1 << 31) - _P
_LOW, _31 = np.uint64((1 << 31) - 1), np.uint64(31)
_kept_powers = [np.ones((2, 1), np.uint64), np.ones((2, 1), np.uint64)]
KEPT_POWERS = 1 << 20


def _mod(x: np.ndarray, rows: slice = slice(0, 2)) -> np.ndarray:
    """Numbers below 2^62 modulo each row's prime 2^31 - c, in place: what stands above 31 bits counts c times."""
    high = np.empty_like(x)
    for _ in range(2):
        np.right_shift(x, _31, out=high)
        x &= _LOW
        high *= _C[rows]
        x += high
    np.subtract(x, _P[rows], out=high)  # of unsigned numbers: it wraps where it would be negative
    return np.minimum(x, high, out=x)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 to base^n for both primes, and the same of the inverses."""
    if _kept_powers[0].shape[1] > n:
        return _kept_powers[0][:, : n + 1], _kept_powers[1][:, : n + 1]
    out = []
    for bases in (BASES, [pow(b, -1, p) for b, p in zip(BASES, PRIMES, strict=True)]):
        table = np.ones((2, 1), np.uint64)
        while table.shape[1] <= n:
            k = table.shape[1]
            steps = np.array([[pow(b, k, p)] for b, p in zip(bases, PRIMES, strict=True)], np.uint64)
            table = np.concatenate([table, _mod(table * steps)], axis=1)
        out.append(table)
    if n <= KEPT_POWERS:
        _kept_powers[:] = out
    return out[0][:, : n + 1], out[1][:, : n + 1]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prefixes(points: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Prefix hashes (2 by n + 1) of a text, or of one whose prefix hashes ``before`` are known, followed by it."""
    before = np.zeros((2, 1), np.uint64) if before is None else before
    at, n = before.shape[1] - 1, len(points)
    if not n:
        return before
    up = _powers(at + n)[0][:, at : at + n]
    sums = np.cumsum(_mod((points.astype(np.uint64) + np.uint64(1)) * up), axis=1)
    return np.concatenate([before, _mod(sums + before[:, -1:])], axis=1)


def span(hashes: np.ndarray, begin, end) -> np.ndarray:
    """Hashes (2 by k) of spans, the same wherever they stand."""
    begin, end = np.atleast_1d(begin), np.atleast_1d(end)
    down = _powers(hashes.shape[1] - 1)[1]
    return _mod(_mod(hashes[:, end] + _P - hashes[:, begin]) * down[:, begin])


def common_extension(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """How many code points agree from place i of one text and place j of the other on, by halving."""
    top = max(i, j)
    down = _powers(top)[1][:, [i, j]].tolist() if top else [[1, 1], [1, 1]]
    low, high = 0, min(a.shape[1] - 1 - i, b.shape[1] - 1 - j)
    rows = [(p, x, y, int(x[i]), int(y[j]), d, e) for p, x, y, (d, e) in zip(PRIMES, a, b, down, strict=True)]
    while low < high:
        mid = (low + high + 1) // 2
        if all((int(x[i + mid]) - u) * d % p == (int(y[j + mid]) - v) * e % p for p, x, y, u, v, d, e in rows):
            low = mid
        else:
            high = mid - 1
    return low


def _zeros(x: np.ndarray) -> np.ndarray:
    """Zero bits in front."""
    return 64 - np.frexp(x.astype(float))[1].astype(np.int64)


def windows(hashes: np.ndarray, begin: int) -> np.ndarray:
    """64-bit hashes of the windows before each place from ``begin`` on, but for the end."""
    n = hashes.shape[1] - 1
    if n <= begin:
        return np.zeros(0, np.uint64)
    one = slice(0, 1)
    apart = hashes[one, begin:n] + _P[one] - hashes[one, begin - WINDOW : n - WINDOW]
    return (_mod(_mod(apart, one) * _powers(n)[1][one, begin - WINDOW : n - WINDOW], one)[0] + np.uint64(1)) * _SPREAD


class Fingerprint:
    """n, places of the cuts, their levels, the least level, prefix hashes at the cuts and the end."""

    def __init__(self, n: int, level: int, cuts: np.ndarray, levels: np.ndarray, hashes: np.ndarray):
        self.n, self.level, self.cuts, self.levels, self.hashes = n, level, cuts, levels, hashes
        self._at: dict[int, tuple] = {}

    @classmethod
    def of(cls, hashes: np.ndarray, seen: np.ndarray | None = None) -> Fingerprint:
        """From prefix hashes, and the hashes of the windows if they are known."""
        n = hashes.shape[1] - 1
        seen = windows(hashes, WINDOW) if seen is None else seen
        about = max(0, (len(seen) // (4 * CUTS)).bit_length() - 1)  # a level that leaves more than enough, mostly
        while True:
            at = np.flatnonzero(seen < np.uint64(1 << (64 - about))) if about else np.arange(len(seen))
            levels = _zeros(seen[at])
            least = np.bincount(levels, minlength=66)[::-1].cumsum()[::-1]  # cuts of at least each level
            level = int((least > CUTS).sum())
            if level > about or not about:
                break
            about = 0
        stay = levels >= level
        cuts = at[stay] + WINDOW
        return cls(n, level, cuts.astype(np.uint32), levels[stay].astype(np.uint8), hashes[:, np.append(cuts, n)].astype(np.uint32))

    @functools.cached_property
    def text(self) -> str:
        head = np.array([self.n, self.level], "<u4").tobytes()
        return base64.b64encode(head + self.cuts.astype("<u4").tobytes() + self.levels.tobytes() + self.hashes.astype("<u4").tobytes()).decode()

    def __str__(self) -> str:
        return self.text

    @classmethod
    def read(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        n, level = np.frombuffer(raw, "<u4", 2).tolist()
        k = (len(raw) - 16) // 13
        cuts = np.frombuffer(raw, "<u4", k, 8)
        levels = np.frombuffer(raw, np.uint8, k, 8 + 4 * k)
        return cls(n, level, cuts, levels, np.frombuffer(raw, "<u4", 2 * (k + 1), 8 + 5 * k).reshape(2, -1))

    def at(self, level: int) -> tuple[list[int], list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Bounds of the spans at a level, 0 and n among them, the prefix hashes there, and length and hashes of each span."""
        if level not in self._at:
            stay = [k for k, x in enumerate(self.levels.tolist()) if x >= level]
            cuts, last = self.cuts.tolist(), len(self.cuts)
            bounds = [0, *[cuts[k] for k in stay], self.n]
            begin, rows = bounds[:-1], []
            down = [[pow(pow(b, -1, p), x, p) for x in begin] for b, p in zip(BASES, PRIMES, strict=True)] if self.n > KEPT_POWERS else _powers(self.n)[1][:, begin].tolist()
            for p, h, d in zip(PRIMES, self.hashes.tolist(), down, strict=True):
                at = [0, *[h[k] for k in stay], h[last]]
                rows += [at, [(y - x) * z % p for x, y, z in zip(at, at[1:], d)]]  # noqa: B905
            sizes = [y - x for x, y in zip(bounds, bounds[1:])]  # noqa: B905
            self._at[level] = bounds, list(zip(rows[0], rows[2], strict=True)), list(zip(sizes, rows[1], rows[3], strict=True))
        return self._at[level]


def likeness_of(a: Fingerprint, b: Fingerprint) -> float:
    if not a.n or not b.n:
        return float(a.n == b.n)
    level = max(a.level, b.level)
    (x, hx, u), (y, hy, v) = a.at(level), b.at(level)
    low, high = 0, min(len(x), len(y)) - 1
    while low < high:  # the last bound up to which both are the same
        mid = (low + high + 1) // 2
        same = x[mid] == y[mid] and hx[mid] == hy[mid]
        low, high = (mid, high) if same else (low, mid - 1)
    lead = x[low]
    u, v = u[low:], v[low:]
    tail = 0
    while u and v and u[-1] == v[-1]:
        tail += u.pop()[0]
        v.pop()
    both = Counter(s for s in u if s[0] >= LEAST_SPAN) & Counter(s for s in v if s[0] >= LEAST_SPAN)
    return (lead + tail + sum(s[0] * k for s, k in both.items())) / max(a.n, b.n)


def likeness(a: str, b: str) -> float:
    """Of two fingerprints: the share of the longer text that stands in both, 0 to 1."""
    return 1.0 if a == b else likeness_of(Fingerprint.read(a), Fingerprint.read(b))


def fingerprint(text: str | None) -> str:
    return str(Fingerprint.of(prefixes(code_points(text or ""))))


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    raw, starts = utf8(batch.column(column))
    data, at = raw.tobytes(), starts.tolist()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def fingerprinted(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """All rows and columns of ``docs``, and the text's fingerprint in the column ``name`` (which must be free)."""
    names = docs.columns
    if name in names:
        raise ValueError(f"there is a column {name} already")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([fingerprint(t) for t in _texts(batch, text)], pa.string())], [*names, name])

    own = docs if docs.schema[text].dataType.simpleString() == "string" else docs.withColumn(text, F.col(text).cast("string"))
    return in_arrow(own, run, ", ".join(f"`{n}` {k}" for n, k in own.dtypes) + f", `{name}` string")


def in_order(docs: DataFrame) -> tuple[DataFrame, dict]:
    """The texts dealt to buckets of the ascending order, each bucket in one partition and in order, with its guest.

    Also the frequent keys of equal rows with their numbers; such rows come once a task that read them.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(F.col("doc_id").isNull().alias("nil"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("hash"), F.length("text").alias("size"), "text")
    names = ["nil", "doc_id", "hash", "size"]
    keys = kept(own.select(*names), "order")
    total = keys.agg(F.count("*").alias("rows"), F.sum("size").alias("chars")).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal = min(MOST_BUCKETS, max(4 * partitions, (total["chars"] or 0) // BUCKET_CHARS))
    firsts = keys.repartitionByRange(deal, *names).groupBy(F.spark_partition_id().alias("bucket")).agg(F.min(F.struct(*names)).alias("first")).collect()  # a key for each bucket
    often = keys.groupBy(*names).agg(F.count("*").alias("times")).where(F.col("times") >= max(1000, total["rows"] // HOT)).collect()  # HOT at most
    forget(keys)
    starts = sorted(tuple(r["first"]) for r in firsts)
    hot = {tuple(r)[:4]: r["times"] for r in often}
    place = {k: (b - 1) % len(starts) for b, k in enumerate(starts)}

    def deal_out(batches):
        given: set[tuple] = set()
        for batch in batches:
            rows, bucket, guest = [], [], []
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if key in hot:
                    if key in given:
                        continue
                    given.add(key)
                rows.append(k)
                bucket.append(bisect_right(starts, key) - 1)
                guest.append(False)
                if key in place:
                    rows.append(k)
                    bucket.append(place[key])
                    guest.append(True)
            part = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(guest, pa.bool_()), *part.columns], ["bucket", "guest", *names, "text"])

    dealt = in_arrow(own, deal_out, "bucket int, guest boolean, nil boolean, doc_id long, hash long, size int, text string")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", *names), hot


class _Document:
    def __init__(self, text: str):
        self.text, self.points = text, code_points(text)
        self.hashes = prefixes(self.points)
        self.windows = windows(self.hashes, WINDOW)
        self.mark = Fingerprint.of(self.hashes, self.windows)


def edited(points: np.ndarray, following: np.ndarray) -> tuple[int, np.ndarray]:
    """How much of a text stays, and what of the following text comes in its place, as many code points or all."""
    cut = len(points) // 4
    return len(points) - cut, following[:cut]


def successors(docs: DataFrame) -> DataFrame:
    """Each document compared with the next one and with its own text edited.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and how far the text
    and either agree from their beginning: common_edited, common_next.
    """
    dealt, hot = in_order(docs)
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long, times int"

    def result(key: tuple, a: _Document, b: _Document, times: int = 1) -> tuple:
        stay, more = edited(a.points, b.points)
        whole = prefixes(more, a.hashes[:, : stay + 1])
        first = max(WINDOW, min(stay + 1, whole.shape[1] - 1))  # the first window that ends in what is new
        mark = Fingerprint.of(whole, np.concatenate([a.windows[: first - WINDOW], windows(whole, first)]))
        text = a.text[:stay] + b.text[: len(more)]
        sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        near = [1.0 if str(a.mark) == str(m) else likeness_of(a.mark, m) for m in (mark, b.mark)]
        return (None if key[0] else key[1], len(a.points), sha, str(a.mark), str(mark), *near, common_extension(a.hashes, 0, whole, 0), common_extension(a.hashes, 0, b.hashes, 0), times)

    def run(batches):
        last = None  # key and document that wait for the next one
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                columns = [batch.column(c).to_pylist() for c in ("guest", "nil", "doc_id", "hash", "size")]
                for guest, *key, text in zip(*columns, _texts(batch, "text"), strict=True):
                    key = tuple(key)
                    if guest and last is None or not guest and last and key == last[0] and key in hot:
                        continue  # the bucket's guest again, or the same row from another task
                    document = last[1] if last and last[1].text == text else _Document(text)
                    if last:
                        rows.append(result(*last, document))
                        left = hot.get(last[0], 1) - 1
                        while left:
                            rows.append(result(*last, last[1], min(left, HOT)))
                            left -= min(left, HOT)
                    last = None if guest else (key, document)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=_SCHEMA)

    out = in_arrow(dealt, run, kinds)
    return out.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("one", "times")


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_edited", pa.int64()), ("common_next", pa.int64()), ("times", pa.int32())])

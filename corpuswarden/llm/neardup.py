"""Near-duplicate documents by Order MinHash and banded alignment.

Words are lower-cased (A-Z) runs without ASCII white space. A k-mer is five words; a text with fewer words is
one k-mer. For the sketches only, each k-mer is labelled with the number of times it stood before in the text.
For each of many hash functions the sketch keeps the few least labelled k-mers in the order of the text, so
that two sketches agree if the texts share k-mers *and* their order. Texts that agree in one of several bands
are candidates.

The similarity of two texts is the lesser of two: c / (n + m - c), with n and m their numbers of k-mers and c
the longest common subsequence, and the same ratio over their sets of k-mers, without which a passage
repeated hundreds of times would outweigh all else. Texts are linked from 0.8 on. The complements of both,
and so of their minimum, are metrics (the first is the Steinhaus form of the insertion-deletion distance); a
link leaves at most (n + m) / 9 insertions and deletions, which bounds the band of the alignment. A band's
key holds one sketch of all labelled k-mers and one of first occurrences.

Exact copies are one node. In each bucket every node is first compared with the bucket's best-connected node;
once the linked ones are one component, only nodes of different components are compared with each other, and
of these only those that lengths, the triangle inequality and a parity sketch of the sets leave open. So a group of any size costs
about its size and no link that joins two components is lost.

Defined results: a text without words (null, empty) is linked to nothing and is a class of its own; rows with
equal texts are one class; the class id is the least doc_id of the class (null doc_ids count last); an empty
table gives an empty result; texts of any length are compared whole; further columns are ignored by ``classes``
and kept by ``kept_documents``, whatever their names. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, fresh, in_arrow, kept, slices, utf8
from .words import LOWER, mix, places, span_hashes

SIMILARITY = 0.8
K = 5
SKETCH = 3  # k-mers of a sketch
BANDS = 24
PARITY = 11  # 2048 bits
STARS = 3  # rounds of comparisons with one node of each bucket
BLOCK = 256  # nodes of a bucket that are compared in one task with as many others
_SEEDS = mix(np.arange(1, 2 * BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """64-bit numbers of the k-mers of hashed words, without the occurrence."""
    n = len(words)
    if not n:
        return words
    out, width = np.zeros(max(1, n - k + 1), np.uint64), min(k, n)
    for j in range(width):
        out = mix(out + words[j : j + len(out)]) + np.uint64(j + 1)
    return out


def labelled(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each k-mer together with how often it stood before in the text, and whether it never did."""
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    new = np.r_[True, s[1:] != s[:-1]]
    if new.all():
        return mix(grams), np.ones(len(grams), bool)
    at = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return mix(grams + nth * np.uint64(0x9FB21C651E98DF25)), nth == 0


def least_in_order(grams: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each hash function a key of its least k-mers, in the order of the text."""
    n, size = len(grams), min(SKETCH, len(grams))
    keys = np.empty(len(seeds), np.uint64)
    step = max(1, (1 << 19) // n)
    for a in range(0, len(seeds), step):
        h = grams[None, :] * seeds[a : a + step, None]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        rows = np.arange(len(h))
        least = np.empty((len(h), size), np.int64)
        for j in range(size):
            least[:, j] = h.argmin(axis=1)
            h[rows, least[:, j]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        least.sort(axis=1)
        key = np.zeros(len(h), np.uint64)
        for j in range(size):
            key = mix(key + grams[least[:, j]])
        keys[a : a + step] = key
    return keys


def sketches(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band: a sketch of all labelled k-mers and one of first occurrences."""
    out = mix(np.arange(BANDS, dtype=np.uint64) + least_in_order(grams, _SEEDS[:BANDS]))
    return mix(out + least_in_order(grams if first.all() else grams[first], _SEEDS[BANDS:]))


def parity(grams: np.ndarray) -> np.ndarray:
    """A bit for each of many hash values, set if an odd number of the (different) k-mers have it.

    Two texts' bits differ in no more places than their sets do in k-mers: a bound that never rejects a link.
    """
    bits = np.bincount((mix(grams) >> np.uint64(64 - PARITY)).astype(np.int64), minlength=1 << PARITY).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def word_arrays(batch: pa.RecordBatch):
    """The hashed words of each row, and a 128-bit key of its words."""
    raw, starts = utf8(batch.column("text"))
    begin, end = places(raw, starts)
    hashes = span_hashes(raw, begin, end, LOWER)
    bounds = np.searchsorted(begin, starts).tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        words = hashes[a:b]
        yield words, xxhash.xxh3_128_digest(words.tobytes())


def text_key() -> list[Column]:
    """hash, size: with the doc_id, the same for rows of equal id and text."""
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("hash"), F.coalesce(F.length(text), F.lit(-1)).alias("size")]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key of the text, of the words (null without words), numbers of k-mers, parity sketch, keys of the bands."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                node, n, bands, distinct, odd = [], [], [], [], []
                for words, key in word_arrays(batch):
                    grams, first = labelled(kmers(words))
                    node.append(key if len(words) else None)
                    n.append(len(grams))
                    distinct.append(int(first.sum()))
                    odd.append(parity(grams[first]) if len(words) else None)
                    bands.append(sketches(grams, first).view(np.int64) if len(words) else None)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "hash", "size")), pa.array(node, pa.binary()), pa.array(n, pa.int32()), pa.array(distinct, pa.int32()), pa.array(odd, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "hash", "size", "node", "n", "distinct", "odd", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *text_key())
    return in_arrow(rows, run, "doc_id long, hash long, size int, node binary, n int, distinct int, odd array<long>, bands array<long>")


def node_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The hashed words of each wanted node, from the rows that stand for it: at.doc_id, at.hash and at.size."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                want = batch.column("node").to_pylist()
                found = [(key, words.tobytes()) for (words, key), w in zip(word_arrays(batch), want, strict=True) if key == w]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([w for _, w in found], pa.binary())], ["node", "words"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *text_key())
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"at.{c}")) for c in ("doc_id", "hash", "size")])
    met = own.join(wanted, same)  # at most one node for a row
    return in_arrow(met.select("node", "text"), run, "node binary, words binary").dropDuplicates(["node"])


def common_subsequence(x: np.ndarray, y: np.ndarray, most: int) -> int:
    """Length of the longest common subsequence, or -1 if more than ``most`` entries have to go.

    Furthest points on each diagonal for a growing number of insertions and deletions, all diagonals at once;
    how far two texts agree from a point on is found by halving over hashes of prefixes.
    """
    n, m = len(x), len(y)
    head = 0
    shorter = min(n, m)
    differs = np.flatnonzero(x[:shorter] != y[:shorter])
    head = int(differs[0]) if len(differs) else shorter
    x, y = x[head:], y[head:]
    shorter = min(len(x), len(y))
    differs = np.flatnonzero(x[len(x) - shorter :][::-1] != y[len(y) - shorter :][::-1])
    tail = int(differs[0]) if len(differs) else shorter
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    a, b = len(x), len(y)
    if not a or not b:
        return head + tail if a + b <= most else -1
    base = np.uint64(0xD6E8FEB86659FD93)
    up = np.cumprod(np.r_[np.uint64(1), np.full(max(a, b), base)], dtype=np.uint64)
    px = np.r_[np.uint64(0), np.cumsum(mix(x) * up[:a], dtype=np.uint64)]
    py = np.r_[np.uint64(0), np.cumsum(mix(y) * up[:b], dtype=np.uint64)]

    def slide(i: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        j = i - diagonal
        low, high = np.zeros(len(i), np.int64), np.minimum(a - i, b - j)
        low_ok = high >= 0
        high = np.maximum(high, 0)
        moving = np.flatnonzero(low_ok & (high > 0))
        if len(moving):  # most points cannot move at all
            moving = moving[x[i[moving]] == y[j[moving]]]
            low[moving] = 1
        while len(moving):
            mid = (low[moving] + high[moving] + 1) // 2
            im, jm = i[moving], j[moving]
            same = (px[im + mid] - px[im]) * up[np.maximum(jm - im, 0)] == (py[jm + mid] - py[jm]) * up[np.maximum(im - jm, 0)]
            low[moving] = np.where(same, mid, low[moving])
            high[moving] = np.where(same, high[moving], mid - 1)
            moving = moving[low[moving] < high[moving]]
        return i + low

    reach = slide(np.zeros(1, np.int64), np.zeros(1, np.int64))
    goal = a - b
    for d in range(most + 1):
        diagonals = np.arange(-d, d + 1, 2)
        if d:
            down = np.r_[reach, -2]  # insertion: from the diagonal above
            right = np.r_[-2, reach] + 1
            reach = np.maximum(down, right)
            inside = (reach <= a) & (reach - diagonals <= b) & (reach - diagonals >= 0) & (reach >= 0)
            moved = np.flatnonzero(inside)
            reach[moved] = slide(reach[moved], diagonals[moved])
        if abs(goal) <= d and (goal - d) % 2 == 0 and reach[(goal + d) // 2] >= a:
            return head + tail + (a + b - d) // 2
    return -1


def similarity(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> tuple[float, bool]:
    """(similarity, exact). Where it is clearly lower than asked for, an upper bound, and not exact."""
    x, y = kmers(x), kmers(y)
    n, m = len(x), len(y)
    if not n or not m:
        return 0.0, True
    (lx, fx), (ly, fy) = labelled(x), labelled(y)
    ratio = lambda c, a, b: c / (a + b - c)
    distinct = ratio(len(np.intersect1d(lx[fx], ly[fy], assume_unique=True)), int(fx.sum()), int(fy.sum()))
    # Labels pair each k-mer as often as it stands in both texts: no common subsequence is longer.
    bound = min(distinct, ratio(len(np.intersect1d(lx, ly, assume_unique=True)), n, m))
    if bound < least:
        return bound, False
    # c >= least * (n + m) / (1 + least), so at most so many entries of either text are left out
    c = common_subsequence(x, y, int(np.floor((n + m) * (1 - least) / (1 + least) + 1e-9)))
    return (min(distinct, ratio(c, n, m)), True) if c >= 0 else (np.nextafter(least, 0), False)


def compared(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """a, b, similarity of each pair of nodes. Beyond a link's reach it is an upper bound."""

    def run(batches):
        for batch in batches:
            sims = []
            x, y = batch.column("x"), batch.column("y")
            for k in range(batch.num_rows):
                sims.append(float(similarity(np.frombuffer(x[k].as_buffer(), np.uint64), np.frombuffer(y[k].as_buffer(), np.uint64))[0]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], ["a", "b", "sim"])

    left = words.select(F.col("node").alias("a"), F.col("words").alias("x"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("y"))
    return in_arrow(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a binary, b binary, sim double")


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node of each component, for nodes with links (columns a, b).

    Labels fall to the least label next to them, then to the label of their label, until none changes.
    """
    both = kept(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        of = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        lower = kept(lower.join(of, "root").select("node", "old", F.least("root", "further").alias("root")), "labels")
        forget(labels)
        labels = lower
        if not lower.where("root != old").take(1):
            forget(both)
            return lower.select("node", "root")


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``roots`` after further links; only components that these meet are looked at."""
    if roots is None:
        return components(links)
    a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    up = components(ends.where("a != b").distinct())
    old = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = up.join(roots.select("node"), "node", "left_anti").select("node", "root")
    return kept(old.unionByName(new), "roots")


def open_pairs(rooted: DataFrame, sims: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: nodes that share a bucket, lie in different components, and may be similar after all cheap bounds.

    A bucket's nodes are dealt to blocks of about ``BLOCK``; two blocks meet in a task of their own.
    """
    tops = rooted.groupBy("band").agg(F.max(F.struct("weight", "node")).alias("h"), F.count("*").alias("members")).select("band", F.col("h.node").alias("head"), F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    far = sims.select("a", "b", (1 - F.col("sim")).alias("far"))
    placed = rooted.join(tops, "band").select("band", "node", "n", "root", "head", "blocks", F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).join(far, ["a", "b"], "left")
    own = F.when(F.col("node") == F.col("head"), 0.0).otherwise(F.col("far"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = kept(placed.select("band", "node", "n", "root", own.alias("far"), "blocks", block.alias("block")).join(nodes.select("node", "distinct", "odd"), "node"), "open")
    names = ["band", "node", "n", "root", "far", "distinct", "odd"]
    x = rows.withColumn("hi", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).select(*names, F.col("block").alias("lo"), "hi").alias("x")
    y = rows.withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("block")))).select(*names, "lo", F.col("block").alias("hi")).alias("y")
    met = reduce(lambda p, q: p & q, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("band", "lo", "hi")])
    once = (F.col("x.lo") != F.col("x.hi")) | (F.col("x.node") < F.col("y.node"))
    reach = 1 - SIMILARITY
    # A known distance is exact up to the reach and a lower bound beyond it.
    beyond = ((F.col("x.far") <= reach) & (F.col("y.far") - F.col("x.far") > reach)) | ((F.col("y.far") <= reach) & (F.col("x.far") - F.col("y.far") > reach))
    differ = sum((F.bit_count(F.col("x.odd")[k].bitwiseXOR(F.col("y.odd")[k])) for k in range((1 << PARITY) // 64)), F.lit(0))
    possible = differ * (1 + SIMILARITY) <= (F.col("x.distinct") + F.col("y.distinct")) * (1 - SIMILARITY) + 1e-6
    pairs = x.join(y, met & once & (F.col("x.root") != F.col("y.root")) & close("x.n", "y.n") & ~F.coalesce(beyond, F.lit(False)) & possible)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct().join(sims, ["a", "b"], "left_anti")


def rooted_rows(docs: DataFrame) -> DataFrame:
    """doc_id, hash, size, root (null without words), n_links, n_kmers for each row; a class has one root.

    n_links: verified links of the row's text to other texts, as far as they were needed for the classes.
    """
    signed = kept(signatures(docs), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "hash", "size")).alias("at"), *(F.first(c).alias(c) for c in ("n", "distinct", "odd", "bands")))
    nodes = kept(nodes, "nodes")
    buckets = nodes.select("node", "n", F.explode("bands").alias("band"))
    sizes = buckets.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    sized = kept(buckets.join(sizes, "band"), "met")
    weights = kept(sized.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    met = kept(sized.drop("size").join(weights, "node"), "met")
    forget(sized)
    words = kept(node_words(docs, weights.select("node").join(nodes.select("node", "at"), "node")), "words")

    # Stars first: each bucket's nodes with the one that meets most others anywhere (of many copies, the one
    # that all were made from), then, where a bucket is still of several components, with the heaviest node of
    # a component that had none of its heads.
    sims = roots = before = None
    for _ in range(STARS):
        rooted = torn_buckets(met, roots)
        free = rooted
        if before is not None:
            served = rooted.join(before.select("band", F.col("head").alias("node")), ["band", "node"]).select("band", "root").distinct()
            free = rooted.join(served, ["band", "root"], "left_anti")
        heads = kept(free.groupBy("band").agg(F.max(F.struct("weight", "node", "n", "root")).alias("h")).select("band", F.col("h.node").alias("head"), F.col("h.n").alias("head_n"), F.col("h.root").alias("head_root")), "heads")
        before = heads if before is None else before.unionByName(heads)
        stars = rooted.join(heads, "band").where((F.col("root") != F.col("head_root")) & close("n", "head_n"))
        pairs = stars.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b"))
        if sims is None:
            # Most buckets of a node have the same head; once they are linked, its other heads are often too.
            often = kept(pairs.groupBy("a", "b").agg(F.count("*").alias("agree")).join(weights.select(F.col("node").alias("a"), F.col("weight").alias("wa")), "a").join(weights.select(F.col("node").alias("b"), F.col("weight").alias("wb")), "b"), "stars")
            lighter = F.when((F.col("wa") < F.col("wb")) | ((F.col("wa") == F.col("wb")) & (F.col("a") < F.col("b"))), F.col("a")).otherwise(F.col("b"))
            best = often.withColumn("light", lighter).groupBy("light").agg(F.max(F.struct("agree", "a", "b")).alias("x")).select("x.a", "x.b")
            sims = kept(compared(best, words), "sims")
            roots = components(sims.where(F.col("sim") >= SIMILARITY))
            pairs = often.select("a", "b")
        pairs = apart(pairs.distinct().join(sims, ["a", "b"], "left_anti"), roots)
        more = kept(compared(pairs, words), "sims")
        sims = sims.unionByName(more)
        roots = joined(roots, more.where(F.col("sim") >= SIMILARITY))

    # What is still apart within a bucket: all pairs that lengths and distances to a common node leave open.
    last = kept(compared(open_pairs(torn_buckets(met, roots), sims, nodes), words), "sims")
    links = kept(sims.unionByName(last).where(F.col("sim") >= SIMILARITY), "links")
    roots = joined(roots, last.where(F.col("sim") >= SIMILARITY))

    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    found = nodes.select("node").join(roots, "node", "left").join(degree, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = kept(signed.select("doc_id", "hash", "size", "node", F.col("n").alias("n_kmers")).join(found, "node", "left").drop("node"), "rows")
    forget(signed, nodes, weights, met, words, links)
    return rows


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, n_links, n_kmers for each row."""
    rows = rooted_rows(docs)
    sizes = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(sizes, "root", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("n_kmers").cast("long").alias("n_kmers"))


def close(n: str, m: str) -> Column:
    """Whether the numbers of k-mers allow a link."""
    return F.least(n, m) >= SIMILARITY * F.greatest(n, m)


def torn_buckets(met: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``met`` with the root of each node's component, for the buckets with more than one component."""
    if roots is None:
        return met.withColumn("root", F.col("node"))
    rooted = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    torn = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("band")
    return rooted.join(torn, "band")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components."""
    a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where("coalesce(ra, a) != coalesce(rb, b)").select("a", "b")


def alike(docs: DataFrame) -> DataFrame:
    """hash, size (see ``text_key``) and root of each text that is in one class with another text."""
    rows = rooted_rows(docs.select("doc_id", "text"))
    texts = rows.where("root is not null").select("root", "hash", "size").distinct()
    several = texts.groupBy("root").agg(F.count("*").alias("texts")).where("texts > 1")
    found = kept(texts.join(several, "root", "left_semi").select("hash", "size", "root"), "alike")
    forget(rows)
    return found


def kept_documents(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, and of each class only one row, with the class's doc_id; rows without words all stay.

    Of equal ids and texts that differ in other columns, the row with the least of these stays; columns without an
    order (maps) don't decide.
    """
    rows = rooted_rows(docs.select("doc_id", "text"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "size")
    one = rows.where("root is not null").groupBy("root", "doc_id", "hash", "size").agg(F.count("*").alias("times"))
    one = one.groupBy("root").agg(F.min(F.struct(key.alias("key"), "times")).alias("x")).select("x.key.doc_id", "x.key.hash", "x.key.size", "x.times")
    wordless = rows.where("root is null").select("doc_id", "hash", "size").distinct().withColumn("times", F.lit(1).cast("long"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    doc, hashed, size, times, own_hash, own_size = fresh(docs.columns, "doc", "hash", "size", "times", "own_hash", "own_size")
    chosen = kept(one.unionByName(wordless), "chosen").toDF(doc, hashed, size, times)
    forget(rows)
    of_text = text_key()
    own = docs.select(*names, of_text[0].alias(own_hash), of_text[1].alias(own_size))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(own_hash) == F.col(hashed)) & (F.col(own_size) == F.col(size))
    met = own.join(chosen, same)
    # Only rows that stand several times are brought together.
    ordered = F.struct(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not any(k in kind for k in ("map<", "variant"))])
    again = met.where(F.col(times) > 1).groupBy(doc, hashed, size).agg(F.min_by(F.struct(*names), ordered).alias("x"))
    return met.where(F.col(times) == 1).select(*names).unionByName(again.select(*[F.col(f"x.`{c}`") for c in docs.columns]))

"""Spelling variants: words that differ from a much more frequent word by one code point.

Occurrences are counted by tasks and added up. Two words at one edit share all before the edit or all behind it,
so one of their halves. Each word stands, as it is and reversed, in sorted lists of words that begin with the same
half; a list is scanned for each of its words with the edit matrix's band of three diagonals. Rows of the matrix
are kept for the prefix that adjacent words share (their LCP), and all words with a prefix whose row exceeds one
edit are passed over at once. The words of a block are scanned in step with each other, as arrays.

The sorted lists are cut in blocks by range, so a list of any length is dealt to several tasks; a word visits a
later block of its list unless the block's shared prefix already exceeds one edit. Only the blocks of cut lists
are broadcast: at most two for each block. A word has no more near words than one edit can make, whatever the
vocabulary, so no group of pairs grows with the data.

Defined results: a null text has no words; a null doc_id counts as an empty one in the hash; repeated rows are
occurrences each; texts and words of any length are read whole; an empty table gives an empty result; other
columns are ignored. Within a slice of a few MB, runs are told apart by 64-bit hashes; words are compared whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import forget, in_arrow, kept, slices, utf8
from .words import span_hashes

LEAST_LENGTH = 5  # code points of a word
LEAST_TIMES = 3  # occurrences of a word
DELETED = 97  # one in so many runs of a text loses a code point
SLICE = 1 << 21  # bytes of text that are worked on at once
HELD = 300_000  # different words that a task holds before it hands on their counts
BLOCK = 50_000  # entries of the sorted lists in a block, about
CELLS = 1 << 22  # code points of the words that are scanned at once

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_SHORT = 64  # bytes; longer runs are hashed one by one


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def runs(low: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of letters in lowered UTF-8, and its number of code points."""
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lead = low == 0xC3  # of U+00C0 to U+00FF
    letter = ((low >= 97) & (low <= 122)) | lead
    letter[1:] |= lead[:-1]
    edge = np.zeros(len(low) + 1, bool)
    edge[starts] = True
    edge[-1] = True
    before = np.r_[False, letter[:-1]]
    begin = np.flatnonzero(letter & (~before | edge[:-1]))
    after = np.r_[letter[1:], False]
    end = np.flatnonzero(letter & (~after | edge[1:])) + 1
    leads = np.r_[0, np.cumsum(lead)]
    return begin, end, end - begin - (leads[end] - leads[begin])


def crcs(low: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of what each ``state`` (a crc32) stands for followed by the span, all spans in step."""
    size = end - begin
    order = np.argsort(-np.minimum(size, _SHORT + 1), kind="stable")
    order = order[int((size > _SHORT).sum()) :]
    longest = np.bincount(size[order], minlength=1) if len(order) else np.zeros(1, np.int64)
    active = np.cumsum(longest[::-1])[::-1]  # spans with at least so many bytes
    c, at = ~state[order], begin[order]
    for k in range(len(active) - 1):
        m = int(active[k + 1])
        c[:m] = _CRC[(c[:m] ^ low[at[:m] + k]) & np.uint32(255)] ^ (c[:m] >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = ~c
    for k in np.flatnonzero(size > _SHORT).tolist():
        out[k] = zlib.crc32(low[begin[k] : end[k]].tobytes(), int(state[k]))
    return out


def counted(batch: pa.RecordBatch) -> dict[bytes, int]:
    """Occurrences of each word (UTF-8) in the batch's texts, after the deletions."""
    raw, starts = utf8(batch.column("text"))
    low = _LOW[raw]
    begin, end, points = runs(low, starts)
    long = points >= LEAST_LENGTH  # a deletion makes no run longer
    begin, end, points = begin[long], end[long], points[long]
    if not len(begin):
        return {}
    ids = ["" if x is None else str(x) for x in batch.column("doc_id").to_pylist()]
    state = np.array([zlib.crc32(f"{x}:".encode()) for x in ids], np.uint32)
    h = crcs(low, begin, end, state[np.searchsorted(starts, begin, "right") - 1])
    hit = h % DELETED == 0
    whole, data = ~hit, low.tobytes()
    _, first, times = np.unique(span_hashes(low, begin[whole], end[whole]), return_index=True, return_counts=True)
    b, e = begin[whole][first].tolist(), end[whole][first].tolist()
    out = {data[x:y]: k for x, y, k in zip(b, e, times.tolist(), strict=True)}
    for k in np.flatnonzero(hit & (points > LEAST_LENGTH)).tolist():
        word = data[begin[k] : end[k]].decode("utf-8", "replace")
        at = int(h[k]) % len(word)
        word = (word[:at] + word[at + 1 :]).encode()
        out[word] = out.get(word, 0) + 1
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts with their occurrences."""

    def run(batches):
        held: dict[bytes, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                for word, k in counted(batch).items():
                    held[word] = held.get(word, 0) + k
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(texts, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


def entries(words: DataFrame) -> DataFrame:
    """The lists that each word stands in: back (whether reversed), half that all share, word (in that order), n.

    Of two near words the shorter has m code points; they share the first or the last m // 2. So a word stands by
    the halves of its own length and of the length before.
    """
    halves = F.array_distinct(F.array(F.floor(F.length("word") / 2), F.greatest(F.floor((F.length("word") - 1) / 2), F.lit(1))))
    both = words.select("n", F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("word")), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("word")))).alias("x")).select("n", "x.back", "x.word")
    return both.select("back", F.explode(halves.cast("array<int>")).alias("size"), "word", "n").select("back", F.col("word").substr(F.lit(1), F.col("size")).alias("half"), "word", "n")


def scan(words: list[str], lists: np.ndarray, asks: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word, near word) of indices: for each of ``asks`` its near words in words[begin:end].

    ``words`` are in order within their lists (numbers in ``lists``). All scans go on in step: one row of the band
    for each at a time.
    """
    size = np.array([len(w) for w in words], np.int64)
    width = int(size.max()) + 2
    text = np.frombuffer(b"".join(w.encode("latin-1").ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    count = len(words)
    same = (text[1:] == text[:-1]) & (text[1:] != 0)
    lcp = np.full(count + 1, -1, np.int64)
    lcp[1:count] = np.where(lists[1:] == lists[:-1], np.where(same.all(axis=1), width, same.argmin(axis=1)), -1)
    # The end of the words from a place on that share their first d code points.
    over = np.empty((count, width), np.int32)
    nxt = np.full(width, count, np.int64)
    depth = np.arange(width)
    for p in range(count - 1, -1, -1):
        nxt = np.where(lcp[p + 1] < depth, p + 1, nxt)
        over[p] = nxt
    asked = np.zeros((len(asks), width + 2), np.uint8)
    asked[:, 1 : width + 1] = text[asks]
    goal = size[asks]
    rows = np.full((len(asks), width + 1, 3), 2, np.uint8)  # distance to the asked word's prefixes one shorter, as long, one longer
    rows[:, 0] = (2, 0, 1)
    near_a, near_b = [], []
    q = np.flatnonzero(begin < end)
    p, last, d = begin[q].astype(np.int64), end[q].astype(np.int64), np.zeros(len(q), np.int64)
    own = asks[q] + 1 == p  # what follows the asked word itself shares rows with it
    d[own] = np.minimum(lcp[p[own]], width)
    for k in range(1, width + 1):
        rows[q[own & (d >= k)], k] = (1, 0, 1)
    while len(q):
        a, b, c = (x.astype(np.int64) for x in rows[q, d].T)
        t = text[p, d]
        a2 = np.minimum(a + (t != asked[q, d]), b + 1)
        a2[d == 0] = 1
        b2 = np.minimum(np.minimum(b + (t != asked[q, d + 1]), c + 1), a2 + 1)
        c2 = np.minimum(c + (t != asked[q, d + 2]), b2 + 1)
        row = np.minimum(np.stack([a2, b2, c2], axis=1), 2)
        d += 1
        rows[q, d] = row
        full = d == size[p]
        off = goal[q] - d + 1  # the place of the asked word's length in the band
        met = full & (off >= 0) & (off <= 2)
        met[met] = row[met, off[met]] == 1
        near_a.append(asks[q[met]])
        near_b.append(p[met])
        dead = row.min(axis=1) > 1
        on = dead | full
        p = np.where(dead, over[p, np.minimum(d, width - 1)], np.where(full, p + 1, p))
        d = np.where(on, np.maximum(lcp[p], 0), d)
        stay = p < last
        q, p, last, d = q[stay], p[stay], last[stay], d[stay]
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(near_a), join(near_b)


def _pairs(words: list[str], lists: np.ndarray, guest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs within each list between its words, and between its guests and its words, each pair once.

    A list's words come in order, then its guests.
    """
    ends = np.flatnonzero(np.r_[lists[1:] != lists[:-1], True]) + 1
    hosts = np.flatnonzero(~guest)
    place = np.cumsum(~guest) - 1  # of a word among the words
    firsts = np.r_[0, ends[:-1]]
    number = np.searchsorted(ends, np.arange(len(words)), "right")
    low = np.searchsorted(hosts, firsts)[number]
    high = np.searchsorted(hosts, ends)[number]
    # Guests stand behind the words for the scan, in a list of no one.
    order = np.r_[hosts, np.flatnonzero(guest)]
    all_words = [words[k] for k in order]
    own = np.r_[lists[hosts], np.full(int(guest.sum()), -1)]
    begin = np.where(guest, low, place + 1)[order]
    end = high[order]
    got_a, got_b = [], []
    width = max(map(len, words)) + 2
    step = max(1, 8 * CELLS // (3 * width))
    for at in range(0, len(order), step):
        asks = np.arange(at, min(at + step, len(order)))
        a, b = scan(all_words, own, asks, begin[asks], end[asks])
        got_a.append(order[a])
        got_b.append(order[b])
    return np.concatenate(got_a), np.concatenate(got_b)


def near_words(words: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """word, n, near, near_n: both ways for each pair of near words, perhaps several times; the tables it reads."""
    total = words.count()
    deal = max(1, -(-3 * total // BLOCK))
    listed = kept(entries(words).repartitionByRange(deal, "back", "half", "word").withColumn("block", F.spark_partition_id()), "lists")
    spans = listed.groupBy("back", "half", "block").agg(F.min("word").alias("lo"), F.max("word").alias("hi"))
    several = Window.partitionBy("back", "half")
    at_edge = listed.groupBy("back", "half").agg(F.min("block").alias("first"), F.max("block").alias("last")).where("first < last").select("back", "half")  # a cut each: less than blocks
    cut = spans.join(F.broadcast(at_edge), ["back", "half"]).withColumn("blocks", F.count("*").over(several))
    shared = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.length("lo")), lambda k: F.col("lo").substr(F.lit(1), k) == F.col("hi").substr(F.lit(1), k))), F.lit(0))
    cut = kept(cut.select("back", "half", F.col("block").alias("to"), F.col("lo").substr(F.lit(1), shared).alias("start")), "cuts")
    reach = [F.levenshtein(F.col("word").substr(F.lit(1), F.length("start") + k), F.col("start"), 1) >= 0 for k in (-1, 0, 1)]
    guests = listed.join(F.broadcast(cut), ["back", "half"]).where((F.col("to") > F.col("block")) & (reach[0] | reach[1] | reach[2]))
    both = listed.select("block", "back", "half", F.lit(False).alias("guest"), "word", "n").unionByName(guests.select(F.col("to").alias("block"), "back", "half", F.lit(True).alias("guest"), "word", "n"))
    dealt = both.repartition(deal, "block").sortWithinPartitions("block", "back", "half", "guest", "word")

    def run(batches):
        held: list[tuple] = []
        width = 0

        def found():
            """Near words among the lists held, both ways."""
            number, lists = 0, np.empty(len(held), np.int64)
            for k, r in enumerate(held):
                number += k > 0 and r[:3] != held[k - 1][:3]
                lists[k] = number
            a, b = _pairs([r[4][len(r[2]) :] for r in held], lists, np.array([r[3] for r in held], bool))
            straight = [r[4][::-1] if r[1] else r[4] for r in held]
            n = np.array([r[5] for r in held], np.int64)
            names = pa.array(straight, pa.string())
            for x, y in ((a, b), (b, a)):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(x)), pa.array(n[x]), names.take(pa.array(y)), pa.array(n[y])], ["word", "n", "near", "near_n"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rest = len(r[4]) - len(r[2])  # alike for all words of a list
                if held and r[:3] != held[-1][:3] and len(held) * (max(width, rest) + 2) > CELLS:
                    yield from found()
                    held, width = [], 0
                held.append(r)
                width = max(width, rest)
        if held:
            yield from found()

    return in_arrow(dealt, run, "word string, n long, near string, near_n long"), [listed, cut]


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) end. Each round doubles how far a word has come."""
    at = kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = kept(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(at)
        at = after.drop("moved")
        at._kept_at = after._kept_at
        if not after.where("moved").take(1):
            return at


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the texts."""
    words = kept(vocabulary(docs), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    pairs, tables = near_words(words)
    near = pairs.groupBy("word", "near").agg(F.first("near_n").alias("near_n")).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    form_n = -F.col("best.less")
    much = form_n >= 2 * F.col("n")
    table = kept(words.join(near, "word", "left").select("word", F.when(much, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(much, form_n).alias("form_n")), "variants")
    forget(words, *tables)
    ends = roots(table.where("form is not null"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

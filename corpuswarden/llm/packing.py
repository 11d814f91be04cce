"""Packing of tokenised documents into sequences: shortest-pack-first over the histogram of lengths.

Documents are encoded on the executors and cut into pieces of at most ``capacity`` tokens. Only the
histogram of piece lengths (``capacity`` bins at most) reaches the driver, which places lengths from the
longest to the shortest, each into the packs that hold least so far, many equal packs at a time. The packs
form patterns with counts; a piece finds its place by its rank among the pieces of its length.

Defined results: null or empty text is one end token; equal rows are packed each for itself; an empty table
gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import LONGEST, byte_symbols, checked
from .shared import in_arrow, kept, slices, utf8

CAPACITY = 2048
END_ID = 1
#: Words a worker remembers; beyond this it forgets all and starts anew.
MEMORY = 400_000

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"

# The published pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The white space of that pattern, written out, as Python's own \s holds four more characters.
_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


class ByteBpe(dict):
    """Ids of text by a byte-level BPE file, as little-endian 32-bit numbers; remembers words seen.

    White space always parts tokens under the file's pattern, so a text's ids are those of its runs.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        of = byte_symbols()
        ranks = {bytes([b]): spec["model"]["vocab"][c] for c, b in of.items()}
        ranks |= {bytes(of[c] for c in token): k for token, k in checked(spec["model"]).items()}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()

    def __missing__(self, run: str) -> bytes:
        if len(run) > LONGEST:
            return np.array(self.whole.encode(run, add_special_tokens=False).ids, dtype="<u4").tobytes()
        ids = np.array(self.fast.encode_ordinary(run), dtype="<u4").tobytes()
        if len(run) <= 64:
            if len(self) >= MEMORY:
                self.clear()
            self[run] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join([self[run] for run in _RUNS.findall(text)])


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document; every piece but the last of a document has ``capacity`` tokens."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        code = byte_bpe(tokenizer)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            raw, starts = utf8(batch.column("text"))
            data = raw.tobytes()
            out = []
            for doc_id, a, b in zip(batch.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                ids = code.encode(data[a:b].decode("utf-8", "replace")) + end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    part = ids[4 * at : 4 * (at + capacity)]
                    out.append((doc_id, at, len(part) // 4, zlib.crc32(part), n))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths in order) that hold every length as often as the histogram says."""
    open_packs: list[tuple[int, int, int, tuple[int, ...]]] = []  # total, tie-break, count, lengths
    serial = 0
    for length in sorted(histogram, reverse=True):
        left, placed = histogram[length], []
        while left:
            if open_packs and open_packs[0][0] + length <= capacity:
                total, _, count, lengths = heapq.heappop(open_packs)
                used = min(left, count)
                placed.append((total + length, used, (*lengths, length)))
                if used < count:
                    heapq.heappush(open_packs, (total, serial, count - used, lengths))
                    serial += 1
            elif (again := min(placed, default=None)) and again[0] + length <= capacity:
                placed.remove(again)
                total, count, lengths = again
                used = min(left, count)
                placed.append((total + length, used, (*lengths, length)))
                if used < count:
                    placed.append((total, count - used, lengths))
            else:
                used, each = left, capacity // length  # new packs, one after another
                if used >= each:
                    placed.append((length * each, used // each, (length,) * each))
                if used % each:
                    placed.append((length * (used % each), 1, (length,) * (used % each)))
            left -= used
        for total, count, lengths in placed:
            heapq.heappush(open_packs, (total, serial, count, lengths))
            serial += 1
    return [(count, lengths) for _, _, count, lengths in sorted(open_packs)]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset, copies) of each length in each pattern.

    ``copies`` pieces of a length follow each other in one sequence; their ranks do too.
    """
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length, same in groupby(lengths):  # in falling order
            copies = len(list(same))
            rank = taken.get(length, 0)
            out.append((length, rank, rank + count * copies, sequence, offset, copies))
            taken[length] = rank + count * copies
            offset += length * copies
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = docs.sparkSession
    table = kept(pieces(docs, tokenizer, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    places = spark.createDataFrame(slots(shortest_pack_first(histogram, capacity)), "slot_length int, first_rank long, after_rank long, first_sequence long, first_offset long, copies long")
    buckets = max(1, sum(histogram.values()) // 8000)
    dealt = table.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    bases = counts.select("length", "bucket", before.alias("base"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("row", F.row_number().over(order) - 1).join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("row"))
    # The places grow with the number of lengths and patterns, which the capacity bounds, not with the pieces.
    met = ranked.join(F.broadcast(places), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("after_rank")))
    nth = F.col("rank") - F.col("first_rank")
    sequence, offset = F.col("first_sequence") + F.expr("(rank - first_rank) div copies"), F.col("first_offset") + F.col("length") * (nth % F.col("copies"))
    return met.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), offset.alias("offset"))

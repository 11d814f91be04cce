"""BPE encoding and decoding with content-defined chunks that documents share.

A rolling hash over the last bytes decides where a text is cut, so equal passages give equal chunks wherever
they stand. Chunks found in two documents or more are encoded once, by the task that holds their first
document, and kept as sorted arrays in the shared folder. Every task then takes those ids from the mapped
arrays and encodes only what is its own. Where two parts meet inside a word, both halves of that word are
taken back and the word is encoded anew, over as many parts as it spans: white space always parts tokens of
this kind of vocabulary, so at the nearest white space on both sides the ids agree exactly.

Defined results: null or empty text has no ids and decodes to an empty text; texts of any length are cut the
same way; equal rows give equal results; a null doc_id stays null; an empty table gives an empty result; columns
other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import LONGEST, byte_symbols, checked
from .shared import in_arrow, kept, map_arrays, put_arrays, shared_dir, slices, utf8
from .words import BYTE, powers

WINDOW = 32  # bytes that decide on a cut
MEAN_BITS = 9  # a cut every 512 bytes on average
LEAST = 128  # bytes between cuts
END = b"\x01"  # stands for the end of a piece in text that does not hold it
# The published pre-tokenisation pattern of the word vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE = b" \t\n\r\x0b\x0c"
_WORD = re.compile("[^ \t\n\x0b\x0c\r]+")
# All but ASCII and Latin letters, whose lower case and composed form are one character of every Unicode version.
_OTHER = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\u012f\u0131-\u024f]")


class WordBpe:
    """Ids (little-endian 32 bits) of bytes by a vocabulary of words.

    Text of Latin letters and ASCII is lower-cased, cut into pieces and merged by ranks, each piece with the end
    mark; words with other characters, or with the file's special tokens, go to the tokenizers library whole.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.no_truncation()
        self.coder.no_padding()
        self.tokens = np.empty(self.coder.get_vocab_size(), dtype=object)
        for token, k in self.coder.get_vocab().items():
            self.tokens[k] = token
        self.numbers = [str(k) for k in range(len(self.tokens))]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, of = spec["model"]["end_of_word_suffix"], byte_symbols()
        self.special = [x["content"] for x in spec["added_tokens"]]
        ranks = {bytes([b]): spec["model"]["vocab"][c] for c, b in of.items()}
        ranks |= {bytes([b]) + END: spec["model"]["vocab"][c + suffix] for c, b in of.items()}
        for token, k in checked(spec["model"], suffix).items():
            own = bytes(of[c] for c in token.removesuffix(suffix))
            if END not in own:  # plain text never holds the mark
                ranks[own + END if token.endswith(suffix) else own] = k
        self.fast = tiktoken.Encoding("words", pat_str="[^\\x01]+\\x01", mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(PIECES)

    def whole(self, text: str) -> bytes:
        return np.array(self.coder.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def plain(self, text: str) -> bytes:
        pieces = self.pieces.findall(text.lower())
        if not pieces:
            return b""
        if max(map(len, pieces)) > LONGEST:
            return self.whole(text)
        mark = END.decode()
        return self.fast.encode_to_numpy(mark.join(pieces) + mark, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def is_plain(self, text: str) -> bool:
        return _OTHER.search(text) is None and not any(s in text for s in self.special)

    def encode(self, data: bytes) -> bytes:
        text = data.decode("utf-8", "replace")
        if self.is_plain(text):
            return self.plain(text)
        runs = itertools.groupby(_WORD.findall(text), self.is_plain)
        return b"".join([(self.plain if plain else self.whole)(" ".join(words)) for plain, words in runs])


@functools.cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def cuts(raw: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """For each text its ends of chunks, as places in ``raw``; the end of the text is the last."""
    n = len(raw)
    found = np.zeros(0, np.int64)
    if n > WINDOW:
        up, down = powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[raw] * up[:-1], out=sums[1:])
        rolled = (sums[WINDOW:] - sums[:-WINDOW]) * down[: n + 1 - WINDOW]
        found = np.flatnonzero((rolled >> np.uint64(64 - MEAN_BITS)) == 0) + WINDOW
        found = found[found < n]
        for _ in range(3):  # a cut inside a character moves to the next one
            inside = (raw[np.minimum(found, n - 1)] & 0xC0) == 0x80
            found = found + (inside & (found < n))
        found = found[found < n]
    bounds = np.searchsorted(found, starts)
    found = found.tolist()
    out = []
    for a, b, i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        ends, last = [], a
        for x in found[i:j]:
            if x - last >= LEAST and x - a >= WINDOW and b - x > 0:
                ends.append(x)
                last = x
        if b > a:
            ends.append(b)
        out.append(ends)
    return out


def chunks(batch: pa.RecordBatch, column: str = "text"):
    """(row, bytes of the text, [(begin, end, 128-bit hash)]) of each row."""
    raw, starts = utf8(batch.column(column))
    data = raw.tobytes()
    for row, (a, b, ends) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), cuts(raw, starts), strict=True)):
        text, last, parts = data[a:b], 0, []
        for end in ends:
            parts.append((last, end - a, xxhash.xxh3_128_intdigest(text[last : end - a])))
            last = end - a
        yield row, text, parts


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hi = table.column("hi").to_numpy().view(np.uint64)
    lo = table.column("lo").to_numpy().view(np.uint64)
    return hi, lo, np.lexsort((lo, hi))


class Shelf:
    """Sorted 128-bit keys in files by their first bits. A file that was written and is gone is an error."""

    def __init__(self, uri: str, bits: int, written: frozenset[int]):
        self.uri, self.bits, self.files = uri, bits, dict.fromkeys(set(range(1 << bits)) - written)

    def find(self, key: int) -> tuple[dict | None, int]:
        shard = key >> (128 - self.bits)
        if shard not in self.files:
            self.files[shard] = map_arrays(f"{self.uri}/{shard:05d}.arr")
        if (x := self.files[shard]) is None:
            return None, -1
        hi, lo = np.uint64(key >> 64), np.uint64(key & ((1 << 64) - 1))
        at = int(np.searchsorted(x["hi"], hi))
        while at < len(x["hi"]) and x["hi"][at] == hi:
            if x["lo"][at] == lo:
                return x, at
            at += 1
        return None, -1


def shared_chunks(docs: DataFrame) -> DataFrame:
    """Hashes of the chunks that two documents or more hold, with the least doc_id among them."""

    def count(batches):
        seen: dict[int, list[int]] = {}

        def flush():
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([_signed(k >> 64) for k in keys], pa.int64()), pa.array([_signed(k & ((1 << 64) - 1)) for k in keys], pa.int64()), pa.array([seen[k][0] for k in keys], pa.int64()), pa.array([seen[k][1] for k in keys], pa.int64())], ["hi", "lo", "n", "doc"])
            seen.clear()

        for whole in batches:
            for batch in slices(whole, "text"):
                ids = batch.column("doc_id").to_pylist()
                for row, _, parts in chunks(batch):
                    doc = ids[row]
                    for key in {p[2] for p in parts}:
                        at = seen.get(key)
                        if at is None:
                            seen[key] = [1, doc]
                        else:
                            at[0] += 1
                            at[1] = min(at[1], doc)
                if len(seen) > 300_000:
                    yield from flush()
        yield from flush()

    own = in_arrow(docs, count, "hi long, lo long, n long, doc long")
    return own.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.min("doc").alias("doc")).where("n > 1")


def _shelve(table: DataFrame, uri: str, bits: int, extra) -> frozenset[int]:
    """Write the rows of each shard as one file; the numbers of the files. extra(table, order): further arrays."""

    def write(part: pa.Table) -> pa.Table:
        hi, lo, order = _keys(part)
        first = np.r_[True, (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])] if len(order) else np.zeros(0, bool)
        order = order[first]
        put_arrays(f"{uri}/{part.column('shard')[0].as_py():05d}.arr", {"hi": hi[order], "lo": lo[order]} | extra(part, order))
        return pa.table({"shard": part.column("shard").slice(0, 1)})

    shard = F.shiftrightunsigned("hi", 64 - bits).cast("int") if bits else F.lit(0)
    return frozenset(r["shard"] for r in table.withColumn("shard", shard).groupBy("shard").applyInArrow(write, "shard int").collect())  # a number for each file


def _docs(part: pa.Table, order: np.ndarray) -> dict:
    return {"doc": part.column("doc").to_numpy()[order]}


def _spans(part: pa.Table, order: np.ndarray) -> dict:
    ids = part.column("ids").combine_chunks()
    values = [ids[int(k)].as_py() for k in order]
    return {"at": np.cumsum([0, *map(len, values)]).astype(np.int64), "ids": np.frombuffer(b"".join(values), np.uint8), "head": part.column("head").to_numpy()[order], "tail": part.column("tail").to_numpy()[order]}


def _edges(text: bytes) -> tuple[int, int]:
    """Where the first white space begins and the last one ends; (-1, -1) without any."""
    words = text.split(None, 1)
    head = 0 if text[:1] in _SPACE and text else (len(words[0]) if words else 0)
    if head == len(text):
        return -1, -1
    last = text.rsplit(None, 1)
    return head, len(text) - (0 if text[-1:] in _SPACE else len(last[-1]))


def encode(docs: DataFrame, tokenizer: str, digests: bool = False) -> DataFrame:
    """doc_id and the ids of its text; with ``digests`` also its decoded text, both as hashes and without the ids."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("doc_id"), F.col("text").cast("string").alias("text"))
    common = kept(shared_chunks(docs), "chunks")
    bits = max(2, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())  # a few files for each reducing task
    first, ready = shared_dir(spark, "first"), shared_dir(spark, "encoded")
    firsts = _shelve(common, first, bits, _docs)

    def encode_first(batches):
        code, shelf = word_bpe(tokenizer), Shelf(first, bits, firsts)
        for whole in batches:
            for batch in slices(whole, "text"):
                docs_here, out, mine = batch.column("doc_id").to_pylist(), [], set()
                for row, text, parts in chunks(batch):
                    for a, b, key in parts:
                        x, at = shelf.find(key)
                        if x is None or x["doc"][at] != docs_here[row] or key in mine:
                            continue
                        mine.add(key)
                        part = text[a:b]
                        head, tail = _edges(part)
                        ids = code.encode(part)
                        out.append((_signed(key >> 64), _signed(key & ((1 << 64) - 1)), ids, len(code.encode(part[:head])) if head > 0 else 0, len(code.encode(part[tail:])) if tail >= 0 else 0))
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32()], strict=True)], ["hi", "lo", "ids", "head", "tail"])

    readies = _shelve(in_arrow(docs, encode_first, "hi long, lo long, ids binary, head int, tail int"), ready, bits, _spans)

    def whole_ids(code: WordBpe, shelf: Shelf, text: bytes, parts) -> bytes:
        out, open_word, own = [], b"", 0  # own: where text that no other document has begins
        for a, b, key in parts:
            x, at = shelf.find(key)
            if x is None:
                continue
            if own < a:  # what stands before, up to its last white space
                part = text[own:a]
                head, tail = _edges(part)
                if tail < 0:
                    open_word += part
                else:
                    out.append(code.encode(open_word + part[:tail]))
                    open_word = part[tail:]
            part = text[a:b]
            head, tail = _edges(part)
            own = b
            if tail < 0:
                open_word += part
                continue
            ids = x["ids"][x["at"][at] : x["at"][at + 1]].tobytes()
            if open_word:
                out.append(code.encode(open_word + part[:head]))
                skip = int(x["head"][at])
            else:
                skip = 0
            out.append(ids[skip : len(ids) - int(x["tail"][at])])
            open_word = part[tail:]
        out.append(code.encode(open_word + text[own:]))
        return b"".join(out)

    def finish(batches):
        code, shelf = word_bpe(tokenizer), Shelf(ready, bits, readies)
        for whole in batches:
            for batch in slices(whole, "text"):
                out = []
                for _, text, parts in chunks(batch):
                    ids = np.frombuffer(whole_ids(code, shelf, text, parts), dtype="<u4")
                    if digests:
                        numbers = " ".join(map(code.numbers.__getitem__, ids.tolist()))
                        out.append((len(ids), hashlib.sha256(numbers.encode()).hexdigest(), hashlib.sha256(decoded(code, ids).encode()).hexdigest()))
                    else:
                        out.append((ids.tolist(),))
                doc_ids = pa.array([None if x == -(1 << 62) else x for x in batch.column("doc_id").to_pylist()], pa.int64())
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids"]
                yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    return in_arrow(docs, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>")


def decoded(code: WordBpe, ids: np.ndarray) -> str:
    """The text of ids. A vocabulary without a decoder of its own joins its tokens by spaces."""
    if code.coder.decoder is not None:
        return code.coder.decode(ids.tolist(), skip_special_tokens=False)
    return " ".join(code.tokens[ids].tolist())


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the text of its ids; null ids: empty."""

    def texts(batches):
        code = word_bpe(tokenizer)
        for batch in batches:
            out = [decoded(code, np.array(ids or [], dtype=np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return in_arrow(encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")), texts, "doc_id long, text string")

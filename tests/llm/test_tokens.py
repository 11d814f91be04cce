"""BPE with shared chunks and packing against the tokenizers library itself."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpuswarden.llm import encoding, packing

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def corpus():
    rng = random.Random(6)
    words = ["The", "cats'", "don't", "Été", "été", "日本語", "x" * 900, "12345", "<|endoftext|>", "a b", "\U0001f600", "tab\tbed", "\x1cfs", "…", "ΑΣ"] + [f"w{k}ing" for k in range(200)]
    passage = " ".join(rng.choices(words[15:], k=700))
    texts = [None, "", " \n ", "plain", "日" * 3000, "a" * 5000, passage]
    for k in range(30):
        own = rng.choice([" ", "\n", "  ", ""]).join(rng.choices(words, k=rng.randrange(0, 300)))
        cut = rng.randrange(len(passage) - 1)
        texts.append(own + rng.choice(["", " ", "zz"]) + (passage[cut:] if k % 2 else passage[:cut]) + rng.choice(["", "tail", " tail"]))
    return list(enumerate(texts)) + [(6, passage), (None, "no id")]


def test_ids_and_text_equal_the_library(spark):
    rows = corpus()
    coder = Tokenizer.from_file(WORD)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoding.encode(docs, WORD, digests=True).collect())
    want = []
    for k, t in rows:
        ids = coder.encode(t or "", add_special_tokens=False).ids
        want.append((str(k), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(coder.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    whole = encoding.encode(docs, WORD)
    texts = sorted((str(r.doc_id), r.text) for r in encoding.decode(whole, WORD).collect())
    assert texts == sorted((str(k), coder.decode(coder.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for k, t in rows)
    assert encoding.encode(docs.where("false"), WORD, digests=True).count() == 0


def test_pieces_are_exact_and_sequences_are_whole(spark):
    rows = corpus()
    coder = Tokenizer.from_file(BYTE)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(docs, BYTE, capacity=256).collect()
    want = []
    for k, t in rows:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(str(k), a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes()), len(ids)) for a in range(0, len(ids), 256)]
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(docs.where("false"), BYTE).count() == 0


def test_patterns_hold_the_histogram():
    rng = random.Random(2)
    for _ in range(50):
        histogram = {rng.randrange(1, 65): rng.randrange(1, 5000) for _ in range(rng.randrange(0, 40))}
        patterns = packing.shortest_pack_first(histogram, 64)
        back = {}
        for count, lengths in patterns:
            assert count > 0 and sum(lengths) <= 64
            for x in lengths:
                back[x] = back.get(x, 0) + count
        assert back == histogram

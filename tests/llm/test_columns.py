"""Further columns, also with names that operators use themselves, repeated rows and null ids, for all operators."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpuswarden.llm import cotrain, encoding, langid, lines, lm, media, neardup, packing, quality, secrets

CLASHING = ["row", "key", "cut", "changed", "_row", "host", "host_lines", "dropped", "lines_dropped", "score", "lang_pred", "_text", "hash", "size", "times", "doc", "own_hash", "node", "band", "start", "kind", "n", "word", "bucket", "rank", "a.b"]


@pytest.fixture(scope="module")
def docs(spark):
    shared = "these are ten words that many pages of this host share\n"
    rows = [(k, shared + " ".join(f"w{(k * 7 + j) % 90}" for j in range(30)) + (f" token = '{k:040x}'" if k % 3 == 0 else ""), "en" if k % 2 else "fr", "h", 7) for k in range(30)]
    rows += [rows[3], rows[3], (None, rows[4][1], None, None, None), (None, None, None, None, None), (40, "", "en", "h", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return table.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def intact(got, rows):
    """The rows have all their columns, with their own values in the clashing ones."""
    assert got.columns[: 5 + len(CLASHING)] == rows.columns
    for r in got.collect():
        for k, c in enumerate(CLASHING):
            assert r[5 + k] == f"own {c}" or c == "lines_dropped", c


def test_operators_that_keep_columns(docs):
    cleaned = lines.cleaned(docs)
    intact(cleaned, docs)
    assert cleaned.count() == docs.count() and cleaned.where("instr(text, 'these are ten') > 0 and source = 'h'").count() == 0
    accepted = langid.accepted(docs, 0.0)
    intact(accepted, docs)
    assert accepted.count() == docs.count() - 2
    redacted = secrets.redacted(docs)
    intact(redacted, docs)
    assert redacted.count() == docs.count() and redacted.where("text rlike '[0-9a-f]{24}'").count() == 0
    one = neardup.kept_documents(docs)
    intact(one, docs)
    assert one.where("doc_id = 3").count() == 1 and one.where("text is null or text = ''").count() == 2


def test_operators_that_ignore_columns(docs, spark):
    n = docs.count()
    word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    labels = spark.createDataFrame([(k, k % 2, "own") for k in range(20)], "doc_id long, quality int, score string")
    assert secrets.scanned(docs).count() == quality.judged(docs).count() == neardup.classes(docs).count() == n
    assert encoding.encode(docs, word).count() == cotrain.scored(docs, labels).count() == n
    assert packing.pack(docs, byte).where("start = 0").count() == n
    assert media.features(media.read_archives(spark, media.write_archives(docs)[0])).count() == n
    assert langid.identified(docs, F.lit(True), ["doc_id", "word"]).columns == ["doc_id", "word", "lang_pred", "score"]
    scores = lm.score(docs, lm.train(docs), keep=["doc_id", "score", "n"])
    assert scores.columns[:3] == ["doc_id", "n", "n_tokens"] and scores.count() == n
    same = [r.score for r in scores.where("doc_id = 3").collect()]
    assert len(same) == 3 and len(set(same)) == 1

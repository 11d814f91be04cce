"""Every stage on its predecessor's rows, checked by what it has to do."""

import random

import corpus_pipeline as p
from corpuswarden.llm import lines, neardup


def test_stages(spark):
    rng = random.Random(1)
    syllables = {"aa": "tha ing ona ed re st".split(), "bb": "éau ion ré le ou çen".split()}
    text = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))
    rows = []
    for k in range(60):
        lang = "aa" if k % 2 else "bb"
        rows.append((k, text(lang, 80) + "\nFollow us everywhere\n" + text(lang, 5), lang, "host", 1))
    copy = rows[4][1].split(" ")
    copy[20] = "changed"
    secret = "0123456789abcdef" * 3
    rows += [(100, "12 34 !!", "aa", "host", 8), (101, None, "aa", "host", 0), (102, rows[3][1], "aa", "other", 1), (103, " ".join(copy), "bb", "host", 1), (104, text("aa", 60) + f" token = '{secret}' " + text("aa", 9), "aa", "host", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append({r.doc_id: r for r in docs.collect()})
    assert set(seen[0]) == set(range(60)) | {102, 103, 104}
    assert all("Follow us" not in seen[1][k].text and seen[1][k].n_chars == len(seen[1][k].text) for k in range(60))
    assert set(seen[2]) == set(range(60)) | {104}
    assert secret not in seen[3][104].text and "[secret]" in seen[3][104].text and set(seen[3]) == set(seen[2])
    packed = p.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == set(seen[3])


def test_one_whole_text_of_the_copies_of_a_host_stays(spark):
    words = [f"w{k}" for k in range(500)]
    rng = random.Random(2)
    page = lambda: "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(6))
    five, many = page(), page()
    rows = [(k, page() + "\nFollow us everywhere", "aa", "host", 1) for k in range(60)]
    rows += [(100 + k, five, "aa", "host", len(five)) for k in range(5)] + [(200 + k, many, "aa", "host", len(many)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(p.STAGES)["near_duplicates"](spark, dict(p.STAGES)["line_dedup"](spark, docs, ""), "").collect()
    assert [r.doc_id for r in got if r.text == five] == [100] and [r.doc_id for r in got if r.text == many] == [200]
    assert len(got) == 62 and not any("Follow us" in r.text for r in got)


def test_the_same_texts_stay_without_ids(spark):
    rng = random.Random(3)
    syllables = {"aa": "tha ing ona ed re st".split(), "bb": "éau ion ré le ou çen".split()}
    text = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))
    rows = [(text("aa" if k % 2 else "bb", 40), "aa" if k % 2 else "bb") for k in range(60)]
    rows += rows[:5] + [("12 34 !!", "aa"), (None, "aa")]
    seen = []
    for ids in (lambda k: k, lambda k: None, lambda k: 1, lambda k: k % 5):
        docs = spark.createDataFrame([(ids(k), t, lang, "host", 1) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, "").cache()
        seen.append(sorted(r.text for r in docs.collect()))
        assert len({(r.sequence_id, r.offset) for r in p.STAGES[-1][1](spark, docs, "").collect()}) >= 60
    assert len(seen[0]) == 60 and seen[0] == seen[1] == seen[2] == seen[3]


def test_a_text_of_many_lines(spark):
    import time

    long = "\n".join(f"line {k} of a long text" for k in range(60_000))
    docs = spark.createDataFrame([(1, long, "aa", "host", 1), (2, long + "\nmore", "aa", "host", 1), (3, "x\ny", "aa", "host", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    began = time.time()
    got = {r.doc_id: r.text for r in dict(p.STAGES)["line_dedup"](spark, docs, "").collect()}
    assert got[1] == long and time.time() - began < 60


def test_one_whole_text_of_near_copies_stays(spark):
    """Five articles of 30 lines that differ in a line each, among 100 pages of their host with a line in common: given
    the classes of near copies, line dedup counts them as one page."""
    words = [f"w{k}" for k in range(500)]
    rng = random.Random(5)
    page = lambda n: [" ".join(rng.choices(words, k=12)) for _ in range(n)]
    article = page(30)
    near = ["\n".join([*article[: 5 * k], " ".join(rng.choices(words, k=12)), *article[5 * k + 1 :]]) for k in range(5)]
    rows = [(k, "\n".join([*page(6), "Follow us everywhere"]), "aa", "host", 1) for k in range(100)] + [(200 + k, t + "\nFollow us everywhere", "aa", "host", 1) for k, t in enumerate(near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clean = lines.cleaned(docs, copies=True, alike=neardup.alike(docs)).select(*docs.columns)
    got = dict(p.STAGES)["near_duplicates"](spark, clean, "").collect()
    assert len(got) == 101 and not any("Follow us" in r.text for r in got)
    assert [r.text for r in got if r.doc_id >= 200] == [near[0]]

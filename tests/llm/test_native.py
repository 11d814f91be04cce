"""Quality rules, line dedup and secret scans against SQL or plain Python."""

import base64
import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest

from corpuswarden.llm import lines, oracles, quality, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    words = ["the", "of", "cat", "#x", "a|b", "é", "日本", "tables<", "x" * 300] + [f"w{k}" for k in range(40)]
    out = []
    for k in range(160):
        text = "\n".join(" ".join(rng.choices(words, k=rng.randrange(0, 30))) for _ in range(rng.randrange(0, 7)))
        if k % 3 == 0:
            text += "\n  Subscribe to our list \nAll rights"
        out.append((k, text, "en", rng.choice(["a", "a", "a", "b", None]), len(text)))
    out += [(200, None, None, None, None), (201, "", "en", "c", 0), (202, " \n\n\t", "en", "c", 4), (203, "go go go " * 3000, "en", "d", 1), (204, "one two", "en", "d", 7)]
    return [*out, out[0], out[3], (None, "one two three", "en", "a", 13)]


def same(got, want):
    key = lambda r: tuple("" if x is None or x != x else str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want))


def by_sql(rows, sql):
    db = duckdb.connect()
    db.register("raw", pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(["doc_id", "text", "lang", "source", "n_chars"])}))
    db.sql("CREATE TABLE documents AS SELECT doc_id::BIGINT doc_id, text::VARCHAR text, lang::VARCHAR lang, source::VARCHAR source, n_chars::BIGINT n_chars FROM raw")
    r = db.sql(sql)
    return r.columns, r.fetchall()


@pytest.mark.parametrize("job,sql", [(quality.judged, oracles.OP3), (lines.cleaned, oracles.OP4)])
def test_equals_sql(spark, job, sql):
    rows = corpus()
    df = job(spark.createDataFrame(rows, SCHEMA))
    columns, want = by_sql(rows, sql)
    same([tuple(r[c] for c in columns) for r in df.collect()], want)
    assert df.sparkSession.createDataFrame([], SCHEMA).transform(job).count() == 0


def test_a_failing_host_takes_its_pages_with_it(spark):
    good = " ".join(f"w{k}" for k in range(80))
    rows = [(k, good if k % 10 == 0 else "short", "en", "bad", 1) for k in range(200)] + [(1000 + k, good if k % 10 else "short", "en", f"h{k % 4}", 1) for k in range(200)]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[k] for k in range(200)) and all(got[1000 + k] == bool(k % 10) for k in range(200))


def plain_base(text):
    found = [("assign", m.start(), m.end()) for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.A) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda x: (x[1], order.index(x[0])))


def secret_rows():
    rng = random.Random(2)
    hexes = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(40)]
    free = [base64.b64encode(hashlib.sha256(f"x{k}".encode()).digest()).decode().rstrip("=") for k in range(12)]
    names = ["getApplicationContextFactory", "internationalization_settings_panel", "the-quick-brown-fox-jumps-over", "AbstractSingletonProxyFactoryBean", "========================", "------------------------------", "characteristically-unprofessional"]
    vocabulary = [f"{a}{b}" for a in ("under", "inter", "applica", "manage", "proper", "consider", "setting", "factory") for b in ("stand", "tion", "ment", "ing", "ities", "Bean", "_panel", "-over")]
    vocabulary += "the-quick brown-fox jumps-over getApplication ContextFactory nationalization settings_panel Abstract Singleton ProxyFactory unprofessional characteristic ---------- ======".split()
    rows = []
    for k in range(40):
        t = " ".join(rng.choices(vocabulary, k=200) + rng.choices(names, k=3))
        rows.append((k, f"é日 {t} token = \"{hexes[k]}\" {t}"))
    rows += [(100 + k, f"see {x} and {names[k % len(names)]}") for k, x in enumerate(free)]
    rows += [(200, None), (201, ""), (202, "token: token: abcdef password=abc PASSWD='abcdef' api_key:xyzxyz9 apikey = \"a.b=c-d\""), (203, "AKIA" + "A1" * 9 + " AKIAXX " + "AKIA" * 8), (204, "secret=" + "0123456789abcdef" * 400), (205, "token=token=token=abcdef"), (202, "token: token: abcdef")]
    return rows, free, names


def test_secret_spans(spark):
    rows, free, names = secret_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = secrets.scanned(docs).collect()
    assert len(got) == len(rows)
    want = sorted((k, *(sum(s[0] == kind for s in base) for kind in ("assign", "access", "hex")), hashlib.sha256(",".join(":".join(map(str, s)) for s in base).encode()).hexdigest()) for k, t in rows for base in [plain_base(t or "")])
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    for k, x in enumerate(free):
        assert by[100 + k].spans == f"random:4:{4 + len(x)}"
    assert all(by[k].n_random == 0 for k in range(40))


def test_redaction_and_empty_table(spark):
    rows, free, _ = secret_rows()
    docs = spark.createDataFrame([(k, t, "x", 5) for k, t in rows], "doc_id long, text string, row string, n_chars long")
    got = {(r.doc_id): r for r in secrets.redacted(docs).collect()}
    assert docs.columns == secrets.redacted(docs).columns and len(secrets.redacted(docs).collect()) == len(rows)
    assert got[100].text.startswith("see [secret] and ") and free[0] not in got[100].text
    assert got[0].text.count("[secret]") == 1 and got[0].text.startswith("é日 ") and got[0].n_chars == len(got[0].text)
    assert got[200].text is None and got[201].text == "" and got[201].n_chars == 5
    assert secrets.scanned(docs.where("false")).count() == 0


def test_repeated_rows_with_secrets(spark):
    text = f"see AKIA{'A1' * 8} and token = abcdef12 then AKIA{'B2' * 8} end"
    rows = [(1, text), (1, text), (None, text), (None, text), (None, text), (2, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = secrets.scanned(docs).collect()
    base = plain_base(text)
    want = ",".join(":".join(map(str, s)) for s in base)
    assert len(got) == len(rows) and {(r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got} == {(1, 2, 0, hashlib.sha256(want.encode()).hexdigest(), want)}
    assert [r.text for r in secrets.redacted(docs).collect()] == ["see [secret] and [secret] then [secret] end"] * len(rows)


def test_random_rests_of_runs_that_patterns_cut(spark):
    rows, free, names = secret_rows()
    access, rng = "AKIA" + "A1B2" * 4, random.Random(6)
    mixed = "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZghjkmnpqrstuvwxyz", k=10)) + "0a1b2c3d4e5f" * 2 + "".join(rng.choices("QWXZKJVBghjkqzxwv", k=10))
    own = [f"see {access}/{free[0]} end", f"see {free[1]}/token=abc123 end", f"see {mixed} end", f"see {names[0]}/token=abc123 end", f"see {access}/{names[0]}/{access} end"]
    docs = spark.createDataFrame(rows + [(300 + k, t) for k, t in enumerate(own)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redacted(docs).where("doc_id >= 300").collect()}
    assert not any(x in t for t in got.values() for x in (free[0], free[1], access))
    assert mixed[:10] not in got[302] and mixed[-10:] not in got[302]
    assert got[303] == f"see {names[0]}/[secret] end" and got[304] == f"see [secret]/{names[0]}/[secret] end"

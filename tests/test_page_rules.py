"""For each rule one page that violates it and one that does not."""

import pytest

from corpuswarden.operators import markup as m
from corpuswarden.operators import page_rules
from corpuswarden.plans.fixtures import CASES, HEAD

@pytest.fixture(scope="module")
def fired(spark):
    rows = []
    for rule, (bad, good) in CASES.items():
        for kind, text in (("bad", bad), ("good", good)):
            rows.append(("s", len(rows), f"{rule}/{kind}", text[1:] if text.startswith("^") else HEAD + text))
    own = m.masked(spark.createDataFrame(rows, "site_id string, page_id long, path string, html string")).cache()
    tags = m.tags(own).cache()
    found = page_rules.head_findings(own, tags).unionByName(page_rules.body_findings(own, tags)).unionByName(page_rules.structured_data_findings(own, tags))
    return {(r.path, r.rule_id) for r in found.collect()}


@pytest.mark.parametrize("rule", CASES)
def test_fires_on_the_violation_only(fired, rule):
    assert (f"{rule}/bad", rule) in fired
    assert (f"{rule}/good", rule) not in fired


def test_a_fragment_is_no_document(spark):
    rows = [(1, "https://a.example/partials/x.html", "<p>x</p>"), (2, "https://a.example/blog/x.html", "<p>x</p>"), (3, "https://a.example/x.html", "<p>x</p>"), (4, "https://a.example/a/b/index.html?q", "<p>x</p>"), (5, "https://a.example/partials/y.html", "<body>x")]
    own = spark.createDataFrame(rows, "page_id long, path string, html string")
    assert {r.page_id for r in own.where(page_rules.is_document()).collect()} == {3, 4, 5}


def test_equal_descriptions_of_a_site_and_first_paths(spark):
    page = lambda k, d: (k, f"https://{'a' if k < 20 else 'b'}.example/{k:02d}", f'<html><meta name="description" content="{d}">')
    rows = [page(k, "Same  text") for k in range(9)] + [page(9, "other"), page(20, "same text"), (30, "https://a.example/partials/x.html", '<meta name="description" content="same text">')]
    own = m.masked(m.pages(spark.createDataFrame(rows, "page_id long, url string, html string")))
    got = page_rules.duplicate_descriptions(own, m.tags(own)).collect()
    assert [(r.site_id, r.description, r.pages, r.paths) for r in got] == [("a.example", "same text", 9, [f"https://a.example/{k:02d}" for k in range(6)])]


def test_pages_without_an_id_are_pages_each(spark):
    rows = [(None, "https://a.example/1", "<p><i>x</i>"), (None, "https://a.example/2", "<b><i>y</i></b>\n<u>"), (3, "https://a.example/3", "")]
    own = m.masked(m.pages(spark.createDataFrame(rows, "page_id long, url string, html string")))
    got = sorted((r.path[-1], r.seq, r.offset, r.line, r.name) for r in m.tags(own).collect())
    assert got == [("1", 0, 0, 1, "p"), ("1", 1, 3, 1, "i"), ("1", 2, 7, 1, "i"), ("2", 0, 0, 1, "b"), ("2", 1, 3, 1, "i"), ("2", 2, 7, 1, "i"), ("2", 3, 11, 1, "b"), ("2", 4, 16, 2, "u")]
    assert m.elements(m.tags(own)).where("name = 'i'").count() == 2

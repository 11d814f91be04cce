"""Tags and paired elements against a plain scanner and a stack."""

import random

from corpuswarden.operators import markup as m

SCHEMA = "site_id string, page_id long, path string, html string"


def pages(spark, texts):
    return spark.createDataFrame([("s", k, f"p{k}", t) for k, t in enumerate(texts)], SCHEMA)


def stack(tags):
    """Pairs of (open seq, close offset) as a stack for each name gives them."""
    out, open_tags = set(), {}
    for t in tags:
        if t.closing:
            if open_tags.get(t.name):
                out.add((open_tags[t.name].pop(), t.offset))
        elif not t.self_closing:
            open_tags.setdefault(t.name, []).append(t.seq)
    return out


def test_quotes_comments_and_long_tags(spark):
    texts = ['<a title="x > y" href=\'a>b\'>t</a>', "<!-- <b>no</b> -->\n<i>yes</i>", "<div " + 'data-x="1" ' * 100_000 + ">x</div>", "no tags", "", "<p>one<p>two</p></p></p><br/><img src=x>", "<b", '<a title="open>text</a>']
    own = m.masked(pages(spark, texts))
    rows = m.tags(own).orderBy("page_id", "seq").collect()
    by = {}
    for r in rows:
        by.setdefault(r.page_id, []).append(r)
        assert texts[r.page_id][r.offset : r.end] == r.raw
    assert [(t.name, t.closing) for t in by[0]] == [("a", False), ("a", True)]
    assert [t.name for t in by[1]] == ["i", "i"] and by[1][0].offset == texts[1].index("<i>")
    assert len(by[2]) == 2 and 3 not in by and 4 not in by and 6 not in by
    assert [t.name for t in by[7]] == ["a"] and by[7][0].closing


def test_pairs_equal_a_stack(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["<b>", "</b>", "<i>", "</i>", "<b/>", "x"]) for _ in range(rng.randrange(0, 40))) for _ in range(150)]
    tags = m.tags(pages(spark, texts))
    want = {}
    for t in tags.orderBy("page_id", "seq").collect():
        want.setdefault(t.page_id, []).append(t)
    got = {}
    for e in m.elements(tags).collect():
        got.setdefault(e.page_id, set()).add((e.seq, e.close_offset))
    assert all(got.get(k, set()) == stack(v) for k, v in want.items())


def test_surface_headings_and_css(spark):
    html = "<html><svg><title>no</title></svg><title>yes</title><h1>One <b>two</b></h1><h3></h3><style>/* a{} */ a, b{color:red} b{outline:none}</style></html>"
    own = pages(spark, [html])
    tags = m.tags(own)
    assert [t.offset for t in m.surface(tags).where("name = 'title' and not closing").collect()] == [html.index("<title>yes")]
    assert [(h.level, h.text) for h in m.headings(own, tags).orderBy("offset").collect()] == [(1, "One two"), (3, "")]
    assert sorted((r.selector, r.declarations) for r in m.css_rules(m.styles(own, tags)).collect()) == [("a", "color:red"), ("b", "color:red"), ("b", "outline:none")]

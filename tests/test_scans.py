"""Tables of tags are made once for each query over heads and images, and places hold on long pages."""

from corpuswarden.functions import text as t
from corpuswarden.operators import findings as f
from corpuswarden.operators import markup as m
from corpuswarden.operators import page_rules
from corpuswarden.plans import audits
from corpuswarden.plans.fixtures import with_fixtures
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def leaves(df) -> list[str]:
    """Kinds of the tables that a plan reads."""
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [found.apply(k).nodeName() for k in range(found.size())]


def test_heads_read_tags_once(spark):
    for df in (audits.head(spark, DATA), audits.earlier(spark, DATA)):
        kinds = leaves(df)  # tags of facts, hidden ones and titles; the pages themselves
        assert kinds.count("InMemoryRelation") >= 3 and len([k for k in kinds if k == "LogicalRelation"]) <= 3, kinds
    spark.catalog.clearCache()


def test_kept_tags_give_the_same_findings(spark):
    pages, tags = audits.fixture_tables(spark, DATA)
    all_tags, own = (page_rules.head_findings(pages, x) for x in (tags, page_rules.of_head(tags)))
    assert own.count() == all_tags.count() and own.exceptAll(all_tags).isEmpty()
    spark.catalog.clearCache()


def test_styled_images_tag_only_pages_with_contracts(spark):
    sheet = "<style>.box{width:9px;height:9px}.box img{width:9px;height:9px}</style>"
    rows = [(1, "http://a.org/1", sheet + "\n<p class='box'><img src=a></p><img src=b>"), (2, "http://a.org/2", "<p class='box'><img src=c></p>")]
    pages = m.masked(m.pages(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert [(r.page_id, r.seq) for r in page_rules.styled_images(pages, m.tags(pages)).collect()] == [(1, 3)]
    assert [(r.path, r.line) for r in page_rules.image_findings(pages, m.tags(pages)).orderBy("path").collect()] == [("http://a.org/1", 2), ("http://a.org/2", 1)]
    spark.catalog.clearCache()


def test_places_on_long_pages(spark):
    html = "".join(f"é\n<p\nid='{k}'>{k}</p>" for k in range(1500)) + "<br"
    pages = m.pages(spark.createDataFrame([(1, "http://a.org/", html)], "page_id long, url string, html string"))
    found = m.tags(pages).orderBy("seq").collect()
    assert len(found) == 3000 and all(html[x.offset : x.end] == x.raw and html.count("\n", 0, x.offset) + 1 == x.line for x in found)
    sums = F.transform(F.array(*map(F.lit, (31, 32, 33, 1024, 1025, 40_000))), lambda n: F.element_at(t.running_sums(F.sequence(F.lit(1), n), 5), -1))
    assert spark.range(1).select(sums.alias("x")).first().x == [5 + n * (n + 1) // 2 for n in (31, 32, 33, 1024, 1025, 40_000)]


def test_pieces_of_a_page(spark):
    html = "1 < 2 <\n<p a='<'>x<퟿>\n<br/\n>y <b>z</b>> <" "<i\tt=\"\n>\"></i >\n<u"
    pages = m.pages(spark.createDataFrame([(1, "http://a.org/", html), (2, "http://a.org/2", ""), (3, "http://a.org/3", "x > y")], "page_id long, url string, html string"))
    found = m.tags(pages).orderBy("seq").collect()
    assert [(x.name, x.attrs, x.closing, x.self_closing) for x in found] == [("p", " a='<'", False, False), ("br", "/\n", False, False), ("b", "", False, False), ("b", "", True, False), ("i", '\tt="\n>"', False, False), ("i", " ", True, False)]
    assert [x.seq for x in found] == list(range(6))
    assert all(html[x.offset : x.end] == x.raw and html.count("\n", 0, x.offset) + 1 == x.line for x in found)


def test_attributes_in_any_case(spark):
    row = spark.range(1).select(m.attribute(F.lit(" ClassName='a' É"), "className").alias("a"), m.attribute(F.lit(" DATA-lcp"), "data-lcp").alias("b"), m.attribute(F.lit(" xid=1"), "id").alias("c"), m.attribute(F.lit(None).cast("string"), "id").alias("d")).first()
    assert tuple(row) == ("a", "", None, None)


def test_page_findings_keep_only_tags_that_rules_ask_for(spark, monkeypatch):
    spark.catalog.clearCache()
    rows = with_fixtures(spark.read.parquet(f"{DATA}/pages.parquet"))
    pages = m.masked(m.pages(rows)).persist()
    every, kept, body = m.tags(pages).persist(), [], page_rules.body_findings
    whole = page_rules.head_findings(pages, every).unionByName(body(pages, every)).unionByName(page_rules.structured_data_findings(pages, every))
    monkeypatch.setattr(page_rules, "body_findings", lambda pages, tags: kept.append(tags) or body(pages, tags))
    some = page_rules.page_findings(rows).where("rule_id not like 'seo-duplicate-static-%'")
    assert kept[0].where("name in ('p', 'li', 'br') and (closing or trim(attrs) = '')").isEmpty() and kept[0].count() < every.count()
    assert sorted(map(str, f.deduplicated(some).collect())) == sorted(map(str, f.deduplicated(whole).collect()))
    spark.catalog.clearCache()

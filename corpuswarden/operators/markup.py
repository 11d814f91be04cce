"""Structure of HTML pages as tables: tags, paired elements, headings, style rules.

Input pages have ``site_id``, ``page_id``, ``path`` and ``html``. Offsets count code points. A tag whose
quotes never close is passed over; text after it is still read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NBSP, collapsed, newlines, running_sums

#: Possessive throughout, so that a tag of any length is matched without recursion.
TAG = "<(/?)([A-Za-z][A-Za-z0-9_:.-]*)(?=[\\s/>])((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
#: What a page falls into: text up to a tag with the tag, or up to a "<" that begins none, or to the end.
PIECE = f"[^<]*+(?:{TAG}|<|\\z)"
COMMENT = "(?s)<!--.*?(?:-->|$)"
#: Files of components, in which a tag with a capital is a component and no element.
COMPONENT_FILE = "(?i)\\.(?:jsx|tsx|mdx|vue|svelte|astro)(?:[?#].*)?$"
#: Above every length of a page: in a number, line breaks count so much and characters one.
_LINE = 1 << 32
VOID = "area base br col embed hr img input link meta param source track wbr".split()


def pages(df: DataFrame) -> DataFrame:
    """site_id (host of the URL), page_id, path (the URL) and html of a crawl table.

    A page without an id gets a negative one from its URL and text. Ids are taken to be unique otherwise.
    """
    own = -F.pmod(F.xxhash64("url", "html"), F.lit(1 << 62)) - 1
    return df.select(F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit("")).alias("site_id"), F.coalesce(F.col("page_id"), own).alias("page_id"), F.col("url").alias("path"), F.coalesce("html", F.lit("")).alias("html"))


def blanked(text: Column, pattern: str, start: str | None = None) -> Column:
    """Each match overwritten by blanks, line breaks kept, so offsets stay. ``start``: literal text that any match begins
    with and that is found in no text without a match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    blanks = F.concat(F.transform(found, lambda m: F.regexp_replace(m, "[^\\n]", " ")), F.array(F.lit("")))
    parts = F.transform(F.arrays_zip(gaps.alias("g"), blanks.alias("b")), lambda z: F.concat(z["g"], z["b"]))
    return F.when(F.contains(text, F.lit(start)) if start else text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


def masked(df: DataFrame, column: str = "html") -> DataFrame:
    return df.withColumn(column, blanked(F.col(column), COMMENT, "<!--"))


def tags(pages: DataFrame) -> DataFrame:
    """site_id, page_id, path, seq, offset, end, line, name, closing, self_closing, attrs (raw), of masked pages.

    Names are in lower case, but as written in files of components. Places and lines are running sums over the pieces of a page, within the page's row:
    nothing is shuffled, and pages are told apart whatever their ids. One search finds tags and the text between.
    """
    parts = pages.select("site_id", "page_id", "path", F.col("path").rlike(COMPONENT_FILE).alias("as_written"), F.regexp_extract_all("html", F.lit(PIECE), F.lit(0)).alias("pieces"))
    # Lengths and line breaks as one number, so that one running sum gives both.
    both = lambda x: F.length(x) * F.lit(_LINE + 1) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) * F.lit(_LINE)
    ends = parts.select("site_id", "page_id", "path", "as_written", "pieces", running_sums(F.transform("pieces", both), _LINE).alias("ends"))
    with_tag = F.filter(F.arrays_zip("pieces", "ends"), lambda t: t["pieces"].endswith(">") & F.contains(t["pieces"], F.lit("<")))  # a "<" alone ends its piece
    each = ends.select("site_id", "page_id", "path", "as_written", F.posexplode(with_tag).alias("seq", "t"))
    each = each.withColumn("raw", F.substr("t.pieces", F.instr("t.pieces", F.lit("<"))))
    raw = F.col("raw")
    end, line = F.col("t.ends") % _LINE, F.floor(F.col("t.ends") / _LINE) - newlines(raw)
    written = F.regexp_extract(raw, "^</?([A-Za-z][A-Za-z0-9_:.-]*)", 1)
    before = F.length(written) + 1 + raw.startswith("</").cast("int")
    attrs = F.substr(raw, before + 1, F.length(raw) - before - 1 - raw.endswith("/>").cast("int"))
    return each.select(
        "site_id", "page_id", "path", F.col("seq").cast("int").alias("seq"), (end - F.length(raw)).cast("int").alias("offset"), end.cast("int").alias("end"), line.cast("int").alias("line"),
        F.when(F.col("as_written"), written).otherwise(F.lower(written)).alias("name"), raw.startswith("</").alias("closing"), raw.endswith("/>").alias("self_closing"), attrs.alias("attrs"), "raw",
    )


def attribute(attrs: Column | str, name: str) -> Column:
    """Value of an attribute; empty if it has none, null if it isn't there.

    Patterns are tried only on tags that hold the name at all, as few do.
    """
    a = F.col(attrs) if isinstance(attrs, str) else attrs
    head = f"(?is)(?:^|[\\s\"'/]){name}"
    value = F.regexp_extract(a, f"{head}\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)", 1)
    found = F.when(a.rlike(f"{head}\\s*="), F.regexp_replace(value, "^[\"']|[\"']$", "")).when(a.rlike(f"{head}(?=[\\s/>]|$)"), F.lit(""))
    return F.when(F.contains(F.lower(a), F.lit(name.lower())), found)


def has(attrs: Column | str, name: str) -> Column:
    return attribute(attrs, name).isNotNull()


def meaningful(attrs: Column | str, name: str) -> Column:
    """There, and neither blank nor an empty expression."""
    return F.coalesce(~collapsed(attribute(attrs, name)).isin("", "{}", "null", "undefined", "{null}", "{undefined}", "{''}"), F.lit(False))


def enabled(attrs: Column | str, name: str) -> Column:
    """A boolean attribute that is there and not literally false."""
    return F.coalesce(~F.lower(collapsed(attribute(attrs, name))).isin("false", "{false}"), F.lit(False))


def literal_true(attrs: Column | str, name: str) -> Column:
    return F.coalesce(F.lower(collapsed(attribute(attrs, name))).isin("true", "{true}"), F.lit(False))


def visible(content: Column) -> Column:
    """Text without drawings and tags, blanks collapsed."""
    t = F.regexp_replace(content, "(?is)<svg\\b.*?</svg\\s*>", " ")
    t = F.regexp_replace(t, "<[^>]*>", " ")
    t = F.regexp_replace(t, "(?i)&nbsp;|&#160;", NBSP)
    return collapsed(t)


def elements(tags: DataFrame, names: list[str] | None = None, carried: list[str] | None = None) -> DataFrame:
    """Paired elements: offset, open_end, close_offset, close_end, attrs of each opening tag with its closing one, and
    the columns ``carried`` of the opening tag and, as close_*, of the closing one.

    As a stack would pair them for each name, by windows alone: the depth is the running sum of +1 and -1 less
    its running minimum, closings that set a new minimum are stray, and on each level an opening is paired with
    the next row if that is a closing.
    """
    own = tags.where(~F.col("self_closing") | F.col("closing"))
    own = own.where(F.col("name").isin(names)) if names else own.where(~F.col("name").isin(VOID))
    order = Window.partitionBy("page_id", "name").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    s = own.withColumn("s", F.sum(F.when(F.col("closing"), -1).otherwise(1)).over(upto))
    low = s.withColumn("m", F.least(F.lit(0), F.min("s").over(upto)))
    low = low.withColumn("before", F.coalesce(F.lag("m").over(order), F.lit(0)))
    real = low.where(~(F.col("closing") & (F.col("m") < F.col("before")))).withColumn("level", F.col("s") - F.col("m") + F.col("closing").cast("int"))
    level = Window.partitionBy("page_id", "name", "level").orderBy("seq")
    nxt = real.select("*", F.lead("closing").over(level).alias("next_closing"), F.lead("offset").over(level).alias("close_offset"), F.lead("end").over(level).alias("close_end"), *[F.lead(c).over(level).alias(f"close_{c}") for c in carried or []])
    more = [x for c in carried or [] for x in (c, f"close_{c}")]
    return nxt.where("not closing and next_closing").select("site_id", "page_id", "path", "name", "seq", "line", "offset", F.col("end").alias("open_end"), "close_offset", "close_end", "attrs", "raw", *more)


def depths(tags: DataFrame, elements: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """Tags with, for each kind (a condition on elements), in how many elements of it they lie: in_*.

    Running counts of elements that began and have not ended, in one window for all kinds.
    """
    began = elements.select("page_id", *[c.cast("int").alias(f"_{k}") for k, c in kinds.items()], F.explode(F.array(F.struct(F.col("open_end").alias("at"), F.lit(1).alias("step")), F.struct(F.col("close_offset").alias("at"), F.lit(-1).alias("step")))).alias("x"))
    marks = began.select("page_id", "x.at", "x.step", *[F.coalesce(F.col(f"_{k}") * F.col("x.step"), F.lit(0)).alias(f"_{k}") for k in kinds])
    both = tags.select("*", F.col("offset").alias("at"), F.lit(0).alias("step"), *[F.lit(0).alias(f"_{k}") for k in kinds]).unionByName(marks, allowMissingColumns=True)
    # At one place: ends first, then beginnings, then the tag that stands there.
    order = Window.partitionBy("page_id").orderBy("at", F.when(F.col("step") == -1, 0).when(F.col("step") == 1, 1).otherwise(2)).rowsBetween(Window.unboundedPreceding, 0)
    return both.select("*", *[F.sum(f"_{k}").over(order).alias(f"in_{k}") for k in kinds]).where("step = 0").drop("at", "step", *[f"_{k}" for k in kinds])


def with_content(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Elements with the markup between their tags."""
    html = pages.select("page_id", "html")
    return elements.join(html, "page_id").withColumn("content", F.substring(F.col("html"), (F.col("open_end") + 1), (F.col("close_offset") - F.col("open_end")))).drop("html")


HIDDEN = ["svg", "math", "template", "script", "style", "textarea"]


def surface(tags: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Tags outside of drawings, templates, scripts, styles and text areas; of ``names`` alone if they are given."""
    own = tags.where(F.col("name").isin(names)) if names else tags
    return depths(own, elements(tags, HIDDEN), {"hidden": F.lit(True)}).where("in_hidden = 0").drop("in_hidden")


def headings(pages: DataFrame, tags: DataFrame) -> DataFrame:
    """page_id, level, offset, attrs, content and text of the headings."""
    own = with_content(elements(tags, [f"h{k}" for k in range(1, 7)]), pages)
    return own.select("site_id", "page_id", "path", F.substring("name", 2, 1).cast("int").alias("level"), "offset", "line", "attrs", "content", visible(F.col("content")).alias("text"))


def named(attrs: Column, content: Column) -> Column:
    """Whether an element has an accessible name: by attributes, text, or a named image inside."""
    return (
        meaningful(attrs, "aria-label")
        | meaningful(attrs, "aria-labelledby")
        | meaningful(attrs, "title")
        | (visible(content) != "")
        | content.rlike("(?is)<(?:img|Image)\\b[^>]*\\salt\\s*=\\s*(?:\"[^\"]*\\S[^\"]*\"|'[^']*\\S[^']*')")
        | content.rlike("(?is)<[a-z][^>]*\\saria-label\\s*=\\s*(?:\"[^\"]*\\S[^\"]*\"|'[^']*\\S[^']*')")
        | content.rlike("(?is)<title\\b[^>]*>\\s*\\S")
    )


def css_rules(styles: DataFrame) -> DataFrame:
    """A row for each selector of each rule of column ``css``: rule, selector, declarations."""
    css = F.regexp_replace("css", "(?s)/\\*.*?(?:\\*/|$)", " ")
    rules = styles.select(*[c for c in styles.columns if c != "css"], F.posexplode(F.regexp_extract_all(css, F.lit("([^{}]+)\\{([^{}]*)\\}"), F.lit(0))).alias("rule", "body"))
    parts = rules.withColumn("declarations", F.trim(F.regexp_extract("body", "\\{([^{}]*)\\}", 1))).withColumn("selectors", F.regexp_extract("body", "^([^{}]+)\\{", 1))
    return parts.select(*[c for c in styles.columns if c != "css"], "rule", F.explode(F.split("selectors", ",")).alias("selector"), "declarations").withColumn("selector", collapsed("selector"))


def styles(pages: DataFrame, tags: DataFrame) -> DataFrame:
    """Inline style blocks: site_id, page_id, path, offset, css."""
    return with_content(elements(tags, ["style"]), pages).select("site_id", "page_id", "path", "open_end", F.col("content").alias("css"))


def scripts(pages: DataFrame, tags: DataFrame) -> DataFrame:
    """Inline script blocks with their type and text."""
    own = with_content(elements(tags, ["script"]), pages)
    return own.select("site_id", "page_id", "path", "open_end", F.lower(F.coalesce(attribute("attrs", "type"), F.lit(""))).alias("type"), "attrs", F.col("content").alias("text"))

"""From elements to pages and blocks.

Headings and content pair up by position. Running counts over one window per document
give every element its section and item; the rest is projection and aggregation on the
same placement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from . import heading_tags as H
from . import tokens as K
from .tokens import before, doc_window, upto


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def flow(elements: DataFrame) -> DataFrame:
    """Elements with `real` (a heading with text), `h1_ord`, `h2_ord` (document-wide) and
    `h2_key` (the item the element belongs to, 0 before the first one of its section)."""
    w = doc_window()
    real = _flag(F.col("level").isNotNull() & (F.col("text") != ""))
    e = elements.withColumn("real", real)
    e = e.withColumn("_h1", real & (F.col("level") == 1)).withColumn("_h2", real & (F.col("level") == 2))
    e = (e.withColumn("h1_ord", F.sum(_flag(F.col("_h1")).cast("int")).over(upto(w)).cast("int"))
          .withColumn("h2_ord", F.sum(_flag(F.col("_h2")).cast("int")).over(upto(w)).cast("int")))
    key = F.when(_flag(F.col("_h2")), F.col("h2_ord")).when(_flag(F.col("_h1")), 0)
    e = e.withColumn("_k", key)
    return e.withColumn("h2_key", F.coalesce(F.last("_k", ignorenulls=True).over(upto(w)), F.lit(0))).drop("_h1", "_h2", "_k")


def with_own(elements: DataFrame, docs: DataFrame, own: Column) -> DataFrame:
    """Elements with those of the documents themselves beside them."""
    return elements.unionByName(K.own_elements(docs, own), allowMissingColumns=True)


def early() -> Column:
    """Whether an element before the first level-1 heading needs a section of its own."""
    return (F.col("h1_ord") == 0) & ((F.col("real") & (F.col("level") == 2)) | (~F.col("tag").isin("h1", "h2") & T.has_content(F.col("html"))))


def numbered_sections(rows: DataFrame) -> DataFrame:
    """rows(doc_id, h1_ord, early, title, word_level, pos, …), a row a section and one for what comes before: the sections in order, the first one
    synthetic if something comes before or there is no other."""
    w = Window.partitionBy("doc_id")
    keep = (F.col("h1_ord") > 0) | F.coalesce("early", F.lit(False)) | (F.max("h1_ord").over(w) == 0)
    s = rows.withColumn("_keep", keep).filter("_keep").drop("_keep", "early").withColumn("synthetic", F.col("h1_ord") == 0)
    s = s.withColumn("idx", (F.row_number().over(w.orderBy("h1_ord")) - 1).cast("int"))
    level = F.when(F.col("idx") == 0, 1).otherwise(F.coalesce("word_level", F.lit(1)))
    return (s.withColumn("level", level.cast("int")).withColumn("pos", F.when(F.col("synthetic"), -1).otherwise(F.col("pos")))
            .withColumn("title", F.when(F.col("synthetic"), fixed.DEFAULT_BLOCK_TITLE).otherwise(F.col("title"))))


def sections(fl: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, h1_ord, idx, title, level, word_level, synthetic, pos).

    Documents without any element, whose only section is the synthetic one, are those that `docs` adds, or that have an element
    of their own (`tokens.elements` with `own`).
    """
    if docs is not None:
        fl = with_own(fl, docs, F.lit("")).withColumns({"real": F.coalesce("real", F.lit(False)), "h1_ord": F.coalesce("h1_ord", F.lit(0))})
    head = F.col("real") & (F.col("level") == 1)
    rows = fl.groupBy("doc_id", "h1_ord").agg(
        F.bool_or(early()).alias("early"), F.max(F.when(head, F.col("text"))).alias("title"),
        F.max(F.when(head, H.tag_value(F.col("open_tag"), 1).cast("int"))).alias("word_level"), F.min(F.when(head, F.col("pos"))).alias("pos"))
    return numbered_sections(rows).select("doc_id", "h1_ord", "idx", "title", "level", "word_level", "synthetic", "pos")


def sections_with_items(fl: DataFrame) -> DataFrame:
    """(doc_id, h1_ord, idx, title, level, word_level, synthetic, items): the sections with their items (h2_ord, text, option, word_option) in
    order, from a flow with the documents' own elements; one fold, no join."""
    head, item = F.col("real") & (F.col("level") == 1), F.col("real") & (F.col("level") == 2)
    word = H.tag_value(F.col("open_tag"), 2)
    one = F.struct("h2_ord", "text", F.coalesce(word, F.lit("html")).alias("option"), word.alias("word_option"))
    rows = fl.groupBy("doc_id", "h1_ord").agg(
        F.bool_or(early()).alias("early"), F.max(F.when(head, F.col("text"))).alias("title"),
        F.max(F.when(head, H.tag_value(F.col("open_tag"), 1).cast("int"))).alias("word_level"), F.min(F.when(head, F.col("pos"))).alias("pos"),
        F.array_sort(F.collect_list(F.when(item, one))).alias("items"))
    return numbered_sections(rows).select("doc_id", "h1_ord", "idx", "title", "level", "word_level", "synthetic", "items")


def section_items(fl: DataFrame) -> DataFrame:
    """(doc_id, h1_ord, h2_ord, text, option, word_option, pos)."""
    word = H.tag_value(F.col("open_tag"), 2)
    return fl.filter("real and level = 2").select(
        "doc_id", "h1_ord", "h2_ord", "text", F.coalesce(word, F.lit("html")).alias("option"),
        word.alias("word_option"), "pos")


def sectionize(fl: DataFrame) -> DataFrame:
    """(doc_id, sec, level, text, html, h1_ord, h2_key, pos): headings, and the runs of
    content between them joined to one row of level 999. Empty headings vanish."""
    real = F.col("real")
    s = _stretches(fl).filter(real | (F.col("html") != ""))
    return s.select("doc_id", F.when(real, F.col("level")).otherwise(999).alias("level"), "text", "html", "h1_ord", "h2_key", "pos",
                    (F.row_number().over(doc_window()) - 1).cast("int").alias("sec"))


def _stretches(fl: DataFrame) -> DataFrame:
    """(doc_id, real, pos, level, text, html, h1_ord, h2_key, early, word_level): a row for every heading with text, and one for what follows up to
    the next; its `html` is that of the content there, '' without any. One aggregate on the documents' placement."""
    real = F.col("real")
    e = fl.withColumn("_isl", F.sum(real.cast("int")).over(upto(doc_window())))
    content = ~real & F.col("level").isNull()
    e = e.withColumns({"_html": F.when(content, F.col("html")), "_at": F.when(real | content, F.col("pos"))})
    return (e.groupBy("doc_id", "_isl", "real")
            .agg(F.min("_at").alias("pos"), F.max(F.when(real, F.col("level"))).alias("level"), F.coalesce(F.max(F.when(real, F.col("text"))), F.lit("")).alias("text"),
                 F.coalesce(T.strip(F.expr("listagg(_html, '') within group (order by pos)")), F.lit("")).alias("html"),
                 F.min("h1_ord").alias("h1_ord"), F.min("h2_key").alias("h2_key"), F.bool_or(early()).alias("early"),
                 F.max(F.when(real & (F.col("level") == 1), H.tag_value(F.col("open_tag"), 1).cast("int"))).alias("word_level"))
            .drop("_isl"))


def section_ranges(fl: DataFrame) -> DataFrame:
    """(doc_id, h1_ord, start, end): the `sections` of a flow with their half-open ranges of the rows of `sectionize`; the synthetic
    section covers what precedes the first level-1 heading.

    Both come from the same stretches: rows are counted by section, and a section's range ends at the count up to it. Rows without a
    document have no range.
    """
    head = F.col("real") & (F.col("level") == 1)
    rows = _stretches(fl).groupBy("doc_id", "h1_ord").agg(
        F.bool_or("early").alias("early"), F.max(F.when(head, F.col("text"))).alias("title"), F.max("word_level").alias("word_level"),
        F.min(F.when(head, F.col("pos"))).alias("pos"), F.count_if(F.col("real") | (F.col("html") != "")).alias("n"))
    upper = F.sum("n").over(upto(Window.partitionBy("doc_id").orderBy("h1_ord")))
    s = numbered_sections(rows.withColumn("end", upper))
    known = F.col("doc_id").isNotNull()
    return s.select("doc_id", "h1_ord", F.when(F.col("synthetic"), 0).when(known, F.col("end") - F.col("n") + 1).alias("start"),
                    F.when(known, F.col("end")).when(F.col("synthetic"), 0).alias("end"))


def serialize(level: Column, text: Column, html: Column) -> Column:
    """HTML of a section row inside a range; null for what a range leaves out."""
    def head(n: int) -> Column:
        return F.concat(F.lit(f"<h{n}>"), T.escape_xml(text), F.lit(f"</h{n}>"))
    return F.when(level == 999, html).when(level == 3, head(3)).when(level == 4, head(4))


def heading_media(open_html: Column) -> Column:
    """Images of a heading; a link comes along only if it wraps no text."""
    pat = r"(?is)<a\b[^>]*\shref=[^>]*>(?:\s|<(?!/?a\b)[^>]*>)*<img\b[^>]*>(?:\s|<(?!/?a\b)[^>]*>)*</a>|<img\b[^>]*>"
    return F.array_join(F.regexp_extract_all(open_html, F.lit(pat), F.lit(0)), "")


def heading_link_text(html: Column) -> Column:
    """Heading text with its links kept and every other tag dissolved, '' without one.

    The heading is cut at its links; inside and outside of them only text remains.
    """
    link = r"(?is)<a\b[^>]*\shref=[^>]*>.*?</a>"
    inner = F.regexp_replace(html, r"(?is)^<h[1-6][^>]*>|</h[1-6]>$", "")
    def words(c: Column) -> Column:
        bare = F.regexp_replace(c, r"<[^>]+>", "")
        return T.escape_xml(F.when(c.contains("&"), T.unescape_xml(bare)).otherwise(bare))

    def made(v: Column) -> Column:
        ext = F.when(v["href"].rlike("(?i)^https?://"), ' target="_blank" rel="noopener noreferrer"').otherwise("")
        return F.when((F.coalesce(v["href"], F.lit("")) == "") | T.is_blank(v["body"]), v["body"]).otherwise(
            F.concat(F.lit('<a href="'), T.escape_xml(v["href"]), F.lit('"'), ext, F.lit(">"), v["body"], F.lit("</a>")))

    def one(a: Column) -> Column:
        def cut(start: Column) -> Column:
            body = words(F.substring(a, F.length(start) + 1, F.length(a) - F.length(start) - 4))
            return T.let(F.struct(T.strip(T.attr(start, "href")).alias("href"), body.alias("body")), made)
        return T.let(F.regexp_extract(a, r"(?is)^(<a\b[^>]*>)", 1), cut)

    def joined(v: Column) -> Column:
        gaps = F.transform(F.split(v["inner"], link), words)
        out = F.array_join(F.flatten(F.zip_with(gaps, F.concat(F.transform(v["links"], one), F.array(F.lit(""))), lambda g, a: F.array(g, a))), "")
        return F.when(F.exists(v["links"], lambda a: T.plain_text(a) != ""), T.collapse(out)).otherwise("")

    return T.let(inner, lambda x: T.let(F.struct(x.alias("inner"), F.regexp_extract_all(x, F.lit(link), F.lit(0)).alias("links")), joined))


def with_heading_media(fl: DataFrame) -> DataFrame:
    """Adds `media` and `text_html` of real headings ('' elsewhere)."""
    head = F.col("real")
    return (fl.withColumn("media", F.when(head & F.col("html").contains("<img"), heading_media(F.col("html"))).otherwise(""))
            .withColumn("text_html", F.when(head & F.col("html").contains("<a"), heading_link_text(F.col("html"))).otherwise("")))


GROUP_END_PARA = rf"(?iu){fixed.P_OPEN}{fixed.WS}*{fixed.GROUP_END}{fixed.WS}*</p>"


def strip_group_end(html: Column) -> Column:
    return T.strip(F.regexp_replace(F.regexp_replace(html, GROUP_END_PARA, ""), "(?iu)" + fixed.GROUP_END, ""))


def split_group_end(html: Column) -> Column:
    """struct(body, spill): the first closing marker in a paragraph of its own splits."""
    halves = F.split(html, GROUP_END_PARA, 2)
    return F.struct(strip_group_end(F.get(halves, F.lit(0))).alias("body"),
                    F.coalesce(strip_group_end(F.get(halves, F.lit(1))), F.lit("")).alias("spill"))


def contents(fl: DataFrame) -> DataFrame:
    """(doc_id, h1_ord, h2_key, content, media, text_html, text, option): the serialised
    content of every item with the item's own text and option, and under `h2_key` 0 what
    comes before the first item."""
    return _contents(fl.filter("real or level is null"))


def _contents(fl: DataFrame, **more: Column) -> DataFrame:
    e = with_heading_media(fl)
    head = F.concat(F.col("media"), T.blank_to(F.col("text_html"), T.escape_xml(F.col("text"))))
    piece = (F.when(F.col("level").isNull(), F.col("html"))
             .when(F.col("real") & F.col("level").isin(3, 4), F.concat(F.lit("<h"), F.col("level").cast("string"), F.lit(">"), head,
                                                       F.lit("</h"), F.col("level").cast("string"), F.lit(">"))).otherwise(""))
    lead = F.col("real") & (F.col("level") <= 2)
    own = F.when(F.col("real") & (F.col("level") == 2), F.coalesce(H.tag_value(F.col("open_tag"), 2), F.lit("html")))
    return (e.withColumn("piece", piece).withColumn("own_option", own).groupBy("doc_id", "h1_ord", "h2_key")
            .agg(F.expr("listagg(piece, '') within group (order by pos)").alias("content"),
                 F.max(F.when(lead, F.col("media"))).alias("media"), F.max(F.when(lead, F.col("text_html"))).alias("text_html"),
                 F.max(F.when(lead, F.col("text"))).alias("text"), F.max("own_option").alias("option"), *[c.alias(n) for n, c in more.items()])
            .withColumn("media", F.coalesce("media", F.lit(""))).withColumn("text_html", F.coalesce("text_html", F.lit(""))))


def h2_content(fl: DataFrame, items: DataFrame) -> DataFrame:
    c = contents(fl).select("doc_id", "h1_ord", F.col("h2_key").alias("h2_ord"), "content")
    return (items.select("doc_id", "h1_ord", "h2_ord").join(c, ["doc_id", "h1_ord", "h2_ord"], "left")
            .withColumn("content", F.coalesce("content", F.lit(""))))


def item_chunks(fl: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One row per stretch of a section: its own lead-in (`h2_ord` 0) and every item, with
    the block and panel group it falls into and the HTML it contributes.

    `items` brings options other than the document's own (remembered ones, for instance).
    """
    c = contents(fl).withColumnRenamed("h2_key", "h2_ord")
    i = c if items is None else c.drop("option").join(
        items.select("doc_id", "h1_ord", "h2_ord", "option"), ["doc_id", "h1_ord", "h2_ord"], "left")
    return _chunks(i).filter("used").drop("used")


def _chunks(i: DataFrame) -> DataFrame:
    """Adds what item_chunks says to rows of contents; a lead-in without content is not `used`, and does not act on the others."""
    w = Window.partitionBy("doc_id", "h1_ord").orderBy("h2_ord")
    i = i.withColumn("panel", F.coalesce(F.col("option").isin("accordion", "tabs"), F.lit(False)))
    halves = split_group_end(F.col("content"))
    body = F.when(F.col("panel"), halves["body"]).otherwise(strip_group_end(F.col("content")))
    own_media = F.when((F.col("media") != "") & ((F.col("h2_ord") == 0) | F.coalesce(F.col("option") != "html", F.lit(False))),
                       F.concat(F.lit("<p>"), F.col("media"), F.lit("</p>")))
    i = (i.withColumn("spill", F.when(F.col("panel"), halves["spill"]).otherwise(""))
          .withColumn("body", F.concat_ws("\n", own_media, F.when(body != "", body))))
    i = i.withColumn("used", (F.col("h2_ord") > 0) | (F.col("body") != ""))
    fresh = F.col("panel") & (~F.coalesce(F.lag("panel").over(w), F.lit(False)) | (F.lag("option").over(w) != F.col("option"))
                              | (F.lag("spill").over(w) != ""))
    i = i.withColumn("_new", fresh)
    i = i.withColumn("_nextnew", F.coalesce(F.lead("_new").over(w), F.lit(True)) | ~F.coalesce(F.lead("panel").over(w), F.lit(False)))
    is_title = F.col("option").eqNullSafe("idevice-title")
    i = (i.withColumn("block_seq", F.sum(is_title.cast("int")).over(upto(w)).cast("int"))
          .withColumn("group_id", F.when(F.col("panel"), F.sum(F.col("_new").cast("int")).over(upto(w)).cast("int"))))
    filled = T.blank_to(F.col("body"), "<p></p>")
    head = F.concat(F.lit("<h2>"), F.when(F.col("option") == "html", F.col("media")).otherwise(""),
                    F.when(F.col("option") == "html", T.blank_to(F.col("text_html"), T.escape_xml(F.col("text"))))
                    .otherwise(T.escape_xml(F.col("text"))), F.lit("</h2>"))
    panel = F.concat_ws("\n",
                        F.when(F.col("_new"), F.concat(F.lit('<div class="exe-fx exe-'), F.col("option"), F.lit('">'))),
                        head, filled,
                        F.when(F.col("_nextnew") | (F.col("spill") != ""), F.lit("</div>")),
                        F.when(F.col("spill") != "", F.col("spill")))
    chunk = (F.when(F.col("h2_ord") == 0, F.col("body")).when(F.col("panel"), panel)
             .when(is_title, filled).otherwise(F.concat_ws("\n", head, F.when(F.col("body") != "", F.col("body")))))
    return i.withColumn("chunk", chunk).drop("_new", "_nextnew", "content")


def panel_groups(chunks: DataFrame) -> DataFrame:
    """(doc_id, h1_ord, group_id, option, panels, first_h2, titles)."""
    return (chunks.filter("group_id is not null").groupBy("doc_id", "h1_ord", "group_id")
            .agg(F.min("option").alias("option"), F.count("*").alias("panels"), F.min("h2_ord").alias("first_h2"),
                 F.expr("listagg(text, '|') within group (order by h2_ord)").alias("titles")))


def option_blocks(chunks: DataFrame) -> DataFrame:
    """(doc_id, h1_ord, block_idx, title, html): untitled flow and titled blocks."""
    b = (chunks.groupBy("doc_id", "h1_ord", "block_seq")
         .agg(F.coalesce(F.max(F.when(F.col("option") == "idevice-title", F.col("text"))), F.lit("")).alias("title"),
              F.expr("listagg(chunk, '\n') within group (order by h2_ord)").alias("html")))
    w = Window.partitionBy("doc_id", "h1_ord").orderBy("block_seq")
    return b.select("doc_id", "h1_ord", (F.row_number().over(w) - 1).cast("int").alias("block_idx"), "title",
                    T.blank_to(F.col("html"), "<p></p>").alias("html"))


def page_parents(pages: DataFrame) -> DataFrame:
    """Adds `parent_idx`: level 2 to the latest level-1 page, level 3 to the latest
    level-2 page even when a newer level-1 page lies between."""
    w = Window.partitionBy("doc_id").orderBy("page_idx")
    last = lambda k: F.last(F.when(F.col("level") == k, F.col("page_idx")), ignorenulls=True).over(before(w))
    return pages.withColumn("parent_idx", F.when(F.col("level") == 2, last(1)).when(F.col("level") == 3, last(2)))


def pages(sects: DataFrame) -> DataFrame:
    return page_parents(sects.select("doc_id", F.col("idx").alias("page_idx"), "title", "level", "h1_ord"))


def blocks(pgs: DataFrame, opt_blocks: DataFrame) -> DataFrame:
    """(doc_id, page_idx, block_idx, title, html); a page without blocks gets an empty one."""
    return (pgs.select("doc_id", "h1_ord", "page_idx").join(opt_blocks, ["doc_id", "h1_ord"], "left")
            .select("doc_id", "page_idx", F.coalesce("block_idx", F.lit(0)).alias("block_idx"),
                    F.coalesce("title", F.lit("")).alias("title"), F.coalesce("html", F.lit("<p></p>")).alias("html")))


def outline(elements: DataFrame) -> DataFrame:
    """(doc_id, page_idx, title, level, parent_idx, h1_ord, word_level, synthetic, blocks): every page with its blocks (title, html), from
    converted elements with those of the documents themselves.

    One ordered flow on the documents' placement: elements are folded to stretches, stretches to blocks, blocks to sections, and the sections
    are numbered. Each step keeps what the next one needs, so nothing is read, tokenised or joined a second time.
    """
    head = F.col("real") & (F.col("level") == 1)
    c = _contents(flow(elements), early=F.bool_or(early()), pos=F.min(F.when(head, F.col("pos"))),
                  word_level=F.max(F.when(head, H.tag_value(F.col("open_tag"), 1).cast("int"))))
    c = c.withColumnRenamed("h2_key", "h2_ord").withColumn("section", F.when(F.col("h2_ord") == 0, F.struct("text", "word_level", "pos")))
    b = _chunks(c).groupBy("doc_id", "h1_ord", "block_seq").agg(
        F.bool_or("used").alias("used"), F.max("section").alias("section"), F.bool_or("early").alias("early"),
        F.coalesce(F.max(F.when(F.col("option") == "idevice-title", F.col("text"))), F.lit("")).alias("title"),
        F.expr("listagg(case when used then chunk end, '\n') within group (order by h2_ord)").alias("html"))
    block = F.struct("block_seq", "title", T.blank_to(F.coalesce("html", F.lit("")), "<p></p>").alias("html"))
    s = b.groupBy("doc_id", "h1_ord").agg(F.max("section").alias("s"), F.bool_or("early").alias("early"), F.array_sort(F.collect_list(F.when(F.col("used"), block))).alias("blocks"))
    bare = F.array(F.struct(F.lit("").alias("title"), F.lit("<p></p>").alias("html")))
    blocks = F.transform("blocks", lambda x: F.struct(x["title"].alias("title"), x["html"].alias("html")))
    s = s.select("doc_id", "h1_ord", F.col("s.text").alias("title"), "s.word_level", "s.pos", "early",
                 F.when(F.size("blocks") > 0, blocks).otherwise(bare).alias("blocks"))
    return page_parents(numbered_sections(s).withColumnRenamed("idx", "page_idx")).select(
        "doc_id", "page_idx", "title", "level", "parent_idx", "h1_ord", "word_level", "synthetic", "blocks")


def page_blocks(rows: DataFrame) -> DataFrame:
    """(doc_id, page_idx, block_idx, title, html) of pages with their blocks."""
    return rows.select("doc_id", "page_idx", F.posexplode_outer("blocks").alias("block_idx", "b")).select("doc_id", "page_idx", "block_idx", "b.title", "b.html")


def outline_of(docs: DataFrame, placed: bool = False) -> DataFrame:
    """The outline straight from docs(doc_id, html), placed and tokenised once."""
    return outline(K.elements(docs, placed, own=F.lit("")))


def build(docs: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, blocks) of the structured route, from converted elements. Whoever needs both reads them from one `outline`."""
    rows = outline(with_own(elements, docs, F.lit("")))
    return rows.select("doc_id", "page_idx", "title", "level", "h1_ord", "parent_idx"), page_blocks(rows)


# --- structure choices ----------------------------------------------------------------

def apply_word_structure(sects: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Levels and options as the document's own tags say."""
    lvl = F.when(F.col("idx") == 0, 1).otherwise(F.coalesce("word_level", F.lit(1)))
    return (sects.withColumn("level", lvl.cast("int")),
            items.withColumn("option", F.coalesce("word_option", F.lit("html"))))


def word_structure_state(sects: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, has_tags, matches_tags) per document."""
    lvl = F.when(F.col("idx") == 0, 1).otherwise(F.coalesce("word_level", F.lit(1)))
    s = sects.select("doc_id", F.col("word_level").isNotNull().alias("t"), (F.col("level") == lvl).alias("m"))
    i = items.select("doc_id", F.col("word_option").isNotNull().alias("t"),
                     (F.col("option") == F.coalesce("word_option", F.lit("html"))).alias("m"))
    return s.unionByName(i).groupBy("doc_id").agg(F.bool_or("t").alias("has_tags"), F.bool_and("m").alias("matches_tags"))


# --- the second route -------------------------------------------------------------------

def heading_outline(elements: DataFrame, h1: str = "page", h2: str = "page", h3: str = "block", h4: str = "block", html_col: str = "html") -> DataFrame:
    """(doc_id, page_idx, title, level, parent_idx, blocks) straight from headings and per-level modes.

    Elements include those of the documents themselves, which carry the file name. `html_col` names the sanitised HTML. Unlike the structured
    route, a higher level resets the parent chain, and an implicit first page holds content that comes first.
    """
    w = doc_window()
    is_own = F.col("pos") < 0
    e = elements.withColumn("clean", F.col(html_col))
    e = e.filter((F.col("text") != "") | T.has_content(F.col("clean")) | is_own)
    if h1 == "resource":
        nth = F.sum(F.coalesce(F.col("level") == 1, F.lit(False)).cast("int")).over(upto(w))
        e = e.withColumn("_n", nth).filter(~((F.coalesce("level", F.lit(0)) == 1) & (F.col("_n") == 1)))
        eff = F.when(F.col("level") > 1, F.col("level") - 1).otherwise(F.col("level"))
    else:
        eff = F.col("level")
    e = e.withColumn("eff", eff)
    role = F.when(is_own, "own").when(F.col("eff") == 1, "page")
    if h2 == "page":
        role = role.when(F.col("eff") == 2, "page").when(F.col("eff") == 3, "page" if h3 == "page" else "block")
        if h3 == "page":
            role = role.when(F.col("eff") == 4, "page" if h4 == "page" else "block")
    else:
        role = role.when(F.col("eff") == 2, "block")
    e = e.withColumn("role", F.coalesce(role, F.lit("content")))
    is_page = F.col("role") == "page"
    nth = F.sum((~is_own).cast("int")).over(upto(w))
    starts = F.when((nth == 1) & ~is_own, (~(is_page & (F.coalesce("eff", F.lit(0)) == 1))).cast("int"))
    e = e.withColumn("_first", starts).withColumn("_imp", F.coalesce(F.max("_first").over(upto(w)), F.lit(0)))
    # the document's own row stands for the implicit page, which may hold nothing else
    implied = F.coalesce(F.max("_first").over(Window.partitionBy("doc_id")), F.lit(0)) - 1
    e = e.withColumn("page_idx", F.when(is_own, implied).otherwise(F.sum(is_page.cast("int")).over(upto(w)) - 1 + F.col("_imp")).cast("int"))
    last = lambda k: F.last(F.when(is_page & (F.col("eff") == k), F.col("page_idx")), ignorenulls=True).over(before(w))
    e = e.withColumns({f"_p{k}": last(k) for k in (1, 2, 3)})
    second = F.when(F.col("_p2") > F.coalesce("_p1", F.lit(-1)), F.col("_p2"))
    third = F.when(F.col("_p3") > F.greatest(F.coalesce("_p1", F.lit(-1)), F.coalesce("_p2", F.lit(-1))), F.col("_p3"))
    prev = F.col("page_idx") - 1
    parent = (F.when(F.col("eff") == 2, F.coalesce("_p1", prev)).when(F.col("eff") == 3, F.coalesce(second, F.col("_p1"), prev))
              .when(F.col("eff") == 4, F.coalesce(third, second, F.col("_p1"), prev)))

    v = Window.partitionBy("doc_id", "page_idx").orderBy("pos")
    is_block, is_content = F.col("role") == "block", F.col("role") == "content"
    c = e.withColumn("block_seq", F.sum(is_block.cast("int")).over(upto(v))).withColumn("piece", F.when(is_content, F.col("clean")))
    page = F.when(is_page, F.struct(F.col("text").alias("title"), F.col("eff").alias("level"), parent.alias("parent_idx")))
    b = c.groupBy("doc_id", "page_idx", "block_seq").agg(
        F.bool_or(is_block | is_content).alias("used"), F.max(page).alias("page"), F.max(F.when(is_own, F.col("open_tag"))).alias("own"),
        F.coalesce(F.max(F.when(is_block, F.col("text"))), F.lit(fixed.DEFAULT_BLOCK_TITLE)).alias("title"),
        F.expr("listagg(piece, '\n') within group (order by pos)").alias("html"))
    block = F.struct("block_seq", "title", T.blank_to(F.coalesce("html", F.lit("")), "<p></p>").alias("html"))
    p = b.groupBy("doc_id", "page_idx").agg(F.max("page").alias("page"), F.max("own").alias("own"),
                                            F.array_sort(F.collect_list(F.when(F.col("used"), block))).alias("bs"))
    # the document's own row is a page only where nothing else is
    p = p.withColumn("_top", F.max("page_idx").over(Window.partitionBy("doc_id"))).filter("page_idx >= 0 or _top < 0")
    empty = F.col("page_idx") < 0
    title = F.when(empty, T.blank_to(T.stem(F.col("own")), "Página 1")).otherwise(F.coalesce("page.title", F.lit("Página 1")))
    bare = F.array(F.struct(F.lit(fixed.DEFAULT_BLOCK_TITLE).alias("title"), F.when(empty, fixed.EMPTY_DOC_HTML).otherwise("<p></p>").alias("html")))
    blocks = F.when(F.size("bs") > 0, F.transform("bs", lambda x: F.struct(x["title"].alias("title"), x["html"].alias("html")))).otherwise(bare)
    return p.select("doc_id", F.greatest("page_idx", F.lit(0)).alias("page_idx"), title.alias("title"), F.coalesce("page.level", F.lit(1)).alias("level"),
                    F.col("page.parent_idx").alias("parent_idx"), blocks.alias("blocks"))


def heading_mode_pages(elements: DataFrame, docs: DataFrame, h1: str = "page", h2: str = "page",
                       h3: str = "block", h4: str = "block", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """(pages, blocks) of the second route; `docs` brings documents without elements and the names of their files."""
    e = with_own(elements, docs, F.col("filename"))
    if html_col != "html":
        e = e.withColumn(html_col, F.coalesce(html_col, F.lit("")))
    rows = heading_outline(e, h1, h2, h3, h4, html_col)
    return rows.drop("blocks"), page_blocks(rows)

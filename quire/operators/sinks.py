"""Rows and texts to write: navigation, components, properties, page and print HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from . import nav as N


def nav_rows(pages: DataFrame) -> DataFrame:
    """(doc_id, ord, page_id, parent_id, name): ids are deterministic, '' at the root."""
    pid = lambda i: F.concat(F.col("doc_id").cast("string"), F.lit("-"), i.cast("string"))
    return pages.select("doc_id", F.col("page_idx").alias("ord"), pid(F.col("page_idx")).alias("page_id"),
                        F.coalesce(pid(F.col("parent_idx")), F.lit("")).alias("parent_id"),
                        F.upper(N.page_titles(pages)).alias("name"))


def split_cdata(c: Column) -> Column:
    return F.replace(c, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))


def component_rows(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_idx, ord, name, minimized, html_view, json): one row per block."""
    html = T.upper_h2(T.blank_to(F.col("html"), "<p></p>"))
    placed = F.replace(html, F.lit(f'"{fixed.RESOURCE_DIR}/'), F.lit(f'"{{{{context_path}}}}/{fixed.RESOURCE_DIR}/'))
    b = blocks.withColumn("_h", placed)
    view = F.concat(F.lit('<div class="exe-text-template">\n'), F.col("_h"), F.lit("\n</div>"))
    payload = F.to_json(F.struct(
        F.concat_ws("-", F.lit("idevice"), "doc_id", "page_idx", "block_idx").alias("ideviceId"),
        F.lit("").alias("textInfoDurationInput"), F.lit("Duración").alias("textInfoDurationTextInput"),
        F.lit("").alias("textInfoParticipantsInput"), F.lit("Agrupamiento").alias("textInfoParticipantsTextInput"),
        F.col("_h").alias("textTextarea"), F.lit("Mostrar retroalimentación").alias("textFeedbackInput"),
        F.lit("").alias("textFeedbackTextarea")))
    return b.select("doc_id", "page_idx", F.col("block_idx").alias("ord"), F.upper("title").alias("name"),
                    (T.strip(F.col("title")) != "").alias("minimized"), split_cdata(view).alias("html_view"),
                    split_cdata(payload).alias("json"))


def doc_properties(docs: DataFrame, themes: DataFrame, author: str = "") -> DataFrame:
    """(doc_id, key, value) from docs(doc_id, title, subtitle, theme_id) and
    themes(theme_id, language); the theme table is joined by key, Spark sizes the join."""
    d = docs.join(themes.select("theme_id", "language"), "theme_id", "left")
    lang = F.when(F.col("language").isin(fixed.KNOWN_LANGS), F.col("language")).otherwise("es")
    sub = F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.DEFAULT_SUBTITLE.items() for x in kv]), lang)
    props = [("pp_title", T.blank_to(F.col("title"), fixed.DEFAULT_DOC_TITLE)), ("pp_subtitle", T.blank_to(F.col("subtitle"), sub)),
             ("pp_author", F.lit(author)), ("pp_lang", lang), ("pp_theme", F.col("theme_id")),
             ("pp_license", F.lit("creative commons: attribution - non commercial - share alike 4.0")),
             ("pp_addExeLink", F.lit("false")), ("pp_addPagination", F.lit("false")), ("pp_addSearchBox", F.lit("true"))]
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in props])
    return d.select("doc_id", F.inline(pairs))


def with_blocks(pages: DataFrame, blocks: DataFrame | None) -> DataFrame:
    """Pages that hold their blocks (title, html) in order; without `blocks` they do already."""
    if blocks is None:
        return pages
    b = blocks.groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list(F.struct("block_idx", "title", "html"))).alias("blocks"))
    return pages.join(b, ["doc_id", "page_idx"], "left")


def joined_blocks(one) -> Column:
    """The text that `one` makes of each block, line by line; '' for a page without any."""
    return F.coalesce(F.array_join(F.transform("blocks", one), "\n"), F.lit(""))


def page_html(pages: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_idx, href, html): one text per page from its blocks in order."""
    def article(b: Column) -> Column:
        kind = F.when(T.strip(b["title"]) != "", "box minimized").otherwise("box")
        return F.concat(F.lit('<article class="'), kind, F.lit('"><h1>'), T.escape_xml(T.blank_to(b["title"], fixed.DEFAULT_BLOCK_TITLE)),
                        F.lit("</h1>\n"), b["html"], F.lit("\n</article>"))

    p = with_blocks(pages, blocks).withColumn("_body", joined_blocks(article)).drop("blocks")
    p = N.page_neighbours(N.page_hrefs(p, around=True)).withColumn("_t", N.page_titles(p))
    head = F.concat(F.lit("<h2>"), T.escape_xml(F.col("_t")), F.lit("</h2>\n"))
    link = lambda c, n: F.when(F.col(c) != "", F.concat(F.lit(f'\n<a class="{n}" href="'), F.col(c), F.lit('"></a>'))).otherwise("")
    return p.select("doc_id", "page_idx", "href",
                    F.concat(head, F.col("_body"), link("prev_href", "prev"), link("next_href", "next")).alias("html"))


def print_block(title: Column, html: Column) -> Column:
    shown = T.upper_h2(html)
    plain = F.concat(F.lit('<div class="content-block">\n  <div class="block-html">'), shown, F.lit("</div>\n</div>"))
    titled = F.concat(F.lit('<div class="content-block idevice-with-title">\n  <header class="idevice-header">\n    <h4 class="idevice-title">'),
                      T.escape_text(F.upper(title)), F.lit('</h4>\n  </header>\n  <div class="block-html">'), shown, F.lit("</div>\n</div>"))
    return (F.when((html == "") | (T.strip(html) == "<p></p>"), "")
            .when((title == "") | (title == fixed.DEFAULT_BLOCK_TITLE), plain).otherwise(titled))


def iframe_links(html: Column) -> Column:
    """Frames to visible links of their address."""
    pat = r'(?is)<iframe[^>]*\bsrc="([^"]*)"[^>]*>.*?</iframe>'
    from .markers import rewrite_matches

    def one(m: Column) -> Column:
        url = T.video_link(F.regexp_extract(m, pat, 1))
        return F.when(url == "", "").otherwise(F.concat(
            F.lit('<div style="text-align: center; margin: 1em 0;"><a href="'), url,
            F.lit('" target="_blank" rel="noopener noreferrer">'), url, F.lit("</a></div>")))
    return F.when(html.contains("<iframe"), rewrite_matches(html, pat, one)).otherwise(html)


def print_html(pages: DataFrame, blocks: DataFrame | None = None, numbered: bool = False) -> DataFrame:
    """(doc_id, html): one text per document, sections in page order."""
    p = with_blocks(pages, blocks).withColumn("_body", joined_blocks(lambda b: print_block(b["title"], iframe_links(b["html"])))).drop("blocks")
    p = N.heading_numbers(p) if numbered else p.withColumn("number", F.lit(None).cast("string"))
    lvl, idx = F.col("level").cast("string"), F.col("page_idx").cast("string")
    title = F.concat_ws(" ", "number", "title")
    sec = F.concat(F.lit('<section id="section-'), idx, F.lit('" class="section-level-'), lvl, F.lit('">\n  <h'), lvl,
                   F.lit(' class="section-title-'), lvl, F.lit('">'), T.escape_text(F.upper(title)), F.lit("</h"), lvl, F.lit(">\n  "),
                   F.col("_body"), F.lit("\n</section>"))
    return (p.withColumn("_sec", sec).groupBy("doc_id")
            .agg(F.concat(F.lit('<div class="content-pages">\n'), F.expr("listagg(_sec, '\n') within group (order by page_idx)"),
                          F.lit("\n</div>")).alias("html")))


def render_summary(pages: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_count, block_count)."""
    p = with_blocks(pages, blocks)
    return p.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.sum(F.coalesce(F.size("blocks"), F.lit(0)).cast("long")).alias("block_count"))


def write_pages(page_rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Replace the page texts under `path`, one folder per hash bucket of documents."""
    (page_rows.withColumn("bucket", F.pmod(F.hash("doc_id"), F.lit(buckets))).write.mode("overwrite")
     .partitionBy("bucket").parquet(path))


def write_image_store(images: DataFrame, path: str) -> None:
    """Every distinct image once, by content hash."""
    images.dropDuplicates(["sha"]).write.mode("overwrite").parquet(path)

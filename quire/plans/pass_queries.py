"""Queries over the HTML passes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import images as I
from ..functions import text as T
from ..operators import markers as M
from ..operators import tokens as K
from . import corpus as C
from .issue_queries import CTX_SQL, FORM_SQL
from .registry import query

DOC_HTML = "select doc_id, string_agg({x}, '' order by pos) as html from {t} group by doc_id"


def clean_docs(spark, sf):
    return M.normalize_markers(C.marked_docs(spark, sf).select("doc_id", "html"))


def clean_tokens(spark, sf):
    return K.tokens(clean_docs(spark, sf), placed=True)


@query("marker_normalize", C.with_sql(C.EL_SQL) + DOC_HTML.format(x="html", t="el"))
def marker_normalize(spark, sf):
    return clean_docs(spark, sf)


@query("box_form", C.with_sql(CTX_SQL + FORM_SQL) + DOC_HTML.format(x="html_formed", t="form_el"))
def box_form(spark, sf):
    return K.untokenize(M.form_boxes(clean_tokens(spark, sf)))


# every line of the text; a third of them bring an embed in a paragraph of its own, a third one inside their text
_FRAME = "'&lt;iframe src=\"https://www.youtube.com/embed/v' || doc_id || '-' || {i} || '?a=1&amp;b=2\"&gt;&lt;/iframe&gt;'"
_SHOWN = ("""'<div class="sem_video"><iframe style="display: block; margin: 1em auto; max-width: 100%;" src="https://www.youtube.com/embed/v' || doc_id || '-' || line_no """
          """|| '?a=1&b=2"></iframe></div>'""")


def _embedded(a: str, i: str, own: str, inner: str) -> str:
    return (f"case {i} % 3 when 0 then '<p>' || {a} || '</p>' || {own} when 1 then '<p>' || {a} || {inner} || {a} || '</p>' else '<p>' || {a} || '</p>' end")


@query("embed_iframe", C.with_sql(C.LINES_SQL) + f"""select doc_id, string_agg({_embedded(C.escape_text('txt'), 'line_no', _SHOWN, _SHOWN)}, '' order by line_no) as html
from lines group by doc_id""")
def embed_iframe(spark, sf):
    frame = _FRAME.format(i="i")
    line = _embedded(C.escape_text("trim(x)"), "i", f"'<p> ' || {frame} || ' </p>'", frame)
    docs = C.placed(spark, sf).select("doc_id", F.array_join(F.expr(f"transform(split(text, '\\n'), (x, i) -> {line})"), "").alias("html"))
    return M.embed_iframes(docs)


ORIENT_SQL = """,
ori as (
  select *, case when k in (10, 12) and next_k = 11 then ''
    when k = 11 and prev_k = 10 then replace(html, '<table>', '<table class="sem_tabla_horizontal">')
    when k = 11 and prev_k = 12 then replace(html, '<table>', '<table class="sem_tabla_vertical">') else html end as html_orient,
    case when k = 11 then case when prev_k = 12 then 'vertical' else 'horizontal' end end as orient,
    sum(case when k = 11 then 1 else 0 end) over (partition by doc_id order by pos)::INT - 1 as tbl
  from ctx
)"""


@query("table_orient", C.with_sql(CTX_SQL + ORIENT_SQL) + DOC_HTML.format(x="html_orient", t="ori"))
def table_orient(spark, sf):
    return K.untokenize(M.orient_tables(clean_tokens(spark, sf)))


@query("table_headers", C.with_sql(CTX_SQL + ORIENT_SQL) + """
select doc_id, tbl, r::INT as "row", c::INT as col, 'c' || r || c || ' ' || substr(md5(txt), (r * 3 + c + 1)::INT, 4) as text,
  case when head then 'th' else 'td' end as tag, case when head then case orient when 'horizontal' then 'col' else 'row' end end as scope
from (select *, case orient when 'horizontal' then r = 0 else c = 0 end as head
      from ori, (values (0), (1), (2)) a(r), (values (0), (1), (2)) b(c) where k = 11)""")
def table_headers(spark, sf):
    t = M.structure_tables(M.orient_tables(clean_tokens(spark, sf)))
    t = M.table_cells(t).filter("tdepth > 0 and col >= 0 and row >= 0")
    cells = (t.groupBy("doc_id", "table_id", "row", "col")
             .agg(F.expr("listagg(tok, '') within group (order by pos)").alias("html")))
    w = Window.partitionBy("doc_id").orderBy("table_id")
    tag = F.regexp_extract("html", "^<(t[hd])", 1)
    return cells.select("doc_id", (F.dense_rank().over(w) - 1).alias("tbl"), F.col("row").cast("int").alias("row"),
                        F.col("col").cast("int").alias("col"), T.plain_text(F.col("html")).alias("text"), tag.alias("tag"),
                        T.attr(F.regexp_extract("html", "^(<[^>]+>)", 1), "scope").alias("scope"))


@query("resource_split_br", C.with_sql(CTX_SQL) + DOC_HTML.format(x="html_split", t="sp"))
def resource_split_br(spark, sf):
    return M.split_resource_breaks(clean_docs(spark, sf))


@query("resource_lines", C.with_sql(CTX_SQL) + f"""
select doc_id, kind, text, count(*) as n from (
  select doc_id, case when pos % 4 = 1 then 'documento' else 'video' end as kind,
    case when pos % 4 = 1 then 'doctail' else {C.plain(C.escape_text('txt'))} end as text
  from sp where k = 13 and pos % 4 <> 0 and (pos % 4 = 1 or txt <> '')) group by all""")
def resource_lines(spark, sf):
    t = M.resource_lines(K.tokens(M.split_resource_breaks(clean_docs(spark, sf)), placed=True))
    e = K.elements_of(t)
    kind = F.regexp_extract("open_tag", rf"{fixed.CLASS_PREFIX}recurso_(\w+)", 1)
    return (e.select("doc_id", kind.alias("kind"), "text").filter("kind <> ''")
            .groupBy("doc_id", "kind", "text").agg(F.count("*").alias("n")))


LISTS_SQL = """,
li as (
  select *, case when k in (14, 15) then (1 + length(txt) % 5)::INT end as n_items,
    (k in (14, 15) and pos % 7 = 0) as own_start,
    (level is not null or tag = 'ul') as is_reset
  from el
),
lr as (select *, sum((is_reset or own_start)::INT) over (partition by doc_id order by pos) as run from li),
ls as (
  select *, sum(n_items) over p as items_before, max(own_start::INT) over q as has_own
  from lr window p as (partition by doc_id, run order by pos rows between unbounded preceding and 1 preceding),
                 q as (partition by doc_id, run order by pos)
)"""
LIST_START = "case when k in (14, 15) and not own_start and items_before > 0 then (items_before + 1 + coalesce(has_own, 0) * 9)::BIGINT end"


@query("list_continue", C.with_sql(C.EL_SQL + LISTS_SQL) + f"""
select doc_id, pos, {LIST_START} as start_at from ls where k in (14, 15)""")
def list_continue(spark, sf):
    t = M.list_starts(clean_tokens(spark, sf))
    return t.filter("starts and tag = 'ol'").select("doc_id", F.col("block").cast("int").alias("pos"), "start_at")


@query("autolink", C.with_sql(C.LINES_SQL) + """
select doc_id, line_no, ord, case ord when 0 then 'www.site.org/p' || line_no else 'http://x.example.com/' || doc_id || '?a=1' end as url,
  case ord when 0 then 'https://www.site.org/p' || line_no else 'http://x.example.com/' || doc_id || '?a=1' end as href
from lines, (values (0), (1)) v(ord) where k = 20""")
def autolink(spark, sf):
    t = K.with_depth(clean_tokens(spark, sf))
    links = M.found_links(t.select("doc_id", "pos", "tok", "kind", "tag"))
    at = t.select("doc_id", "pos", F.col("block").alias("line_no"))
    return links.join(at, ["doc_id", "pos"]).select("doc_id", "line_no", "ord", "url", "href")


@query("autolink_html", C.with_sql(C.EL_SQL) + DOC_HTML.format(x="""case when k = 20 then
  replace(replace(html, 'www.site.org/p' || pos || ',', '<a href="https://www.site.org/p' || pos || '">www.site.org/p' || pos || '</a>,'),
          'http://x.example.com/' || doc_id || '?a=1.', '<a href="http://x.example.com/' || doc_id || '?a=1">http://x.example.com/' || doc_id || '?a=1</a>.')
  else html end""", t="el"))
def autolink_html(spark, sf):
    return K.untokenize(M.autolink(clean_tokens(spark, sf)))


@query("external_links", r"""
with docs as (select page_id as doc_id, '<p><a href="' || url || '">u</a></p>' || html as html from pages),
body as (select doc_id, regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<head\b[^>]*>.*?</head>', '', 'gis'),
    '(<script\b[^>]*>).*?(</script>)', '\1\2', 'gis') as html from docs),
a as (select doc_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from body)
select doc_id, href, regexp_matches(href, '^(?i)https?://') as external, count(*) as n from a group by all""")
def external_links(spark, sf):
    docs = C.page_docs(spark, sf).select("doc_id", F.concat(F.lit('<p><a href="'), "url", F.lit('">u</a></p>'), "html").alias("html"))
    f = M.link_flags(K.tokens(docs, placed=True))
    return f.groupBy("doc_id", "href", "external").agg(F.count("*").alias("n"))


@query("inline_images", C.with_sql(C.EL_SQL) + """
select doc_id, pos, (pos % 2 = 1 and text <> '') as is_inline,
  case when pos % 2 = 1 then 12 else ('0x' || substr(hex(from_base64(md5(txt))), 33, 8))::BIGINT end as w,
  case when pos % 2 = 1 then 7 else ('0x' || substr(hex(from_base64(md5(txt))), 41, 8))::BIGINT end as h
from el where k = 18""")
def inline_images(spark, sf):
    t = M.image_blocks(K.with_depth(clean_tokens(spark, sf)))
    return t.filter("tag = 'img'").select("doc_id", F.col("block").cast("int").alias("pos"), F.col("inline").alias("is_inline"),
                                          F.col("img_w").alias("w"), F.col("img_h").alias("h"))


# lists are continued among top-level blocks; the content of a formed box is not
TOP_SQL = """,
top as (
  select * from form_el e where not exists (
    select 1 from formed f where f.doc_id = e.doc_id and f.open_pos < e.pos and e.pos < f.close_pos)
)"""
FOLD_SQL = CTX_SQL + FORM_SQL + ORIENT_SQL + TOP_SQL + LISTS_SQL.replace("from el\n", "from top\n") + r""",
folded as (
  select e.doc_id, e.pos, case
    when e.opens or e.closes then e.html_formed
    when e.k in (10, 12) and o.html_orient = '' then ''
    when e.k = 11 then (
      select '<table class="sem_tabla_' || o.orient || '">' || (case o.orient when 'horizontal' then '<thead>' else '<tbody>' end) ||
        string_agg('<tr>' || cells || '</tr>' || (case when r = 0 and o.orient = 'horizontal' then '</thead><tbody>' when r = 2 then '</tbody>' else '' end), '' order by r) || '</table>'
      from (select r, string_agg(case when (o.orient = 'horizontal' and r = 0) then '<th scope="col">' || v || '</th>'
                                      when (o.orient = 'vertical' and c = 0) then '<th scope="row">' || v || '</th>' else '<td>' || v || '</td>' end, '' order by c) as cells
            from (select a.r, b.c, 'c' || a.r || b.c || ' ' || substr(md5(e.txt), (a.r * 3 + b.c + 1)::INT, 4) as v
                  from (values (0), (1), (2)) a(r), (values (0), (1), (2)) b(c)) group by r))
    when e.k = 13 and e.pos % 4 = 1 then replace(e.html_split, '<p>[documento:] ', '<p class="sem_recurso sem_recurso_documento">')
    when e.k = 13 and e.pos % 4 > 1 and e.txt <> '' then replace(e.html, '<p>[vídeo:] ', '<p class="sem_recurso sem_recurso_video">')
    when l.start_at is not null then replace(e.html, '<ol>', '<ol start="' || l.start_at || '">')
    when e.k = 20 then replace(replace(e.html,
        'www.site.org/p' || e.pos || ',', '<a href="https://www.site.org/p' || e.pos || '" target="_blank" rel="noopener noreferrer">www.site.org/p' || e.pos || '</a>,'),
        'http://x.example.com/' || e.doc_id || '?a=1.', '<a href="http://x.example.com/' || e.doc_id || '?a=1" target="_blank" rel="noopener noreferrer">http://x.example.com/' || e.doc_id || '?a=1</a>.')
    when e.k = 21 then replace(e.html, '<a href="https://in.example.com/' || e.doc_id || '">', '<a href="https://in.example.com/' || e.doc_id || '" target="_blank" rel="noopener noreferrer">')
    when e.k = 18 and e.pos % 2 = 1 then replace(e.html, ' data-w="12" data-h="7" />', case when e.text <> ''
        then ' class="sem_img_inline" width="12" height="7" style="width:12px;height:7px" />' else ' />' end)
    else e.html_formed end as html
  from form_el e join ori o using (doc_id, pos) left join (select doc_id, pos, """ + LIST_START + """ as start_at from ls) l using (doc_id, pos)
)"""


@query("html_passes", C.with_sql(FOLD_SQL) + DOC_HTML.format(x="html", t="folded"))
def html_passes(spark, sf):
    return M.apply_passes(C.marked_docs(spark, sf), placed=True)


# --- images -----------------------------------------------------------------------------

IMG_SQL = C.LINES_SQL + """,
img as (select doc_id, line_no, source, from_base64(md5(txt)) as content from lines where k = 18)"""


def found_images(spark, sf):
    """Data URLs of the marked documents, one row per occurrence."""
    d = C.marked_rows(spark, sf)
    urls = F.regexp_extract_all("html", F.lit(I.DATA_URL), F.lit(0))
    return d.select("doc_id", "source", F.posexplode_outer(urls).alias("ord", "url")).filter("url is not null")


@query("fn_sha256", C.with_sql(IMG_SQL) + "select doc_id, (row_number() over (partition by doc_id order by line_no) - 1)::INT as ord, sha256(content) as sha from img")
def fn_sha256(spark, sf):
    return found_images(spark, sf).select("doc_id", "ord", F.sha2(I.data_url_bytes(F.col("url")), 256).alias("sha"))


@query("fn_data_url", C.with_sql(IMG_SQL) + """select doc_id, (row_number() over (partition by doc_id order by line_no) - 1)::INT as ord,
  'png' as subtype, octet_length(content)::INT as n_bytes, 'data:image/png;base64,' || base64(content) as again from img""")
def fn_data_url(spark, sf):
    b = I.data_url_bytes(F.col("url"))
    return found_images(spark, sf).select("doc_id", "ord", I.data_url_subtype(F.col("url")).alias("subtype"),
                                          F.octet_length(b).alias("n_bytes"), I.data_url(F.lit("png"), b).alias("again"))


@query("fn_image_size", C.with_sql(IMG_SQL) + """select doc_id, (row_number() over (partition by doc_id order by line_no) - 1)::INT as ord,
  ('0x' || substr(hex(content), 33, 8))::BIGINT as width, ('0x' || substr(hex(content), 41, 8))::BIGINT as height from img""")
def fn_image_size(spark, sf):
    s = I.data_url_size(F.col("url"))
    return found_images(spark, sf).select("doc_id", "ord", s["width"].alias("width"), s["height"].alias("height"))


@query("image_extract", C.with_sql(C.EL_SQL) + DOC_HTML.format(x="""case when k = 18 then replace(html, 'data:image/png;base64,' || md5(txt),
   'content/resources/img_' || sha256(from_base64(md5(txt))) || '.png') else html end""", t="el"))
def image_extract(spark, sf):
    return M.extract_images(clean_docs(spark, sf))


@query("image_dedup", C.with_sql(IMG_SQL) + """select sha256(content) as sha, 'content/resources/img_' || sha256(content) || '.png' as path,
  count(*) as refs, count(distinct doc_id) as docs from img group by content""")
def image_dedup(spark, sf):
    return M.image_store(M.image_refs(C.marked_rows(spark, sf))).select("sha", "path", "refs", "docs")

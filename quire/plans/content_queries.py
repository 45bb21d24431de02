"""Queries over sanitising and content reading, on raw pages and on derived documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import content as Q
from ..operators import structure as R
from ..operators import tokens as K
from . import corpus as C
from .registry import query, table
from .structure_queries import TOK_SQL


def page_tokens(spark, sf):
    return K.tokens(C.page_docs(spark, sf), placed=True)


def _decode(x):
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


ALLOWED = "('b','i','strike','p','ul','ol','li','table','th','td','thead','tbody','tr','strong','em','u','sup','sub','blockquote','pre','code','h3','h4','h5','h6','a')"
SAN_SQL = TOK_SQL + f""",
s0 as (select *, (kind in ('text', 'bracket') or (tag = 'br' and kind <> 'close') or (tag in ('p', 'td', 'th') and kind = 'open') or (tag = 'a' and kind = 'open' and tok like '%href="_%')) as counted,
   regexp_extract(tok, 'href="([^"]*)"', 1) as href from tk),
s1 as (select *, sum(coalesce(counted, false)::INT) over (partition by doc_id order by pos) as c,
   sum(case kind when 'open' then 1 when 'close' then -1 else 0 end) over (partition by doc_id, tag order by pos) + (kind = 'close')::INT as lvl from s0),
s2 as (select *, lag(kind) over v as pk, lead(kind) over v as nk, lag(c) over v as pc, lead(c) over v as nc, lag(href) over v as ph from s1 window v as (partition by doc_id, tag, lvl order by pos)),
s3 as (select *, (kind = 'open' and nk = 'close') or (kind = 'close' and pk = 'open') as matched,
   case when kind = 'open' then nc - c when kind = 'close' then c - pc end as inside, case when kind = 'open' then href else ph end as link from s2),
s4 as (select *, tag in {ALLOWED} and (coalesce(matched, false) or tag = 'p') and (tag in ('p', 'td', 'th', 'a') or inside > 0) and (tag <> 'a' or link <> '') as live,
   case tag when 'b' then 'strong' when 'i' then 'em' when 'strike' then 'del' else tag end as o from s3),
s5 as (select doc_id, pos, case when kind in ('text', 'bracket') then {C.escape_xml(_decode('tok'))}
   when tag = 'br' then '<br />' when not coalesce(live, false) then ''
   when kind = 'open' then '<' || o || (case when tag = 'a' then ' href="' || {C.escape_xml('link')} || '"' || (case when regexp_matches(link, '(?i)^https?://') then ' target="_blank" rel="noopener noreferrer"' else '' end) else '' end) || '>'
   else '</' || o || '>' end as out from s4)
"""


@query("sanitize_allowlist", SAN_SQL + "select doc_id, string_agg(out, '' order by pos) as html from s5 group by doc_id")
def sanitize_allowlist(spark, sf):
    return Q.sanitize_docs(C.page_docs(spark, sf), placed=True)


def _with_embeds(spark, sf):
    extra = F.concat(F.lit('<iframe src="https://www.youtube.com/embed/v'), "page_id", F.lit('"><b>x</b></iframe><video controls></video><p><a href="'), "url",
                     F.lit('" target="_top">u</a></p><object data="d.swf"></object><script>alert(1)</script>'))
    return table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.concat(extra, "html").alias("html"))


@query("sanitize_preview", TOK_SQL + r"""
select doc_id, '<div class="preview-embed-placeholder">▶ Vídeo: https://www.youtube.com/watch?v=v' || doc_id || '</div><video controls></video><p><a href="' || url || '" target="_top">u</a></p>'
  || '<div class="preview-embed-placeholder">Contenido incrustado omitido en la vista previa.</div><div class="preview-embed-placeholder">Contenido incrustado omitido en la vista previa.</div>'
  || string_agg(case when tag = 'a' and kind = 'open' and not regexp_matches(tok, 'href="(#|[a-z]+:|//)') then regexp_replace(tok, 'href="[^"]*"', 'href="#"') else tok end, '' order by pos) as html
from tk join pages on page_id = doc_id group by doc_id, url""")
def sanitize_preview(spark, sf):
    return K.untokenize(Q.sanitize_preview(K.tokens(_with_embeds(spark, sf))))


@query("embedded_notices", """
select page_id as doc_id, v.tag, case v.tag when 'iframe' then 'https://www.youtube.com/embed/v' || page_id when 'object' then 'd.swf' else 'sin URL' end as source,
  '[Contenido incrustado omitido: ' || (case v.tag when 'iframe' then 'https://www.youtube.com/embed/v' || page_id when 'object' then 'd.swf' else 'sin URL' end) || ']' as notice
from pages, (values ('iframe'), ('video'), ('object')) v(tag)""")
def embedded_notices(spark, sf):
    return Q.embedded_notices(K.tokens(_with_embeds(spark, sf))).select("doc_id", "tag", "source", "notice")


@query("distinct_warnings", """
select 'contenido incrustado (' || tag || ') omitido: ' || source as warning, min(ord) as first_ord from (
  select page_id * 1000 as ord, v.tag, case v.tag when 'iframe' then 'https://www.youtube.com/embed/v' || page_id when 'object' then 'd.swf' else 'sin URL' end as source
  from pages, (values ('iframe'), ('video'), ('object')) v(tag)) group by all""")
def distinct_warnings(spark, sf):
    n = Q.embedded_notices(K.tokens(_with_embeds(spark, sf))).select((F.col("doc_id") * 1000).alias("ord"), "warning")
    return Q.distinct_warnings(n, [])


# nested lists in two kinds, from the lines of the documents
LIST_HTML = ("'<ol><li>a ' || {t} || '<ul><li>b</li></ul></li><li>c<ol><li>d ' || cast({i} as string) || '</li></ol> e</li></ol><ul><li>f<ol><li>g</li></ol></li></ul>'")


@query("list_flatten", C.with_sql(C.LINES_SQL) + f"""
select doc_id, (row_number() over (partition by doc_id order by line_no, v.o) - 1)::INT as ord, v.level::INT as level, v.n > 0 as ordered,
  (case when v.n > 0 then line_no * 2 + v.n end)::INT as instance,
  case v.o when 0 then trim('a ' || {C.collapse("replace(txt, '&', '+')")}) when 3 then 'd ' || line_no when 1 then 'b' when 2 then 'c e' when 4 then 'f' else 'g' end as text
from lines, (values (0, 0, 1), (1, 1, 0), (2, 0, 1), (3, 1, 1), (4, 0, 0), (5, 1, 2)) v(o, level, n)""")
def list_flatten(spark, sf):
    from pyspark.sql import Window
    one = LIST_HTML.format(t="replace(trim(t), '&', '+')", i="i")
    d = C.placed(spark, sf).select("doc_id", F.array_join(F.expr(f"transform(split(text, '\\n'), (t, i) -> {one})"), "").alias("html"))
    r = Q.flatten_lists(K.tokens(d, placed=True))
    w = Window.partitionBy("doc_id").orderBy("pos")
    return r.select("doc_id", (F.row_number().over(w) - 1).alias("ord"), "level", "ordered", "instance", "text")


@query("list_flatten_pages", TOK_SQL + f""", n as (select doc_id, pos, tok from tk),
it as (select doc_id, pos, lead(tok) over (partition by doc_id order by pos) as a, lead(tok, 2) over (partition by doc_id order by pos) as t from tk where true)
select doc_id, {C.plain('t')} as text, count(*) as n from (select i.* from it i join tk k using (doc_id, pos) where k.tag = 'li' and k.kind = 'open') group by all""")
def list_flatten_pages(spark, sf):
    return Q.flatten_lists(page_tokens(spark, sf)).groupBy("doc_id", "text").agg(F.count("*").alias("n"))


@query("pre_lines", """select doc_id, unnest(string_split(text, chr(10))) as line,
  (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT as line_no from documents""")
def pre_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("text"))
    return Q.pre_lines(d).select("doc_id", "line", "line_no")


RUN_SQL = TOK_SQL + f""",
r0 as (select *, sum(case when tag in ('strong', 'b') then case kind when 'open' then 1 when 'close' then -1 else 0 end else 0 end) over w > 0 as bold,
  sum(case when tag in ('em', 'i') then case kind when 'open' then 1 when 'close' then -1 else 0 end else 0 end) over w > 0 as italic,
  last_value(case when tag = 'a' and kind = 'open' then regexp_extract(tok, 'href="([^"]*)"', 1) when tag = 'a' then '' end ignore nulls) over w as href
  from tk window w as (partition by doc_id order by pos rows unbounded preceding))"""


@query("inline_runs", RUN_SQL + f"""
select doc_id, pos::INT as pos, case when tag = 'br' then '' else regexp_replace({_decode('tok')}, '{C.WS}+', ' ', 'g') end as text, bold, italic,
  case when regexp_matches(href, '(?i)^(https?:|mailto:)') then href end as href, coalesce(tag = 'br', false) as is_break
from r0 where tag is null or tag = 'br'""")
def inline_runs(spark, sf):
    return Q.inline_runs(page_tokens(spark, sf)).select("doc_id", "pos", "text", "bold", "italic", "href", "is_break")


# headings with images and links, from the lines
HEAD_HTML = """'<h2>' || (case {i} % 4 when 0 then '<img src="l.png" />' || {t} when 1 then '<a href="/x"><img src="l.png" /> <img src="m.png" /></a><b>' || {t} || '</b>'
  when 2 then '<em>see</em> <a href="https://e.com/?a=1&amp;b=' || cast({i} as string) || '"><b>' || {t} || '</b></a> end' else '<a href="/r">' || {t} || '</a><img src="n.png" />' end) || '</h2>'"""
HEAD_TEXT = "replace(replace({t}, '&', '+'), '<', '-')"
HEAD_SQL = C.LINES_SQL + f""",
hd as (select doc_id, line_no, {C.collapse(HEAD_TEXT.format(t='txt'))} as y from lines)"""


def heading_rows(spark, sf):
    d = C.lines(spark, sf).withColumn("y", F.expr(HEAD_TEXT.format(t="txt")))
    return d.select("doc_id", "line_no", "y", F.expr(HEAD_HTML.format(i="line_no", t="y")).alias("html"))


MEDIA = """case line_no % 4 when 0 then '<img src="l.png" />' when 1 then '<a href="/x"><img src="l.png" /> <img src="m.png" /></a>' when 2 then '' else '<img src="n.png" />' end"""
LINKED = """case when y = '' then '' when line_no % 4 = 2 then 'see <a href="https://e.com/?a=1&amp;b=' || line_no || '" target="_blank" rel="noopener noreferrer">' || {e} || '</a> end'
  when line_no % 4 = 3 then '<a href="/r">' || {e} || '</a>' else '' end""".format(e=C.escape_xml("y"))


@query("heading_media", C.with_sql(HEAD_SQL) + f"select doc_id, line_no, {MEDIA} as media from hd")
def heading_media(spark, sf):
    return heading_rows(spark, sf).select("doc_id", "line_no", R.heading_media(F.col("html")).alias("media"))


@query("heading_link_text", C.with_sql(HEAD_SQL) + f"select doc_id, line_no, {LINKED} as linked from hd")
def heading_link_text(spark, sf):
    return heading_rows(spark, sf).select("doc_id", "line_no", R.heading_link_text(F.col("html")).alias("linked"))


@query("heading_media_place", C.with_sql(HEAD_SQL) + f""", x as (select *, {MEDIA} as media, {LINKED} as linked,
   case when line_no % 4 = 2 then trim('see ' || y || ' end') else y end as title from hd),
g as (select doc_id, line_no, case when title = '' then '' else '<h2>' || media || (case when linked <> '' then linked else {C.escape_xml('title')} end) || '</h2>' end as h from x)
select doc_id, case when coalesce(string_agg(h, chr(10) order by line_no) filter (where h <> ''), '') = '' then '<p></p>' else string_agg(h, chr(10) order by line_no) filter (where h <> '') end as html from g group by doc_id""")
def heading_media_place(spark, sf):
    """Level-2 headings kept as text: the image goes in front, the link stays."""
    one = HEAD_HTML.format(i="i", t=HEAD_TEXT.format(t="trim(t)"))
    d = C.placed(spark, sf).select("doc_id", F.array_join(F.expr(f"transform(split(text, '\\n'), (t, i) -> {one})"), "").alias("html"))
    return R.page_blocks(R.outline_of(d, placed=True)).select("doc_id", "html")

"""Queries over the scalar functions, on the lines of `documents` and on other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import images as I
from ..functions import text as T
from . import corpus as C
from .registry import query, table

L = C.with_sql(C.LINES_SQL)
# a line dressed up with tags, entities, blanks and accents
DRESS = "'<b>' || txt || '</b> &amp; &lt;x&gt; \"q\" ''a'' &nbsp; Ünïcode Ñ  ' || lang || '<i> ª</i>'"
HTML = "'<h1>' || txt || '</h1><h2 class=\"a\">' || txt || ' &aacute; <em>it</em></h2><p>tail ' || lang || '</p>'"

PLUS = "replace(txt, '&', '+')"


def _lines(spark, sf, expr="txt"):
    return C.lines(spark, sf).withColumn("x", F.expr(expr.replace("''a''", "\\'a\\'")))


def scalar(key, fn, sql, expr="txt"):
    """One value per line: `fn` on the Spark side, `sql` (over x) on the other."""
    @query(key, L + f", b as (select doc_id, line_no, lang, txt, {expr} as x from lines) select doc_id, line_no, {sql} as v from b")
    def run(spark, sf):
        return _lines(spark, sf, expr).select("doc_id", "line_no", fn(F.col("x")).alias("v"))
    return run


scalar("fn_escape_xml", T.escape_xml, C.escape_xml("x"), DRESS)
scalar("fn_escape_text", T.escape_text, C.escape_text("x"), DRESS)
scalar("fn_unescape_basic", T.unescape_basic, "replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')", DRESS)
scalar("fn_unescape_xml", T.unescape_xml, "'<' || txt || '> é \" '' ñ€ &' || lang",
       "'&lt;' || txt || '&gt; &#233; &quot; &apos; &#xF1;&#x20AC; &amp;' || lang")
scalar("fn_upper_h2", T.upper_h2,
       f"'<h1>' || @ || '</h1><h2 class=\"a\">' || {C.upper('@')} || ' &aacute; <em>IT</em></h2><p>tail ' || lang || '</p>'".replace("@", PLUS),
       HTML.replace("txt", PLUS))
scalar("fn_strip_diacritics", T.strip_diacritics, "strip_accents(x)", "txt || ' ÁÉñçÖøß Šž'")
scalar("fn_normalize_text", T.normalize_text, C.collapse("x"), "'  ' || txt || '  \t x '")
scalar("fn_normalize_tag", T.normalize_tag,
       "regexp_replace(strip_accents(lower(translate(x, 'ºª', 'oa'))), '[^a-z0-9]', '', 'g')", "txt || ' 3º [1ª]'")
scalar("fn_normalize_title", T.normalize_title, C.collapse("lower(strip_accents(x))"), "'  ' || txt || '   É '")
scalar("fn_slug", T.slug, C.slug("x"))
scalar("fn_stem", lambda x: T.blank_to(T.stem(x), fixed.DEFAULT_DOC_TITLE),
       f"case when {C.strip('''regexp_replace(x, '[.][^.]+$', '')''')} = '' then 'Documento importado' else {C.strip('''regexp_replace(x, '[.][^.]+$', '')''')} end",
       "case when line_no % 5 = 0 then '.docx' else ' ' || txt || ' v1.docx' end")
scalar("fn_title_scale", lambda x: F.round(T.title_scale(x, 90) * 100).cast("int"),
       f"(case when length({C.strip('x')}) <= 90 then 100 else round(greatest(0.4, round(sqrt(90.0::DOUBLE / length({C.strip('x')})), 2)) * 100) end)::INT")
scalar("fn_context_after", T.context_after, C.context_after("x"), HTML)
scalar("fn_context_before", T.context_before, C.context_before("x"), HTML)
scalar("fn_heading_text", T.heading_text, f"substr({C.untagged('x')}, 1, 60)", HTML)
scalar("fn_truncate", lambda x: T.truncate(x, 40), "case when length(x) <= 40 then x else rtrim(substr(x, 1, 39)) || '…' end")
scalar("fn_plain_text", T.plain_text, C.plain("x"), DRESS)
scalar("fn_has_content", T.has_content, f"({C.plain('x')} <> '' or regexp_matches(x, '(?i)<(img|table|iframe|video)\\b'))",
       "case line_no % 4 when 0 then '<p> &nbsp;</p>' when 1 then '<p><img src=\"a\"></p>' when 2 then '<p><b></b></p>' else '<p>' || txt || '</p>' end")
scalar("fn_without_code", T.without_code, "txt || '<p></p>b' || lang",
       "txt || '<pre class=\"k\">[fin] ' || lang || '</pre><p><code>[pie]</code></p>b' || lang")
scalar("fn_fnv1a", T.fnv1a, C.fnv1a("x"))
scalar("fn_video_link", T.video_link,
       "case when line_no % 2 = 0 then 'https://www.youtube.com/watch?v=' || lang || line_no else 'https://v.example.com/' || lang end",
       "case when line_no % 2 = 0 then 'https://www.youtube-nocookie.com/embed/' || lang || line_no || '?rel=0' else 'https://v.example.com/' || lang end")
scalar("fn_depth_tag", lambda x: T.depth_tag(x.cast("int")),
       "case when x::INT <= 0 then '' when x::INT = 1 then ' [Subpágina]' else ' [3er nivel]' end", "cast(line_no % 4 as string)")


@query("fn_document_title", """
with b as (select doc_id, 'doc ' || doc_id || '.docx' as f,
  case doc_id % 4 when 0 then '' when 1 then ' Generated  by python-docx ' when 2 then ' ' || source || ' ' end as d from documents)
select doc_id, case when doc_id % 4 = 2 then trim(d) else 'doc ' || doc_id end as title,
  case when doc_id % 4 = 2 then 'description' else 'filename' end as source from b""")
def fn_document_title(spark, sf):
    d = table(spark, sf, "documents")
    desc = F.expr("case doc_id % 4 when 0 then '' when 1 then ' Generated  by python-docx ' when 2 then ' ' || source || ' ' end")
    return (d.select("doc_id", T.document_title(F.concat(F.lit("doc "), "doc_id", F.lit(".docx")), desc).alias("r"))
            .select("doc_id", "r.title", "r.source"))


@query("fn_image_ext", """
select p_partkey, coalesce(case lower(x) when 'jpeg' then 'jpg' when 'jpg' then 'jpg' when 'png' then 'png' when 'gif' then 'gif'
    when 'webp' then 'webp' when 'svg+xml' then 'svg' when 'bmp' then 'bmp' end, 'png') as stored,
  case lower(x) when 'jpeg' then 'jpg' when 'jpg' then 'jpg' when 'png' then 'png' when 'gif' then 'gif' when 'bmp' then 'bmp' end as word
from (select p_partkey, case p_size % 8 when 0 then 'JPEG' when 1 then 'jpg' when 2 then 'PNG' when 3 then 'gif' when 4 then 'webp'
  when 5 then 'svg+xml' when 6 then 'bmp' else 'tiff' end as x from part)""")
def fn_image_ext(spark, sf):
    x = F.expr("case p_size % 8 when 0 then 'JPEG' when 1 then 'jpg' when 2 then 'PNG' when 3 then 'gif' when 4 then 'webp' when 5 then 'svg+xml' when 6 then 'bmp' else 'tiff' end")
    return table(spark, sf, "part").select("p_partkey", I.image_ext(x).alias("stored"), I.word_image_ext(x).alias("word"))


@query("fn_fit_width", """
with b as (select p_partkey, case when p_size % 3 = 0 then null else p_size * 37 end as aw, case when p_size % 5 = 0 then 0 else p_size * 11 end as ah,
  case when p_size % 7 <> 0 then p_partkey % 1500 + 1 end as sw, case when p_size % 7 <> 0 then p_partkey % 900 + 1 end as sh from part),
s as (select *, case when aw > 0 and ah > 0 then aw when sw is not null then sw else 400 end::BIGINT as w,
  case when aw > 0 and ah > 0 then ah when sw is not null then sh else 300 end::BIGINT as h from b)
select p_partkey, least(w, 600) as width, case when w > 600 then greatest(1, floor(h * 600 / w::DOUBLE + 0.5)::BIGINT) else h end as height,
  round(least(1.0::DOUBLE, 2000.0::DOUBLE / w, 2800.0::DOUBLE / h) * 1000)::INT as print_scale from s""")
def fn_fit_width(spark, sf):
    b = table(spark, sf, "part").select(
        "p_partkey", F.expr("case when p_size % 3 = 0 then null else p_size * 37 end").alias("aw"),
        F.expr("case when p_size % 5 = 0 then 0 else p_size * 11 end").alias("ah"),
        F.expr("case when p_size % 7 <> 0 then p_partkey % 1500 + 1 end").alias("sw"),
        F.expr("case when p_size % 7 <> 0 then p_partkey % 900 + 1 end").alias("sh"))
    size = I.fit_width(F.col("aw"), F.col("ah"), F.col("sw"), F.col("sh"))
    own = I.fit_width(F.col("aw"), F.col("ah"), F.col("sw"), F.col("sh"), limit=10**9)
    scale = F.round(I.print_scale(own["width"], own["height"]) * 1000).cast("int")
    return b.select("p_partkey", size["width"].alias("width"), size["height"].alias("height"), scale.alias("print_scale"))


@query("fn_resource_name", """
select page_id, case page_id % 3 when 0 then 'img ' || page_id || '.png' when 1 then 'a+b%zz' || page_id || '.jpg'
  else 'x' || page_id || '.gif' end as name from pages""")
def fn_resource_name(spark, sf):
    src = F.expr("case page_id % 3 when 0 then './resources/img%20' || page_id || '.png' when 1 then 'resources/a+b%zz' || page_id || '.jpg' else '/d/e/x' || page_id || '.gif' end")
    return table(spark, sf, "pages").select("page_id", T.resource_name(src).alias("name"))


@query("fn_next_version", """
select p_partkey, (greatest(coalesce(pub, 0), coalesce(loc, 0)) + 1)::INT as next,
  case when p_size % 2 = 0 then '<theme><version>' || (greatest(coalesce(pub, 0), coalesce(loc, 0)) + 1) || '</version><name>n</name></theme>'
       else '<theme> <version>' || (greatest(coalesce(pub, 0), coalesce(loc, 0)) + 1) || '</version>' || chr(10) || '    <name>n</name></theme>' end as xml
from (select p_partkey, p_size, case when p_size % 3 <> 0 then p_size end as pub, case when p_size % 5 <> 0 then (p_partkey % 60)::INT end as loc from part)""")
def fn_next_version(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", "p_size", F.expr("case when p_size % 3 <> 0 then p_size end").alias("pub"),
        F.expr("case when p_size % 5 <> 0 then cast(p_partkey % 60 as int) end").alias("loc"))
    xml = F.expr("case when p_size % 2 = 0 then '<theme><version> 3 </version><name>n</name></theme>' else '<theme> <name>n</name></theme>' end")
    nxt = T.next_version(F.col("pub"), F.col("loc"))
    return p.select("p_partkey", nxt.alias("next"), T.set_version(xml, nxt).alias("xml"))


@query("fn_protect_code", L + """
select doc_id, string_agg('<p>' || replace(replace(replace(txt, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p><pre>[ejemplo] x [fin]</pre><div class="sem_pie"><p>y</p></div>', '' order by line_no) as html
from lines group by doc_id""")
def fn_protect_code(spark, sf):
    """Markers inside code stay as they are while those around it form boxes."""
    from ..operators import markers as M
    from ..operators import tokens as K
    one = ("'<p>' || replace(replace(replace(trim(t), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || "
           "'</p><pre>[ejemplo] x [fin]</pre><p>[pie]</p><p>y</p><p>[fin]</p>'")
    docs = C.placed(spark, sf).select("doc_id", F.array_join(F.expr(f"transform(split(text, '\\n'), t -> {one})"), "").alias("html"))
    return K.untokenize(M.form_boxes(K.tokens(docs, placed=True)))

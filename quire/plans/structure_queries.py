"""Queries over structuring, navigation and the written rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import heading_tags as H
from ..operators import issues as S
from ..operators import markers as M
from ..operators import nav as N
from ..operators import sinks as W
from ..operators import structure as R
from ..operators import tokens as K
from . import corpus as C
from .registry import query, table

HS = C.with_sql(C.HS_SQL)


def docs(spark, sf):
    return C.structured_docs(spark, sf)


def flow(spark, sf):
    return R.flow(K.elements(docs(spark, sf), placed=True))


def sections(spark, sf):
    return R.sections(flow(spark, sf))


def items(spark, sf):
    return R.section_items(flow(spark, sf))


def pages(spark, sf):
    return R.pages(sections(spark, sf))


def outline(spark, sf):
    return R.outline_of(docs(spark, sf), placed=True)


@query("src_html_docs", """
select page_id as doc_id, url as filename, length(html) as n_chars from pages""")
def src_html_docs(spark, sf):
    return C.page_docs(spark, sf).select("doc_id", F.col("url").alias("filename"), F.length("html").cast("bigint").alias("n_chars"))


TOK_SQL = r"""with body as (select page_id as doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
    '<head\b[^>]*>.*?</head>', '', 'gis'), '(<script\b[^>]*>).*?(</script>)', '\1\2', 'gis'), '(<style\b[^>]*>).*?(</style>)', '\1\2', 'gis'), '</?(html|body|!doctype)\b[^>]*>', '', 'gi') as html from pages),
tk0 as (select doc_id, unnest(regexp_extract_all(html, '<[^>]+>|\[[^\[\]<>]*\]|[^<\[]+|[<\[]')) as tok,
  generate_subscripts(regexp_extract_all(html, '<[^>]+>|\[[^\[\]<>]*\]|[^<\[]+|[<\[]'), 1) - 1 as pos from body),
tk1 as (select *, nullif(lower(regexp_extract(tok, '^</?([a-zA-Z!][a-zA-Z0-9:!-]*)', 1)), '') as tag from tk0),
tk as (select *, case when tag is null then case when regexp_matches(tok, '^\[.*\]$') then 'bracket' else 'text' end when tok like '</%' then 'close'
   when tag in ('area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr') or tok like '%/>' then 'void' else 'open' end as kind
  from tk1)"""

CONTAINERS = "('div','article','section','nav','aside','header','footer','main','figure','ul','ol','dl','table','blockquote','pre','form','details','h1','h2','h3','h4','h5','h6','video','audio','object','iframe')"
PAGE_EL_SQL = TOK_SQL + f""",
d0 as (select *, case when tag in {CONTAINERS} then case kind when 'open' then 1 when 'close' then -1 else 0 end else 0 end as d from tk),
d1 as (select *, sum(d) over (partition by doc_id order by pos) as s from d0),
d2 as (select *, s - least(0, min(s) over (partition by doc_id order by pos)) as after_d from d1),
d3 as (select *, coalesce(lag(after_d) over (partition by doc_id order by pos), 0) as depth from d2),
d4 as (select *, coalesce(last_value(case when depth = 0 and tag = 'p' and kind = 'open' then 1 when depth = 0 and tag = 'p' and kind = 'close' then 0
    when depth = 0 and tag in {CONTAINERS} and kind = 'open' then 0 end ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as in_p from d3),
d5 as (select *, coalesce(depth = 0 and ((kind = 'open' and (tag in {CONTAINERS} or tag = 'p')) or (tag in ('img', 'hr', 'embed') and in_p = 0)), false) as starts from d4),
d6 as (select *, sum(starts::INT) over (partition by doc_id order by pos) - 1 as block from d5),
pel as (select doc_id, block::INT as pos, arg_min(tag, pos) as tag, string_agg(tok, '' order by pos) as html
  from d6 where (starts or depth > 0 or in_p = 1) and block >= 0 group by doc_id, block)"""


@query("elements", PAGE_EL_SQL + f"select doc_id, pos, tag, {C.plain('html')} as text, md5(html) as digest from pel")
def elements(spark, sf):
    return K.elements(C.page_docs(spark, sf), placed=True).select("doc_id", "pos", "tag", "text", F.md5("html").alias("digest"))


@query("elements_marked", C.with_sql(C.EL_SQL) + "select doc_id, pos, tag, level, text from el")
def elements_marked(spark, sf):
    d = M.normalize_markers(C.marked_docs(spark, sf).select("doc_id", "html"))
    return K.elements(d, placed=True).select("doc_id", "pos", "tag", "level", "text")


@query("parse_structure", HS + "select doc_id, h1_ord, idx, title, level, word_level, synthetic from sect")
def parse_structure(spark, sf):
    return sections(spark, sf).drop("pos")


@query("parse_structure_items", HS + "select doc_id, h1_ord, h2_ord, text, option, word_option from items")
def parse_structure_items(spark, sf):
    return items(spark, sf).drop("pos")


@query("sectionize", HS + "select doc_id, sec, level, text, html from secs")
def sectionize(spark, sf):
    return R.sectionize(flow(spark, sf)).select("doc_id", "sec", "level", "text", "html")


@query("section_ranges", HS + """, n as (select doc_id, count(*)::INT as n, min(case when level = 1 then sec end) as h1 from secs group by doc_id)
select s.doc_id, s.h1_ord, case when synthetic then 0 else h.sec + 1 end::INT as start,
  case when synthetic then coalesce(n.h1, n.n, 0) else coalesce((select min(x.sec) from secs x where x.doc_id = s.doc_id and x.level = 1 and x.sec > h.sec), n.n) end::INT as "end"
from sect s left join n on n.doc_id = s.doc_id left join secs h on h.doc_id = s.doc_id and h.level = 1 and h.h1_ord = s.h1_ord and not s.synthetic""")
def section_ranges(spark, sf):
    r = R.section_ranges(flow(spark, sf))
    return r.select("doc_id", "h1_ord", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@query("h2_content", HS + """select i.doc_id, i.h1_ord, i.h2_ord, coalesce(c.content, '') as content
from items i left join conts c on c.doc_id = i.doc_id and c.h1_ord = i.h1_ord and c.h2_key = i.h2_ord""")
def h2_content(spark, sf):
    fl = flow(spark, sf)
    return R.h2_content(fl, R.section_items(fl))


@query("serialize_range", HS + "select doc_id, h1_ord, h2_key, content from conts")
def serialize_range(spark, sf):
    return R.contents(flow(spark, sf)).select("doc_id", "h1_ord", "h2_key", "content")


@query("page_parent", HS + "select doc_id, page_idx, title, level, parent_idx from pages_out")
def page_parent(spark, sf):
    return pages(spark, sf).drop("h1_ord")


@query("h2_option_blocks", HS + "select doc_id, h1_ord, block_idx, title, html from blocks_out")
def h2_option_blocks(spark, sf):
    fl = flow(spark, sf)
    return R.option_blocks(R.item_chunks(fl))


@query("panel_groups", HS + """select doc_id, h1_ord, group_id, min(option) as option, count(*) as panels, min(h2_ord) as first_h2,
  string_agg(text, '|' order by h2_ord) as titles from chunks where group_id is not null group by doc_id, h1_ord, group_id""")
def panel_groups(spark, sf):
    fl = flow(spark, sf)
    return R.panel_groups(R.item_chunks(fl, R.section_items(fl)))


@query("group_end_split", HS + "select doc_id, h1_ord, h2_key, body0 as body, spill0 as spill from cut")
def group_end_split(spark, sf):
    c = R.contents(flow(spark, sf)).withColumn("r", R.split_group_end(F.col("content")))
    return c.select("doc_id", "h1_ord", "h2_key", "r.body", "r.spill")


@query("default_fill", HS + "select doc_id, page_idx, block_idx, title, html from page_blocks")
def default_fill(spark, sf):
    return R.page_blocks(outline(spark, sf))


WORD = "case when idx = 0 then 1 else coalesce(word_level, 1) end"


@query("apply_word_structure", HS + f""", u as (
  select doc_id, word_level is not null as t, (level + h1_ord % 2) = ({WORD}) as m from sect
  union all select doc_id, word_option is not null, option = coalesce(word_option, 'html') from items)
select doc_id, bool_or(t) as has_tags, bool_and(m) as matches_tags from u group by doc_id""")
def apply_word_structure(spark, sf):
    """Two questions about choices that move every second section one level down."""
    fl = flow(spark, sf)
    moved = R.sections(fl).withColumn("level", F.col("level") + F.col("h1_ord") % 2)
    return R.word_structure_state(moved, R.section_items(fl))


@query("apply_word_structure_levels", HS + f"select doc_id, h1_ord, ({WORD})::INT as level from sect")
def apply_word_structure_levels(spark, sf):
    fl = flow(spark, sf)
    s, _ = R.apply_word_structure(R.sections(fl).withColumn("level", F.lit(1)), R.section_items(fl))
    return s.select("doc_id", "h1_ord", "level")


@query("heading_tag_first_page", HS + """select doc_id, 'heading-tag-first-page' as kind, case word_level when 2 then 'Subpágina' else '3er nivel' end as label, title as context
from sect where idx = 0 and word_level > 1""")
def heading_tag_first_page(spark, sf):
    return H.first_page_issue(sections(spark, sf)).select("doc_id", "kind", "label", "context")


RULES_SQL = C.HS_SQL + """,
rules as (
  select doc_id, 'level-jump' as rule, h1_ord, null::INT as h2_ord from (select *, coalesce(lag(level) over (partition by doc_id order by idx), 0) as p from sect) where level = 3 and p not in (2, 3)
  union all
  select doc_id, 'title-not-last', h1_ord, h2_ord from (select *, lead(option) over (partition by doc_id, h1_ord order by h2_ord) as nx from items) where option = 'idevice-title' and nx <> 'idevice-title'
)"""


@query("structure_rules", C.with_sql(RULES_SQL) + "select doc_id, rule, h1_ord, h2_ord from rules")
def structure_rules(spark, sf):
    fl = flow(spark, sf)
    return S.structure_rules(R.sections(fl), R.section_items(fl))


@query("section_error_counts", C.with_sql(RULES_SQL) + """select s.doc_id, s.h1_ord, count(r.h2_ord) as item_errors, count(r.rule) > 0 as any_error
from sect s left join rules r on r.doc_id = s.doc_id and r.h1_ord = s.h1_ord group by s.doc_id, s.h1_ord""")
def section_error_counts(spark, sf):
    fl = flow(spark, sf)
    s = R.sections(fl)
    return S.section_error_counts(s, S.structure_rules(s, R.section_items(fl)))


# --- the second route ----------------------------------------------------------------------

def _modes(h1, h2, h3):
    resource = h1 == "resource"
    eff = "case when level > 1 then level - 1 else level end" if resource else "level"
    skip = "where not (coalesce(level, 0) = 1 and nth = 1)" if resource else ""
    role = "case when eff = 1 then 'page' "
    if h2 == "page":
        role += f"when eff = 2 then 'page' when eff = 3 then '{'page' if h3 == 'page' else 'block'}' "
    else:
        role += "when eff = 2 then 'block' "
    role += "else 'content' end"
    return C.HS_SQL + f""",
m0 as (select *, sum(case when level = 1 then 1 else 0 end) over (partition by doc_id order by pos) as nth from hs_el where text <> ''),
m1 as (select *, {eff} as eff from m0 {skip}),
m2 as (select *, {role} as role, row_number() over (partition by doc_id order by pos) as rn from m1),
m3 as (select *, max(case when rn = 1 and not (role = 'page' and eff = 1) then 1 else 0 end) over (partition by doc_id order by pos) as imp from m2),
m4 as (select *, (sum((role = 'page')::INT) over (partition by doc_id order by pos) - 1 + imp)::INT as page_idx from m3),
m5 as (select *, max(case when role = 'page' and eff = 1 then page_idx end) over p as p1, max(case when role = 'page' and eff = 2 then page_idx end) over p as p2 from m4
  window p as (partition by doc_id order by pos rows between unbounded preceding and 1 preceding)),
mp as (
  select doc_id, page_idx, text as title, eff as level, case when eff = 2 then coalesce(p1, page_idx - 1)
    when eff = 3 then coalesce(case when p2 > coalesce(p1, -1) then p2 end, p1, page_idx - 1) end as parent_idx from m5 where role = 'page'
  union all select doc_id, 0, 'Página 1', 1, null from m5 where rn = 1 and imp = 1
  union all select doc_id, 0, 'doc-' || doc_id, 1, null from documents where doc_id not in (select doc_id from m5))"""


def _mode_query(key, h1, h2, h3):
    @query(key, C.with_sql(_modes(h1, h2, h3)) + "select doc_id, page_idx, title, level, parent_idx from mp")
    def run(spark, sf):
        d = docs(spark, sf)
        return R.heading_outline(K.elements(d, placed=True, own=F.col("filename")), h1=h1, h2=h2, h3=h3).drop("blocks")


_mode_query("heading_mode_pages", "page", "page", "page")
_mode_query("heading_mode_pages_resource", "resource", "page", "block")
_mode_query("heading_mode_pages_block", "page", "block", "block")


@query("heading_mode_blocks", C.with_sql(_modes("page", "block", "block")) + """, mb as (
  select *, sum((role = 'block')::INT) over (partition by doc_id, page_idx order by pos) as seq from m5 where role <> 'page'),
b as (select doc_id, page_idx, seq, coalesce(max(case when role = 'block' then text end), 'Contenido') as title,
  string_agg(case when role = 'content' then html end, chr(10) order by pos) as html from mb group by all),
bb as (select *, row_number() over (partition by doc_id, page_idx order by seq) - 1 as block_idx from b)
select p.doc_id, p.page_idx, coalesce(b.block_idx, 0)::INT as block_idx, coalesce(b.title, 'Contenido') as title,
  case when p.doc_id not in (select doc_id from m5) then '<p>Documento importado sin encabezados detectados.</p>' else coalesce(nullif(b.html, ''), '<p></p>') end as html
from mp p left join bb b on b.doc_id = p.doc_id and b.page_idx = p.page_idx""")
def heading_mode_blocks(spark, sf):
    d = docs(spark, sf)
    return R.page_blocks(R.heading_outline(K.elements(d, placed=True, own=F.col("filename")), h1="page", h2="block", h3="block"))


# --- navigation -----------------------------------------------------------------------------

NUM_SQL = C.HS_SQL + """,
nn as (
  select p.*, (select count(*) from pages_out a where a.doc_id = p.doc_id and a.level = 1 and a.page_idx <= p.page_idx) as n1,
    (select count(*) from pages_out a where a.doc_id = p.doc_id and a.level = 2 and a.page_idx <= p.page_idx
       and a.page_idx > coalesce((select max(z.page_idx) from pages_out z where z.doc_id = p.doc_id and z.level = 1 and z.page_idx <= p.page_idx), -1)) as n2,
    (select count(*) from pages_out a where a.doc_id = p.doc_id and a.level = 3 and a.page_idx <= p.page_idx
       and a.page_idx > coalesce((select max(z.page_idx) from pages_out z where z.doc_id = p.doc_id and z.level <= 2 and z.page_idx <= p.page_idx), -1)) as n3
  from pages_out p
),
num as (select *, case level when 1 then n1 || '.' when 2 then n1 || '.' || n2 || '.' when 3 then n1 || '.' || n2 || '.' || n3 || '.' end as number from nn)"""


@query("heading_numbers", C.with_sql(NUM_SQL) + "select doc_id, page_idx, number from num")
def heading_numbers(spark, sf):
    return N.heading_numbers(pages(spark, sf)).select("doc_id", "page_idx", "number")


@query("toc", C.with_sql(NUM_SQL) + f"select doc_id, page_idx, 'section-' || page_idx as id, {C.upper('title')} as title, level, number from num")
def toc(spark, sf):
    return N.toc(pages(spark, sf))


# titles repeat so that addresses collide
HREF_SQL = C.HS_SQL + f""",
sl as (select *, {C.slug('title')} as slug, sum((page_idx > 0)::INT) over (partition by doc_id, {C.slug('title')} order by page_idx) as nth
  from (select doc_id, page_idx, level, parent_idx, 'Tema ' || (page_idx % 3) || ' é' as title from pages_out)),
hr as (select *, case when page_idx = 0 then 'index.html' when nth > 1 then 'html/' || slug || '-' || nth || '.html' else 'html/' || slug || '.html' end as href from sl)"""


def repeated_pages(spark, sf):
    return pages(spark, sf).withColumn("title", F.concat(F.lit("Tema "), (F.col("page_idx") % 3).cast("string"), F.lit(" é")))


@query("page_hrefs", C.with_sql(HREF_SQL) + "select doc_id, page_idx, href from hr")
def page_hrefs(spark, sf):
    return N.page_hrefs(repeated_pages(spark, sf)).select("doc_id", "page_idx", "href")


@query("page_prev_next", C.with_sql(HREF_SQL) + """select doc_id, page_idx,
  case when page_idx = 0 then '' when page_idx = 1 then '../index.html' else replace(lag(href) over w, 'html/', '') end as prev_href,
  coalesce(case when page_idx = 0 then lead(href) over w else replace(lead(href) over w, 'html/', '') end, '') as next_href
from hr window w as (partition by doc_id order by page_idx)""")
def page_prev_next(spark, sf):
    p = N.page_neighbours(N.page_hrefs(repeated_pages(spark, sf), around=True))
    return p.select("doc_id", "page_idx", "prev_href", "next_href")


@query("nav_tree", HS + """
select p.doc_id, p.page_idx, coalesce(lpad(b.page_idx::VARCHAR, 6, '0') || '/', '') || coalesce(lpad(a.page_idx::VARCHAR, 6, '0') || '/', '') || lpad(p.page_idx::VARCHAR, 6, '0') as path,
  ((a.page_idx is not null)::INT + (b.page_idx is not null)::INT) as depth,
  (select count(*) from pages_out k where k.doc_id = p.doc_id and k.parent_idx = p.page_idx) as n_children
from pages_out p left join pages_out a on a.doc_id = p.doc_id and a.page_idx = p.parent_idx
  left join pages_out b on b.doc_id = a.doc_id and b.page_idx = a.parent_idx""")
def nav_tree(spark, sf):
    return N.nav_tree(pages(spark, sf)).select("doc_id", "page_idx", "path", "depth", "n_children")


# --- written rows ------------------------------------------------------------------------------

@query("sink_nav_rows", HS + f"""select doc_id, page_idx as ord, doc_id || '-' || page_idx as page_id,
  case when parent_idx is null then '' else doc_id || '-' || parent_idx end as parent_id,
  {C.upper("case when title = '' then 'Página ' || (page_idx + 1) else title end")} as name from pages_out""")
def sink_nav_rows(spark, sf):
    return W.nav_rows(pages(spark, sf))


@query("sink_component_rows", HS + f"""select doc_id, page_idx, block_idx as ord, {C.upper('title')} as name, trim(title) <> '' as minimized
from page_blocks""")
def sink_component_rows(spark, sf):
    return W.component_rows(R.page_blocks(outline(spark, sf))).select("doc_id", "page_idx", "ord", "name", "minimized")


@query("sink_component_payload", C.with_sql(C.LINES_SQL) + f"""select doc_id, line_no::INT as ord,
  '<div class="exe-text-template">' || chr(10) || '<p>a]]]]><![CDATA[>b</p><h2>' || {C.upper("replace(replace(txt, '&', '+'), '<', '-')")} || '</h2>' || chr(10) || '</div>' as html_view,
  length(txt) > 0 as has_json from lines""")
def sink_component_payload(spark, sf):
    html = F.concat(F.lit("<p>a]]>b</p><h2>"), T.swap(F.col("txt"), ("&", "+"), ("<", "-")), F.lit("</h2>"))
    b = C.lines(spark, sf).select("doc_id", F.lit(0).alias("page_idx"), F.col("line_no").alias("block_idx"), F.lit("").alias("title"), html.alias("html"), "txt")
    r = W.component_rows(b.drop("txt"))
    return r.select("doc_id", "ord", "html_view", ((F.length("json") > 300) & F.col("html_view").isNotNull()).alias("_j")).join(
        b.select("doc_id", F.col("block_idx").alias("ord"), (F.length("txt") > 0).alias("has_json")), ["doc_id", "ord"]).drop("_j")


@query("sink_page_html", C.with_sql(C.HS_SQL) + f""", body as (
  select doc_id, page_idx, string_agg('<article class="' || (case when trim(title) <> '' then 'box minimized' else 'box' end) || '"><h1>' ||
    {C.escape_xml("case when title = '' then 'Contenido' else title end")} || '</h1>' || chr(10) || html || chr(10) || '</article>', chr(10) order by block_idx) as html
  from page_blocks group by all)
select p.doc_id, p.page_idx, md5('<h2>' || {C.escape_xml('p.title')} || '</h2>' || chr(10) || b.html) as digest from pages_out p join body b on b.doc_id = p.doc_id and b.page_idx = p.page_idx""")
def sink_page_html(spark, sf):
    out = W.page_html(outline(spark, sf))
    return out.select("doc_id", "page_idx", F.md5(F.regexp_replace("html", r'(\n<a class="(prev|next)" href="[^"]*"></a>)+$', "")).alias("digest"))


@query("sink_print_html", C.with_sql(C.HS_SQL) + f""", pb as (
  select *, case when html = '' or html = '<p></p>' then ''
    when title = '' or title = 'Contenido' then '<div class="content-block">' || chr(10) || '  <div class="block-html">' || html || '</div>' || chr(10) || '</div>'
    else '<div class="content-block idevice-with-title">' || chr(10) || '  <header class="idevice-header">' || chr(10) || '    <h4 class="idevice-title">' || {C.escape_text(C.upper('title'))} ||
      '</h4>' || chr(10) || '  </header>' || chr(10) || '  <div class="block-html">' || html || '</div>' || chr(10) || '</div>' end as blk
  from (select doc_id, page_idx, block_idx, title, replace(replace(html, '<h2>', '<h4>'), '</h2>', '</h4>') as html from page_blocks)),
bd as (select doc_id, page_idx, string_agg(blk, chr(10) order by block_idx) as body from pb group by all),
sc as (select p.doc_id, p.page_idx, '<section id="section-' || p.page_idx || '" class="section-level-' || level || '">' || chr(10) || '  <h' || level || ' class="section-title-' || level || '">' ||
  {C.escape_text(C.upper('title'))} || '</h' || level || '>' || chr(10) || '  ' || body || chr(10) || '</section>' as sec from pages_out p join bd using (doc_id, page_idx))
select doc_id, md5('<div class="content-pages">' || chr(10) || string_agg(sec, chr(10) order by page_idx) || chr(10) || '</div>') as digest from sc group by doc_id""")
def sink_print_html(spark, sf):
    lower = F.transform("blocks", lambda b: F.struct(b["title"].alias("title"), T.swap(b["html"], ("<h2>", "<h4>"), ("</h2>", "</h4>")).alias("html")))
    return W.print_html(outline(spark, sf).withColumn("blocks", lower)).select("doc_id", F.md5("html").alias("digest"))


@query("render_summary", HS + """select p.doc_id, count(distinct p.page_idx) as page_count, count(*) as block_count
from page_blocks p group by p.doc_id""")
def render_summary(spark, sf):
    return W.render_summary(outline(spark, sf))


@query("sink_image_store", """with i as (select sha256(from_base64(md5(trim(t)))) as sha from (
  select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents)
  where (doc_id * 7 + line_no * 13 + length(trim(t))) % 23 = 18)
select distinct sha, 'content/resources/img_' || sha || '.png' as path from i""")
def sink_image_store(spark, sf):
    return M.image_store(M.image_refs(C.marked_rows(spark, sf))).select("sha", "path")


@query("sink_doc_properties", """
with d as (select doc_id, case when doc_id % 5 = 0 then '' else 'T' || doc_id end as title, case when doc_id % 3 = 0 then 'S' else '' end as subtitle, source as theme_id, lang from documents),
t as (select source as theme_id, min(lang) as language from documents group by source),
j as (select d.*, case when t.language in ('es', 'ca', 'en') then t.language else 'es' end as l from d left join t using (theme_id))
select doc_id, 'pp_title' as key, case when title = '' then 'Documento importado' else title end as value from j
union all select doc_id, 'pp_subtitle', case when subtitle <> '' then subtitle when l = 'en' then 'University Library' when l = 'ca' then 'Biblioteca Universitària' else 'Biblioteca Universitaria' end from j
union all select doc_id, 'pp_lang', l from j union all select doc_id, 'pp_theme', theme_id from j""")
def sink_doc_properties(spark, sf):
    d = table(spark, sf, "documents")
    dd = d.select("doc_id", F.expr("case when doc_id % 5 = 0 then '' else 'T' || doc_id end").alias("title"),
                  F.expr("case when doc_id % 3 = 0 then 'S' else '' end").alias("subtitle"), F.col("source").alias("theme_id"))
    themes = d.groupBy(F.col("source").alias("theme_id")).agg(F.min("lang").alias("language"))
    return W.doc_properties(dd, themes).filter(F.col("key").isin("pp_title", "pp_subtitle", "pp_lang", "pp_theme"))

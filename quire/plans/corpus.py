"""The corpora the queries run on, derived from the given tables.

`documents` become marked-up HTML: every line turns into one element whose kind follows
from its number, length and document. The element text is one CASE expression that both
engines read, so the check never depends on how the library parses HTML. `pages` are HTML
already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import WS
from .registry import table

# --- SQL text helpers (valid in DuckDB) ----------------------------------------------


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def plain(x: str) -> str:
    t = f"regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '&nbsp;|&#160;|&#xa0;', ' ', 'gi')"
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        t = f"replace({t}, '{a}', '{b}')"
    return collapse(t)


def escape_text(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def escape_xml(x: str) -> str:
    return f"replace({escape_text(x)}, '''', '&#39;')"


def untagged(x: str) -> str:
    return collapse(f"regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' ', 'gi')")


def context_after(x: str) -> str:
    t = untagged(f"substr({x}, 1, 400)")
    return f"(case when length({t}) > 60 then rtrim(substr({t}, 1, 60)) || '…' else {t} end)"


def context_before(x: str) -> str:
    t = untagged(f"right({x}, 400)")
    return f"(case when length({t}) > 60 then '…' || ltrim(right({t}, 60)) else {t} end)"


def upper(x: str) -> str:
    return f"upper(replace({x}, 'ß', 'SS'))"


def slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def fnv1a(x: str) -> str:
    return (f"lpad(lower(to_hex(list_reduce(list_prepend(2166136261::BIGINT, list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), "
            "lambda c: unicode(c)::BIGINT)), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) & 4294967295)::BIGINT))), 8, '0')")


# --- marked documents ------------------------------------------------------------------

K = "((doc_id * 7 + {i} * 13 + length(trim({t}))) % 23)"


def _cells(t: str) -> str:
    rows = []
    for r in range(3):
        cells = "".join(f"<td>c{r}{c} ' || substr(md5({t}), {r * 3 + c + 1}, 4) || '</td>" for c in range(3))
        rows.append(f"<tr>{cells}</tr>")
    return "'<table>" + "".join(rows) + "</table>'"


def element_case(t: str, i: str, k: str, dirty: bool) -> str:
    """HTML of one line. `dirty` writes some markers the way word processors leave them;
    otherwise as they are after normalisation."""
    esc = f"replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    h = lambda n: (f"case when {i} % 11 = 0 then '<h{n}></h{n}>' else '<h{n}>' || {esc} || '</h{n}>' end")
    m = lambda a, b: f"'{a if dirty else b}'"
    li = f"repeat('<li>x</li>', CAST(1 + length({t}) % 5 AS INT))"
    return f"""case {k}
      when 0 then '<p>[ejemplo]</p>'
      when 2 then {m('<p><strong>[Definición]</strong></p>', '<p>[Definición]</p>')}
      when 3 then '<p>[importante]</p>'
      when 5 then case when {i} % 5 = 0 then '<ul><li>[pie] item</li></ul>' else {m('<p>[<em>pie</em>]</p>', '<p>[pie]</p>')} end
      when 1 then '<p>[fin]</p>' when 4 then '<p>[fin]</p>'
      when 6 then {m('<p>[fi<a id="b"></a>n]</p>', '<p>[fin]</p>')}
      when 7 then {h(1)} when 8 then {h(2)} when 9 then {h(3)}
      when 10 then '<p>[horizontal]</p>'
      when 11 then {_cells(t)}
      when 12 then '<p style="margin-left:1pt">[vertical]</p>'
      when 13 then case when {i} % 4 = 0 then '<p>[enlace:]</p>'
                        when {i} % 4 = 1 then '<p>' || {esc} || '<br />[documento:] doc<br />tail</p>'
                        else '<p>[vídeo:] ' || {esc} || '</p>' end
      when 14 then case when {i} % 7 = 0 then '<ol start="10">' else '<ol>' end || {li} || '</ol>'
      when 15 then case when {i} % 7 = 0 then '<ol start="10">' else '<ol>' end || {li} || '</ol>'
      when 16 then '<ul><li>' || {esc} || '</li></ul>'
      when 17 then case when {i} % 3 = 0 then '<ul><li>[fin acordeón]</li></ul>' else '<p>[fin acordeón]</p>' end
      when 18 then case when {i} % 2 = 0 then '<p><img src="data:image/png;base64,' || md5({t}) || '" /></p>'
                        else '<p>' || {esc} || '<img src="data:image/png;base64,' || md5({t}) || '" data-w="12" data-h="7" /></p>' end
      when 20 then '<p>' || {esc} || ' www.site.org/p' || CAST({i} AS STRING) || ', http://x.example.com/' || CAST(doc_id AS STRING) || '?a=1.</p>'
      when 21 then '<p><a href="https://in.example.com/' || CAST(doc_id AS STRING) || '">www.no.org</a> <a href="/rel">' || {esc} || '</a></p>'
      else '<p>' || {esc} || '</p>' end"""


def marked(documents: DataFrame) -> DataFrame:
    """docs(doc_id, source, lang, filename, html): built within the row, no shuffle."""
    lines = ("transform(split(text, '\\n'), (t, i) -> "
             + element_case("trim(t)", "i", K.format(t="t", i="i"), dirty=True) + ")")
    return documents.select(
        "doc_id", "source", "lang", F.expr("'doc-' || cast(doc_id as string) || '.docx'").alias("filename"),
        F.array_join(F.expr(lines), "").alias("html"))


def placed(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """A table placed by its key while its rows are still small: everything derived from a
    row stays where it is, and so do the windows over it."""
    return table(spark, sf_dir, name).repartition(key)


def marked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(placed(spark, sf_dir))


def marked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents for work within the row: spread evenly however the files are cut."""
    return marked(placed(spark, sf_dir))


def page_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", "html")
    return pages.repartition("doc_id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = placed(spark, sf_dir)
    d = d.select("doc_id", "source", "lang", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "txt"))
    d = d.withColumn("txt", F.trim("txt"))
    return d.withColumn("k", F.expr(K.format(t="txt", i="line_no")))


LINES_SQL = f"""
lines as (
  select doc_id, source, lang, line_no, trim(t) as txt, {K.format(t='t', i='line_no')} as k
  from (select doc_id, source, lang, unnest(string_split(text, chr(10))) as t,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents)
)"""

_LEVEL = "case when k in (7, 8, 9) then k - 6 end"

# one row per element, as it is after marker normalisation
EL_SQL = LINES_SQL + f""",
el as (
  select doc_id, source, lang, line_no::INT as pos, txt, k,
    case when k in (7, 8, 9) then 'h' || (k - 6) when k = 11 then 'table' when k in (14, 15) then 'ol'
         when k = 16 or (k = 17 and line_no % 3 = 0) or (k = 5 and line_no % 5 = 0) then 'ul' else 'p' end as tag,
    ({_LEVEL})::INT as level, html, {plain('html')} as text,
    case k when 0 then 'ejemplo' when 2 then 'definición' when 3 then 'importante' when 5 then 'pie'
           when 1 then 'fin' when 4 then 'fin' when 6 then 'fin' end as mark
  from (select *, {element_case('txt', 'line_no', 'k', dirty=False)} as html from lines)
)"""

# real headings and their running counts
FLOW_SQL = EL_SQL + """,
fl as (
  select *, (level is not null and text <> '') as is_real,
    coalesce(sum(case when level = 1 and text <> '' then 1 else 0 end) over w, 0)::INT as h1_ord,
    coalesce(sum(case when level = 2 and text <> '' then 1 else 0 end) over w, 0)::INT as h2_ord
  from el window w as (partition by doc_id order by pos rows unbounded preceding)
)"""


def with_sql(*ctes: str) -> str:
    return "with " + ",\n".join(c.strip() for c in ctes) + "\n"


# --- structured documents: many headings, with and without structure tags ---------------

def structured_case(t: str, i: str, m: str) -> str:
    esc = f"replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    body = f"(case when {i} % 11 = 5 then '' else {esc} end)"
    a1 = (f"(case (doc_id + {i}) % 4 when 1 then ' data-structure-tag=\"pagina-principal\"' when 2 then ' data-structure-tag=\"subpagina\"' "
          f"when 3 then ' data-structure-tag=\"3er-nivel\"' else '' end)")
    a2 = (f"(case (doc_id + {i}) % 4 when 1 then ' data-structure-tag=\"titulo-idevice\"' when 2 then ' data-structure-tag=\"acordeon\"' "
          f"when 3 then ' data-structure-tag=\"pestanas\"' else '' end)")
    return f"""case {m} when 0 then '<h1' || {a1} || '>' || {body} || '</h1>'
      when 1 then '<h2' || {a2} || '>' || {body} || '</h2>' when 2 then '<h2' || {a2} || '>' || {body} || '</h2>'
      when 3 then '<h2' || {a2} || '>' || {body} || '</h2>' when 4 then '<h3>' || {body} || '</h3>'
      when 5 then '<p>[fin acordeón]</p>' when 8 then '<h5>' || {body} || '</h5>' else '<p>' || {esc} || '</p>' end"""


M = "((doc_id + {i} * 5 + length({t})) % 9)"


def structured_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs(doc_id, source, lang, filename, html) rich in headings."""
    t = "trim(t)"
    lines = f"transform(split(text, '\\n'), (t, i) -> {structured_case(t, 'i', M.format(t='trim(t)', i='i'))})"
    return placed(spark, sf_dir).select(
        "doc_id", "source", "lang", F.expr("'doc-' || cast(doc_id as string) || '.docx'").alias("filename"),
        F.array_join(F.expr(lines), "").alias("html"))


HS_SQL = LINES_SQL + f""",
hs_el as (
  select doc_id, source, lang, line_no::INT as pos, m, html, {plain('html')} as text,
    (case m when 0 then 1 when 1 then 2 when 2 then 2 when 3 then 2 when 4 then 3 when 8 then 5 end)::INT as level,
    (case when m = 0 then nullif((doc_id + line_no) % 4, 0) end)::INT as word_level,
    case when m in (1, 2, 3) then case (doc_id + line_no) % 4 when 1 then 'idevice-title' when 2 then 'accordion' when 3 then 'tabs' end end as word_option
  from (select *, {structured_case("txt", 'line_no', 'm')} as html from (select *, {M.format(t='txt', i='line_no')} as m from lines))
),
hs as (
  select *, (level is not null and text <> '') as is_real,
    coalesce(sum(case when level = 1 and text <> '' then 1 else 0 end) over w, 0)::INT as h1_ord,
    coalesce(sum(case when level = 2 and text <> '' then 1 else 0 end) over w, 0)::INT as h2_ord
  from hs_el window w as (partition by doc_id order by pos rows unbounded preceding)
),
hk as (
  select *, coalesce(last_value(case when is_real and level = 2 then h2_ord when is_real and level = 1 then 0 end ignore nulls) over (
    partition by doc_id order by pos rows unbounded preceding), 0)::INT as h2_key
  from hs
),
per_doc as (
  select doc_id, bool_or(is_real and level = 1) as any_h1,
    bool_or(h1_ord = 0 and ((is_real and level = 2) or (coalesce(level, 0) not in (1, 2) and text <> ''))) as early
  from hs group by doc_id
),
sect0 as (
  select doc_id, 0 as h1_ord, 'Contenido' as title, null::INT as word_level, true as synthetic, -1 as pos
  from per_doc where coalesce(early, false) or not coalesce(any_h1, false)
  union all select doc_id, h1_ord, text, word_level, false, pos from hs where is_real and level = 1
),
sect as (
  select *, (case when idx = 0 then 1 else coalesce(word_level, 1) end)::INT as level
  from (select *, (row_number() over (partition by doc_id order by h1_ord) - 1)::INT as idx from sect0)
),
items as (
  select doc_id, h1_ord, h2_ord, text, coalesce(word_option, 'html') as option, word_option, pos from hs where is_real and level = 2
),
pages_out as (
  select doc_id, idx as page_idx, title, level, h1_ord,
    case level when 2 then max(case when level = 1 then idx end) over p when 3 then max(case when level = 2 then idx end) over p end as parent_idx
  from sect window p as (partition by doc_id order by idx rows between unbounded preceding and 1 preceding)
),
secs as (
  select *, (row_number() over (partition by doc_id order by pos) - 1)::INT as sec from (
    select doc_id, pos, level, text, '' as html, h1_ord, h2_key from hk where is_real
    union all
    select doc_id, min(pos), 999, '', string_agg(html, '' order by pos), h1_ord, h2_key
    from (select *, sum(is_real::INT) over (partition by doc_id order by pos) as isl from hk where is_real or level is null)
    where not is_real group by doc_id, isl, h1_ord, h2_key)
),
conts as (
  select doc_id, h1_ord, h2_key, string_agg(case when level is null then html when level in (3, 4) then '<h' || level || '>' || {escape_xml('text')} || '</h' || level || '>' else '' end, '' order by pos) as content
  from hk where is_real or level is null group by all
),
cut as (
  select *, case when strpos(content, '<p>[fin acordeón]</p>') > 0 then substr(content, 1, strpos(content, '<p>[fin acordeón]</p>') - 1) else content end as body0,
    case when strpos(content, '<p>[fin acordeón]</p>') > 0 then replace(substr(content, strpos(content, '<p>[fin acordeón]</p>') + 21), '<p>[fin acordeón]</p>', '') else '' end as spill0
  from conts
),
chunk0 as (
  select c.doc_id, c.h1_ord, c.h2_key as h2_ord, i.text, i.option, coalesce(i.option in ('accordion', 'tabs'), false) as panel,
    case when i.option in ('accordion', 'tabs') then body0 else replace(content, '<p>[fin acordeón]</p>', '') end as body,
    case when i.option in ('accordion', 'tabs') then spill0 else '' end as spill
  from cut c left join items i on i.doc_id = c.doc_id and i.h1_ord = c.h1_ord and i.h2_ord = c.h2_key
),
chunk1 as (
  select *, panel and (not coalesce(lag(panel) over w, false) or lag(option) over w <> option or lag(spill) over w <> '') as fresh
  from chunk0 where h2_ord > 0 or body <> '' window w as (partition by doc_id, h1_ord order by h2_ord)
),
chunks as (
  select *, sum(case when option = 'idevice-title' then 1 else 0 end) over w as block_seq,
    case when panel then sum(case when fresh then 1 else 0 end) over w end as group_id,
    lead(fresh) over o as next_fresh, lead(panel) over o as next_panel
  from chunk1 window w as (partition by doc_id, h1_ord order by h2_ord rows unbounded preceding), o as (partition by doc_id, h1_ord order by h2_ord)
),
blocks_out as (
  select doc_id, h1_ord, (row_number() over (partition by doc_id, h1_ord order by block_seq) - 1)::INT as block_idx, title,
    case when html = '' then '<p></p>' else html end as html
  from (select doc_id, h1_ord, block_seq, coalesce(max(case when option = 'idevice-title' then text end), '') as title,
      string_agg(case when h2_ord = 0 then body
        when panel then (case when fresh then '<div class="exe-fx exe-' || option || '">' || chr(10) else '' end) || '<h2>' || {escape_xml('text')} || '</h2>' || chr(10)
          || (case when body = '' then '<p></p>' else body end) || (case when spill <> '' or coalesce(next_fresh, true) or not coalesce(next_panel, false) then chr(10) || '</div>' else '' end)
          || (case when spill <> '' then chr(10) || spill else '' end)
        when option = 'idevice-title' then case when body = '' then '<p></p>' else body end
        else '<h2>' || {escape_xml('text')} || '</h2>' || (case when body <> '' then chr(10) || body else '' end) end, chr(10) order by h2_ord) as html
    from chunks group by doc_id, h1_ord, block_seq)
),
page_blocks as (
  select p.doc_id, p.page_idx, coalesce(b.block_idx, 0) as block_idx, coalesce(b.title, '') as title, coalesce(b.html, '<p></p>') as html
  from pages_out p left join blocks_out b on b.doc_id = p.doc_id and b.h1_ord = p.h1_ord
)"""

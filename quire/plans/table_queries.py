"""Queries over memory, cleaner, catalogue and regression operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..operators import catalogue as G
from ..operators import cleaner as L
from ..operators import memory as Y
from ..operators import regress as X
from ..operators import structure as R
from ..operators import tokens as K
from . import corpus as C
from ..session import ensure_checkpoint_dir
from .registry import query, table

# --- fingerprints and memory -------------------------------------------------------------

# choices: every third document keeps what its tags say, the others change some
CHOICE_LEVEL = "case when doc_id % 3 <> 0 and idx = 1 then 2 else level end"
CHOICE_OPTION = "case when doc_id % 3 <> 0 and h2_ord % 4 = 0 then 'accordion' else option end"


def chosen_sections(spark, sf):
    s = R.sections_with_items(R.flow(K.elements(C.structured_docs(spark, sf), placed=True, own=F.lit(""))))
    option = F.expr("transform(items, x -> named_struct('h2_ord', x.h2_ord, 'text', x.text, 'option', case when doc_id % 3 <> 0 and x.h2_ord % 4 = 0 "
                    "then 'accordion' else x.option end, 'word_option', x.word_option))")
    return s.withColumn("level", F.expr(CHOICE_LEVEL)).withColumn("items", option)


def structures(spark, sf):
    return Y.fingerprints_of(chosen_sections(spark, sf))


FP_SQL = C.HS_SQL + f""",
ch_s as (select *, {CHOICE_LEVEL} as chosen from sect),
ch_i as (select *, {CHOICE_OPTION} as chosen from items),
heads as (
  select doc_id, h1_ord, 0 as h2_ord, title as t, coalesce(word_level::VARCHAR, '-') as tag, chosen = (case when idx = 0 then 1 else coalesce(word_level, 1) end) as std from ch_s
  union all select doc_id, h1_ord, h2_ord, text, coalesce(word_option, '-'), chosen = coalesce(word_option, 'html') from ch_i
),
fpa as (
  select doc_id, string_agg({C.collapse('lower(strip_accents(t))')}, chr(10) order by h1_ord, h2_ord) as title_text,
    case when bool_or(tag <> '-') then string_agg(tag, ',' order by h1_ord, h2_ord) else '' end as tags, bool_and(std) as is_default from heads group by doc_id
),
fpb as (select doc_id, string_agg(n::VARCHAR, ',' order by h1_ord) as shape from (
  select s.doc_id, s.h1_ord, count(i.h2_ord) as n from ch_s s left join ch_i i on i.doc_id = s.doc_id and i.h1_ord = s.h1_ord group by all) group by doc_id),
fpl as (select doc_id, string_agg(chosen::VARCHAR, ',' order by idx) as levels from ch_s group by doc_id),
fpo as (select doc_id, string_agg(chosen, ',' order by h2_ord) as options from ch_i group by doc_id),
fp as (select a.doc_id, b.shape, {C.fnv1a('a.title_text')} as titles, a.tags, a.is_default, l.levels, coalesce(o.options, '') as options
  from fpa a join fpb b using (doc_id) join fpl l using (doc_id) left join fpo o using (doc_id))"""
FP = C.with_sql(FP_SQL)


@query("structure_shape", FP + "select doc_id, shape from fp")
def structure_shape(spark, sf):
    return structures(spark, sf).select("doc_id", "shape")


@query("structure_titles", FP + "select doc_id, titles from fp")
def structure_titles(spark, sf):
    return structures(spark, sf).select("doc_id", "titles")


@query("structure_tags", FP + "select doc_id, tags from fp")
def structure_tags(spark, sf):
    return structures(spark, sf).select("doc_id", "tags")


@query("structure_choices", FP + "select doc_id, is_default, levels, options from fp")
def structure_choices(spark, sf):
    f = structures(spark, sf)
    return f.select("doc_id", "is_default", F.array_join(F.transform("levels", lambda x: x.cast("string")), ",").alias("levels"),
                    F.array_join("options", ",").alias("options"))


# events of a memory: few keys, deletions, one owner with most of the rows
def events(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("lang").alias("owner"), F.expr("'s' || (doc_id * doc_id % 61)").alias("shape"), F.expr("'t' || (doc_id * doc_id % 61)").alias("titles"),
                    (F.col("doc_id") % 4 == 1).alias("is_default"), F.col("doc_id").alias("at"), F.col("source").alias("tags"))


MEM_SQL = """with ev as (select lang as owner, 's' || (doc_id * doc_id % 61) as shape, doc_id * doc_id % 61 as key, doc_id % 4 = 1 as is_default, doc_id as ts, source as tags from documents),
last_ev as (select owner, key, max(ts) as ts from ev group by all),
cand as (select l.owner, l.key, l.ts, row_number() over (partition by l.owner order by l.ts desc) as r from last_ev l join ev e on e.owner = l.owner and e.ts = l.ts where not e.is_default),
c20 as (select * from cand where r <= 20),
moments as (select c.owner, c.key, c.ts, e.ts as t from c20 c join ev e on e.owner = c.owner and e.ts > c.ts),
latest as (select m.owner, m.key, m.t, f.key as other, max(f.ts) as ts from moments m join ev f on f.owner = m.owner and f.ts > m.ts and f.ts <= m.t group by all),
present as (select l.owner, l.key, l.t, count(*) as n from latest l join ev e on e.owner = l.owner and e.ts = l.ts where not e.is_default group by all),
lost as (select owner, key from present group by all having max(n) >= 20),
memory as (select c.owner, c.key, c.ts, row_number() over (partition by c.owner order by c.ts desc) as rank from c20 c anti join lost l on l.owner = c.owner and l.key = c.key)
"""


@query("remember_structure", MEM_SQL + "select owner, 's' || key as shape, 't' || key as titles, ts as \"at\", rank from memory")
def remember_structure(spark, sf):
    return Y.remember(events(spark, sf), width=100).select("owner", "shape", "titles", "at", "rank")


# every document asks what the older ones of its owner left; a default structure leaves nothing
REC_SQL = FP_SQL + """,
st as (select fp.*, d.lang as owner from fp join documents d using (doc_id)),
rc as (
  select *, last_value(case when not is_default then levels end ignore nulls) over g as l0, last_value(case when not is_default then options end ignore nulls) over g as o0,
    last_value(case when not is_default then levels end ignore nulls) over t as l1, last_value(case when not is_default then options end ignore nulls) over t as o1
  from st window g as (partition by owner, shape, tags order by doc_id rows between unbounded preceding and 1 preceding),
    t as (partition by owner, shape, tags, titles order by doc_id rows between unbounded preceding and 1 preceding)),
recalled as (select doc_id, case when l1 is not null then 'same' else 'similar' end as kind, coalesce(l1, l0) as levels, coalesce(o1, o0) as options
  from rc where coalesce(l1, l0) is not null)"""
RECALL_WIDTH = 250


def recall_events(spark, sf, chosen=None):
    """Stored, because the operator reads them three times."""
    ensure_checkpoint_dir(spark)
    owners = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("owner"))
    found = structures(spark, sf) if chosen is None else Y.fingerprints_of(chosen)
    return found.drop("title_text").join(owners, "doc_id").withColumn("at", F.col("doc_id")).checkpoint()


@query("recall_structure", C.with_sql(REC_SQL) + "select doc_id, kind, levels, options from recalled")
def recall_structure(spark, sf):
    r = Y.recall_history(recall_events(spark, sf), RECALL_WIDTH)
    return r.select("doc_id", "kind", F.array_join(F.transform("levels", lambda x: x.cast("string")), ",").alias("levels"),
                    F.array_join("options", ",").alias("options"))


@query("recall_applied", C.with_sql(REC_SQL) + """select s.doc_id, s.h1_ord, 0 as h2_ord, coalesce(string_split(r.levels, ',')[s.idx + 1], s.chosen::VARCHAR) as choice
from ch_s s left join recalled r using (doc_id)
union all select i.doc_id, i.h1_ord, i.h2_ord, coalesce(nullif(string_split(r.options, ','), [''])[i.h2_ord], i.chosen) from ch_i i left join recalled r using (doc_id)""")
def recall_applied(spark, sf):
    """Sections and items with the recalled choices put back. The sections are stored, so that the documents are cut once for what they
    leave and for what they get."""
    ensure_checkpoint_dir(spark)
    c = chosen_sections(spark, sf).checkpoint()
    s = Y.apply_recalled_inside(c, Y.recall_history(recall_events(spark, sf, c), RECALL_WIDTH))
    choice = lambda h2_ord, x: F.struct(h2_ord.alias("h2_ord"), x.alias("choice"))
    rows = F.concat(F.array(choice(F.lit(0), F.col("level").cast("string"))), F.transform("items", lambda x: choice(x["h2_ord"], x["option"])))
    return s.select("doc_id", "h1_ord", F.inline(rows))


STORE = """case doc_id % 5 when 0 then 'not json' when 1 then '[]' else '[{"shape":"' || doc_id || '","titles":"ab","levels":[1,2],"options":["html"],"at":' || doc_id || '},' ||
  '{"shape":"x","titles":"y","levels":[1,7],"options":[],"at":1},{"shape":"x","titles":"y","levels":[1],"options":["none"],"at":1},' ||
  '{"shape":"z","titles":"w","tags":"-,2","levels":[],"options":["tabs","accordion"],"at":2},{"titles":"w","levels":[],"options":[],"at":2}]' end"""


@query("src_structure_memory", """select doc_id as owner, 0 as ord, doc_id::VARCHAR as shape, null as tags, doc_id as at, 1 as n_options from documents where doc_id % 5 > 1
union all select doc_id, 3, 'z', '-,2', 2, 2 from documents where doc_id % 5 > 1""")
def src_structure_memory(spark, sf):
    stored = table(spark, sf, "documents").select(F.col("doc_id").alias("owner"), F.expr(STORE).alias("value"))
    return Y.parse_entries(stored).select("owner", "ord", "shape", "tags", "at", F.size("options").alias("n_options"))


# --- cleaner ---------------------------------------------------------------------------------

RAW_COLS = """
  case when k = 11 then 'tbl' when k = 22 and line_no % 9 = 0 then 'sdt' else 'p' end as node,
  case k when 0 then 'sEjejemplo' when 2 then 'xdefinicion' when 3 then 'ximportante' when 4 then 'ximportante' when 7 then 'H3' when 8 then 'H2' when 9 then 'H4' when 10 then 'TDC1'
    when 12 then 'Ttulo' when 16 then 'Prrafodelista' else '' end as style_id,
  case when k = 13 then 'Contenido' when k in (18, 19) then '' when k = 0 and line_no % 3 = 0 then ' Ejemplo ' when k = 3 then '<< ' || txt || ' >>' else txt end as text,
  k = 18 as has_image, k in (14, 15) as is_list, case when k = 20 and line_no % 6 = 0 then '_Toc12' end as anchor"""


def raw_blocks(spark, sf):
    r = C.lines(spark, sf).select("doc_id", F.col("line_no").alias("i"), "k", *[F.expr(x) for x in _split_cols(RAW_COLS)])
    return r.select("doc_id", "i", "node", "style_id", "text", "has_image", "is_list", "anchor", F.lit(None).cast("string").alias("field_code"),
                    F.when(F.col("node") == "tbl", F.array("text", F.lit(""), F.lit("b"))).alias("first_row"))


def _split_cols(text):
    out, depth, cur = [], 0, ""
    for word in text.replace("\n", " ").split(" "):
        depth += (word == "case") - (word in ("end", "end,"))
        cur += " " + word
        if word.endswith(",") and depth == 0 and " as " in cur and cur.rstrip(",").split()[-2] == "as":
            out.append(cur.rstrip(","))
            cur = ""
    return [*out, cur]


STYLES = [("paragraph", "H2", "Heading 2", None), ("paragraph", "H3", "otra", "2"), ("paragraph", "X3", "tercera", "2"), ("paragraph", "H4", "heading 4", "0"),
          ("paragraph", "T1", "TOC 1", "0"), ("character", "C1", "heading 1", None), ("paragraph", "L4", "cuarta", "3")]


def styles(spark, sf):
    """The same style sheet for every document, one row per style."""
    rows = F.array(*[F.struct(F.lit(n).alias("pos"), F.lit(t).alias("type"), F.lit(s).alias("style_id"), F.lit(nm).alias("name"),
                              F.lit(o).cast("string").alias("outline")) for n, (t, s, nm, o) in enumerate(STYLES)])
    return table(spark, sf, "documents").select("doc_id", F.inline(rows))


# every line of a document is a style of its sheet: names, outline levels (one unreadable), tables of contents, character styles
SHEET = """
  case when k % 5 = 0 then 'character' else 'paragraph' end as type, 'S' || line_no as style_id,
  case k % 4 when 1 then 'Heading ' || (1 + length(txt) % 6) when 2 then 'TOC ' || (length(txt) % 3) else txt end as name,
  case when k % 7 = 0 then 'x' when k % 3 < 2 then '' || (length(txt) % 6) end as outline"""


@query("style_levels", C.with_sql(C.LINES_SQL + f""",
sh as (select doc_id, line_no, {SHEET} from lines),
nm as (select *, regexp_extract(lower(name), '^heading\\s*([1-9])$', 1) as named from sh where type = 'paragraph'),
lv as (select *, case when named <> '' then named::INT when not regexp_matches(lower(name), '^(toc|tdc|índice|indice|contents)') then try_cast(outline as INT) + 1 end as level from nm)""")
       + "select doc_id, level, first(style_id order by (named = '')::INT, line_no) as style_id from lv where level between 1 and 4 group by doc_id, level")
def style_levels(spark, sf):
    sheet = C.lines(spark, sf).select("doc_id", F.col("line_no").alias("pos"), *[F.expr(x) for x in _split_cols(SHEET)])
    return L.style_levels(sheet)


RAW_SQL = C.LINES_SQL + f""",
raw as (select doc_id, line_no::INT as i, k, {RAW_COLS} from lines),
rb as (select *, trim(text) as tx, max((node = 'sdt' or coalesce(anchor, '') like '_Toc%' or style_id like 'TDC%')::INT) over (partition by doc_id) = 1 as has_toc,
   sum((node = 'tbl')::INT) over (partition by doc_id order by i) as tbl_no from raw),
ck as (select *, case when node = 'sdt' then 'toc' when node = 'tbl' then 'table' when style_id like 'TDC%' or coalesce(anchor, '') like '_Toc%' then 'toc'
   when has_toc and lower(tx) in ({", ".join(f"'{t}'" for t in fixed.TOC_TITLES)}) and i < 15 then 'cover' when style_id in ('H2', 'H3', 'H4') then 'heading'
   when style_id like '%ejemplo' or style_id like '%definicion' or style_id like '%importante' then 'box' when style_id = 'Ttulo' then 'cover'
   when tx = '' and not has_image then 'empty' when style_id = 'Prrafodelista' or is_list then 'list' else 'para' end as kind from rb),
cl as (select doc_id, i, kind, case kind when 'toc' then 'remove' when 'cover' then 'remove' when 'table' then 'table:horizontal' when 'heading' then 'h' || substr(style_id, 2)
    when 'box' then 'box:' || (case when style_id like '%ejemplo' then 'ejemplo' when style_id like '%definicion' then 'definición' else 'importante' end) else 'keep' end as role,
  case when node = 'sdt' then 'Índice automático' when kind = 'table' then 'Tabla ' || tbl_no || ' · ' || (case when text = '' then 'b' else text || ' / b' end)
    when kind = 'toc' then case when tx = '' then '(entrada de índice)' else tx end when kind = 'empty' then '(línea en blanco)'
    when style_id = 'Ttulo' and kind = 'cover' and tx = '' then '(portada / índice)' when kind in ('para', 'list') and tx = '' then '(imagen)' else tx end as text from ck),
sh as (select *, min(case when kind = 'heading' then substr(role, 2, 1)::INT end) over (partition by doc_id) as low, min(case when kind = 'heading' then i end) over (partition by doc_id) as first_h from cl),
bl as (select doc_id, i, case when i < first_h and kind <> 'toc' then 'cover' else kind end as kind,
  case when i < first_h then 'remove' when kind = 'heading' and low > 1 then 'h' || greatest(1, substr(role, 2, 1)::INT - low + 1) else role end as role,
  case when i < first_h and kind <> 'toc' and text in ('', '(imagen)', '(línea en blanco)') then '(portada)' else text end as text from sh)"""
RAW = C.with_sql(RAW_SQL)


def clean_blocks(spark, sf):
    return L.blocks_of(raw_blocks(spark, sf), styles(spark, sf))


@query("block_classify", RAW + "select doc_id, i, kind, role, text from cl")
def block_classify(spark, sf):
    return L.classify(raw_blocks(spark, sf), L.style_levels(styles(spark, sf)))


@query("level_shift", RAW + """select doc_id, i, case when kind = 'heading' and low > 1 then 'h' || greatest(1, substr(role, 2, 1)::INT - low + 1) else role end as role from sh where kind = 'heading'""")
def level_shift(spark, sf):
    return L.shift_to_top(block_classify(spark, sf)).filter("kind = 'heading'").select("doc_id", "i", "role")


@query("level_shift_manual", RAW + """select doc_id, i, 'h' || least(4, substr(role, 2, 1)::INT + 2) as role from cl where kind = 'heading'""")
def level_shift_manual(spark, sf):
    return L.shift_levels(block_classify(spark, sf), 2).filter("kind = 'heading'").select("doc_id", "i", "role")


@query("front_matter", RAW + "select doc_id, i, kind, role, text from bl")
def front_matter(spark, sf):
    return clean_blocks(spark, sf)


BOX_RUN_SQL = """,
bx0 as (select *, lower(text) in ('ejemplo', 'importante', 'definición', 'definicion', 'pie') as named from bl where role like 'box:%'),
bx1 as (select *, (lag(i) over w is null or lag(i) over w <> i - 1) as fresh from bx0 window w as (partition by doc_id, role order by i)),
bx2 as (select *, sum(fresh::INT) over (partition by doc_id, role order by i) as g from bx1),
bx3 as (select *, coalesce(min(case when not named then i end) over p, min(i) over p) as a, coalesce(max(case when not named then i end) over p, min(i) over p) as z from bx2 window p as (partition by doc_id, role, g)),
bx as (select doc_id, i, 0 as part, '[' || substr(role, 5) || ']' as text from bx3 where i = a
  union all select doc_id, i, 1, case when i = a and i = z then regexp_replace(regexp_replace(text, '^\\s*<<\\s*', ''), '\\s*>>\\s*$', '') when i = a then regexp_replace(text, '^\\s*<<\\s*', '')
     when i = z then regexp_replace(text, '\\s*>>\\s*$', '') else text end from bx3 where not named
  union all select doc_id, i, 2, '[fin]' from bx3 where i = z)"""


@query("box_runs", C.with_sql(RAW_SQL + BOX_RUN_SQL) + "select doc_id, i, part, text from bx")
def box_runs(spark, sf):
    return L.box_runs(clean_blocks(spark, sf)).select("doc_id", "i", "part", "text")


@query("apply_roles", C.with_sql(RAW_SQL + BOX_RUN_SQL) + """select doc_id, i, part, null as style, text from bx
union all select doc_id, i, 0, null, '[horizontal]' from bl where role = 'table:horizontal'
union all select doc_id, i, 1, case when role like 'h_' then 'heading ' || substr(role, 2) when role = 'keep' then kind end, text from bl where role <> 'remove' and role not like 'box:%'""")
def apply_roles(spark, sf):
    return L.apply_roles(clean_blocks(spark, sf))


@query("role_counts", RAW + """select doc_id, count(*) filter (where role = 'h1') as h1, count(*) filter (where role = 'h2') as h2,
  count(*) filter (where role like 'box:%') as box, count(*) filter (where role = 'remove') as removed from bl group by doc_id""")
def role_counts(spark, sf):
    return L.role_counts(clean_blocks(spark, sf))


@query("role_review", RAW + "select doc_id, count(*) as n from bl where kind in ('heading', 'box', 'table', 'cover', 'toc') or role = 'remove' group by doc_id")
def role_review(spark, sf):
    return L.visible(clean_blocks(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n"))


# --- catalogue -----------------------------------------------------------------------------------

CAT = """cat as (select c_name as id, 'N ' || c_custkey as name, c_mktsegment as activity, case when c_custkey % 2 = 0 then 'ca' else 'es' end as language, 'd' as description,
  null::VARCHAR as updated_at, c_custkey as ord from customer),
inp as (select case when c_custkey % 3 = 0 then c_name else 'new_theme_' || (c_custkey % 500) end as id, case when c_custkey % 2 = 0 then 'X ' || c_custkey end as name,
  case when c_custkey % 5 = 0 then 'act' end as activity, null::VARCHAR as language, case when c_custkey % 7 = 0 then 'desc' || c_custkey end as description,
  case when c_custkey % 4 = 0 then '2024-01-01' end as updated_at, c_custkey as ord from customer)"""


def catalogue(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("id"), F.expr("'N ' || c_custkey").alias("name"), F.col("c_mktsegment").alias("activity"),
        F.expr("case when c_custkey % 2 = 0 then 'ca' else 'es' end").alias("language"), F.lit("d").alias("description"),
        F.lit(None).cast("string").alias("updated_at"), F.col("c_custkey").alias("ord"))


def inputs(spark, sf):
    e = F.expr
    return table(spark, sf, "customer").select(
        e("case when c_custkey % 3 = 0 then c_name else 'new_theme_' || (c_custkey % 500) end").alias("id"),
        e("case when c_custkey % 2 = 0 then 'X ' || c_custkey end").alias("name"), e("case when c_custkey % 5 = 0 then 'act' end").alias("activity"),
        F.lit(None).cast("string").alias("language"), e("case when c_custkey % 7 = 0 then 'desc' || c_custkey end").alias("description"),
        e("case when c_custkey % 4 = 0 then '2024-01-01' end").alias("updated_at"), F.col("c_custkey").alias("ord"))


UPS = f"""with {CAT}, li as (select id, min(ord) as in_ord, """ + ", ".join(f"arg_max({c}, ord) filter (where {c} is not null) as {c}" for c in G.FIELDS) + """ from inp group by id),
up as (select coalesce(c.id, l.id) as id, coalesce(l.name, c.name, replace(l.id, '_', ' ')) as name, coalesce(l.activity, c.activity, '') as activity,
  coalesce(l.language, c.language, 'es') as language, coalesce(l.description, c.description, '') as description, coalesce(l.updated_at, c.updated_at) as updated_at,
  case when c.id is null then 1 else 0 end as grp, coalesce(c.ord, l.in_ord) as ord from cat c full join li l on l.id = c.id)
"""


@query("catalogue_upsert", UPS + "select id, name, activity, language, description, updated_at, null as screenshot, grp, ord from up")
def catalogue_upsert(spark, sf):
    return G.upsert(catalogue(spark, sf), inputs(spark, sf))


@query("catalogue_json_out", UPS + """select grp, ord, '{"id":"' || id || '","name":"' || name || '","activity":"' || activity || '","language":"' || language || '","description":"' || description
  || '","screenshot":null' || (case when updated_at is not null then ',"updatedAt":"' || updated_at || '"' else '' end) || '}' as json from up""")
def catalogue_json_out(spark, sf):
    return G.json_rows(catalogue_upsert(spark, sf))


@query("catalogue_remove", "select c_name as id from customer where c_custkey % 3 <> 0")
def catalogue_remove(spark, sf):
    gone = table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_name").alias("id"))
    return G.remove(catalogue(spark, sf), gone).select("id")


@query("catalogue_order", """select c_name as id, c_custkey as ord, case when c_custkey % 4 = 0 then 100000 - c_custkey else 9007199254740991 end as sort_key from customer""")
def catalogue_order(spark, sf):
    saved = table(spark, sf, "customer").filter("c_custkey % 4 = 0").select(F.col("c_name").alias("id"), (F.lit(100000) - F.col("c_custkey")).alias("ord"))
    return G.order(catalogue(spark, sf), saved).select("id", "ord", "sort_key").orderBy("sort_key", "ord")


@query("catalogue_list", """select c_name as id, case when c_custkey % 10 = 0 then 'U' else 'N ' || c_custkey end as name, case when c_custkey % 10 = 0 then 1 else 0 end as src, c_custkey as ord
from customer where c_custkey <> 3""")
def catalogue_list(spark, sf):
    c = catalogue(spark, sf).withColumn("id", F.expr("case when ord = 3 then 'base' else id end"))
    user = c.filter("ord % 10 = 0").withColumn("name", F.lit("U"))
    return G.listing(c, user, selectable=True).select("id", "name", "src", "ord")


FAM = "'Curso ' || (s_suppkey % 30) || (case s_suppkey % 4 when 0 then ' (CASTELLANO)' when 1 then ' (valenciano)' when 2 then ' (INGLÉS)' else ' (X)' end)"


@query("theme_families", f"""with t as (select s_suppkey as ord, {FAM} as name, case s_suppkey % 4 when 0 then 'es' when 1 then 'CA' when 2 then 'en' end as language from supplier),
f as (select *, case when ord % 4 = 3 then name else 'Curso ' || (ord % 30) end as family from t)
select ord, family, lower(family) as key, (case lower(language) when 'es' then 0 when 'ca' then 1 when 'en' then 2 else 9 end) as rank, min(ord) over (partition by lower(family)) as family_ord from f""")
def theme_families(spark, sf):
    t = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ord"), F.expr(FAM).alias("name"),
                                            F.expr("case s_suppkey % 4 when 0 then 'es' when 1 then 'CA' when 2 then 'en' end").alias("language"))
    return G.families(t).select("ord", "family", "key", "rank", "family_ord")


@query("src_catalogue_json", """select n_nationkey as k, 0 as ord, lower(n_name) as id, n_name as name, 'es' as language from nation where n_nationkey % 5 <> 0
union all select n_nationkey, 1, 'b' || n_nationkey, 'B', null from nation where n_nationkey % 5 <> 0""")
def src_catalogue_json(spark, sf):
    text = F.expr("""case when n_nationkey % 5 = 0 then '<html>404</html>' else '{"themes": [{"id": "' || lower(n_name) || '", "name": "' || n_name || '", "language": "es"},
      {"id": "b' || n_nationkey || '", "name": "B", "screenshot": null}]}' end""")
    return G.parse_catalogue(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), text.alias("value"))).select("k", "ord", "id", "name", "language")


@query("theme_config_fields", """select s_suppkey as theme_id, case s_suppkey % 4 when 0 then 'es' when 1 then 'ca' when 2 then null end as language,
  case when s_suppkey % 5 <> 0 then s_name end as title, case when s_suppkey % 3 = 0 then (s_suppkey % 100)::INT end as version from supplier""")
def theme_config_fields(spark, sf):
    xml = F.expr("""'<theme>' || (case when s_suppkey % 3 = 0 then '<version> ' || (s_suppkey % 100) || ' </version>' else '' end) || '<title> ' || (case when s_suppkey % 5 <> 0 then s_name else '' end) || '</title>'
      || (case s_suppkey % 4 when 0 then '<language> ES </language>' when 1 then '<language>ca</language>' when 2 then '<language>fr</language>' else '' end) || '</theme>'""")
    return G.config_fields(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("theme_id"), xml.alias("xml")))


FILES = "case p_partkey % 4 when 0 then 'config.xml' when 1 then 'style.css' when 2 then 'deep/style.css' else 'a.png' end"


def _theme_files(spark, sf):
    return table(spark, sf, "part").select((F.col("p_partkey") % 700).alias("theme_id"), F.expr(FILES).alias("path"))


@query("theme_required_files", f"""with f as (select p_partkey % 700 as theme_id, {FILES} as path from part)
select t.theme_id, v.missing from (select distinct theme_id from f) t, (values ('config.xml'), ('style.css')) v(missing)
where not exists (select 1 from f where f.theme_id = t.theme_id and f.path = v.missing)""")
def theme_required_files(spark, sf):
    from ..operators import issues as S
    return S.theme_required_files(_theme_files(spark, sf))


@query("theme_required_files_nested", f"""with f as (select p_partkey % 700 as theme_id, {FILES} as path from part)
select t.theme_id, v.missing from (select distinct theme_id from f) t, (values ('config.xml'), ('style.css')) v(missing)
where not exists (select 1 from f where f.theme_id = t.theme_id and (f.path = v.missing or f.path like '%/' || v.missing))""")
def theme_required_files_nested(spark, sf):
    from ..operators import issues as S
    return S.theme_required_files(_theme_files(spark, sf), nested=True)


# --- manifests and checksums ----------------------------------------------------------------------

@query("manifest_diff", """select 'public/themes/' || source || '/d/' || doc_id as path, 'upsert' as action, md5(text) as sha from documents where doc_id % 10 <> 7
union all select 'public/themes/' || source || '/d/' || doc_id, 'delete', null from documents where doc_id % 10 = 7
union all select 'public/themes-config.json', 'upsert', 'cafe'""")
def manifest_diff(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("theme_id"), "doc_id", F.md5("text").alias("sha"))
    new = d.filter("doc_id % 10 <> 7").select("theme_id", F.expr("'/d/' || doc_id").alias("path"), "sha")
    old = d.filter("doc_id % 10 <> 3").select("theme_id", F.expr("'d/' || doc_id").alias("path"))
    return G.manifest_diff(new, old, "cafe")


def _archives(spark, sf):
    """An archive per document: its text, and parts of it some of which are absent."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("fixture"), "text")
    parts = F.filter(F.array(
        F.struct(F.lit("content.xml").alias("part"), F.encode("text", "UTF-8").alias("content")),
        F.when(F.col("fixture") % 3 != 0, F.struct(F.lit("ode.xml").alias("part"), F.encode(F.col("text"), "UTF-8").alias("content"))),
        F.when(F.col("fixture") % 4 != 0, F.struct(F.lit("META-INF/manifest.xml").alias("part"), F.encode(F.lit("m"), "UTF-8").alias("content")))),
        lambda x: x.isNotNull())
    return d.select("fixture", F.encode("text", "UTF-8").alias("content")), d.select("fixture", F.inline(parts))


SUMS = """sums as (select doc_id as fixture, 'archive' as part, sha256(text) as sha256 from documents
union all select doc_id, 'content.xml', sha256(text) from documents
union all select doc_id, 'ode.xml', case when doc_id % 3 <> 0 then sha256(text) else 'MISSING' end from documents
union all select doc_id, 'META-INF/manifest.xml', case when doc_id % 4 <> 0 then sha256('m') else 'MISSING' end from documents)"""


@query("checksum_extract", f"with {SUMS} select fixture, part, sha256 from sums")
def checksum_extract(spark, sf):
    return X.extract(*_archives(spark, sf))


BASE = f"""with {SUMS}, base as (select fixture, part, case when fixture % 5 = 0 then md5(sha256) else sha256 end as sha256 from sums where fixture % 10 <> 7),
gen as (select * from sums where fixture % 10 <> 3),
df as (select coalesce(g.fixture, b.fixture) as fixture, coalesce(g.part, b.part) as part, b.sha256 as expected, g.sha256 as "generated"
  from gen g full join base b on b.fixture = g.fixture and b.part = g.part where coalesce(g.part, b.part) in ('archive', 'content.xml', 'ode.xml') and g.sha256 is distinct from b.sha256),
vd as (select f.fixture, count(d.part) as n from (select distinct fixture from gen union select fixture from df) f left join df d on d.fixture = f.fixture group by f.fixture)
"""


def _sides(spark, sf):
    sums = checksum_extract(spark, sf)
    base = sums.filter("fixture % 10 <> 7").withColumn("sha256", F.when(F.col("fixture") % 5 == 0, F.md5("sha256")).otherwise(F.col("sha256")))
    return sums.filter("fixture % 10 <> 3"), base


@query("checksum_diff", BASE + 'select fixture, part, expected, "generated" from df')
def checksum_diff(spark, sf):
    return X.diff(*_sides(spark, sf)).select("fixture", "part", "expected", "generated")


@query("regression_verdicts", BASE + "select fixture, n = 0 as passed, n as n_differences from vd")
def regression_verdicts(spark, sf):
    gen, base = _sides(spark, sf)
    return X.verdicts(gen, X.diff(gen, base))


@query("regression_report", BASE + "select count(*) as total, count(*) filter (where n = 0) as passed, count(*) filter (where n > 0) as failed from vd")
def regression_report(spark, sf):
    return X.report(regression_verdicts(spark, sf))
